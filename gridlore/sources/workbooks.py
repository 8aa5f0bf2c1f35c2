"""Workbooks as cells: CSV, XLSX and XLS without a header assumed, and workbooks written from cells.

Cells are (workbook, sheet, row_idx, col_idx, kind, value): kind is null, bool, int, float, ts (a date, as text with its
time) or str. Worksheets are cut between their rows and byte ranges of CSV files read by tasks of their own; the full grid
with its empty cells is made of the sheets' sizes by Spark. Workbooks are written in pieces of some rows, which are put
behind each other at last.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from datetime import datetime
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.sources import delimited, ooxml
from gridlore.sources.datasource import CELLS, PIECES, READ, Sheet, WorkbookReader, batches, can_open, clear, created, ending, opened, pieces_written, register, reported, sheet_batch, sheet_cells, sheet_names, working
from gridlore.sources.tables import scratch, written

__all__ = ["CELLS", "SAMPLE", "FileValidationError", "create_sample", "failures", "filled", "load_workbooks", "read_cells", "save_workbooks", "scratch", "setting", "show_summary", "validate_file", "xlsx_bytes"]

SUPPORTED = (".xlsx", ".xls", ".csv")
#: Bytes of a range of a CSV file.
RANGE_BYTES = 64 << 20
#: Rows of a sheet that are written as one piece, and of a grid that a task makes at once.
PIECE_ROWS, GRID_ROWS = 2048, 1 << 16


class FileValidationError(ValueError):
    """A file that can't be loaded, and why."""


def validate_file(spark: SparkSession, path: str) -> str:
    """SRC1: the path is there, is a file, and has a supported ending; asked of the file system that Spark reads."""
    return _checked(spark, path)[0]


def _checked(spark: SparkSession, path: str) -> tuple[str, int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileValidationError(f"nothing is at {path}")
    if not fs.getFileStatus(p).isFile():
        raise FileValidationError(f"{path} is a folder")
    if ending(path) not in SUPPORTED:
        raise FileValidationError(f"can't read {path}: its name must end in one of {', '.join(SUPPORTED)}")
    return path, int(fs.getFileStatus(p).getLen())


def _by_content(spark: SparkSession, paths: list[str]) -> DataFrame:
    """READ of files that only Spark's file systems reach, each as one value."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    names = sheet_names(path, io.BytesIO(content))
                except Exception as e:  # noqa: BLE001  whatever a damaged file leads to
                    yield from batches(reported(path, None, lambda e=e: (_ for _ in ()).throw(e)))
                    continue
                for i, name in enumerate(names):
                    yield from batches(reported(path, name, lambda i=i: sheet_cells(path, io.BytesIO(content), i)))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(read, READ)


def _by_range(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> DataFrame:
    """READ of CSV files cut into ranges: the ranges' effects, by tasks; in order, their states; then their cells."""
    cut = spark.createDataFrame([(p, i, a, min(n, a + range_bytes)) for p, n in files for i, a in enumerate(range(0, max(n, 1), range_bytes))], "path string, part long, low long, high long")
    n = min(cut.count(), _parts(spark))  # a task takes several ranges, one after the other

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                with opened(r["path"]) as f:
                    yield pa.RecordBatch.from_pylist([{**r, "effects": json.dumps(delimited.effects(f, r["low"], r["high"]))}])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():

                def cells(r=r) -> Iterator[ooxml.Cell]:
                    with opened(r["path"]) as f:
                        yield from delimited.range_cells(f, r["low"], r["high"], r["state"], r["before"])

                yield from batches(reported(r["path"], delimited.CSV_SHEET, cells))

    seen = cut.repartition(n, "path", "part").mapInArrow(look, "path string, part long, low long, high long, effects string")

    def state(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a file's ranges follow each other in a task
        path, now, before = None, delimited.RECORD, 0
        for b in parts:
            out = []
            for r in b.to_pylist():
                if r["path"] != path:
                    path, now, before = r["path"], delimited.RECORD, 0
                out.append({**{c: r[c] for c in ("path", "part", "low", "high")}, "state": now, "before": before})
                now, more = json.loads(r["effects"])[now]
                before += more
            yield pa.RecordBatch.from_pylist(out)

    entered = seen.repartition("path").sortWithinPartitions("path", "part").mapInArrow(state, "path string, part long, low long, high long, state long, before long")
    return written(entered, "csv-ranges").repartition(n, "path", "part").mapInArrow(read, READ)


def _parts(spark: SparkSession) -> int:
    """Partitions of steps whose work Spark can't tell from their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def _by_rows(spark: SparkSession, sheets: list[Sheet]) -> DataFrame:
    """READ of worksheets: a task a sheet unpacks it and cuts it between rows; what it cuts off is parsed by all tasks."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"number": pa.int64(), "deal": pa.int64(), "before": pa.int64(), "xml": pa.binary(), "error": pa.string()}
        batch = lambda number, deal, before=None, xml=None, error=None: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, deal, before, xml, error), kinds.values())], list(kinds))
        for b in parts:
            for i in b.column("id").to_pylist():
                s, n = sheets[i], 0
                try:
                    if s.error:
                        raise ValueError(s.error)
                    with opened(s.path) as f:
                        # who parses a part reads the workbook's shared strings: the more of them, the more parts go together
                        together = 1 + ooxml.shared_bytes(f) // ooxml.CUT
                        for xml, before in ooxml.cuts(f, s.number):
                            yield batch(i, n // together, before, xml)
                            n += 1
                except Exception as e:  # noqa: BLE001  whatever a damaged file leads to
                    yield batch(i, -1, error=f"{type(e).__name__}: {e}"[:1000])
                    n += 1
                yield batch(i, 0, n)  # names the sheet; parses it, if there are no parts

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, known = None, None
        for b in parts:
            for i, before, xml, error in zip(*(b.column(c).to_pylist() for c in ("number", "before", "xml", "error"))):
                s = sheets[i]
                book, cells = PurePosixPath(s.path).name, []
                if error is None and xml is None:
                    with opened(s.path) as f:
                        yield from batches(reported(s.path, s.name, lambda s=s, f=f, before=before: sheet_cells(s.path, f, s.number) if before == 0 else iter(())))
                    continue
                try:
                    if error is None:
                        if path != s.path:
                            with opened(s.path) as f:
                                path, known = s.path, ooxml.meaning(f)
                        cells.extend(ooxml.cut_cells(xml, before, *known))
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:1000]
                if cells:
                    yield sheet_batch(book, s.name, cells)
                if error is not None:
                    yield from batches(iter([(book, s.name, None, None, None, None, error)]))

    # a task a sheet; of an RDD's size Spark guesses nothing, so it doesn't take cells for few
    ids = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(len(sheets))], len(sheets)), "id long")
    found = ids.mapInArrow(cut, "number long, deal long, before long, xml binary, error string")
    return found.repartition(_parts(spark), "number", "deal").mapInArrow(parse, READ)


def read_cells(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC2, SRC3: READ of the files. Only cells that aren't empty have rows; each sheet has a row without a cell; what can't
    be read has a row with an error, and what was read before it stays."""
    found = [_checked(spark, p) for p in paths]
    register(spark)
    near = [x for x in found if can_open(x[0])]
    long = [x for x in near if ending(x[0]) == ".csv" and x[1] > range_bytes]
    far = [p for p, n in found if (p, n) not in near]
    sheets = WorkbookReader([p for p, _ in near if ending(p) == ".xlsx"]).partitions()
    whole = [p for p, n in near if (p, n) not in long and ending(p) != ".xlsx"]
    parts = [_by_rows(spark, sheets)] if sheets else []
    parts += [spark.read.format("workbook").option("paths", json.dumps(whole)).load()] if whole else []
    parts += [_by_range(spark, long, range_bytes)] if long else []
    parts += [_by_content(spark, far)] if far else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failures(read: DataFrame) -> DataFrame:
    """workbook, sheet (null: the file) and error of what couldn't be read."""
    return read.where("error IS NOT NULL").select("workbook", "sheet", "error")


def sizes(read: DataFrame) -> DataFrame:
    """workbook, sheet, rows, columns, is_empty of every sheet: its used range from the first cell on."""
    out = read.groupBy("workbook", "sheet").agg(F.coalesce(F.max("row_idx") + 1, F.lit(0)).alias("rows"), F.coalesce(F.max("col_idx") + 1, F.lit(0)).alias("columns"))
    return out.withColumn("is_empty", (F.col("rows") == 0) | (F.col("columns") == 0))


def filled(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The sheets' full grids: the cells, and empty ones (kind null) elsewhere."""
    grid = sheets.where("rows > 0 AND columns > 0").select("workbook", "sheet", "rows", "columns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(GRID_ROWS).cast("long"))).alias("low"))
    grid = grid.repartition(_parts(sheets.sparkSession), "workbook", "sheet", "low")  # a large sheet's rows aren't one task's
    grid = grid.select("workbook", "sheet", "columns", F.explode(F.sequence("low", F.least(F.col("rows"), F.col("low") + GRID_ROWS) - 1)).alias("row_idx"))
    grid = grid.select("workbook", "sheet", "row_idx", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("col_idx"))
    out = grid.join(cells.hint("merge"), ["workbook", "sheet", "row_idx", "col_idx"], "left")  # never broadcast, however few they seem
    return out.select("workbook", "sheet", "row_idx", "col_idx", F.coalesce("kind", F.lit("null")).alias("kind"), "value")


def load_workbooks(spark: SparkSession, *paths: str, sparse: bool = False, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """SRC4: (cells, sheets) of the files; sheets has name, rows, columns and is_empty. Sparse cells leave out empty ones.
    What can't be read raises when it is met; read_cells() and failures() give it as rows instead."""
    raw = read_cells(spark, *paths, range_bytes=range_bytes)
    fine = lambda test: F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "workbook", "sheet", "error")).cast("boolean")).otherwise(test)  # noqa: E731  one test, so that none goes before the error's
    sheets = sizes(raw.where(fine(F.col("sheet").isNotNull())))
    cells = raw.where(fine(F.col("row_idx").isNotNull() & (F.col("kind") != "null"))).select("workbook", "sheet", "row_idx", "col_idx", "kind", "value")
    return (cells if sparse else filled(cells, sheets)), sheets


def save_workbooks(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Cells (workbook, sheet, row_idx, col_idx, kind, value) as .xlsx files in a folder, one a workbook, written by tasks;
    workbook is the file's name. Pieces of PIECE_ROWS rows are made and compressed by all tasks; one task a workbook copies
    them into its file, as one stream is all that a file takes."""
    spark, job = cells.sparkSession, uuid.uuid4().hex
    register(spark)
    rows = cells.where("value IS NOT NULL AND kind <> 'null'").select("workbook", "sheet", F.col("row_idx").cast("long").alias("row_idx"), "col_idx", "kind", "value")
    dealt = rows.repartition(_parts(spark), "workbook", "sheet", F.floor(F.col("row_idx") / PIECE_ROWS)).sortWithinPartitions("workbook", "sheet", "row_idx", "col_idx")
    folder = working(path, job)
    pieces = dealt.mapInArrow(lambda b: pieces_written(b, folder, PIECE_ROWS), PIECES)
    try:
        pieces.repartition("workbook").sortWithinPartitions("workbook", "sheet", "block").write.format("workbook").option("job", job).mode(mode).save(path)
    except Exception:
        clear(path, job)  # pieces are written before the sink knows of them
        raise


def joined(spark: SparkSession, files: list[str], path: str) -> str:
    """One file of the files' bytes in that order, copied by a task as a stream."""

    def copy(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            with created(path) as out:
                for name in files:
                    with opened(name) as f:
                        while more := f.read(1 << 20):
                            out.write(more)
            yield b

    spark.range(0, 1, 1, 1).mapInArrow(copy, "id long").collect()
    return path


def show_summary(sheets: DataFrame) -> None:
    """SRC6."""
    sheets.orderBy("workbook", "sheet").show(truncate=False)


def setting(spark: SparkSession, name: str) -> str:
    """SRC7: gridlore.<name> of the session, or its default."""
    return spark.conf.get(f"spark.gridlore.{name}", {"app_name": "gridlore", "environment": "development", "max_sample_values": "5"}[name])


#: SRC5: the sample workbook's sheets.
SAMPLE = {
    "Summary": [["Property Insurance Summary"], ["Prepared for testing"], ["Do not use as exposure data"]],
    "Property Data": [
        ["Location ID", "Bldg Repl Cost New", "Construction Yr", "No. Floors", "Sprk", "Zip"],
        ["LOC001", 450000, 1998, 2, "Y", "82601"], ["LOC002", 720000, 2005, 3, "N", "80202"],
        ["LOC003", 1200000, 2010, 5, "Y", "94105"], ["LOC004", 300000, 1985, 1, "Y", "81301"],
    ],
    "Notes": [["General notes"], ["Values are illustrative"], ["Reviewed by the underwriting team"]],
}


def _cell(v) -> tuple[str, str]:
    if isinstance(v, datetime):
        return "ts", v.isoformat(" ")
    return ("bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str"), str(v)


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """SRC5: a small workbook from rows of values, without header or index of its own."""
    out = io.BytesIO()
    ooxml.write(out, ((name, ((i, j, *_cell(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None)) for name, rows in sheets.items()))
    return out.getvalue()


def create_sample(path: str) -> str:
    with open(path, "wb") as f:
        f.write(xlsx_bytes(SAMPLE))
    return path
