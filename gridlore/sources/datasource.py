"""Workbooks as a Spark data source: `spark.read.format("workbook").load(path)`, `df.write.format("workbook")`.

Read, each worksheet is a partition, whose task streams its cells that aren't empty; a file or sheet that can't be read is a
row with an error. Written, each task streams the workbooks of its rows into files of its own, which the commit moves into
place; rows are cells, or tell where pieces of sheets lie that other tasks have written (see workbooks.save_workbooks). Files are opened by the file systems of pyarrow: local ones, HDFS, S3, GCS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import PurePosixPath
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridlore.sources import biff, delimited, ooxml

CELLS = "workbook string, sheet string, row_idx long, col_idx int, kind string, value string"
READ = CELLS + ", error string"
#: Pieces of sheets, in order of block: their bytes lie in a file; size and crc are of what they were compressed from.
PIECES = "workbook string, sheet string, block long, file string, at long, length long, size long, crc long"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in READ.split(", ")]
#: Cells of a batch.
BATCH = 8192
#: Bytes of a piece that are copied at once, and files of pieces that are open at once.
STEP, OPEN = 1 << 20, 512


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def opened(path: str) -> BinaryIO:
    fs, own = _located(path)
    return fs.open_input_file(own)


def created(path: str) -> BinaryIO:
    fs, own = _located(path)
    return fs.open_output_stream(own)


def can_open(path: str) -> bool:
    """Whether Python's file systems reach the file."""
    try:
        with opened(path):
            return True
    except (OSError, pa.ArrowException):
        return False


def ending(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def sheet_names(path: str, f: BinaryIO) -> list[str]:
    return [delimited.CSV_SHEET] if ending(path) == ".csv" else [n for n, _ in biff.Book(f).sheets] if ending(path) == ".xls" else ooxml.sheet_names(f)


def sheet_cells(path: str, f: BinaryIO, sheet: int) -> Iterator[ooxml.Cell]:
    if ending(path) == ".csv":
        f.seek(0, 2)
        return delimited.range_cells(f, 0, f.tell(), delimited.RECORD, 0)
    return biff.Book(f).cells(sheet) if ending(path) == ".xls" else ooxml.sheet_cells(f, sheet)


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)

    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def sheet_batch(book: str, sheet: str, cells: list[ooxml.Cell]) -> pa.RecordBatch:
    """READ of a sheet's cells."""
    n = len(cells)
    known = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (book, sheet)]
    return pa.RecordBatch.from_arrays([*known, *(pa.array(c, t) for c, t in zip(zip(*cells), _TYPES[2:6])), pa.nulls(n, pa.string())], _NAMES)


def reported(path: str, sheet: str | None, cells: Callable[[], Iterator[ooxml.Cell]]) -> Iterator[tuple]:
    """Rows of READ: one that names the sheet, its cells, and the error that ends them, if any."""
    book = PurePosixPath(path).name
    if sheet is not None:
        yield book, sheet, None, None, None, None, None
    try:
        for cell in cells():
            yield book, sheet, *cell, None
    except Exception as e:  # noqa: BLE001  whatever a damaged file leads to
        yield book, sheet, None, None, None, None, f"{type(e).__name__}: {e}"[:1000]


@dataclass
class Sheet(InputPartition):
    path: str
    number: int
    name: str | None
    error: str | None = None


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Sheet]:
        """A file's list of sheets is read here, nothing more of it."""
        out = []
        for p in self.paths:
            try:
                with opened(p) as f:
                    out += [Sheet(p, i, n) for i, n in enumerate(sheet_names(p, f))]
            except Exception as e:  # noqa: BLE001
                out.append(Sheet(p, -1, None, f"{type(e).__name__}: {e}"[:1000]))
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[ooxml.Cell]:
            if partition.error:
                raise ValueError(partition.error)
            with opened(partition.path) as f:
                yield from sheet_cells(partition.path, f, partition.number)

        return batches(reported(partition.path, partition.name, cells))


@dataclass
class Files(WriterCommitMessage):
    folder: str
    names: list[str]


def working(path: str, job: str) -> str:
    """The folder of what a job hasn't finished."""
    return f"{path.rstrip('/')}/_writing-{job}"


def clear(path: str, job: str) -> None:
    fs, own = _located(working(path, job))
    if fs.get_file_info(own).type != pafs.FileType.NotFound:
        fs.delete_dir(own)


def pieces_written(cells: Iterator[pa.RecordBatch], folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """PIECES of cells (CELLS) that come by workbook, sheet, row and column, `rows` rows each, in a file of this attempt."""
    fs, own = _located(folder)
    file, out, at, now, piece, last = f"{folder}/{uuid.uuid4().hex}", None, 0, None, None, None
    names = [c.split()[0] for c in PIECES.split(", ")]

    def done() -> pa.RecordBatch:
        nonlocal out, at
        if out is None:
            fs.create_dir(own, recursive=True)
            out = fs.open_output_stream(_located(file)[1])
        piece.add(b"</row>")
        own_bytes, begin = piece.end(), at
        out.write(own_bytes)
        at += len(own_bytes)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, file, begin, len(own_bytes), piece.size, piece.crc)], names)

    try:
        for b in cells:
            if not b.num_rows:
                continue
            row = b.column("row_idx").to_numpy()
            books, sheets = (b.column(c).dictionary_encode() for c in ("workbook", "sheet"))
            key = lambda i, b=b, row=row: (b.column("workbook")[i].as_py(), b.column("sheet")[i].as_py(), int(row[i]) // rows)
            apart = lambda x: x[1:] != x[:-1]
            new = np.append(key(0) != now, apart(row // rows) | apart(books.indices.to_numpy()) | apart(sheets.indices.to_numpy()))  # cells that begin a piece
            opens = new | np.append(row[0] != last, apart(row))
            starts, text = ooxml.rows_bytes(b, pa.array(opens & ~new), pa.array(opens))
            cut = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(row)]
            for i, j in zip(cut, cut[1:]):
                if new[i]:
                    if piece is not None:
                        yield done()
                    piece, now = ooxml.Piece(), key(i)
                piece.add(text[starts[i] : starts[j]])
            last = row[-1]
        if piece is not None:
            yield done()
    finally:
        if out is not None:
            out.close()


class WorkbookWriter(DataSourceWriter):
    """Rows come by workbook, sheet, row and column, or are PIECES by workbook, sheet and block (see
    workbooks.save_workbooks). job: that of the pieces, if any."""

    def __init__(self, path: str, overwrite: bool, job: str | None = None):
        self.path, self.overwrite, self.pieces, self.job = path.rstrip("/"), overwrite, job is not None, job or uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Files:
        """Into a folder of this attempt, so attempts that fail or run twice don't meet."""
        folder = f"{working(self.path, self.job)}/{uuid.uuid4().hex}"
        fs, own = _located(folder)
        names = []
        held: dict[str, BinaryIO] = {}

        def copied(r) -> Iterator[bytes]:
            if r["file"] not in held:
                if len(held) == OPEN:
                    held.pop(next(iter(held))).close()
                held[r["file"]] = opened(r["file"])
            held[r["file"]].seek(r["at"])
            for done in range(0, r["length"], STEP):
                yield held[r["file"]].read(min(STEP, r["length"] - done))

        def piece(r) -> tuple:
            return r["size"], r["crc"], r["length"], lambda: copied(r)

        rows = ((r["workbook"], r["sheet"], piece(r) if self.pieces else (r["row_idx"], r["col_idx"], r["kind"], r["value"])) for r in iterator)
        for book, cells in groupby(rows, lambda r: r[0]):
            if not names:
                fs.create_dir(own, recursive=True)
            if book in names:
                raise ValueError(f"the rows of {book} aren't together; write them by save_workbooks")
            names.append(book)
            with fs.open_output_stream(f"{own}/{book}") as f:
                sheets = groupby(cells, lambda r: r[1])
                if self.pieces:
                    ooxml.join(f, ((s, [p for _, _, p in parts]) for s, parts in sheets))
                else:
                    ooxml.write(f, ((s, (c for _, _, c in own_cells)) for s, own_cells in sheets))
        for f in held.values():
            f.close()
        return Files(folder, names)

    def commit(self, messages: list[Files | None]) -> None:
        fs, own = _located(self.path)
        done = [m for m in messages if m is not None and m.names]
        if self.overwrite and fs.get_file_info(own).type == pafs.FileType.Directory:
            for old in fs.get_file_info(pafs.FileSelector(own)):
                if old.type == pafs.FileType.File and ending(old.path) == ".xlsx":
                    fs.delete_file(old.path)
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote one workbook; write them by save_workbooks")
        for m in done:
            for n in m.names:
                fs.move(f"{_located(m.folder)[1]}/{n}", f"{own}/{n}")
        clear(self.path, self.job)

    def abort(self, messages: list[Files | None]) -> None:
        clear(self.path, self.job)


class WorkbookSource(DataSource):
    """Options: path, or paths as a JSON list; to write PIECES, the job that they are of."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> WorkbookReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return WorkbookReader(paths)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], overwrite, self.options.get("job"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
