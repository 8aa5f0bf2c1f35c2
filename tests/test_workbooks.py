"""Workbook sources and sinks: far cells, damaged files, cut CSV files, the binary format against its twin, written files."""

import csv
import datetime
import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridlore.sources import biff, datasource, delimited, ooxml, workbooks

WHEN = datetime.datetime(2024, 3, 5, 12, 30)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_far_cell_is_one_row(spark, tmp_path):
    with open(tmp_path / "far.xlsx", "wb") as f:
        ooxml.write(f, [("S", [(0, 0, "str", "a"), (1_048_575, 16_383, "int", "7")]), ("Nothing", []), ("a & <b>", [(0, 1, "bool", "True"), (0, 2, "str", " x\ny ")])])
    cells, sheets = workbooks.load_workbooks(spark, str(tmp_path / "far.xlsx"), sparse=True)
    assert rows_of(cells.select("sheet", "row_idx", "col_idx", "kind", "value")) == [("S", 0, 0, "str", "a"), ("S", 1_048_575, 16_383, "int", "7"), ("a & <b>", 0, 1, "bool", "True"), ("a & <b>", 0, 2, "str", " x\ny ")]
    assert rows_of(sheets.select("sheet", "rows", "columns", "is_empty")) == [("Nothing", 0, 0, True), ("S", 1_048_576, 16_384, False), ("a & <b>", 1, 3, False)]
    assert datasource.WorkbookReader([str(tmp_path / "far.xlsx")]).partitions()[2].name == "a & <b>"


def test_damaged_files_are_rows(spark, tmp_path):
    good, bad, cut = tmp_path / "good.xlsx", tmp_path / "bad.xlsx", tmp_path / "cut.csv"
    workbooks.create_sample(str(good))
    bad.write_bytes(b"PK no zip")
    cut.write_bytes(b"a,b\n1,2\n\xff\xfe,3\n")
    read = workbooks.read_cells(spark, str(good), str(bad), str(cut))
    assert {(r["workbook"], r["sheet"]) for r in workbooks.failures(read).collect()} == {("bad.xlsx", None), ("cut.csv", "CSV_Data")}
    assert read.where("workbook = 'good.xlsx' AND sheet = 'Property Data' AND row_idx IS NOT NULL").count() == 30
    with pytest.raises(Exception, match="bad.xlsx"):
        workbooks.load_workbooks(spark, str(bad))[0].collect()


def made_csv(rnd, n):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]))
    for i in range(n):
        w.writerow([rnd.choice([i, "", "x\ny, z", 'say "hi"', '5" pipe', "é" * 9, "NA", 1.5, "TRUE"]) for _ in range(rnd.randint(1, 5))])
        if rnd.random() < 0.1:
            out.write("\n")
    return out.getvalue()


def test_csv_ranges(spark, tmp_path):
    rnd = random.Random(4)
    paths = []
    for i in range(3):
        paths.append(tmp_path / f"f{i}.csv")
        paths[-1].write_bytes(b"\xef\xbb\xbf" * (i == 1) + made_csv(rnd, 60).encode())
    (tmp_path / "none.csv").write_bytes(b"")
    paths.append(tmp_path / "none.csv")
    whole = workbooks.read_cells(spark, *map(str, paths))
    cut = workbooks.read_cells(spark, *map(str, paths), range_bytes=70)
    assert rows_of(whole.distinct()) == rows_of(cut.distinct()) and whole.where("kind IS NOT NULL").count() == cut.where("kind IS NOT NULL").count()
    plain = [r for r in csv.reader(io.StringIO(paths[0].read_text(), newline="")) if r]
    dense, sheets = workbooks.load_workbooks(spark, str(paths[0]), range_bytes=70)
    width = max(map(len, plain))
    assert [tuple(r) for r in sheets.select("rows", "columns").collect()] == [(len(plain), width)]
    want = [(i, j, *(("null", None) if j >= len(r) or delimited.kind_of(r[j]) == "null" else (delimited.kind_of(r[j]), r[j]))) for i, r in enumerate(plain) for j in range(width)]
    assert rows_of(dense.select("row_idx", "col_idx", "kind", "value")) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_scan_meets_the_csv_reader(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        s = "".join(rnd.choice(["a", "1", ",", '"', "\n", "\r\n", "é", " ", '""', '"x,\ny"']) for _ in range(rnd.randint(0, 40)))
        b, step = s.encode(), rnd.randint(1, 12)
        cut = [(i, min(len(b), i + step)) for i in range(0, len(b), step)]
        f, got = io.BytesIO(b), []
        for (lo, hi), (state, before) in zip(cut, delimited.entered([delimited.effects(f, lo, hi) for lo, hi in cut])):
            got += delimited.range_cells(f, lo, hi, state, before)
        want = [(i, j, k, None if k == "null" else t) for i, r in enumerate(r for r in csv.reader(io.StringIO(s, newline="")) if r) for j, t in enumerate(r) for k in [delimited.kind_of(t)] if k != "null" or j == len(r) - 1]
        assert got == want, s


def xls_bytes(sheets, strings, short=False):
    """A binary workbook of records, in a compound file of 512-byte sectors. sheets: name -> list of records."""
    rec = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    bof = lambda kind: rec(biff.BOF, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    fmt = "yyyy\\-mm\\-dd hh:mm"
    head = bof(5) + rec(biff.FORMAT, struct.pack("<HHB", 164, len(fmt), 0) + fmt.encode())
    head += b"".join(rec(biff.XF, struct.pack("<HH", 0, i) + bytes(16)) for i in (0, 164, 14))
    # the strings' record is cut in the middle of a text
    flat = [struct.pack("<HB", len(t), 0) + t.encode("latin-1") if t.isascii() else struct.pack("<HB", len(t.encode("utf-16-le")) // 2, 1) + t.encode("utf-16-le") for t in strings]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(flat)
    cut = 8 + sum(map(len, flat[:-1])) + 3 + 2 * (len(strings[-1]) // 2) * (2 - strings[-1].isascii()) // 2
    wide = bytes([not strings[-1].isascii()])
    sst = rec(biff.SST, sst[:cut]) + rec(biff.CONTINUE, wide + sst[cut:])
    names = [struct.pack("<BB", len(n), 0) + n.encode() for n in sheets]
    bounds = sum(4 + 6 + len(n) for n in names)
    at, bodies, listed = len(head) + bounds + len(sst) + 4, b"", b""
    for n, own in zip(names, sheets.values()):
        body = bof(0x10) + b"".join(rec(k, d) for k, d in own) + rec(biff.EOF, b"")
        listed += rec(biff.BOUNDSHEET, struct.pack("<IBB", at + len(bodies), 0, 0) + n)
        bodies += body
    stream = head + listed + sst + rec(biff.EOF, b"") + bodies
    size = len(stream) if short else max(len(stream), 4096)
    stream = stream.ljust(size, b"\0")
    entry = lambda name, kind, start, n: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<III", start, n, 0)
    pad = lambda b: b.ljust(-(-len(b) // 512) * 512, b"\0")
    body, chain = pad(stream), -(-len(stream) // 512)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    follow = lambda start, n: [*range(start + 1, start + n), end]
    mini = -(-len(stream) // 64)
    fat = [0xFFFFFFFD, end] + ([end] if short else []) + follow(3 if short else 2, chain)
    sectors = struct.pack("<128I", *(fat + [free] * (128 - len(fat)))) + pad(entry("Root Entry", 5, 3 if short else end, 64 * mini if short else 0) + entry("Workbook", 2, 0 if short else 2, len(stream)))
    if short:
        sectors += struct.pack("<128I", *(follow(0, mini) + [free] * (128 - mini)))
    header = biff.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 2 if short else end, 1 if short else 0, end, 0)
    return header + struct.pack("<109I", 0, *[free] * 108) + sectors + body


@pytest.mark.parametrize("short", [False, True])
def test_binary_workbook_is_its_twin(spark, tmp_path, short):
    day = (WHEN - ooxml.DAY_0[False]).total_seconds() / 86400
    at = lambda r, c, style=0: struct.pack("<HHH", r, c, style)
    texts = ["Location", "Größe €", "long " * 20 + "日本語テキスト"]
    data = [
        (biff.LABELSST, at(0, 0) + struct.pack("<I", 0)), (biff.LABELSST, at(0, 1) + struct.pack("<I", 1)), (biff.LABELSST, at(0, 2) + struct.pack("<I", 2)), (biff.LABEL, at(0, 3) + struct.pack("<HB", 3, 0) + b"old"),
        (biff.NUMBER, at(1, 0) + struct.pack("<d", 1.25)), (biff.NUMBER, at(1, 1, 1) + struct.pack("<d", day)), (biff.RK, at(1, 2) + struct.pack("<i", (-12345 << 2) | 3)), (biff.BOOLERR, at(1, 3) + bytes([1, 0])),
        (biff.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, (1998 << 2) | 2) + struct.pack("<HI", 0, struct.unpack("<II", struct.pack("<d", 450000.0))[1]) + struct.pack("<H", 1)), (0x201, at(2, 2)), (biff.BOOLERR, at(2, 3) + bytes([0x2A, 1])),
        (biff.FORMULA, at(3, 0) + struct.pack("<d", 2.5) + bytes(8)), (biff.FORMULA, at(3, 1) + bytes([0, 0, 0, 0, 0, 0, 255, 255]) + bytes(8)), (biff.STRING, struct.pack("<HB", 4, 0) + b"made"), (biff.FORMULA, at(3, 2) + bytes([1, 0, 0, 0, 0, 0, 255, 255]) + bytes(8)), (biff.NUMBER, at(65535, 255) + struct.pack("<d", 7.0)),
    ]
    twin = [(0, 0, "str", texts[0]), (0, 1, "str", texts[1]), (0, 2, "str", texts[2]), (0, 3, "str", "old"), (1, 0, "float", "1.25"), (1, 1, "ts", WHEN.isoformat(" ")), (1, 2, "float", "-123.45"), (1, 3, "bool", "True"), (2, 0, "int", "1998"), (2, 1, "int", "450000"), (2, 3, "str", "#N/A"), (3, 0, "float", "2.5"), (3, 1, "str", "made"), (3, 2, "bool", "False"), (65535, 255, "int", "7")]
    (tmp_path / "b.xls").write_bytes(xls_bytes({"Property Data": data, "Empty": []}, texts, short))
    with open(tmp_path / "b.xlsx", "wb") as f:
        ooxml.write(f, [("Property Data", twin), ("Empty", [])])
    (cells, sheets), (cells_2, sheets_2) = (workbooks.load_workbooks(spark, str(tmp_path / n), sparse=True) for n in ("b.xls", "b.xlsx"))
    assert rows_of(cells.drop("workbook")) == rows_of(cells_2.drop("workbook")) == sorted((("Property Data", *c) for c in twin), key=repr)
    assert rows_of(sheets.drop("workbook")) == rows_of(sheets_2.drop("workbook"))


def test_binary_workbook_that_is_none(spark, tmp_path):
    (tmp_path / "x.xls").write_bytes(b"\xd0\xcf" + bytes(900))
    (tmp_path / "y.xls").write_bytes(biff.SIGNATURE + bytes(2000))
    assert workbooks.failures(workbooks.read_cells(spark, str(tmp_path / "x.xls"), str(tmp_path / "y.xls"))).count() == 2


def test_written_by_tasks(spark, tmp_path):
    rnd = random.Random(8)
    kinds = {"int": lambda: str(rnd.randint(-5, 5)), "float": lambda: "1.5", "str": lambda: rnd.choice(["a<b>&", " é ", "x\ny"]), "bool": lambda: "True", "ts": lambda: WHEN.isoformat(" ")}
    rows = [(f"w{b}.xlsx", f"s{s}", i, j, k, kinds[k]()) for b in range(4) for s in range(2) for i in range(30) for j in range(5) for k in [rnd.choice(list(kinds))] if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, workbooks.CELLS).repartition(5)
    path = str(tmp_path / "out")
    workbooks.save_workbooks(df, path)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == [f"w{b}.xlsx" for b in range(4)]
    back, _ = workbooks.load_workbooks(spark, *[f"file://{path}/{n}" for n in files], sparse=True)
    assert rows_of(back) == sorted(rows, key=repr)
    workbooks.save_workbooks(df.where("workbook = 'w1.xlsx'").withColumn("value", F.when(F.col("kind") == "int", F.lit("9")).otherwise(F.col("value"))), path, "overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["w1.xlsx"]
    with pytest.raises(Exception, match="isoformat"):  # a failing task leaves nothing behind
        workbooks.save_workbooks(df.withColumn("value", F.when(F.col("kind") == "ts", F.lit("no date")).otherwise(F.col("value"))), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["w1.xlsx"]


def test_sheets_are_cut_between_rows(spark, tmp_path):
    inner = '<x:row r="3"><x:c r="B3" t="s"><x:v>1</x:v></x:c><x:c><x:v>2.50</x:v></x:c></x:row><!-- <x:row r="9"> --><x:row><x:c t="inlineStr"><x:is><x:r><x:t>a</x:t></x:r><x:r><x:t> &lt;row r="7"&gt;</x:t></x:r></x:is></x:c></x:row><x:row r=\'6\' spans="1:2"/>' + "".join(f'<x:row><x:c r="A{i}"><x:v>{i}</x:v></x:c></x:row>' for i in range(7, 60))
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{ooxml._MAIN}" xmlns:r="{ooxml._REL}"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="N" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="worksheets/n.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>no</t></si><si><t>yes</t></si></sst>",
        "xl/worksheets/s.xml": f'<?xml version="1.0" encoding="UTF-8"?>\n<x:worksheet xmlns:x="{ooxml._MAIN}"><x:cols/><x:sheetData>{inner}</x:sheetData><x:mergeCells/></x:worksheet>',
        "xl/worksheets/n.xml": f'<worksheet xmlns="{ooxml._MAIN}"><sheetData/></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    want = [(2, 1, "str", "yes"), (2, 2, "float", "2.50"), (3, 0, "str", 'a <row r="7">'), *((i - 1, 0, "int", str(i)) for i in range(7, 60))]
    with open(tmp_path / "w.xlsx", "rb") as f:
        assert list(ooxml.sheet_cells(f, 0)) == want and not list(ooxml.cuts(f, 1))
        for size in (1, 90, 1 << 20):
            parts = list(ooxml.cuts(f, 0, size))
            assert [c for xml, before in parts for c in ooxml.cut_cells(xml, before, *ooxml.meaning(f))] == want
    cells, sheets = workbooks.load_workbooks(spark, str(tmp_path / "w.xlsx"))
    assert rows_of(cells.where("kind <> 'null'").select("row_idx", "col_idx", "kind", "value")) == sorted(want, key=repr)
    assert rows_of(sheets.select("sheet", "rows", "columns")) == [("N", 0, 0), ("S", 59, 3)] and cells.count() == 59 * 3
    assert "BroadcastHashJoin" not in cells._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "t.xlsx").write_bytes((tmp_path / "w.xlsx").read_bytes())
    with zipfile.ZipFile(tmp_path / "u.xlsx", "w") as z:
        for name, text in files.items():
            z.writestr(name, text.replace("</x:row><!--", "</x:wrong><!--") if name.endswith("s.xml") else text)
    read = workbooks.read_cells(spark, str(tmp_path / "u.xlsx"))
    assert [(r["sheet"], "mismatched" in r["error"]) for r in workbooks.failures(read).collect()] == [("S", True)]
    assert read.where("value IN ('yes', '2.50')").count() == 2  # what stands before the fault


def test_a_sheet_is_written_and_parsed_by_many_tasks(spark, tmp_path):
    rows = [("w.xlsx", "s", i, j, k, v) for i in range(9000) for j, (k, v) in enumerate([("int", str(i)), ("ts", WHEN.isoformat(" ")), ("str", f"a<b>& é{i}"), ("bool", str(i % 2 == 0)), ("float", f"{i}.5")]) if (i + j) % 7]
    df = spark.createDataFrame(rows, workbooks.CELLS).repartition(3)
    workbooks.save_workbooks(df, str(tmp_path / "o"))
    with zipfile.ZipFile(tmp_path / "o" / "w.xlsx") as z:
        assert z.testzip() is None
    back, _ = workbooks.load_workbooks(spark, str(tmp_path / "o" / "w.xlsx"), sparse=True)
    assert rows_of(back) == sorted(rows, key=repr)
    assert back.select(F.spark_partition_id()).distinct().count() > 2
    a, b = bytes(range(200)), b"x" * 70_001
    assert ooxml.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_joined_parts_are_one_csv_file(spark, tmp_path):
    df = spark.range(3000).select(F.col("id"), F.concat(F.lit('a, "b"\n'), "id").alias("t")).repartition(3).orderBy("id")
    df.write.option("escape", '"').csv(str(tmp_path / "parts"))
    files = sorted(str(p) for p in (tmp_path / "parts").glob("*.csv"))
    path = workbooks.joined(spark, files, str(tmp_path / "whole.csv"))
    assert (tmp_path / "whole.csv").read_bytes() == b"".join(open(f, "rb").read() for f in files)
    cells, sheets = workbooks.load_workbooks(spark, path, range_bytes=1000)
    assert "BroadcastHashJoin" not in cells._jdf.queryExecution().executedPlan().toString()  # of cells, however few ranges they come from
    assert cells.where("col_idx = 0 AND value = string(row_idx)").count() == 3000 and cells.where("col_idx = 1 AND value = concat('a, \"b\"\n', row_idx)").count() == 3000
