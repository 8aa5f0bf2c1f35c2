"""XLSX worksheets as streams of cells that aren't empty, and workbooks written from such streams.

Cells are (row, column, kind, value). A worksheet is parsed event by event and forgotten row by row, so only the shared
strings of a workbook are held; a far cell costs one cell. A worksheet can also be cut between its rows into documents that
are parsed apart, and a workbook put together from pieces of sheets that were compressed apart.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache, reduce
from typing import BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Number formats of dates and times that workbooks don't spell out, and day 0.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DAY_0 = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}

Cell = tuple[int, int, str, str]


def shows_date(code: str) -> bool:
    """Whether a number format shows a date or a time: it has their letters outside literals, colours and spacing."""
    code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.', "", code).lower()
    return bool(re.search("[dmyhs]", code)) and "general" not in code


@lru_cache(1 << 14)
def _moment(x: float, day_0: datetime) -> str | None:
    try:
        return (day_0 + timedelta(seconds=round(x * 86400))).isoformat(" ")
    except OverflowError:  # no day of the calendar
        return None


def number(x: float, text: str, is_date: bool, day_0: datetime) -> tuple[str, str]:
    """Kind and text of a number."""
    moment = _moment(x, day_0) if is_date else None
    if moment is not None:
        return "ts", moment
    return ("int", str(int(x))) if x.is_integer() else ("float", text)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _column(ref: str) -> int:
    return _place(ref.rstrip("0123456789"))


@lru_cache(1 << 14)
def _place(letters: str) -> int:
    n = 0
    for ch in letters:
        if ch.isalpha():
            n = 26 * n + ord(ch.upper()) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root, own, out = ElementTree.fromstring(z.read("xl/styles.xml")), set(DATE_FORMATS), set()
    for f in (e for e in root.iter() if _tag(e) == "numFmt"):
        (own.add if shows_date(f.get("formatCode", "")) else own.discard)(int(f.get("numFmtId")))
    for xfs in (e for e in root if _tag(e) == "cellXfs"):
        out = {i for i, xf in enumerate(e for e in xfs if _tag(e) == "xf") if int(xf.get("numFmtId", 0)) in own}
    return out


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" not in z.namelist():
        return out
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                e.clear()
    return out


def _links(z: zipfile.ZipFile) -> tuple[ElementTree.Element, list[tuple[str, str]]]:
    """The workbook's element, and name and file of its worksheets, in order."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in (e for e in book.iter() if _tag(e) == "sheet"):
        target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return book, out


def sheet_names(f: BinaryIO) -> list[str]:
    with zipfile.ZipFile(f) as z:
        return [name for name, _ in _links(z)[1]]


def _meaning(z: zipfile.ZipFile, book: ElementTree.Element) -> tuple[set[int], list[str], datetime]:
    """What a cell's text is read with: the styles of dates, the shared strings and day 0."""
    return _date_styles(z), _shared_strings(z), DAY_0[any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())]


def meaning(f: BinaryIO) -> tuple[set[int], list[str], datetime]:
    with zipfile.ZipFile(f) as z:
        return _meaning(z, _links(z)[0])


def _cell(row: int, col: int, e: ElementTree.Element, text: str, dates: set[int], shared: list[str], day_0: datetime) -> Cell | None:
    kind = e.get("t", "n")
    if text == "":
        return None
    if kind == "s":
        text = shared[int(text)]
    if kind == "b":
        return row, col, "bool", "True" if text == "1" else "False"
    if kind == "n":
        return row, col, *number(float(text), text, int(e.get("s", 0)) in dates, day_0)
    return (row, col, "str", text) if text else None


def _text(e: ElementTree.Element) -> str:
    if len(e) == 1 and len(e[0]) == 1 and _tag(e[0]) == "is" and _tag(e[0][0]) == "t":
        return e[0][0].text or ""
    return "".join(x.text or "" for x in e.iter() if _tag(x) in ("v", "t"))


def _streamed(part: BinaryIO, row: int, dates: set[int], shared: list[str], day_0: datetime) -> Iterator[Cell]:
    col, rows = -1, None
    for event, e in ElementTree.iterparse(part, ("start", "end")):
        tag = _tag(e)
        if event == "start" and tag == "sheetData":
            rows = e
        elif event == "start" and tag == "row":
            row, col = int(e.get("r", row + 2)) - 1, -1
        elif event == "end" and tag == "c":
            col = _column(e.get("r")) if e.get("r") else col + 1
            cell = _cell(row, col, e, _text(e), dates, shared, day_0)
            if cell:
                yield cell
        elif event == "end" and tag == "row":
            (e if rows is None else rows).clear()  # the rows before too, which are held otherwise, if empty


def sheet_cells(f: BinaryIO, sheet: int) -> Iterator[Cell]:
    """The cells of the sheet of that number that aren't empty, in the file's order."""
    with zipfile.ZipFile(f) as z:
        book, links = _links(z)
        with z.open(links[sheet][1]) as part:
            yield from _streamed(part, -1, *_meaning(z, book))


#: Bytes of a worksheet that are cut off at once.
CUT = 1 << 18
_ATTRIBUTES = rb"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_ROOT = re.compile(rb"<((?:[\w.-]+:)?worksheet)(?=[\s>])" + _ATTRIBUTES + rb"(?<!/)>")
_DATA = re.compile(rb"<((?:[\w.-]+:)?sheetData)(?=[\s>])" + _ATTRIBUTES + rb"(?<!/)>")
# a row's tag; the end of the rows; what can hide such tags, whole; the beginning of what isn't whole yet
_TOKEN = re.compile(rb"<(?:(?:[\w.-]++:)?row(?=[\s/>])(?P<row>" + _ATTRIBUTES + rb")>|(?P<end>/(?:[\w.-]++:)?sheetData\s*>)|(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>)|(?P<open>[!?]))", re.DOTALL)
_NUMBER = re.compile(rb"""\sr\s*=\s*["']\s*(\d+)""")
_ENCODING = re.compile(rb"""\A<\?xml[^>]*\sencoding\s*=\s*["'](?!utf-?8["'])""", re.I)


def cuts(f: BinaryIO, sheet: int, size: int = CUT) -> Iterator[tuple[bytes, int]]:
    """The sheet as documents of whole rows, some `size` bytes each, and the number of the row before each document's first
    one (what rows without a number count from). Nothing, before anything else, if the sheet isn't of a form that can be cut:
    sheet_cells() reads it then. Rows are only looked for here; what stands around them is parsed."""
    with zipfile.ZipFile(f) as z, z.open(_links(z)[1][sheet][1]) as part:
        held = part.read(CUT).removeprefix(b"\xef\xbb\xbf")
        root, data = _ROOT.search(held), _DATA.search(held)
        if not root or not data or _ENCODING.search(held) or b"<!" in held[: data.end()]:
            return
        around = expat.ParserCreate()
        around.Parse(held[: data.end()])
        before_rows, behind_rows = root[0] + data[0], b"</" + data[1] + b"></" + root[1] + b">"
        held, last, more = held[data.end() :], -1, True
        while more:
            cut, number, before = 0, last, last
            for m in _TOKEN.finditer(held):
                if m["open"] or m["end"]:
                    break
                if m["row"] is not None:
                    cut, before = m.start(), number
                    r = _NUMBER.search(m["row"])
                    number = int(r[1]) - 1 if r else number + 1
            else:
                m = None
            if m and m["end"]:
                yield before_rows + held[: m.start()] + behind_rows, last
                around.Parse(held[m.start() :])
                while more := part.read(CUT):
                    around.Parse(more)
                around.Parse(b"", True)
                return
            if cut:
                yield before_rows + held[:cut] + behind_rows, last
                held, last = held[cut:], before
            more = part.read(max(size, len(held)))
            held += more
        yield before_rows + held, last  # cut off; whoever parses it will say so


def cut_cells(xml: bytes, before: int, dates: set[int], shared: list[str], day_0: datetime) -> Iterator[Cell]:
    """The cells of a document of cuts()."""
    try:
        rows = ElementTree.fromstring(xml)[0]
    except ElementTree.ParseError:
        yield from _streamed(io.BytesIO(xml), before, dates, shared, day_0)  # what stands before the fault
        return
    row, space = before, rows.tag.removesuffix("sheetData")
    row_tag, cell_tag, value_tag = space + "row", space + "c", space + "v"
    for r in rows:
        if r.tag != row_tag:
            continue
        row, col = int(r.get("r", row + 2)) - 1, -1
        for e in r:
            if e.tag != cell_tag:
                continue
            ref = e.get("r")
            col = _place(ref.rstrip("0123456789")) if ref else col + 1
            if len(e) == 1 and e[0].tag == value_tag:
                text = e[0].text or ""
                if text.isdigit() and text.isascii() and text[0] != "0" and len(text) < 16 and e.get("t") is None and e.get("s") is None:
                    yield row, col, "int", text
                    continue
            else:
                text = _text(e)
            cell = _cell(row, col, e, text, dates, shared, day_0)
            if cell:
                yield cell


def shared_bytes(f: BinaryIO) -> int:
    """The size of the workbook's shared strings."""
    with zipfile.ZipFile(f) as z:
        return z.getinfo("xl/sharedStrings.xml").file_size if "xl/sharedStrings.xml" in z.namelist() else 0


@lru_cache(1 << 14)
def _letters(j: int) -> str:
    return (_letters(j // 26 - 1) if j > 25 else "") + chr(65 + j % 26)


_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _written(row: int, col: int, kind: str, value: str) -> str:
    at = f"{_letters(col)}{row + 1}"
    if kind == "ts":
        return f'<c r="{at}" s="1"><v>{_days(value)!r}</v></c>'
    if kind in ("int", "float"):
        return f'<c r="{at}"><v>{value}</v></c>'
    if kind == "bool":
        return f'<c r="{at}" t="b"><v>{int(value == "True")}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


_BEFORE, _BEHIND = f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode(), b"</sheetData></worksheet>"


def _row_texts(cells: Iterable[Cell]) -> Iterator[bytes]:
    """The rows of cells that come by row and column."""
    at, out = None, []
    for row, col, kind, value in cells:
        if row != at:
            out.append(f'{"</row>" if at is not None else ""}<row r="{row + 1}">')
            at = row
        out.append(_written(row, col, kind, value))
        if len(out) > 4096:
            yield "".join(out).encode()
            out = []
    yield "".join([*out, "</row>" if at is not None else ""]).encode()


# the texts around a cell's value, by kind; the last one is for all others
_KINDS = pa.array(["int", "float", "bool", "ts"])
_OPEN = pa.array(['"><v>', '"><v>', '" t="b"><v>', '" s="1"><v>', '" t="inlineStr"><is><t xml:space="preserve">'])
_CLOSE = pa.array(["</v></c>"] * 4 + ["</t></is></c>"])


def rows_bytes(cells: pa.RecordBatch, closes: pa.Array, opens: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The rows of cells (row_idx, col_idx, kind, value) as _row_texts() has them, all at once: where each cell's bytes begin
    and the last one's end, and the bytes. opens: the cells that begin a row; closes: those that end one before."""
    row, col, kind, value = (cells.column(c) for c in ("row_idx", "col_idx", "kind", "value"))
    code = pc.fill_null(pc.index_in(kind, value_set=_KINDS), 4)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = pc.replace_substring(value, a, b)
    value = pc.if_else(pc.equal(code, 2), pc.if_else(pc.equal(value, "True"), "1", "0"), value)
    when = pc.equal(code, 3)
    value = pc.replace_with_mask(value, when, pa.array([repr(_days(t)) for t in value.filter(when).to_pylist()], pa.string()))
    n = pc.cast(pc.add(row, 1), pa.string())
    tag = pc.if_else(opens, pc.binary_join_element_wise(pc.if_else(closes, "</row>", ""), '<row r="', n, '">', ""), "")
    letters = pa.array([_letters(j) for j in range(pc.max(col).as_py() + 1)]).take(col)
    out = pc.binary_join_element_wise(*(pc.cast(x, pa.large_string()) for x in (tag, pa.scalar('<c r="'), letters, n, _OPEN.take(code), value, _CLOSE.take(code), pa.scalar(""))))
    return np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, 8 * out.offset), memoryview(out.buffers()[2])


@lru_cache(1 << 14)
def _days(text: str) -> float:
    return (datetime.fromisoformat(text) - DAY_0[False]).total_seconds() / 86400


class Piece:
    """Bytes of a sheet, compressed so that pieces behind each other are one stream: size and crc are of the bytes."""

    def __init__(self):
        self.size, self.crc, self.deflate, self.out = 0, 0, zlib.compressobj(6, zlib.DEFLATED, -15), []

    def add(self, b: bytes) -> None:
        self.size, self.crc = self.size + len(b), zlib.crc32(b, self.crc)
        self.out.append(self.deflate.compress(b))

    def end(self, last: bool = False) -> bytes:
        return b"".join([*self.out, self.deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)])


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, highest powers in the lowest bits."""
    p = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            p ^= b
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return p


def joined_crc(a: int, b: int, size: int) -> int:
    """The CRC-32 of bytes with that of a, followed by `size` bytes with that of b."""
    power, shift = 1 << 23, 1 << 31  # x^8, 1
    while size:
        if size & 1:
            shift = _times(power, shift)
        power, size = _times(power, power), size >> 1
    return _times(shift, a) ^ b


def _around(b: bytes, last: bool = False) -> tuple[int, int, int, Callable[[], Iterator[bytes]]]:
    p = Piece()
    p.add(b)
    own = p.end(last)
    return p.size, p.crc, len(own), lambda: iter([own])


def join(f: BinaryIO, sheets: Iterable[tuple[str, list[tuple[int, int, int, Callable[[], Iterator[bytes]]]]]]) -> None:
    """Writes a workbook of sheets' pieces, (size, crc, compressed size, bytes) each: they are copied as they are. f needs no
    seek."""
    names = []
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, own in sheets:
            names.append(name)
            parts, info = [_around(_BEFORE), *own, _around(_BEHIND, True)], zipfile.ZipInfo(f"xl/worksheets/sheet{len(names)}.xml")
            info.compress_type, info.file_size, info.compress_size = zipfile.ZIP_DEFLATED, sum(p[0] for p in parts), sum(p[2] for p in parts)
            info.CRC = reduce(lambda crc, p: joined_crc(crc, p[1], p[0]), parts, 0)
            info.header_offset = z.fp.tell()
            z.fp.write(info.FileHeader(zip64=True))
            for p in parts:
                for b in p[3]():
                    z.fp.write(b)
            z.start_dir = z.fp.tell()
            z.filelist.append(info)
            z.NameToInfo[info.filename] = info
        _finish(z, names)


def write(f: BinaryIO, sheets: Iterable[tuple[str, Iterable[Cell]]]) -> None:
    """Writes a workbook as its sheets' cells come, those of a sheet by row and column. f needs no seek."""
    names = []
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, cells in sheets:
            names.append(name)
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as part:
                part.write(_BEFORE)
                for b in _row_texts(cells):
                    part.write(b)
                part.write(_BEHIND)
        _finish(z, names)


def _finish(z: zipfile.ZipFile, names: list[str]) -> None:
    """The parts of a workbook that tell of its sheets."""
    n = range(1, len(names) + 1)
    z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
    z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, names)) + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="s1" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
