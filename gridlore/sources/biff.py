"""Binary .xls workbooks (BIFF8 records in a compound file) as streams of cells that aren't empty.

A compound file is a small file system: sectors in chains, a directory of streams, and short streams within one. The
workbook's stream is a sequence of records; its first part names the sheets and holds the strings that cells refer to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from gridlore.sources.ooxml import DATE_FORMATS, DAY_0, Cell, number, shows_date

# The format's signature, chain ends and record numbers.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
LAST_SECTOR = 0xFFFFFFFA
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FORMAT, XF, DATEMODE, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Compound:
    """The streams of a compound file."""

    def __init__(self, f: BinaryIO):
        self.f = f
        head = self._read(0, 512)
        if head[:8] != SIGNATURE:
            raise ValueError("not a binary workbook")
        self.size, self.mini_size = 1 << struct.unpack_from("<H", head, 30)[0], 1 << struct.unpack_from("<H", head, 32)[0]
        directory, self.cutoff, mini, n_mini, more, _ = (struct.unpack_from("<I", head, i)[0] for i in (48, 56, 60, 64, 68, 72))
        tables = [x for x in struct.unpack_from("<109I", head, 76) if x < LAST_SECTOR]
        seen = set()
        while more < LAST_SECTOR and more not in seen:
            seen.add(more)
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += [x for x in part[:-1] if x < LAST_SECTOR]
            more = part[-1]
        self.next = [x for t in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        self.mini_next = list(struct.unpack(f"<{n_mini * self.size // 4}I", self._chain(mini))) if n_mini else []
        self.entries = {}
        entries = self._chain(directory)
        for i in range(0, len(entries), 128):
            e = entries[i : i + 128]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le")
            if e[66] in (2, 5):
                self.entries.setdefault(name if e[66] == 2 else "", struct.unpack_from("<II", e, 116))

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        return got + bytes(n - len(got))

    def _sector(self, i: int) -> bytes:
        return self._read((i + 1) * self.size, self.size)

    def _numbers(self, start: int, following: list[int]) -> list[int]:
        out, seen = [], set()
        while start < LAST_SECTOR:
            if start in seen or start >= len(following):
                raise ValueError("a broken chain of sectors")
            seen.add(start)
            out.append(start)
            start = following[start]
        return out

    def _chain(self, start: int) -> bytes:
        return b"".join(self._sector(i) for i in self._numbers(start, self.next))

    def stream(self, *names: str) -> bytes:
        start, size = next((self.entries[n] for n in names if n in self.entries), (None, None))
        if start is None:
            raise ValueError("no workbook in the file")
        if size >= self.cutoff:
            return self._chain(start)[:size]
        short, m = self._chain(self.entries[""][0]), self.mini_size
        return b"".join(short[i * m : (i + 1) * m] for i in self._numbers(start, self.mini_next))[:size]


def records(b: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(b):
        kind, n = struct.unpack_from("<HH", b, at)
        yield kind, b[at + 4 : at + 4 + n]
        at += 4 + n


class Pieces:
    """A record and those that continue it, read as one; text that is cut begins its next piece with its own width."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.i, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at == len(self.pieces[self.i]):
                self.i, self.at = self.i + 1, 0
            part = self.pieces[self.i][self.at : self.at + n]
            self.at, n, out = self.at + len(part), n - len(part), out + part
        return out

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self, n: int | None = None) -> str:
        n = self.number("<H") if n is None else n
        flags = self.number("<B")
        runs, extra = self.number("<H") if flags & 8 else 0, self.number("<I") if flags & 4 else 0
        out = ""
        while len(out) < n:
            if self.at == len(self.pieces[self.i]):
                self.i, self.at = self.i + 1, 0
                flags = self.number("<B")
            wide = flags & 1
            units = min(n - len(out), (len(self.pieces[self.i]) - self.at) >> wide)
            part = self.take(units << wide)
            out += "".join(map(chr, struct.unpack(f"<{units}H", part))) if wide else part.decode("latin-1")
        self.take(4 * runs + extra)
        return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class Book:
    """What a workbook's first part says of its sheets."""

    def __init__(self, f: BinaryIO):
        self.bytes = Compound(f).stream("Workbook", "Book")
        self.sheets: list[tuple[str, int]] = []
        self.strings: list[str] = []
        formats, styles, shared, day_1904 = {}, [], [], False
        for kind, data in records(self.bytes):
            if kind == BOF and struct.unpack_from("<H", data)[0] != 0x600:
                raise ValueError("a workbook of an older binary version; save it as .xlsx")
            if kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == BOUNDSHEET and data[5] == 0:
                self.sheets.append((Pieces([data[7:]]).text(data[6]), struct.unpack_from("<I", data)[0]))
            elif kind == SST:
                shared = [data]
            elif kind == CONTINUE and shared and not self.strings:
                shared.append(data)
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", data)[0]] = Pieces([data[2:]]).text()
            elif kind == XF:
                styles.append(struct.unpack_from("<H", data, 2)[0])
            elif kind == DATEMODE:
                day_1904 = data[:1] == b"\1"
            elif kind == EOF:
                break
        if shared:
            p = Pieces(shared)
            p.take(4)
            self.strings = [p.text() for _ in range(p.number("<I"))]
        self.day_0 = DAY_0[day_1904]
        self.dates = [shows_date(formats[x]) if x in formats else x in DATE_FORMATS for x in styles]

    def _number(self, x: float, style: int) -> tuple[str, str]:
        return number(x, repr(x), style < len(self.dates) and self.dates[style], self.day_0)

    def cells(self, sheet: int) -> Iterator[Cell]:
        waiting = None
        for kind, data in records(self.bytes, self.sheets[sheet][1]):
            if kind == EOF:
                return
            if kind == STRING and waiting:
                text = Pieces([data]).text()
                if text:
                    yield *waiting, "str", text
                waiting = None
            if kind not in (LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA):
                continue
            row, col, style = struct.unpack_from("<HHH", data)
            if kind == LABELSST:
                text = self.strings[struct.unpack_from("<I", data, 6)[0]]
            elif kind in (LABEL, RSTRING):
                text = Pieces([data[6:]]).text()
            else:
                text = ""
            if text:
                yield row, col, "str", text
            elif kind == NUMBER:
                yield row, col, *self._number(struct.unpack_from("<d", data, 6)[0], style)
            elif kind == RK:
                yield row, col, *self._number(rk(struct.unpack_from("<I", data, 6)[0]), style)
            elif kind == MULRK:
                for i in range((len(data) - 6) // 6):
                    style, value = struct.unpack_from("<HI", data, 4 + 6 * i)
                    yield row, col + i, *self._number(rk(value), style)
            elif kind == BOOLERR:
                yield row, col, *_flag(data[6], data[7])
            elif kind == FORMULA:
                if data[12:14] != b"\xff\xff":
                    yield row, col, *self._number(struct.unpack_from("<d", data, 6)[0], style)
                elif data[6] == 0:
                    waiting = (row, col)
                elif data[6] in (1, 2):
                    yield row, col, *_flag(data[8], data[6] - 1)


def _flag(value: int, is_error: int) -> tuple[str, str]:
    return ("str", ERRORS.get(value, "#ERR!")) if is_error else ("bool", "True" if value else "False")


def rk(value: int) -> float:
    """A number in 30 bits: of a double the upper ones, or a whole number, maybe of hundredths."""
    x = float((value - (value >> 31 << 32)) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<II", 0, value & 0xFFFFFFFC))[0]
    return x / 100 if value & 1 else x
