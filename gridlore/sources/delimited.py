"""CSV files of any size as streams of cells, cut into byte ranges.

A range can begin inside a quoted field, so where records begin isn't seen from it alone. A reader of CSV has four states;
each range says, for each of them, in which state it is left and how many records end in it. Taken together in order,
these give every range's true state and the number of its first record.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

from gridlore.sources.ooxml import Cell

CSV_SHEET = "CSV_Data"
# CSV fields that are read as empty.
NA = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
_INT, _FLOAT = re.compile(r"[+-]?\d+\Z"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")
#: States: at the start of a record, at the start of a later field, in a plain field, in a quoted one, behind a quote in it.
RECORD, FIELD, PLAIN, QUOTED, CLOSING = range(5)
STATES = 5
_PLAIN_END, _QUOTE = re.compile(rb"[,\r\n]"), re.compile(rb'"')
#: Bytes that are read at once.
STEP = 1 << 20


def kind_of(text: str) -> str:
    return "null" if text in NA else "int" if _INT.match(text) else "float" if _FLOAT.match(text) else "bool" if text in ("True", "False", "TRUE", "FALSE", "true", "false") else "str"


def scan(b: bytes, state: int, ends: list[int] | None = None) -> tuple[int, int]:
    """The state behind the bytes and the number of records that end in them; ends: gets the places behind these. Blank
    lines are no records. A line feed behind a carriage return is one."""
    i, n, size = 0, 0, len(b)
    while i < size:
        c = b[i]
        if state == QUOTED:
            m = _QUOTE.search(b, i)
            if not m:
                return QUOTED, n
            i, state = m.end(), CLOSING
        elif state == PLAIN or (state == CLOSING and c not in b'",\r\n'):
            m = _PLAIN_END.search(b, i)
            if not m:
                return PLAIN, n
            i, state = m.start(), CLOSING  # what ends a field ends it here too
            if b[i] == 0x22:
                state = PLAIN
        elif c == 0x22:
            i, state = i + 1, QUOTED
        elif c == 0x2C:
            i, state = i + 1, FIELD
        elif c in b"\r\n":
            i += 1
            if state != RECORD:
                n += 1
                if ends is not None:
                    ends.append(i)
            state = RECORD
        else:
            state = PLAIN
    return state, n


def chunks(f: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    f.seek(start)
    while start < end:
        b = f.read(min(STEP, end - start))
        if not b:
            return
        start += len(b)
        yield b


def _marked(f: BinaryIO, start: int) -> int:
    """The range's start, behind the mark of UTF-8 that a file may begin with."""
    f.seek(start)
    return 3 if start == 0 and f.read(3) == b"\xef\xbb\xbf" else start


def effects(f: BinaryIO, start: int, end: int) -> list[tuple[int, int]]:
    """For each state in which the range can be entered: the state in which it is left, and the records that end in it."""
    now = [(s, 0) for s in range(STATES)]
    for b in chunks(f, _marked(f, start), end):
        after = {s: scan(b, s) for s in {s for s, _ in now}}  # states that meet go on as one
        now = [(after[s][0], n + after[s][1]) for s, n in now]
    return now


def entered(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The state in which each of a file's ranges is entered, and the records that end before it."""
    out, state, n = [], RECORD, 0
    for part in parts:
        out.append((state, n))
        state, more = part[state]
        n += more
    return out


class _Text(io.RawIOBase):
    """Bytes of a file from a place on, to the end of the record that the range's last byte belongs to."""

    def __init__(self, f: BinaryIO, start: int, end: int, state: int):
        self.f, self.end, self.state, self.at, self.left = f, end, state, start, b""
        self.done = False

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left and not self.done:
            self.f.seek(self.at)
            b = self.f.read(STEP if self.at >= self.end else min(STEP, self.end - self.at))
            if not b:
                self.done = True
            elif self.at >= self.end:  # the rest of the last record
                ends: list[int] = []
                scan(b, self.state, ends)
                if self.state == RECORD or ends:
                    b, self.done = b"" if self.state == RECORD else b[: ends[0]], True
            self.at += len(b)
            self.state, self.left = scan(b, self.state)[0], b
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def range_cells(f: BinaryIO, start: int, end: int, state: int, before: int) -> Iterator[Cell]:
    """The cells that aren't empty of the records that begin in a range; those that are entered in another state than RECORD
    begin before it, and belong to the range before. before: the records that end before the range."""
    row, start = before, _marked(f, start)
    if state != RECORD:
        at, found = start, False
        for b in chunks(f, start, end):
            ends: list[int] = []
            after, _ = scan(b, state, ends)
            if ends:
                start, found, row = at + ends[0], True, row + 1
                break
            at, state = at + len(b), after
        if not found:
            return
    text = io.TextIOWrapper(io.BufferedReader(_Text(f, start, end, RECORD), STEP), "utf-8", newline="")
    for record in csv.reader(text):
        if record:
            for col, t in enumerate(record):
                kind = kind_of(t)
                if kind != "null":
                    yield row, col, kind, t
            if kind_of(record[-1]) == "null":  # the width of the sheet counts empty fields
                yield row, len(record) - 1, "null", None
            row += 1
