"""Suffix-array dedup by prefix-free parsing.

A rolling hash over GRAM bytes triggers where it is the least of some window's hashes, so every window of `length`
bytes holds a trigger, and equal windows hold it at the same place. Triggers cut the corpus into phrases. What stands
before a trigger is a suffix of the phrases so far (the dictionary's side), what stands after it is the parse that
follows. A trigger whose gram occurs once in the corpus can't be in a repeat. The others meet by gram, each distinct
surrounding of a block once: there the left sides are sorted as reversed strings and the right sides as strings, each
with the common prefixes of neighbours (a suffix array's order and LCPs, bounded by the window), and the two orders
combine: at every offset, windows are equal just when both sides are of one class. Grams that occur very often don't
meet in one task: their windows are compared one by one, by two 64-bit hashes, dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm import repeats as R
from gridlore.llm.common import SEGMENT, Poly, blocked, corpus_size, materialize, mix, release, text_chunks

#: Bytes of a gram; occurrences of a gram above which its windows are compared one by one.
GRAM, HOT = 64, 2048
#: Bytes of text of a block: a block's windows of hot grams take some 30 bytes each while they are sorted.
BLOCK_BYTES = 4 << 20

_GRAM, _FIRST, _SECOND = Poly(21), Poly(22), Poly(23)
U64 = np.uint64


def pieces(texts: pa.ChunkedArray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts one after another, in pieces of about SEGMENT bytes: first byte, bytes, offsets of the texts in them. A
    longer text is cut into pieces that overlap, so that each of its windows starts in one piece and lies in it."""
    base = 0
    for _, b, off in text_chunks(texts, SEGMENT):
        if len(b) <= SEGMENT:
            yield base, b, off
        else:  # one text
            for i in range(0, len(b), SEGMENT):
                own = b[i : i + SEGMENT + length - 1]
                yield base + i, own, np.array([0, len(own)])
        base += len(b)


def triggers(b: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts b[off[i]:off[i + 1]]: trigger positions, hashes of their grams, and the first and last start of the
    windows whose least gram hash it is (of equal ones, the first)."""
    none = np.zeros(0, np.int64)
    n_starts = len(b) - length + 1
    if n_starts <= 0:
        return none, none.astype(U64), none, none
    h = _GRAM.windows(b, GRAM)
    key = (h >> U64(28) << U64(28)) | np.arange(len(h), dtype=U64)  # the place breaks ties; pieces are far below 2^28 bytes
    span = length - GRAM + 1
    pad = (-len(key)) % span
    k = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, span)
    down = np.minimum.accumulate(k, axis=1).reshape(-1)
    up = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(up[:n_starts], down[span - 1 : span - 1 + n_starts])
    at = (least & U64((1 << 28) - 1)).astype(np.int64)
    edge = np.zeros(n_starts + 1, np.int32)  # windows that cross into the next text
    lo, hi = np.clip(off[1:] - length + 1, 0, n_starts), np.clip(off[1:], 0, n_starts)
    lo = np.maximum(lo, np.minimum(off[:-1], n_starts))
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    starts = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    if not len(starts):
        return none, none.astype(U64), none, none
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # least hashes are all small: mixed again, they spread evenly over buckets
    return at[first], mix(h[at[first]]), starts[first], starts[last]


#: Kinds of rows: a distinct surrounding of repeated triggers, and a window of hot ones. at: where they are in the block,
#: packed, as Spark adds up a list column's rows for each row that it hands to Python.
AROUND = "kind int, block long, n long, key long, key2 long, before int, spread int, at binary, data binary"
RECORD, WINDOW = 0, 1


def packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Runs of 64-bit numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((8 * cut).astype(np.int32).tobytes()), pa.py_buffer(values.astype("<i8").tobytes())])


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's begin and end."""
    values, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in column.chunks:
        if not len(c):
            continue
        cut = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        values.append(np.frombuffer(c.buffers()[2], np.uint8)[cut[0] : cut[-1]].view("<i8") if cut[-1] > cut[0] else values[0])
        sizes.append(np.diff(cut) // 8)
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Found:
    """Collects rows of AROUND."""

    def __init__(self, block: int):
        self.block, self.parts = block, []

    def add(self, kind: int, key: np.ndarray, key2: np.ndarray, before, spread, at: np.ndarray, place: np.ndarray, data) -> None:
        """One row for each key, in order; place: which of them each `at` belongs to."""
        order = np.argsort(place, kind="stable")
        n = np.bincount(place, minlength=len(key))
        lists = packed(at[order], np.concatenate([[0], np.cumsum(n)]))
        k, zero = len(key), np.zeros(len(key), np.int32)
        cols = [np.full(k, kind, np.int32), np.full(k, self.block, np.int64), n.astype(np.int64), key.view(np.int64), key2.view(np.int64), zero if before is None else before.astype(np.int32), zero if spread is None else spread.astype(np.int32)]
        self.parts.append(pa.table([*map(pa.array, cols), lists, pa.nulls(k, pa.binary()) if data is None else pa.array(data, pa.binary())], names=[c.split()[0] for c in AROUND.split(", ")]))

    def table(self) -> pa.Table:
        if not self.parts:
            none = np.zeros(0, U64)
            self.add(RECORD, none, none, None, None, np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        return pa.concat_tables(self.parts)


def surroundings(t: pa.Table, back: pa.Table, length: int) -> pa.Table:
    """A block's repeated triggers (in back: key, hot), as rows of AROUND."""
    out = Found(t["block"][0].as_py() if len(t) else 0)
    if not len(t) or not len(back):
        return out.table()
    key, hot = R.field(back, "key").view(U64), R.field(back, "hot").astype(bool)
    order = np.argsort(key)
    key, hot = key[order], hot[order]
    rec, win = [], []
    for c, (base, b, off) in enumerate(pieces(t.sort_by("rid")["text"], length)):
        at, gram, lo, hi = triggers(b, off, length)
        i = np.minimum(np.searchsorted(key, gram), len(key) - 1)
        known = key[i] == gram
        own = known & ~hot[i]
        t0, g, lo0, end = at[own], gram[own], lo[own], hi[own] + length
        p1, p2 = _FIRST.prefix(b), _SECOND.prefix(b)
        sides = mix((t0 - lo0).astype(U64) * U64(1 << 20) + (end - t0).astype(U64))
        rec.append((mix(_FIRST.of(p1, lo0, end) ^ sides ^ g), _SECOND.of(p2, lo0, end), g, t0 - lo0, hi[own] - lo0, base + t0, np.full(len(t0), c), lo0, end))
        own = known & hot[i]
        n = hi[own] - lo[own] + 1
        start = np.repeat(lo[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        win.append((_FIRST.of(p1, start, start + length), _SECOND.of(p2, start, start + length), base + start))
    h1, h2, g, before, spread, at, piece, lo, end = (np.concatenate(x) for x in zip(*rec))
    u, _, place, _ = R.distinct(h1, h2)
    if len(u):
        one = np.zeros(len(u), np.int64)
        one[place] = np.arange(len(place))
        byte = [b for _, b, _ in pieces(t.sort_by("rid")["text"], length)]
        data = [byte[c][x:y].tobytes() for c, x, y in zip(piece[one].tolist(), lo[one].tolist(), end[one].tolist())]
        out.add(RECORD, g[one], np.zeros(len(u), U64), before[one], spread[one], at, place, data)
    h1, h2, at = (np.concatenate(x) for x in zip(*win))
    u1, u2, place, _ = R.distinct(h1, h2)
    if len(u1):
        out.add(WINDOW, u1, u2, None, None, at, place, None)
    return out.table()


def combine(gram: np.ndarray, left: np.ndarray, spread: np.ndarray, many: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each record (its trigger `left` bytes in, windows from its first `spread + 1` bytes on): at which offsets
    before the trigger the window occurs again. many: records that stand for several places."""
    n = len(gram)
    size = spread.astype(np.int64) + length
    begin = np.cumsum(size) - size
    left = left.astype(np.int64)
    found = np.zeros((n, length), bool)
    lo, hi = left - spread, left  # offsets of a record: lo .. hi
    found[:] = many[:, None] & (np.arange(length) >= lo[:, None]) & (np.arange(length) <= hi[:, None])
    _, group, total = np.unique(gram, return_inverse=True, return_counts=True)
    live = np.flatnonzero(total[group] > 1)
    if not len(live):
        return found
    # classes by depth: the records sorted by gram and side, and how far neighbours agree
    def side(way: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(live), 8 + depth), np.uint8)
        wide[:, :8] = gram[live].astype(">u8").view(np.uint8).reshape(-1, 8)
        have = np.minimum(left[live] if way < 0 else (size - left)[live], depth)
        for z in range(0, len(live), 4096):
            i = np.arange(depth)[None, :]
            at = begin[live[z : z + 4096], None] + left[live[z : z + 4096], None] + (i if way > 0 else -1 - i)
            ok = i < have[z : z + 4096, None]
            wide[z : z + 4096, 8:] = np.where(ok, data[np.where(ok, at, 0)], 0)
        order = np.argsort(np.ascontiguousarray(wide).view(f"S{8 + depth}").reshape(-1), kind="stable")
        lcp = np.empty(len(live), np.int64)
        lcp[0] = -1
        for z in range(1, len(live), 4096):
            y = min(len(live), z + 4096)
            differ = wide[order[z:y]] != wide[order[z - 1 : y - 1]]
            lcp[z:y] = np.where(differ.any(1), differ.argmax(1), 8 + depth) - 8
        return order, lcp

    (lo_order, lo_lcp), (hi_order, hi_lcp) = side(-1, int(hi[live].max())), side(1, length - int(lo[live].min()))
    m = len(live)
    a, b = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(int(lo[live].min()), int(hi[live].max()) + 1):
        own = np.flatnonzero((lo[live] <= o) & (o <= hi[live]))
        if len(own) > 1:
            a[lo_order] = np.cumsum(lo_lcp < o)
            b[hi_order] = np.cumsum(hi_lcp < length - o)
            key = a[own] * (m + 1) + b[own]
            order = np.argsort(key, kind="stable")
            k = key[order]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            found[live[own[order[same[1:] | same[:-1]]]], o] = True
    return found


REMOVED = "block long, at binary"


def meet(t: pa.Table, length: int) -> pa.Table:
    """Of a bucket's surroundings: for each block, start and end of the stretches that repeated windows cover."""
    data = t["data"].combine_chunks() if t["data"].num_chunks != 1 else t["data"].chunk(0)
    first, last = (int(x) for x in np.frombuffer(data.buffers()[1], np.int32)[[data.offset, data.offset + len(data)]])
    cols = [t[c].to_numpy() for c in ("key", "before", "spread", "n")]
    found = combine(cols[0].view(U64), cols[1], cols[2], cols[3] > 1, np.frombuffer(data.buffers()[2], np.uint8)[first:last], length)
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, o1), (_, o2) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # runs of offsets o1 .. o2 - 1
    values, begin = unpacked(t["at"])
    n = np.diff(begin)[row]
    place = values[np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    start, end = place - np.repeat(o2 - 1, n), place - np.repeat(o1, n) + length
    block = np.repeat(t["block"].to_numpy()[row], n)
    order = np.lexsort((start, block))
    block, both = block[order], np.stack([start[order], end[order]], 1).reshape(-1)
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    lists = packed(both, np.append(2 * cut, len(both)))
    release()
    return pa.table({"block": pa.array(block[cut], pa.int64()), "at": lists})


def without(t: pa.Table, back: pa.Table, length: int) -> pa.Table:
    """A block's texts without the stretches in back (at: starts and ends of the block's bytes, or with hot starts alone)."""
    t = t.sort_by("rid")
    hot = back["hot"].to_numpy(zero_copy_only=False).astype(bool) if len(back) else np.zeros(0, bool)
    at, one = (unpacked(back.filter(pa.array(x))["at"])[0] for x in (~hot, hot))
    start, end = np.concatenate([at[::2], one]), np.concatenate([at[1::2], one + length])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    text, kept, sizes, removed, spans, base = t["text"], [], [], [], [], 0
    for _, b, off in text_chunks(text):
        raw = b.tobytes()
        for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
            i, z = np.searchsorted(start, [base + lo, base + hi])  # a stretch lies in one text
            s, e = start[i:z] - base, end[i:z] - base
            new = np.append(True, s[1:] > e[:-1]) if len(s) else np.zeros(0, bool)
            s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)] if len(e) else e
            parts = [raw[x:y] for x, y in zip([lo, *e.tolist()], [*s.tolist(), hi])]
            kept.append(parts[0] if len(parts) == 1 else b"".join(parts))
            sizes.append(hi - lo), removed.append(int((e - s).sum())), spans.append(len(s))
        base += len(b)
    out = pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})
    release()
    return out


def remove_repeats(docs: DataFrame, length: int = 400, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of each row of docs (doc_id, text): the text's UTF-8 bytes without
    those that are covered by a string of `length` bytes that also starts elsewhere, judged on the input.

    Null text is empty; shorter texts stay whole; repeated rows repeat each other; an empty table gives no rows. kept is
    binary, as a cut may split a character. Long texts are parsed in pieces; one task holds a text whole, at some 4
    times its bytes, and up to 16 bytes more for each place of it that a hot gram's window repeats.
    """
    if not GRAM < length < SEGMENT:
        raise ValueError(f"length must be over {GRAM} and below {SEGMENT}")
    _, n_bytes = corpus_size(docs)
    texts, n = blocked(docs, n_bytes, "doc_id", block_bytes=block_bytes)

    def grams(t: pa.Table) -> pa.Table:
        found = [triggers(b, off, length)[1] for _, b, off in pieces(t["text"], length)]
        u, _, _, counts = R.distinct(g := np.concatenate([np.zeros(0, U64), *found]), np.zeros(len(g), np.uint8))
        return R.key_rows(t["block"][0].as_py(), counts, u)

    again = R.repeated(texts.groupBy("block").applyInArrow(grams, R.KEYS), n).withColumn("hot", F.col("total") > HOT)
    again = R.by_block(again, "key", F.col("hot").cast("long").alias("hot"))
    # written, as two ways go on from here
    around = materialize(texts.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lambda t, back: surroundings(t, back, length), AROUND), "suffix-around")
    records = around.where(F.col("kind") == RECORD).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n))).repartition(min(n, R.PARTITIONS), "bucket")
    removed = records.groupBy("bucket").applyInArrow(lambda t: meet(t, length), REMOVED).withColumn("hot", F.lit(False))
    if not (hot := around.where(F.col("kind") == WINDOW).select("block", "n", "key", "key2", "at")).isEmpty():
        removed = removed.union(R.repeated(hot, n, "at").select("block", "at", F.lit(True)))
    out = texts.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(lambda t, back: without(t, back, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true)::INTEGER AS new FROM hit)),
spans AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS x, a - 1 AS y FROM spans UNION ALL SELECT d.r, coalesce(max(z), 1), max(octet_length(b)) FROM d LEFT JOIN spans ON d.r = spans.r GROUP BY d.r),
kept AS (SELECT gaps.r, string_agg(hex(b[x:y]), '' ORDER BY x) AS kept FROM gaps JOIN d ON d.r = gaps.r WHERE y >= x GROUP BY gaps.r),
n AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n.n_removed, 0)::BIGINT AS n_removed, coalesce(n.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.kept, ''))) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
