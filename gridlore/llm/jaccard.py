"""N-gram Jaccard join over a prefix tree.

Word shingles have one global order: by a sketch of their corpus frequency, rare ones first, then by hash. Two sets of
enough similarity share a shingle among the rarest of each (the prefix), so only texts that share one can be linked.
Texts that are joined by such pairs, directly or through others, are a family. Every pair of a family whose lengths can
be similar is compared, once: a family's blocks meet in tries of their sets, common shingles first. The probes of a
block walk a trie together, add up the overlap of the path once for all sets below, and leave a subtree whose remaining
lengths can't bring the overlap that is needed. Texts with equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm import repeats as R
from gridlore.llm.common import BLOCK_BYTES, SEGMENT, Poly, ascii_lower, column, corpus_size, discard, free, hashed_words, joined, keyed, materialize, mix, parted, rejoin, release, text_chunks
from gridlore.llm.graph import components

#: Slots of the frequency sketch, least and most (a byte each is broadcast); bytes of text for each slot, so that a shingle of
#: some twenty texts stands out in a corpus of any size up to the most; partial sums of a slice of it.
SLOTS, MOST_SLOTS, SLOT_BYTES, SLICES, LEVELS = 1 << 20, 1 << 24, 512, 16, 64
#: Texts that share a prefix shingle: of up to FEW, the pairs that their pictures let through are candidates, of more, all.
#: A family's blocks have about BLOCK texts.
FEW, BLOCK = 24, 128
#: Texts to be built of which a bit map is broadcast (16 bits each); of more, texts are joined instead.
MAPPED = 1 << 22
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 500_000
#: Bytes of the table of which probes hold which shingles of a trie.
HELD_BYTES = 64 << 20

_BYTES, _WORDS, _CHECK = Poly(31), Poly(32), np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def shingles(texts: pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of `size` lower-cased words, or of all words if there are fewer."""
    for _, b, off in text_chunks(texts):
        b = ascii_lower(b)
        _, _, wo, (w,) = hashed_words(b, off, _BYTES)
        full = _WORDS.windows(w, size)
        for lo, hi in zip(wo[:-1].tolist(), wo[1:].tolist()):
            if hi - lo >= size:
                h = np.sort(full[lo : hi - size + 1])
                yield h[np.append(True, h[1:] != h[:-1])]
            elif hi > lo:
                yield mix(_WORDS.windows(w[lo:hi], hi - lo) + U64(hi - lo))
            else:
                yield np.zeros(0, U64)


def set_id(h: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        x = [np.sum(mix(h ^ k), dtype=U64) for k in (U64(0x5851F42D4C957F2D), _CHECK)]
        x = mix(np.array([x[0] + U64(len(h)), x[1] ^ U64(len(h))], U64)).view(np.int64)
    return int(x[0]), int(x[1])


def slots_for(n_bytes: int) -> int:
    return min(MOST_SLOTS, max(SLOTS, 1 << (n_bytes // SLOT_BYTES).bit_length()))


def slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> U64(65 - slots.bit_length())).astype(np.int64)


def ordered(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order, ascending: frequency level in the upper bits, then hash."""
    return np.sort((sketch[slot(h, len(sketch))].astype(U64) << U64(58)) | (h >> U64(6)))


def picture(h: np.ndarray) -> np.ndarray:
    """The set hashed to one or two bits an element, a power of two in all; a bit is the parity of what falls on it. Two
    sets differ in as many elements at least as their pictures in bits. Halves laid over each other are the smaller picture."""
    m = max(64, 1 << max(0, len(h) - 1).bit_length())
    at = (mix(h) & U64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8)).view("<i8")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of a and b elements with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


FIRST = "rid string, doc_id long, n long, sid long, other long, bits array<long>, slice int, counts binary"


def first_scan(docs: DataFrame, size: int, slots: int = SLOTS) -> DataFrame:
    """Rows of documents (rid, doc_id, n, sid and other: the set's 128 bits), and of the task's part of the frequency
    sketch (slice, counts)."""
    names = [c.split()[0] for c in FIRST.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int32)
        for b in batches:
            n, sid, other, bits = [], [], [], []
            for h in shingles(b.column("text"), size):
                np.add.at(total, slot(h, slots), 1)
                x, y = set_id(h)
                n.append(len(h)), sid.append(x), other.append(y), bits.append(picture(h))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, sid, other)), pa.array(bits, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        none, w = pa.nulls(SLICES, pa.int64()), slots // SLICES
        counts = [zstandard.compress(total[i * w : (i + 1) * w].astype("<i8").tobytes(), 1) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.string()), none, none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], names)
        release()

    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, FIRST)


def sketch_of(first: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """The slots' frequency levels: a byte a slot comes to the driver. Sums go over two steps, so that no task meets all parts."""

    def add(t: pa.Table, last: bool) -> pa.Table:
        total = np.zeros(slots // SLICES, np.int64)
        for d in t["counts"]:
            total += np.frombuffer(zstandard.decompress(d.as_py()), "<i8")
        out = np.minimum(LEVELS - 1, np.rint(3 * np.log2(1 + total))).astype(np.uint8) if last else total
        return pa.table({"slice": t["slice"].slice(0, 1), "counts": pa.array([zstandard.compress(out.tobytes(), 1)], pa.binary())})

    parts = first.where("slice IS NOT NULL").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    schema = "slice int, counts binary"
    sums = parts.groupBy("slice", "part").applyInArrow(lambda t: add(t, False), schema).groupBy("slice").applyInArrow(lambda t: add(t, True), schema)
    out = np.zeros(slots, np.uint8)
    for r in sums.collect():
        own = np.frombuffer(zstandard.decompress(r["counts"]), np.uint8)
        out[r["slice"] * len(own) : (r["slice"] + 1) * len(own)] = own
    return out


class Trie:
    """A prefix tree over sorted arrays of 64-bit numbers: a node is a run of the sorted list that agrees up to a depth."""

    def __init__(self, sets: list[np.ndarray]):
        byte = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=byte.__getitem__)
        self.sets = [sets[k] for k in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.own = np.unique(np.concatenate(self.sets))
        self.at = [np.searchsorted(self.own, s) for s in self.sets]

    def links(self, probes: list[np.ndarray], percent: int) -> np.ndarray:
        """Whether each probe (row) is linked with each set (column, in the order given)."""
        out = np.zeros((len(probes), len(self.sets)), bool)
        step = max(1, HELD_BYTES // len(self.own))
        for i in range(0, len(probes), step):
            self._walk(probes[i : i + step], percent, out[i : i + step])
        return out

    def _walk(self, probes: list[np.ndarray], percent: int, out: np.ndarray) -> None:
        held = np.zeros((len(self.own), len(probes)), np.uint8)
        for i, p in enumerate(probes):
            at = np.minimum(np.searchsorted(self.own, p), len(self.own) - 1)
            held[at[self.own[at] == p], i] = 1
        size = np.array([len(p) for p in probes], np.int64)
        todo = [(0, len(self.sets), 0, np.zeros(len(probes), np.int64), np.ones(len(probes), bool))]
        while todo:
            lo, hi, depth, overlap, on = todo.pop()
            least, most = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
            on = on & (100 * np.minimum(size, most) >= percent * np.maximum(size, least))
            if not on.any():
                continue
            a, z = self.sets[lo], self.sets[hi - 1]
            m = min(len(a), len(z))
            if hi - lo == 1:
                end = m
            else:
                differ = np.flatnonzero(a[depth:m] != z[depth:m])
                end = depth + int(differ[0]) if len(differ) else m
            overlap = overlap + held[self.at[lo][depth:end]].sum(axis=0, dtype=np.int64)
            on = on & (overlap + np.minimum(size - overlap, most - end) >= needed(size, least, percent))
            if not on.any():
                continue
            while lo < hi and len(self.sets[lo]) == end:
                out[:, self.order[lo]] = on & (100 * overlap >= percent * (size + end - overlap))
                lo += 1
            if lo < hi:
                nxt = np.array([s[end] for s in self.sets[lo:hi]], U64)
                cuts = [0, *(np.flatnonzero(nxt[1:] != nxt[:-1]) + 1).tolist(), hi - lo]
                todo += [(lo + x, lo + y, end, overlap, on) for x, y in zip(cuts, cuts[1:])]


def pack_block(sid: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A block's texts, the shingles once, the sets as steps through them."""
    own, place = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    step, first = place.astype(np.int64), np.cumsum(size) - size
    step[1:] -= place[:-1]
    step[first] = place[first]
    return zstandard.compress(joined(sid.astype("<i8"), weight.astype("<i8"), size.astype("<i8"), own.astype("<u8"), step.astype("<i4")), 1)


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sid, weight, size, own, step = parted(zstandard.decompress(data), "<i8", "<i8", "<i8", "<u8", "<i4")
    cut = np.append(0, np.cumsum(size)).tolist()
    return sid, weight, [own[np.cumsum(step[x:y])] for x, y in zip(cut, cut[1:])]


Block = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def meet(x: Block, y: Block | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, n of the texts a that are linked in block x, or between x and y: b is the least text of the two blocks that a is
    connected with by these links, n how many documents it is linked with by them."""
    same = y is None
    (xs, xw, sets), (ys, yw, others) = x, x if y is None else y
    linked = Trie(others).links(sets, percent)
    if same:
        np.fill_diagonal(linked, False)
    n = [linked @ yw, linked.T @ xw]
    far = np.iinfo(np.int64).max
    left, right = xs.copy(), ys.copy()
    while True:  # the least goes round until nothing changes
        l2 = np.minimum(left, np.where(linked, right, far).min(axis=1))
        if same:
            right = l2
        r2 = np.minimum(right, np.where(linked.T, l2, far).min(axis=1))
        if same:
            l2 = r2
        done = np.array_equal(l2, left) and np.array_equal(r2, right)
        left, right = l2, r2
        if done:
            break
    sides = [(xs, left, n[0])] if same else [(xs, left, n[0]), (ys, right, n[1])]
    return tuple(np.concatenate([s[k][s[2] > 0] for s in sides]) for k in range(3))


PAIRS = "kind int, a long, b long, m long, least long"  # kind 0: a pair of sids that share m tokens here and must share `least`; 1: b is in a large run of which a is one


def summed(rows: list[np.ndarray]) -> np.ndarray:
    """Rows a, b, m, least; one a pair, with the sum of m."""
    x = np.concatenate([np.zeros((0, 4), np.int64), *rows])
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    first = np.flatnonzero(np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1))) if len(x) else np.zeros(0, np.int64)
    return np.column_stack([x[first, :2], np.add.reduceat(x[:, 2], first) if len(x) else x[:, 2], x[first, 3]])


class Runs:
    """Runs of texts that share a prefix shingle, from rows sorted by token, n and sid: pairs of small ones, stars of large ones."""

    def __init__(self, percent: int, few: int, least: Callable[[np.ndarray, int], np.ndarray] | None = None):
        self.percent, self.few, self.least = percent, few, least
        self.held: tuple[list, list] = ([], [])
        self.rest = [np.zeros(0, np.int64)] * 3
        self.star: tuple[int, int, int] | None = None  # token, first sid and last n of a large run that goes on

    def keep(self, kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
        """n: the smaller size of each pair."""
        if len(a):
            least = np.ones(len(a), np.int64) if n is None or self.least is None else self.least(n, self.percent)
            self.held[kind].append(np.stack([np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), least], 1))
            if sum(map(len, self.held[kind])) > HELD_PAIRS:
                self.held[kind][:] = [summed(self.held[kind])]

    def full(self) -> bool:
        return sum(len(x) for k in self.held for x in k) > HELD_PAIRS

    def batch(self) -> pa.RecordBatch:
        p = [summed(x) for x in self.held]
        kind, p = np.repeat([0, 1], [len(x) for x in p]), np.concatenate(p)
        kind, p = kind[p[:, 0] != p[:, 1]], p[p[:, 0] != p[:, 1]]
        self.held = ([], [])
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(p[:, k], pa.int64()) for k in range(4))], ["kind", "a", "b", "m", "least"])

    def add(self, token: np.ndarray, n: np.ndarray, sid: np.ndarray, last: bool = False) -> None:
        token, n, sid = (np.concatenate(x) for x in zip(self.rest, (token, n, sid)))
        if self.star and len(token):  # what goes on with a large run
            same = token == self.star[0]
            k = len(token) if same.all() else int(np.argmin(same))
            gap = np.flatnonzero(100 * np.concatenate([[self.star[2]], n[: k - 1]]) < self.percent * n[:k]) if k else []
            k, ends = (int(gap[0]), True) if len(gap) else (k, k < len(token))
            self.keep(1, np.full(k, self.star[1]), sid[:k])
            self.star = None if ends else (self.star[0], self.star[1], int(n[k - 1]) if k else self.star[2])
            token, n, sid = token[k:], n[k:], sid[k:]
        new = np.ones(len(token), bool)
        # sorted by length: beyond a gap none is similar to one before it
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < self.percent * n[1:])
        again = np.zeros(len(token), bool)
        again[1:] = ~new[1:] & (sid[1:] == sid[:-1])
        token, n, sid, new = token[~again], n[~again], sid[~again], new[~again]
        begin = np.flatnonzero(new)
        if not last and len(begin):  # the last run may go on
            k = begin[-1]
            if len(token) - k > self.few:
                self.star = (int(token[k]), int(sid[k]), int(n[-1]))
                self.keep(1, np.full(len(token) - k, sid[k]), sid[k:])
                self.rest = [np.zeros(0, np.int64)] * 3
            else:
                self.rest = [token[k:], n[k:], sid[k:]]
            token, n, sid, begin = token[:k], n[:k], sid[:k], begin[:-1]
        else:
            self.rest = [np.zeros(0, np.int64)] * 3
        length = np.diff(np.append(begin, len(token)))
        for k in np.unique(length):  # all runs of one length at once
            at = begin[length == k]
            if 2 <= k <= self.few:
                x, y = np.triu_indices(k, 1)
                for z in range(0, len(at), max(1, 1_000_000 // len(x))):
                    some = at[z : z + max(1, 1_000_000 // len(x))]
                    i, j = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                    ok = 100 * n[i] >= self.percent * n[j]
                    self.keep(0, sid[i[ok]], sid[j[ok]], n[i[ok]])
            elif k > self.few:
                for a in at.tolist():
                    self.keep(1, np.full(k, sid[a]), sid[a : a + k])


#: From the frequency levels and the percentage of a join, what gives the tokens of a set; sets that can be linked share one.
Tokens = Callable[[np.ndarray, int], Callable[[np.ndarray], np.ndarray]]


def rarest(sketch: np.ndarray, percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """Tokens of a set: its rarest shingles, as many as must hold shared_tokens() of any set that is linked with it."""
    return lambda h: mix(ordered(h, sketch)[: prefix_length(len(h), percent) - 1 + int(shared_tokens(len(h), percent))])


def shared_tokens(n, percent: int):
    """How many tokens of rarest() a set of n elements shares with any larger one that it is linked with, at least: each
    element that a prefix is longer by must be met once more. It never falls as n grows, and is at most the overlap."""
    return 1 + np.minimum((n - -(-percent * n // 100)) // 6, np.maximum(-(-percent * n // 100) - 1, 0))


def candidates(docs: DataFrame, sketch: np.ndarray, n_bytes: int, size: int, percent: int, block_bytes: int = BLOCK_BYTES, tokens: Tokens = rarest) -> DataFrame:
    """Pairs of set ids that share a token, and how many (m); those of large runs as stars, which stand for all pairs of the
    run. Of pairs that share no token of a large run, m counts all shared ones; they can be linked if it sums up to least.

    A row is a token and a set id; equal sets send theirs once a task. Rows are dealt by token and sorted, and a run goes
    through its task as a stream."""
    shared, few, least = docs.sparkSession.sparkContext.broadcast(sketch), FEW, shared_tokens if tokens is rarest else None

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens(shared.value, percent)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            found, sids, sizes = [np.zeros(0, U64)], [], []

            def out():
                n = [len(x) for x in found[1:]]
                cols = [np.concatenate(found).view(np.int64), np.repeat(np.array(sizes, np.int64), n), np.repeat(np.array(sids, np.int64), n)]
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["token", "n", "sid"])

            held = 0
            for h in shingles(b.column("text"), size):
                sid = set_id(h)
                if len(h) and sid not in seen:
                    seen.add(sid)
                    found.append(of(h))
                    sids.append(sid[0]), sizes.append(len(h))
                    held += len(found[-1])
                    if held > SEGMENT // 4:
                        yield out()
                        found, sids, sizes, held = found[:1], [], [], 0
            if len(seen) > SEGMENT:
                seen.clear()
            yield out()
        release()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(percent, few, least)
        for b in batches:
            runs.add(*(b.column(c).to_numpy() for c in ("token", "n", "sid")))
            if runs.full():
                yield runs.batch()
        runs.add(*[np.zeros(0, np.int64)] * 3, last=True)
        yield runs.batch()
        release()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(prefixes, "token long, n long, sid long")
    parts = max(1, min(R.PARTITIONS, -(-n_bytes // block_bytes)))
    return rows.repartition(parts, "token").sortWithinPartitions("token", "n", "sid").mapInArrow(pairs, PAIRS)


def enough(found: DataFrame) -> DataFrame:
    """The pairs a, b (sids) of candidates() that share as many tokens as linked sets must."""
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("m").alias("m"), F.max("least").alias("least"))
    return pairs.where("m >= least").select("a", "b")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (cids) of pairs (sids) that can be linked by their pictures: each bit that differs stands for an
    element of one set alone, so the overlap is at most half of what the sizes leave."""
    side = lambda s: classes.select(F.col("sid").alias(s), F.col("cid").alias(f"{s}_cid"), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("words", F.least(F.size("a_bits"), F.size("b_bits")))

    def bits(c: str):  # sizes that can be similar give pictures of one size, or of this and its half
        over = F.zip_with(F.slice(c, F.lit(1), F.col("words")), F.slice(c, F.col("words") + 1, F.col("words")), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == F.col("words"), F.col(c)).otherwise(over)

    differ = F.aggregate(F.zip_with(bits("a_bits"), bits("b_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.col("a_n") + F.col("b_n") - differ  # twice the overlap, at most
    rows = rows.where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    return rows.where((100 + percent) * most >= 2 * percent * (F.col("a_n") + F.col("b_n"))).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))


MADE = "family long, block long, lo long, hi long, data binary, a long, b long, n long"


def within(sets: DataFrame, percent: int) -> DataFrame:
    """Of the blocks of sets (family, block, alone, cid, weight, set): what their own links are (see meet), and, if the family
    has others, the block packed (data), with its least and largest set (lo, hi)."""

    def walk(t: pa.Table) -> pa.Table:
        block = (t["cid"].to_numpy(), t["weight"].to_numpy(), [np.frombuffer(s, "<u8") for s in t["set"].to_pylist()])
        a, b, n = meet(block, None, percent)
        rows = [(None, None, None, None, None, *r) for r in zip(a.tolist(), b.tolist(), n.tolist())]
        if not t["alone"][0].as_py():
            size = [len(s) for s in block[2]]
            rows.append((t["family"][0].as_py(), t["block"][0].as_py(), min(size), max(size), pack_block(*block), None, None, None))
        kinds = [("family", pa.int64()), ("block", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("data", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])

    return sets.groupBy("family", "block").applyInArrow(walk, MADE)


def between(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b, n (see meet) of any two blocks of a family whose lengths can be similar."""

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, n = meet(unpack_block(left["data"][0].as_py()), unpack_block(right["data"][0].as_py()), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    x, y = (blocks.select("family", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "lo", "hi")]) for s in "xy")
    met = x.join(y, "family").where("x_block < y_block").where(f"100 * least(x_hi, y_hi) >= {percent} * greatest(x_lo, y_lo)").select("family", "x_block", "y_block")
    keys = ["family", "x_block", "y_block"]
    left, right = (met.join(blocks.select("family", F.col("block").alias(f"{s}_block"), "data"), ["family", f"{s}_block"]).select(*[F.col(c).alias(f"{s}_of_{c}") for c in keys], "data") for s in "xy")
    return left.groupBy(*[f"x_of_{c}" for c in keys]).cogroup(right.groupBy(*[f"y_of_{c}" for c in keys])).applyInArrow(walk, "a long, b long, n long")


def families(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """rid, cid, weight, family, block, alone of every text that has a candidate. A family of over BLOCK texts is cut into
    bands by length, and these by hash into blocks of about BLOCK texts; alone: it is one block."""
    family = components(edges)
    rows = family.join(classes, family.node == classes.cid).select("rid", "cid", "n", "weight", F.col("root").alias("family"))
    members = rows.groupBy("family").agg((F.count(F.lit(1)) <= BLOCK).alias("alone"))
    rows = rejoin(rows, members, ["family"], "cid").withColumn("band", F.when(F.col("alone"), 0).otherwise(F.floor(3 * F.log2("n"))).cast("long"))
    rows = materialize(rows, "jaccard-families")
    blocks = rows.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    block = F.col("band") * F.lit(1 << 40) + F.pmod(F.xxhash64("cid"), F.col("blocks"))
    found = materialize(rejoin(rows, blocks, ["family", "band"], "cid").select("rid", "cid", "weight", "family", block.alias("block"), "alone"), "jaccard-needs")
    discard(rows, family)
    return found


def sets_of(docs: DataFrame, needs: DataFrame, sketch: np.ndarray, size: int) -> DataFrame:
    """needs (rid, ...) with the set of each row, common shingles first. Sets are built where the texts are scanned: a bit
    map lets few others through. Of more rows than it is made for, the texts are joined."""
    spark, many = docs.sparkSession, needs.count()
    slots = 1 << max(16, (16 * many - 1).bit_length()) if many else 1 << 16
    rows = docs.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    slot = F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int")
    wanted = None
    if many <= MAPPED:
        wanted = np.zeros(slots >> 6, np.int64)
        words = needs.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
        words = words.toArrow()  # one of 64 slots each, in at most slots / 64 rows
        wanted[words["at"].to_numpy()] = words["bits"].to_numpy()
    else:
        rows = rows.join(needs.select("rid"), "rid", "left_semi")
    shared = spark.sparkContext.broadcast((sketch, wanted))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits = shared.value
        for b in batches:
            if bits is not None:
                at = b.column("slot").to_numpy()
                b = b.filter(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)))
            sets = [np.sort(~ordered(h, levels)).astype("<u8").tobytes() for h in shingles(b.column("text"), size)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(sets, pa.binary())], ["rid", "set"])
        release()

    return rows.withColumn("slot", slot).mapInArrow(build, "rid string, set binary").join(needs, "rid")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, key: str | None = None, tokens: Tokens = rarest) -> DataFrame:
    """rid, doc_id, n_shingles, class_id, component_id, n_links of each row of docs (doc_id, text).

    Texts are linked when 100 * intersection >= percent * union of their sets; component_id is the least doc_id reachable,
    class_id tells equal sets, n_links is the number of other rows that the row is linked with, those of equal sets too.
    Texts without words (null, empty) have no shingles and no links, and are their own components. Repeated rows are of
    one class. Null ids are no one's component_id, unless there is no other. Empty table: no rows. rid is that of
    common.keyed, or the column `key` of docs, a string that tells its rows apart. Other columns aren't read. A text is
    held whole by one task, at some 15 times its bytes.
    """
    docs = keyed(docs.select("doc_id", "text"), "rid") if key is None else docs.select(F.col(key).alias("rid"), "doc_id", "text")
    _, n_bytes = corpus_size(docs)
    slots = slots_for(n_bytes)
    first = materialize(first_scan(docs, size, slots), "jaccard-sets")
    known = first.where("slice IS NULL").select("rid", "doc_id", "n", "sid", "other", "bits")
    sketch = sketch_of(first, slots)
    classes = known.where("n > 0").groupBy("sid", "other", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.min("bits").alias("bits"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    found = materialize(candidates(docs.select("text"), sketch, n_bytes, size, percent, block_bytes, tokens), "jaccard-candidates")
    pairs = possible(enough(found), classes, percent)
    side = lambda s: classes.select(F.col("sid").alias(s), F.col("cid").alias(f"{s}_cid"))
    stars = found.where("kind = 1").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a_cid", "b_cid")
    needs = families(pairs.union(stars), classes)
    made = materialize(within(sets_of(docs, needs, sketch, size), percent), "jaccard-blocks")
    discard(found, needs)
    links = made.where("a IS NOT NULL").select("a", "b", "n")
    blocks = made.where("data IS NOT NULL").select("family", "block", "lo", "hi", "data")
    if not blocks.isEmpty():
        links = materialize(links.union(between(blocks, percent)), "jaccard-links")
        discard(made)
    roots = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("others"))
    joined = classes.join(roots, classes.cid == roots.node, "left").join(counts, classes.cid == counts.a, "left")
    joined = joined.select("sid", "other", classes.n, "cid", "least", F.coalesce("root", "cid").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = materialize(joined, "jaccard-roots")
    discard(roots, classes)
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    # a large component has many classes, a large class many documents
    ids = rejoin(joined, ids, ["root"], "cid").select("sid", "other", "n", "cid", "component_id", "n_links")
    out = rejoin(known.drop("bits"), ids, ["sid", "other", "n"], "rid", "left")
    lone = F.col("n") == 0
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(~lone, F.col("cid")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(lone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the least id (of its rows the first); columns stay. Documents
    without words are no duplicates of each other."""
    key, names = free(docs, "row"), docs.columns
    rows = keyed(docs, key)
    found = near_duplicates(rows, key=key)
    group = F.struct(F.when(F.col("n_shingles") == 0, F.col("rid")).alias("own"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("of"))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select(F.col("m.rid").alias(key))
    return rows.join(materialize(first, "jaccard-first"), key, "left_semi").select(*[column(c) for c in names])


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT a AS r, a AS reach FROM (SELECT DISTINCT a FROM l) UNION SELECT c.r, l.b FROM c JOIN l ON c.reach = l.a),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.reach GROUP BY c.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.r)::BIGINT AS n_links
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r
"""
