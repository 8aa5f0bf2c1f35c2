"""Shared parts of the corpus operators: scratch tables, row keys, byte hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of bytes other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes or words that are hashed at once. Words of more bytes than LONG_WORD are hashed one by one.
SEGMENT, LONG_WORD = 1 << 20, 1024

#: Parts that the rows of one key are dealt to.
SALTS = 16

#: Bytes of text that one group of documents (a block) holds on average.
BLOCK_BYTES = 8 << 20

U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridlore-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        path = _WRITTEN.pop(t, None)
        if path:
            hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and text bytes, by one distributed aggregate."""
    n, b = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(b)


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str):
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: What a plan may do so that each of its rows is a row of a file.
_ROWS_OF_FILES = {"Project", "Filter", "Relation", "SubqueryAlias"}


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name` (string) that tells its rows apart and is the same each time a row is read: the file and
    the row's place in it. Where docs isn't read from files row by row (joined, exploded, made), it is written as a
    numbered table first."""
    steps = {re.sub(r"^\W+", "", x).split(" ")[0].split("[")[0] for x in docs._jdf.queryExecution().analyzed().treeString().splitlines() if x.strip()}
    try:
        if steps <= _ROWS_OF_FILES:
            file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            found = docs.select("*", F.concat(F.hex(F.xxhash64(file)), F.lit(":"), row.cast("string")).alias(name))
            found.schema  # noqa: B018  resolves the metadata
            return found
    except AnalysisException:
        pass
    return materialize(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "rows")


def blocked(docs: DataFrame, n_bytes: int, *keep: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(rid, *keep, text, block), dealt to blocks evenly whatever the values: no text or key can make a block large, other
    than one text that is larger than a block. rid is that of keyed()."""
    n_blocks = max(1, -(-n_bytes // block_bytes))
    rows = keyed(docs.select(*keep, text), "rid").select("rid", *keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n_blocks)).cast("long"))
    return rows.repartition(n_blocks, "block"), n_blocks


def rejoin(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """many joined with few, which has a row a key: a key's rows are dealt to SALTS parts by a hash of `by`, and few has its
    row in each, so that no key makes a task large."""
    spread = few.withColumn("rejoin_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = many.withColumn("rejoin_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [*keys, "rejoin_part"], how).drop("rejoin_part")


def release() -> None:
    """Gives memory that Arrow and the C library hold for later use back to the system: Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def text_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: first row, bytes, offsets (rows + 1) into the bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


#: The modulus of Poly, a Mersenne prime, and how many windows are hashed at once (their arrays stay in the cache).
PRIME, STRIDE = (1 << 31) - 1, 1 << 16


def folded(x: np.ndarray) -> np.ndarray:
    """A number of the same residue modulo PRIME, for x of 62 bits of at most 33."""
    return (x & U64(PRIME)) + (x >> U64(31))


class Poly:
    """Hashes of substrings from prefix sums: two polynomials modulo a prime, each with a base and values of its own, drawn at
    random for each hash. Equal strings have equal hashes anywhere; strings of n values that differ have equal ones for at
    most n^2 of 2^62 bases (modulo a power of two, strings can be made that collide for all)."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, PRIME, (2, 256), dtype=U64)
        self.seed = rng.integers(0, 1 << 64, 1, dtype=U64)
        self.bases = [int(x) for x in rng.integers(1 << 16, PRIME, 2)]
        self.powers = np.ones((2, 2, 1), np.uint32)

    def upto(self, n: int) -> np.ndarray:
        """By lane: the powers of its base and of the base's inverse."""
        if self.powers.shape[2] <= n:
            size = max(n + 1, 1 << 16)
            self.powers = np.ones((2, 2, size), np.uint32)
            for lane, base in enumerate(self.bases):
                for k, step in enumerate((base, pow(base, -1, PRIME))):
                    x, have = self.powers[lane, k], 1  # doubling: the second half is the first times b^have
                    while have < size:
                        more = min(have, size - have)
                        x[have : have + more] = x[:more].astype(U64) * U64(step) % U64(PRIME)
                        have, step = have + more, step * step % PRIME
        return self.powers

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit hashes; at most 2^21."""
        n = len(values)
        out, powers = np.zeros((2, n + 1), U64), self.upto(n)
        if values.dtype != np.uint8:
            values = mix(values ^ self.seed)
        for i in range(0, n, STRIDE):
            v = values[i : i + STRIDE]
            for lane in (0, 1):
                x = self.table[lane][v] if v.dtype == np.uint8 else v >> U64(33) if lane else v & U64(PRIME)
                own = out[lane, i + 1 : i + 1 + len(v)]
                np.cumsum(folded(x * powers[lane, 0, i : i + len(v)]), out=own, dtype=U64)
                own += out[lane, i]
        return out

    def between(self, low: np.ndarray, high: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """low and high: prefix sums by lane; inverse: the inverse powers by lane."""
        lanes = []
        for lane in (0, 1):
            x = folded(folded(folded(high[lane] - low[lane]) * inverse[lane]))
            lanes.append(np.where(x >= U64(PRIME), x - U64(PRIME), x))
        return mix(lanes[0] << U64(32) | lanes[1])

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.between(prefix[:, start], prefix[:, end], self.upto(prefix.shape[1])[:, 1, start])

    def windows(self, values: np.ndarray, w: int) -> np.ndarray:
        """The hash of each run of w values; in segments, so that tables and sums stay small."""
        out = np.empty(max(0, len(values) - w + 1), U64)
        stride = max(STRIDE, w)
        for i in range(0, len(out), stride):
            n = min(stride, len(out) - i)
            p = self.prefix(values[i : i + n + w - 1])
            out[i : i + n] = self.between(p[:, :n], p[:, w:], self.upto(n)[:, 1, :n])
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def segments(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the bytes of texts b[off[i]:off[i + 1]] behind spaces and texts; only a single word makes a segment larger than SEGMENT."""
    i = 0
    while i < len(b):
        z = min(len(b), i + SEGMENT)
        while z < len(b):
            text, space = int(off[np.searchsorted(off, z, "right") - 1]), np.flatnonzero(_SPACE[b[max(i, z - SEGMENT) : z]])
            cut = max(text, max(i, z - SEGMENT) + int(space[-1]) + 1 if len(space) else 0)
            if cut > i:
                z = cut
                break
            space = np.flatnonzero(_SPACE[b[z : z + SEGMENT]])  # the end of a long word
            z = min(int(off[np.searchsorted(off, z, "right")]), z + int(space[0]) if len(space) else z + SEGMENT, len(b))
            if len(space) or z in off[-1:] or z == int(off[np.searchsorted(off, z)]):
                break
        yield i, z
        i = z


def hashed_words(b: np.ndarray, off: np.ndarray, *hashes: Poly) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the texts b[off[i]:off[i + 1]]: start and end bytes of the words, the words' offsets by text, and each word's hashes."""
    starts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[np.zeros(0, U64)] for _ in hashes]
    for i, z in segments(b, off):
        own = np.unique(np.clip(off, i, z)) - i
        start, end, _ = word_bounds(b[i:z], own)
        long = np.flatnonzero(end - start > LONG_WORD)
        for k, f in enumerate(hashes):
            if z - i <= SEGMENT:
                h = f.of(f.prefix(b[i:z]), start, end)
            else:  # one long word
                h = np.zeros(len(start), U64)
            for j in long.tolist():
                h[j] = xxhash.xxh3_64_intdigest(b[i + start[j] : i + end[j]].tobytes(), int(f.seed[0]))
            found[k].append(h)
        starts.append(start + i), ends.append(end + i)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(start, off), [np.concatenate(x) for x in found]


def word_bounds(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words of the texts b[off[i]:off[i + 1]], and the words' offsets by text."""
    inside = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True  # words don't cross texts
    before = np.zeros(len(b), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(b), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def joined(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], "<u8").tobytes() + b"".join(a.tobytes() for a in arrays)


def parted(b: bytes, *types: str) -> list[np.ndarray]:
    cut = np.cumsum([8 * len(types), *np.frombuffer(b, "<u8", len(types)).tolist()]).tolist()
    return [np.frombuffer(b[x:y], t) for x, y, t in zip(cut, cut[1:], types)]
