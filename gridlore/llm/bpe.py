"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens. A block of documents keeps, for each document, its pre-tokens in order as numbers of
the block's own word list, and sends its distinct words, packed by hash, to buckets. A bucket encodes each distinct word
once, whichever blocks sent it, and returns the ids to these blocks, which put them in place by position. Decoding
joins the table of the ids' bytes. A block sends GROUPS messages at most, and of a corpus of more buckets only so many
blocks share them (some 3 GB of text), so work is linear in the blocks and a word of all documents is no hot key.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import BLOCK_BYTES, corpus_size, joined, parted, release
from gridlore.llm.repeats import PARTITIONS

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def newer_letters(ranks: dict[bytes, int]) -> str:
    """Characters that the regex module takes for letters or numbers and tiktoken, with older Unicode tables, doesn't."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        t = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        out += sorted(set(regex.findall(kind, every)) - set(t.decode(t.encode_ordinary(every))))
    return "".join(out)


class Splitter:
    """The pre-tokens of a text, as tiktoken finds them."""

    def __init__(self, newer: str, pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        self.newer = frozenset(newer)
        self.maybe = re.compile(f"[{min(newer)}-\U0010ffff]") if newer else None

    def __call__(self, text: str) -> list[str]:
        if self.maybe is None or text.isascii() or not self.maybe.search(text) or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        # matched on a text of the same length in which such characters are of no class
        plain = "".join("\ue000" if c in self.newer else c for c in text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(plain)]


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        table[i] = b
    return table


#: Rows of a block (number null): its documents' ids, numbers of tokens, and words as numbers, packed. Rows of words: those of a
#: hash group (number), packed. No lists: Spark adds up a list column's rows for each row that it hands to Python.
PARTS = "to long, block long, number int, data binary"
#: Hash groups of a block's words.
GROUPS = 192

_CODERS: dict[int, tuple[tiktoken.Encoding, list[bytes]]] = {}


def coder(shared) -> tuple[tiktoken.Encoding, list[bytes]]:
    """What encodes one pre-token as a whole, and the bytes of each id; made once a worker."""
    if shared.value[2] not in _CODERS:
        _CODERS.clear()
        ranks = shared.value[0]
        _CODERS[shared.value[2]] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), token_table(ranks)
    return _CODERS[shared.value[2]]


def encode(docs: DataFrame, ranks_path: str = public_tokenizers.path(VOCABULARY), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes) of each row of docs (doc_id, text).

    Null text is empty and has no tokens. Repeated rows are rows of their own, null ids stay. Empty table: no rows. A
    text is held whole by one task. The vocabulary is broadcast; its file bounds it.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, newer_letters(ranks), hash(ranks_path)))
    _, n_bytes = corpus_size(docs)
    n_buckets = max(1, -(-n_bytes // (2 * block_bytes)))
    groups = min(n_buckets, GROUPS)
    slices = -(-n_buckets // groups)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, seq = Splitter(shared.value[1]), TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        doc_ids, tokens, numbers, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = (part << 24) + seq
            raw = [w.encode() for w in words]
            group = np.array([xxhash.xxh64_intdigest(r) % groups for r in raw], np.int64)
            order = np.argsort(group, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            data = place[np.concatenate(numbers)] if numbers else np.zeros(0, np.uint32)
            known = np.array([d is not None for d in doc_ids], "u1")
            yield as_batch([block], [block], [None], [joined(np.array([d or 0 for d in doc_ids], "<i8"), known, np.array(tokens, "<i8"), np.frombuffer(squeeze(data), "u1"))])
            own, cut = np.unique(group[order], return_index=True)
            to, sent = [], []
            for g, i, z in zip(own.tolist(), cut.tolist(), [*cut[1:].tolist(), len(order)]):
                some = [raw[k] for k in order[i:z].tolist()]
                to.append(-1 - (block % slices * groups + g))
                sent.append(joined(np.array([len(r) for r in some], "<u4"), np.frombuffer(b"".join(some), "u1")))
            yield as_batch(to, [block] * len(to), own.tolist(), sent)

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py() or ""
                found = split(text)
                number = np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found))
                doc_ids.append(doc_id), tokens.append(len(found)), numbers.append(number)
                held += len(text)
                if held >= block_bytes:
                    yield from flush()
                    seq += 1
                    words, doc_ids, tokens, numbers, held = {}, [], [], [], 0
        if doc_ids:
            yield from flush()
        release()

    def encode_words(t: pa.Table) -> pa.Table:
        """Of a bucket: each distinct word encoded once, and the ids for each block that sent it."""
        out = []
        if t["to"][0].as_py() < 0:
            enc, _ = coder(shared)
            sizes, raw = zip(*(parted(d.as_py(), "<u4", "u1") for d in t["data"]))
            rows = np.cumsum([0, *map(len, sizes)])
            cut = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            word = pa.Array.from_buffers(pa.large_binary(), int(rows[-1]), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(np.concatenate(raw).tobytes())]).dictionary_encode()
            ids = [enc.encode_ordinary(w.decode()) for w in word.dictionary.to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            flat, start, which = np.fromiter((x for own in ids for x in own), np.uint32, int(n.sum())), np.cumsum(n) - n, word.indices.to_numpy()
            for block, group, i, z in zip(t["block"].to_pylist(), t["number"].to_pylist(), rows.tolist(), rows[1:].tolist()):
                m = n[own := which[i:z]]
                here = flat[np.repeat(start[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                out.append((block, group, joined(np.frombuffer(squeeze(m.astype(np.uint32)), "u1"), np.frombuffer(squeeze(here), "u1"))))
            release()
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["to", "number", "ids"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        if len(left) and left["to"][0].as_py() >= 0:
            _, table = coder(shared)
            got = sorted(zip(right["number"].to_pylist(), right["ids"].to_pylist()))
            n, ids = zip(*([expand(x.tobytes()) for x in parted(d, "u1", "u1")] for _, d in got)) if got else ([], [])
            n, ids = np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64), np.concatenate([np.zeros(0, np.uint32), *ids])
            start = np.cumsum(n) - n
            doc_ids, known, tokens, data = parted(left["data"][0].as_py(), "<i8", "u1", "<i8", "u1")
            doc_ids = [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist())]
            numbers, at = expand(data.tobytes()), 0
            for doc_id, k in zip(doc_ids, tokens.tolist()):
                own = numbers[at : at + k]
                at += k
                m = n[own]
                here = ids[np.repeat(start[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                cols["doc_id"].append(doc_id), cols["n_tokens"].append(len(here))
                cols["ids"].append(here.astype("<u4").tobytes()), cols["decoded"].append(decode_ids(here, table))
        out = pa.table({"doc_id": pa.array(cols["doc_id"], pa.int64()), "n_tokens": pa.array(cols["n_tokens"], pa.int64()), "ids": pa.array(cols["ids"], pa.binary()), "decoded": pa.array(cols["decoded"], pa.binary())})
        release()
        return out

    n_parts = min(3 * n_buckets, PARTITIONS)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parse, PARTS).repartition(n_parts, "to")
    coded = parts.groupBy("to").applyInArrow(encode_words, "to long, number int, ids binary").repartition(n_parts, "to")
    return parts.groupBy("to").cogroup(coded.groupBy("to")).applyInArrow(assemble, "doc_id long, n_tokens long, ids binary, decoded binary")


def as_batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PARTS.split(", ")])


def squeeze(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def expand(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
