"""Substring dedup by difference-cover anchors.

Modulo PERIOD, the positions of COVER meet every difference: of any two places in two documents, some shift below
PERIOD brings both onto cover positions. So two equal windows of WINDOW words share an aligned anchor, the
WINDOW - PERIOD + 1 words from a cover position on. Only anchors are hashed and compared over the corpus; from each
that occurs again the match is extended both ways: the windows around it are compared as wholes, by 96 bits of two
hashes that have no step in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm import repeats as R
from gridlore.llm.common import Poly, blocked, corpus_size, hashed_words, release, text_chunks

# A perfect difference set.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

_WORD1, _WORD2, _ANCHOR, _FIRST, _SECOND = (Poly(11 + i) for i in range(5))


class Words:
    """The words of a block's documents, in order of rid."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("rid")
        self.chunks = [(b, off, *hashed_words(b, off, _WORD1, _WORD2)) for _, b, off in text_chunks(self.table["text"])]
        self.first, self.second = (np.concatenate([np.zeros(0, np.uint64), *(c[5][k] for c in self.chunks)]) for k in (0, 1))
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c[4]) for c in self.chunks)])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def inside(self, length: int) -> np.ndarray:
        """Whether a run of length words from each word on stays in its document."""
        n = len(self.first)
        return np.arange(n) + length <= np.repeat(self.offsets[1:], self.sizes)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the anchors, and their hashes."""
        long = np.repeat(self.sizes >= window, self.sizes)
        place = np.arange(len(self.first)) - np.repeat(self.offsets[:-1], self.sizes)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(long & cover[place % PERIOD] & self.inside(window - PERIOD + 1))
        return at, _ANCHOR.windows(self.first, window - PERIOD + 1)[at]

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window from each word on, as far as there are enough words."""
        return _FIRST.windows(self.first, window), _SECOND.windows(self.second, window)

    def candidates(self, window: int, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor of those at the words hit."""
        n = len(self.first)
        d = np.zeros(n + 1, np.int32)
        np.add.at(d, np.maximum(hit - PERIOD + 1, np.repeat(self.offsets[:-1], self.sizes)[hit] if len(hit) else hit), 1)
        np.add.at(d, hit + 1, -1)
        return np.flatnonzero((np.cumsum(d)[:n] > 0) & self.inside(window))


def dedup_passages(docs: DataFrame, window: int = 35, **blocks: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row of docs (doc_id, text): without the words that are covered by a
    window whose word sequence also starts elsewhere, judged on the input; kept joins the other words by a space.

    Null text has no words; texts of fewer words than a window keep all; repeated rows repeat each other. Empty
    table: no rows. A text is held whole by one task, at some 12 times its bytes; hashes go in segments.
    """
    _, n_bytes = corpus_size(docs)
    texts, n = blocked(docs, n_bytes, "doc_id", **blocks)

    def number(t: pa.Table) -> int:
        return t["block"][0].as_py() if len(t) else 0

    def anchors(t: pa.Table) -> pa.Table:
        _, h = Words(t).anchors(window)
        return R.placed_rows(number(t), R.distinct(h, np.zeros(len(h), np.uint8))[0])

    def around(t: pa.Table, back: pa.Table):
        """The block's words, the starts of windows around anchors that occur again, and these windows: distinct ones, the
        place of each start in them, and their counts."""
        w = Words(t)
        at, h = w.anchors(window)
        _, _, place, counts = R.distinct(h, np.zeros(len(h), np.uint8))
        start = w.candidates(window, at[R.flags(counts, back)[place]])
        a, b = w.windows(window)
        return w, start, R.distinct(a[start], (b[start] >> np.uint64(32)).astype(np.uint32))

    def extend(t: pa.Table, back: pa.Table) -> pa.Table:
        _, _, (u1, u2, _, _) = around(t, back)
        return R.placed_rows(number(t), u1, u2)

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        first = back.filter(pa.array(back["step"].to_numpy() == 0)) if len(back) else back
        w, start, (_, _, place, counts) = around(t, first)
        hit = start[R.flags(counts, back.filter(pa.array(back["step"].to_numpy() == 1)) if len(back) else back)[place]]
        gone = np.zeros(len(w.first), bool)
        if len(hit):
            d = np.zeros(len(w.first) + 1, np.int32)
            np.add.at(d, hit, 1)
            np.add.at(d, hit + window, -1)
            gone = np.cumsum(d)[:-1] > 0
        kept, at = [], 0
        for b, off, s, e, wo, _ in w.chunks:
            stays = np.flatnonzero(~gone[at : at + len(s)])
            at += len(s)
            doc = np.searchsorted(wo, stays, "right") - 1
            more = np.zeros(len(stays), bool)  # another word of the document follows
            more[:-1] = doc[1:] == doc[:-1]
            m = np.zeros(len(b) + 1, np.int8)  # words don't touch but at the edge of texts, where 1 and -1 meet
            np.add.at(m, s[stays], 1)
            np.add.at(m, e[stays], -1)
            mask = np.cumsum(m, dtype=np.int8)[:-1] > 0
            gap = e[stays[more]]
            mask[gap] = True
            out = b.copy()
            out[gap] = 0x20
            size = np.concatenate([[0], np.cumsum(mask)])[off]
            out = out[mask].tobytes()
            kept += [out[size[i] : size[i + 1]] for i in range(len(off) - 1)]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.offsets])
        out = pa.table({"doc_id": w.table["doc_id"], "n_words": pa.array(w.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})
        release()
        return out

    again = R.shared(texts.groupBy("block").applyInArrow(anchors, R.PLACED), n)
    wider = texts.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(extend, R.WIDE)
    back = again.withColumn("step", F.lit(0)).union(R.shared(wider, n).withColumn("step", F.lit(1)))
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op8_cover_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = dedup_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(35)) AS i FROM hit),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT w.r, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN w.w END, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""
