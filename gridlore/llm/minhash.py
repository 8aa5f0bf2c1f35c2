"""MinHash near-duplicates by fast similarity sketching.

A sketch has t coordinates. In each of t rounds every shingle is hashed to a coordinate and a value; a coordinate keeps
the least (round, value) that falls on it, so the rounds end as soon as all are full: after about t ln t placements,
whatever the set's size. Coordinates that t rounds leave empty are filled by t rounds more, the j-th of which places all
shingles on coordinate j, so every coordinate is filled. Two sketches agree in a coordinate with the probability of the
sets' similarity, and the number of agreements is concentrated as if coordinates were independent. Bands of ROWS
coordinates are tokens: sets of the least similarity that counts share one but for once in MISSED^-1 pairs. Every
link is then confirmed on the full sets, as in the n-gram join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import mix
from gridlore.llm.jaccard import near_duplicates

#: Coordinates of a band, and the share of pairs just similar enough that may have no band in common.
ROWS, MISSED = 4, 1e-9

U64 = np.uint64
_EMPTY, _LOW = ~U64(0), U64(0xFFFFFFFF)


def bands(percent: int) -> int:
    """How many bands leave MISSED of the pairs of a similarity of percent / 100 without one that agrees."""
    hit = (percent / 100) ** ROWS
    return 1 if hit >= 1 else math.ceil(math.log(MISSED) / math.log1p(-hit))


def seeds(t: int) -> np.ndarray:
    """Of the 2 t rounds."""
    return mix(np.arange(1, 2 * t + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray, t: int, seed: np.ndarray) -> np.ndarray:
    """The t coordinates of a set of hashes that isn't empty: the round in the upper half, the value in the lower."""
    out, done = np.full(t, _EMPTY), 0
    placed = max(1, math.ceil(t * (math.log(t) + 2)))
    while done < t:
        rounds = min(t - done, -(-placed // len(h)))
        x = mix(h[None, :] ^ seed[done : done + rounds, None])
        at = ((x >> U64(32)) * U64(t)) >> U64(32)
        value = (np.arange(done, done + rounds, dtype=U64)[:, None] << U64(32)) | (x & _LOW)
        np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        done += rounds
        if not (out == _EMPTY).any():  # later rounds have greater values
            return out
    empty = np.flatnonzero(out == _EMPTY)
    for j in empty.tolist():
        out[j] = (U64(t + j) << U64(32)) | (mix(h ^ seed[t + j]) & _LOW).min()
    return out


def banded(_: np.ndarray, percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """Tokens of a set: a hash of each band of its sketch."""
    n = bands(percent)
    seed, band = seeds(n * ROWS), mix(np.arange(1, n + 1, dtype=U64))

    def tokens(h: np.ndarray) -> np.ndarray:
        out = band.copy()
        for x in sketch(h, n * ROWS, seed).reshape(n, ROWS).T:
            out = mix(out ^ x) + x
        return out

    return tokens


def near_copies(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, n_links, kept of each row of docs (doc_id, text): as near_duplicates(), with
    candidates by sketches; kept: the row's id is its component's.

    A pair that is linked is missed as a candidate once in 10^9 at most, and then stays linked where others connect it.
    Texts without words are their own components and kept; null ids are kept where their component has no other id, and
    repeated ids together. Empty table: no rows.
    """
    out = near_duplicates(docs, size, percent, tokens=banded)
    return out.select("rid", "doc_id", "n_shingles", "component_id", "n_links", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_copies(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, hash(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT a AS r, a AS reach FROM (SELECT DISTINCT a FROM l) UNION SELECT c.r, l.b FROM c JOIN l ON c.reach = l.a),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.reach GROUP BY c.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM coalesce(m.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r
"""
