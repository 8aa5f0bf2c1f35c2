"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, maps letters of other scripts that look like Latin ones, and reads digits and signs beside
letters as the letters they stand for. The lexicon holds word beginnings (and whole short words) that are much more
frequent in texts labelled toxic, weighted by log-odds; exceptions are longer words and two-word phrases around a
lexicon hit that clean texts use. A logistic curve over the hits' weight, also by length, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import column, free, materialize, release

#: Labelled rows that the lexicon and the curve are fitted on, at most, by hash order. They bound the lexicon, too.
SAMPLE = 20_000

# Letters of other scripts that look like Latin letters, and signs read as letters.
LOOKALIKES = dict(zip("абвгеёіїјкмнорсстухуѕԁһԛԝαβεηικνορτυχ", "abbreeiijkmhopcctyxysdhqwabenikvoptux"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_FOLD = str.maketrans(LOOKALIKES)
_SIGN = str.maketrans(SIGNS)
_BESIDE = re.compile(r"(?<=[^\W\d_])[0134578@$]+|[0134578@$]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_MIXED = re.compile(r"[Ͱ-ԯ]")


def fold(text: str) -> list[str]:
    """The words of the folded text: compatibility forms (full-width, mathematical) as plain letters, without accents and
    signs of no width."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", text)))
    text = text.lower()
    if _MIXED.search(text):
        text = text.translate(_FOLD)
    return _WORD.findall(_BESIDE.sub(lambda m: m[0].translate(_SIGN), text))


def terms(words: set[str]) -> set[str]:
    """Candidates for the lexicon: beginnings of 4 to 7 letters, and whole words of 3 letters or more (with an end mark)."""
    out = {w[:k] for w in words for k in range(4, min(7, len(w)) + 1)}
    out.update(w + " " for w in words if 3 <= len(w) <= 24)
    return out


class Lexicon:
    """weights: term -> weight; exceptions: words (' word ') or phrases (' two words ') in which hits don't count."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.auto = ahocorasick.Automaton()
        for t, w in weights.items():
            self.auto.add_word(" " + t, (w, len(t.strip())))
        for e in exceptions:
            self.auto.add_word(e, (None, len(e) - 1))
        self.any = bool(weights)
        if self.any:
            self.auto.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """Summed weight of the hits, the same by the square root of the length in words, and the number of hits."""
        words = fold(text)
        if not self.any or not words:
            return 0.0, 0.0, 0
        flat = " " + " ".join(words) + " "
        hits, spared = {}, []
        for end, (w, n) in self.auto.iter(flat):
            if w is None:
                spared.append((end - n, end))
            else:
                start = flat.rfind(" ", 0, end)  # the word that the hit begins; of several hits of a word the heaviest counts
                hits[start] = max(hits.get(start, 0.0), w)
        if spared:  # exceptions begin at a space each; the furthest end so far decides
            spared.sort()
            begins, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            hits = {s: w for s, w in hits.items() if not (k := bisect_right(begins, s)) or ends[k - 1] <= s}
        total = math.fsum(hits.values())
        return total, total / math.sqrt(len(words)), len(hits)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def counted(sample: DataFrame, kind) -> DataFrame:
    """term, toxic and clean documents that have it; kind: folded words -> terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            keys = list(by[0].keys() | by[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][t] for t in keys], pa.int64()), pa.array([by[0][t] for t in keys], pa.int64())], ["term", "toxic", "clean"])
            by[0].clear(), by[1].clear()
            return out

        for b in batches:
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                by[y].update(kind(fold(text.as_py())))
                if len(by[0]) + len(by[1]) > 100_000:
                    yield flush()
        yield flush()
        release()

    return sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (p - y) + ridge * c
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[str], list[float]]:
    """The lexicon, the exceptions and the curve, from labelled rows that aren't held out. Statistics are distributed;
    what comes to the driver is bounded by `sample`. Rows without an id are held out. No toxic or no clean row: an empty lexicon and a
    constant score, the share of toxic rows (0 without any)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxic-sample")
    n = dict(rows.groupBy("toxic").count().collect())
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        share = (pos + 0.5 * (pos > 0)) / (pos + neg + 1)
        return {}, [], [0.0, 0.0, 0.0, math.log(share / (1 - share)) if share else -20.0]
    stats = materialize(counted(rows, lambda words: terms(set(words))), "toxic-terms")
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    both = F.col("toxic") + F.col("clean")
    # G-squared against an even spread; the bar rises with the number of terms tried
    part = lambda k, m: F.when(k > 0, k * F.log(k * (pos + neg) / (both * m))).otherwise(0.0)
    bar = 2 * math.log(max(2, stats.where("toxic >= 4").count())) + 3
    found = stats.select("term", "toxic", odds.alias("odds"), (2 * (part(F.col("toxic"), pos) + part(F.col("clean"), neg))).alias("g")).where((F.col("odds") > 1.5) & (F.col("g") > bar) & (F.col("toxic") >= 4))
    kept: dict[str, float] = {}
    top = sorted(found.select("term", "odds").collect(), key=lambda r: (len(r["term"]), r["term"]))
    for t, w in ((r["term"], r["odds"]) for r in top):  # shorter beginnings first; a longer one only where it says clearly more
        if not any(w <= kept[t[:i]] + 1.0 for i in range(4, len(t)) if t[:i] in kept):
            kept[t] = w

    def around(words: list[str]) -> set[str]:
        out = set()
        for i, w in enumerate(words):
            if any(w[:k] in kept for k in range(4, min(7, len(w)) + 1)) or w + " " in kept:
                out.add(f" {w} ")
                if i:
                    out.add(f" {words[i - 1]} {w} ")
                if i + 1 < len(words):
                    out.add(f" {w} {words[i + 1]} ")
        return out

    spare = counted(rows, around).where((F.col("clean") >= 5) & (odds < 0)).orderBy("term")
    exceptions = [r["term"] for r in spare.collect()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(kept, exceptions)
        for b in batches:
            f = [lex.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(pa.array([float(r[i]) for r in f], pa.float64()) for i in range(3)), b.column("toxic"), b.column("h")], ["a", "b", "c", "toxic", "h"])

    # ids that repeat have more rows than labels; the curve takes as many as the bound allows
    seen = rows.withColumn("h", F.xxhash64("text")).mapInArrow(measure, "a double, b double, c double, toxic int, h long").orderBy("h", "toxic", "a", "b", "c").limit(sample).toArrow().to_pandas()
    x = np.column_stack([np.log1p(seen["a"]), np.log1p(seen["b"]), np.log1p(seen["c"])])
    return kept, exceptions, [float(v) for v in fit_curve(x, seen["toxic"].to_numpy(float))]


def scored(docs: DataFrame, model, *keep: str, score: str = "tx_score") -> DataFrame:
    """docs' columns keep, and the score, under a name that isn't among these. Null text counts as empty; repeated rows are
    rows of their own; an empty table gives no rows. A text is held whole, at some 100 times its bytes while its words are
    folded."""
    weights, exceptions, curve = model
    kept = [column(c).alias(f"c{i}") for i, c in enumerate(keep)]  # mapInArrow takes plain names only
    schema = docs.select(*kept, F.lit(0.0).alias("score")).schema

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(weights, exceptions)
        for b in batches:
            out = []
            for t in b.column(len(keep)):
                f = [math.log1p(v) for v in lex.features(t.as_py() or "")]
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(v * c for v, c in zip(f, curve)) + curve[3])))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.float64())], schema.names)

    return docs.select(*kept, F.col("text").alias("text")).mapInArrow(rate, schema).toDF(*keep, score)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, train(docs, labels), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below one half; the columns stay, whatever their names, rows with null ids or texts too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free(docs, "tx_score")
    return scored(docs, train(docs, labels), *docs.columns, score=score).where(column(score) < 0.5).select(*map(column, docs.columns))
