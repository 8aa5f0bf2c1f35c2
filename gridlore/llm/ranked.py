"""Ranked lexical search by variable-block-max WAND.

Documents are scanned once for each block of queries; only postings of the queries' terms are kept, as a table that needs
no shuffle: a task's share of it is cut into shards by postings. In a shard, documents stand in order of length, and the
boundaries of each posting list's blocks are chosen by dynamic programming: the sum over blocks of (largest impact x
documents spanned), which is the error of the bounds but for a constant, plus a price for each block, is least. A search
adds the block maxima of its terms over the shard's documents, goes on from pivot to pivot (documents whose bound reaches
the least score of the best so far), and reads postings of these alone. All of it is exact, in integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import materialize, release

#: Terms are these bytes' runs: digits, ASCII letters, and all of letters beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_EDGE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are taken apart at once; (query, term) rows of a block of queries; postings of a shard.
PIECE, QUERY_TERMS, SHARD = 1 << 20, 1 << 17, 1 << 21
#: Postings of a block at most; a block's price, in documents at the list's largest impact.
LONGEST, PRICE = 64, 8
#: Documents whose postings are read at once, at first and at most.
FIRST_READ, MOST_READ = 64, 4096


def counted(text: bytes) -> Counter:
    """The terms of a text, ASCII letters lower-cased, with their numbers."""
    out: Counter = Counter()
    i = 0
    while i < len(text):
        z = i + PIECE
        if z < len(text):  # a term goes on to its end
            edge = _EDGE.search(text, z)
            z = edge.start() if edge else len(text)
        out.update(TERM.findall(text[i:z].lower()))
        i = z
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """item (a row's number), item_id, term of queries (item_id, text), each term once; written, so that numbers stay."""
    rows = materialize(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "ranked-queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, x) for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()) for x in counted(t)]
            at = pa.array([i for i, _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item").take(at), b.column("item_id").take(at), pa.array([x for _, x in own], pa.binary())], ["item", "item_id", "term"])

    return rows.mapInArrow(scan, f"item long, item_id {dict(rows.dtypes)['item_id']}, term binary")


POSTED = "doc_id {}, n long, terms array<int>, tfs array<int>"


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (its terms with repeats), and the numbers and counts of the terms given, of each document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            n, own, tf = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                c = counted(t or b"")
                found = sorted((number[x], k) for x, k in c.items() if x in number)
                n.append(c.total()), own.append([x for x, _ in found]), tf.append([k for _, k in found])
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0))
        release()

    return docs.select("doc_id", "text").mapInArrow(scan, POSTED.format(dict(docs.dtypes)["doc_id"]))


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of n terms; whole numbers of any size."""
    if 90 * int(n.max()) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // total
    return np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)


def block_ends(doc: np.ndarray, impact: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where blocks end in posting lists laid end to end (list i: start[i] to start[i + 1]): of all ways to cut a list into
    blocks of at most LONGEST postings, that of the least sum of largest impact x documents spanned + price. All lists go
    forward together, the long ones first."""
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    begin, size = start[:-1][order], size[order]
    price = PRICE * np.maximum.reduceat(impact, start[:-1])[order].astype(np.float64) if len(size) else np.zeros(0)
    step = np.zeros(len(doc), np.uint8)  # the length of the block that ends with a posting, less one
    # by list and by how many postings a block has before its last: best sum before it, its first document, largest impact
    best = np.full((len(size), LONGEST), np.inf)
    first, most = np.zeros((len(size), LONGEST)), np.zeros((len(size), LONGEST))
    last = np.zeros(len(size))
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, "left"))  # lists that have posting j
        at = begin[:k] + j
        best, first, most, last = best[:k], first[:k], most[:k], last[:k]
        for x, new in ((best, last), (first, doc[at]), (most, 0)):
            x[:, 1:] = x[:, :-1].copy()
            x[:, 0] = new
        np.maximum(most, impact[at][:, None], out=most)
        total = best + most * (doc[at][:, None] + 1 - first)
        chosen = np.argmin(total, axis=1)
        last = total[np.arange(k), chosen] + price[:k]
        step[at] = chosen
    ends = []
    for a, z in zip(start[:-1].tolist(), start[1:].tolist()):
        own, i = [], z
        while i > a:
            own.append(i)
            i -= int(step[i - 1]) + 1
        ends += own[::-1]
    return np.array(ends, np.int64)


class Shard:
    """Posting lists of some documents, in blocks."""

    def __init__(self, doc_id: pa.Array, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n_docs: int, total: int):
        by_id = np.empty(len(n), np.int64)  # ids' order, null last
        by_id[pc.sort_indices(doc_id, null_placement="at_end").to_numpy()] = np.arange(len(n))
        order = np.lexsort((by_id, n))
        self.ids, self.rank, self.n_docs = doc_id.take(pa.array(order)), by_id[order], len(n)
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        doc, m = np.repeat(place, sizes), np.repeat(lengths(n, n_docs, total), sizes)
        key = terms.astype(np.int64) * self.n_docs + doc
        by = np.argsort(key)
        tf = tfs.astype(np.int64)
        self.keys, self.impacts = key[by], (1_000_000_000 * tf // (1000 * tf + 8 * m))[by]
        doc, terms = doc[by], terms[by]
        new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        start = np.append(new, len(terms))
        ends = block_ends(doc, self.impacts, start)
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        self.low, self.high = doc[begins], doc[ends - 1] + 1
        self.most = np.maximum.reduceat(self.impacts, begins) if len(ends) else ends
        of = np.searchsorted(ends, start)  # each list's first block
        at = np.append(0, np.searchsorted(ends, start[1:]) + 1) if len(ends) else of
        self.blocks = {t: (a, z) for t, a, z in zip(terms[new].tolist(), at.tolist(), at[1:].tolist())}

    def read(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents."""
        want = terms[:, None] * self.n_docs + docs
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (weights[:, None] * np.where(self.keys[at] == want, self.impacts[at], 0)).sum(axis=0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best with a score above 0, equal ones by id."""
        held = np.array([t in self.blocks for t in terms.tolist()], bool) & (weights > 0)
        terms, weights = terms[held], weights[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores
        cut = [self.blocks[t] for t in terms.tolist()]
        block = np.concatenate([np.arange(a, z) for a, z in cut])
        value = np.repeat(weights, [z - a for a, z in cut]) * self.most[block]
        bound = np.zeros(self.n_docs + 1, np.int64)
        np.add.at(bound, self.low[block], value)
        np.subtract.at(bound, self.high[block], value)
        bound = np.cumsum(bound)[:-1]

        def take(some: np.ndarray) -> int:
            """Puts documents among the best; the score that others must reach."""
            nonlocal docs, scores
            docs, scores = np.append(docs, some), np.append(scores, self.read(some, terms, weights))
            docs, scores = docs[scores > 0], scores[scores > 0]
            best = np.lexsort((self.rank[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            return int(scores[-1]) if len(scores) == k else 1

        # a floor from the documents of the greatest bounds
        some = np.argpartition(-bound, FIRST_READ)[:FIRST_READ] if len(bound) > FIRST_READ else np.arange(len(bound))
        floor, done = take(some), np.zeros(self.n_docs, bool)
        done[some] = True
        at, size = 0, FIRST_READ
        while at < self.n_docs:  # pivots, in order
            pivots = np.flatnonzero((bound[at : at + 16 * size] >= floor) & ~done[at : at + 16 * size])[:size] + at
            if len(pivots) < size:
                at += 16 * size
            else:
                at = int(pivots[-1]) + 1
            if len(pivots):
                floor = take(pivots)
            size = min(2 * size, MOST_READ)
        return docs, scores


def searched(posted: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score, part: each shard's k best of each item (number, terms, weights)."""
    shared, kind = posted.sparkSession.sparkContext.broadcast(items), dict(posted.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cols = [t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in t.column_names]
            own = Shard(cols[0], cols[1].to_numpy(), cols[2].flatten().to_numpy(), cols[3].flatten().to_numpy(), pc.list_value_length(cols[2]).to_numpy(), n_docs, total)
            item, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for number, terms, weights in shared.value:
                d, s = own.search(terms, weights, k)
                item += [number] * len(d)
                docs.append(d), scores.append(s)
            ids = own.ids.take(pa.array(np.concatenate(docs)))
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(np.concatenate(scores), pa.int64())], ["item", "doc_id", "score"])

        n = 0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                held.append(b.slice(i, 1024))
                n += len(held[-1].column("terms").flatten())
                if n > SHARD:
                    yield shard()
                    n = 0
        if held:
            yield shard()
        release()

    return posted.where(F.size("terms") > 0).mapInArrow(scan, f"item long, doc_id {kind}, score long").withColumn("part", F.spark_partition_id())


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of queries (item_id, text) the k rows of docs (doc_id, text) that score
    highest, above 0, equal scores by doc_id.

    Terms are runs of letters beyond ASCII, ASCII letters and digits, only A-Z lower-cased; a score is a sum over the
    query's distinct terms of weight x (10^9 tf div (1000 tf + 8 m)), with the weight by document frequency and m by
    length. Null and empty texts have no terms: as documents they aren't found and don't count, as queries they find
    nothing. Null doc_ids come last among equals; repeated rows are documents or queries of their own. Empty tables: no
    rows. Other columns aren't read. Queries go in blocks of QUERY_TERMS terms, so what is broadcast doesn't grow; a text
    is taken apart in pieces, its distinct terms are held.
    """
    spark = docs.sparkSession
    asked = materialize(query_terms(queries), "ranked-terms")
    n_rows = asked.count()
    n_blocks = max(1, -(-n_rows // QUERY_TERMS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    best = []
    for part in range(n_blocks):
        own = asked.where(F.col("part") == part).select("item", "term").toArrow()  # a bounded block of queries
        numbers, terms = own["item"].to_numpy(), own["term"].to_pylist()
        distinct = sorted(set(terms))
        posted = materialize(postings(docs, distinct), "ranked-postings")
        n_docs, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not distinct:
            continue
        held = {r[0]: r[1] for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        weights = np.array([weight(held.get(i, 0), n_docs) for i in range(len(distinct))], np.int64)
        number = {t: i for i, t in enumerate(distinct)}
        at = np.array([number[t] for t in terms], np.int64)
        order = np.argsort(numbers, kind="stable")
        cuts = np.flatnonzero(np.append(True, numbers[order][1:] != numbers[order][:-1])).tolist()
        items = [(int(numbers[order[a]]), np.sort(at[order[a:z]])) for a, z in zip(cuts, [*cuts[1:], len(order)])]
        best.append(searched(posted, [(i, t, weights[t]) for i, t in items], n_docs, total, k))
    if not best:
        return spark.createDataFrame([], f"item_id {dict(queries.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    found = best[0]
    for b in best[1:]:
        found = found.union(b)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # shards' best first among some, then among all
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(64))).orderBy(*order))).where(F.col("r") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    ids = asked.select("item", "item_id").distinct()
    return out.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs.select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS ts FROM benchmark),
q AS (SELECT item, unnest(ts) AS t FROM b),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
x AS (SELECT q.item, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM x WHERE score > 0) JOIN b USING (item) WHERE rank <= 10
"""
