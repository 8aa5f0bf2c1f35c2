"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import ranked as R

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, queries, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, q in queries:
        found = []
        for d, c in docs:
            m = 10 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(q)) & c.keys())
            if s > 0:
                found.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def made(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "ABC", "日本", "x y", "3d"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i if i % 17 else None, rnd.choice([" ", "\n", ", ", "-"]).join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 3, 30, 200])))) for i in range(n)]
    docs += docs[:9] + [(5000 + i, "abc the same text w3") for i in range(40)] + [(9000, None), (9001, "\u007f\u0080 ;"), (9002, "w1 " * 30_000 + "unique")]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(30)] + [(3, "w0 w0 W0"), (None, "abc"), (77, None), (78, "..."), (79, "nowhere"), (80, "unique w3")]
    return docs, queries


@pytest.mark.parametrize("queries_at_once", [1 << 17, 60])
def test_ranked(spark, monkeypatch, queries_at_once):
    monkeypatch.setattr(R, "QUERY_TERMS", queries_at_once)
    docs, queries = made(400, 2)
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, item long, terms string").repartition(3)
    q = spark.createDataFrame([(*x, 0) for x in queries], "item_id long, text string, term int")
    got = R.ranked(d, q, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, queries, 10)


def test_shards():
    docs, queries = made(300, 7)
    docs = [(d, t) for d, t in docs if terms(t)]
    number = {t: i for i, t in enumerate(sorted({t for _, q in queries for t in terms(q)}))}
    own = [sorted((number[t], k) for t, k in Counter(terms(t)).items() if t in number) for _, t in docs]
    n = np.array([len(terms(t)) for _, t in docs])
    df = Counter(t for x in own for t, _ in x)
    weights = np.array([R.weight(df[i], len(docs)) for i in range(len(number))])
    best = {}
    for part in range(3):
        at = list(range(part, len(docs), 3))
        flat = [x for i in at for x in own[i]]
        shard = R.Shard(pa.array([docs[i][0] for i in at], pa.int64()), n[at], np.array([t for t, _ in flat], np.int32), np.array([k for _, k in flat], np.int32), np.array([len(own[i]) for i in at]), len(docs), int(n.sum()))
        for j, (_, q) in enumerate(queries):
            t = np.array(sorted({number[x] for x in terms(q)}), np.int64)
            d, s = shard.search(t, weights[t] if len(t) else t, 5)
            best.setdefault(j, []).extend(zip((-s).tolist(), [x is None for x in shard.ids.take(pa.array(d)).to_pylist()], shard.ids.take(pa.array(d)).to_pylist()))
    got = [(queries[j][0], i + 1, d, -s) for j, b in best.items() for i, (s, _, d) in enumerate(sorted(b, key=lambda x: (x[0], x[1], x[2] or 0))[:5])]
    assert sorted(got, key=repr) == plain(docs, queries, 5)


def test_blocks_are_the_best():
    rnd = random.Random(9)
    for _ in range(40):
        lists = [(sorted(rnd.sample(range(300), k)), [rnd.randint(1, 1000) for _ in range(k)]) for k in (rnd.randint(1, 100) for _ in range(rnd.randint(1, 6)))]
        doc, impact = (np.array([x for own in lists for x in own[i]], np.int64) for i in (0, 1))
        start = np.cumsum([0, *(len(d) for d, _ in lists)])
        ends = R.block_ends(doc, impact, start)
        assert set(start[1:].tolist()) <= set(ends.tolist()) and (np.diff(np.append(0, ends)) <= R.LONGEST).all()
        for (d, x), a, z in zip(lists, start, start[1:]):
            price, least = R.PRICE * max(x), [0.0]
            for j in range(1, len(d) + 1):
                least.append(min(least[i] + max(x[i:j]) * (d[j - 1] + 1 - d[i]) + price for i in range(max(0, j - R.LONGEST), j)))
            own = [int(e - a) for e in ends if a < e <= z]
            assert sum(max(x[i:j]) * (d[j - 1] + 1 - d[i]) + price for i, j in zip([0, *own], own)) == least[-1]


def test_pieces_and_lengths(monkeypatch):
    text = ("é" * 50 + " Ab1_" * 30 + "x" * 400 + ".") * 3
    whole = R.counted(text.encode())
    monkeypatch.setattr(R, "PIECE", 7)
    assert R.counted(text.encode()) == whole == Counter(t.encode() for t in terms(text))
    assert R.lengths(np.array([3, 10**9]), 10**11, 10**12).tolist() == [10 + 90 * 3 * 10**11 // 10**12, 10 + 90 * 10**20 // 10**12]


def test_empty(spark):
    docs, queries = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.ranked(docs, queries).collect() == R.ranked(docs, some).collect() == R.ranked(some.toDF("doc_id", "text"), queries).collect() == []
