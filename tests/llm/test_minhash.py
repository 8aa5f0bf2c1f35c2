"""Sketches and the near-duplicates found by them against brute force; hashes that must tell texts apart."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridlore.llm import common, cover, jaccard, minhash, parsing

WORD = "[^\x20\x09-\x0d]+"


def sets_of(texts, size):
    out = []
    for t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def linked(rows, size):
    sets = sets_of([t for _, t in rows], size)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in ids.items()}
    return sorted(((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_sketches():
    rng = np.random.default_rng(1)
    t = minhash.bands(80) * minhash.ROWS
    seed = minhash.seeds(t)
    assert minhash.bands(80) == 40 and (1 - 0.8**minhash.ROWS) ** minhash.bands(80) <= minhash.MISSED < (1 - 0.8**minhash.ROWS) ** (minhash.bands(80) - 1)
    for n in (1, 2, 5, 40, 300, 5000):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 1 << 64, n + max(1, n // 4), dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[len(x) - n :])
            sa, sb = minhash.sketch(a, t, seed), minhash.sketch(b, t, seed)
            assert (sa != minhash._EMPTY).all() and (sb != minhash._EMPTY).all()
            agree.append((sa == sb).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.02 and np.std(agree) < 1.2 * 0.5 / t**0.5


def test_sketch_round_by_round():
    rng = np.random.default_rng(2)
    t, seed = 24, minhash.seeds(24)
    for n in (1, 3, 30):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        want = [None] * t
        for i in range(2 * t):
            for x in common.mix(h ^ seed[i]).tolist():
                j = (x >> 32) * t >> 32 if i < t else i - t
                want[j] = min(v for v in (want[j], i << 32 | x & 0xFFFFFFFF) if v is not None)
        assert minhash.sketch(h, t, seed).tolist() == want


def test_near_copies(spark):
    rnd = random.Random(6)
    base = [str(x) for x in range(160)]
    rows = [(i, " ".join(w if rnd.random() > r else f"z{rnd.randint(0, 9)}" for w in base[: rnd.randint(15, 160)])) for i, r in ((i, rnd.choice([0, 0.005, 0.02, 0.04])) for i in range(160))]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (None, "one two"), (None, "alone here"), (505, "x " * 50_000), (7, rows[7][1]), (506, "a b c d"), (507, "a b c d e")]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, rid string, cid int").coalesce(2)
    got = minhash.near_copies(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == linked(rows, 4)
    assert minhash.near_copies(df.limit(0)).collect() == []


def thue_morse(n, a, b):
    x = [a]
    while len(x) < n:
        x += [b if v == a else a for v in x]
    return x[:n]


def test_texts_made_to_collide(spark):
    """Thue-Morse strings and their complements have equal polynomial hashes modulo any power of two."""
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    ids = [f"w{i}" for i in range(17)]
    texts = [x, y, " ".join([*ids, x, *ids]), " ".join([*ids, y, *ids]), " ".join(thue_morse(4096, "left", "right")), " ".join(thue_morse(4096, "right", "left"))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sets = sets_of(texts, 5)
    links = {i: sum(i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(df).collect()} == links
    for window in (35, 2048):
        seqs = [t.split() for t in texts]
        starts = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
        gone = [sum(any(starts[tuple(s[i : i + window])] > 1 for i in range(max(0, k - window + 1), min(k, len(s) - window) + 1)) for k in range(len(s))) for s in seqs] if window == 35 else None
        got = {r["doc_id"]: r["n_removed"] for r in cover.dedup_passages(df, window).collect()}
        assert got == dict(enumerate(gone)) if gone else got[0] == got[1] == got[2] == 0
    for length in (400, 1024, 2048):
        raw = [t.encode() for t in texts]
        starts = Counter(s[i : i + length] for s in raw for i in range(len(s) - length + 1))
        want = []
        for s in raw:
            g = bytearray(len(s))
            for i in range(len(s) - length + 1):
                if starts[s[i : i + length]] > 1:
                    g[i : i + length] = b"\1" * length
            want.append(sum(g))
        assert {r["doc_id"]: r["n_removed"] for r in parsing.remove_repeats(df, length).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("name", ["rid", "RID", "row", "dd_rid"])
def test_columns_of_any_name(spark, name):
    rows = [(1, "a b c d e f g h", "q"), (2, "a b c d e f g h", "q"), (4, "A b c d e f g h", None), (3, "other words are in this one", "q")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 4: (1, 2), 3: (3, 0)}
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]


def test_rows_that_are_multiplied(spark, tmp_path):
    path = "file://" + str(tmp_path / "d")
    spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").write.parquet(path)
    many = spark.read.parquet(path).selectExpr("doc_id", "text", "explode(array(1, 2)) AS copy")
    assert len({r["k"] for r in common.keyed(many, "k").collect()}) == 4
    assert sorted(r["n_links"] for r in jaccard.near_duplicates(many).collect()) == [1, 1, 1, 1]
    assert len({r["k"] for r in common.keyed(spark.read.parquet(path).where("doc_id > 0"), "k").collect()}) == 2
