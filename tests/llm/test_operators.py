"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as ST

import public_tokenizers
from gridlore.llm import ann, bpe, common, cover, graph, jaccard, mixing, parsing, pii, topk, toxicity, urlfilter
from gridlore.llm.common import WORD

LONG = " ".join(f"w{i * i % 997}" for i in range(30_000))
TEXTS = [
    None, "", "  \n ", "one", "One", LONG, "a" * 3000, "é" * 700 + "x", "é" * 700 + "y", "\x00" * 900, "word " * 60, "mixed\tcase\x0bTEXT with\x0cbreaks " * 30,
    *[f"start{i} " + " ".join(str(j * j % 1013) for j in range(150 + i)) + f" end{i}" for i in range(8)], "ˋ ꟺ 𑷠 ﬁ ３ \x1c 'll don't", "한국어 텍스트 é",
]
DOCS = [(None if i == 3 else i, t, "en", None if i % 5 == 0 else f"src{i % 4}", 7, "extra") for i, t in enumerate([*TEXTS, TEXTS[12], TEXTS[5]])] + [(5, LONG, "en", "src1", 7, "extra")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    # names that the operators use inside
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long, block string").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "e.parquet")
    docs.limit(0).write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def words(t):
    return re.findall(WORD, t or "")


def covered(seqs, n):
    count = Counter(hash(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1))
    out = []
    for s in seqs:
        g = bytearray(len(s))
        for i in range(len(s) - n + 1):
            if count[hash(s[i : i + n])] > 1:
                g[i : i + n] = b"\1" * n
        out.append(g)
    return out


def key(rows):
    return sorted(rows, key=repr)


def without_repeats(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    return key((d, len(b), sum(g), sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1])), bytes(x for x, y in zip(b, g) if not y)) for (d, _), b, g in zip(rows, raw, covered(raw, length)))


@pytest.mark.parametrize("hot,block", [(2048, 4 << 20), (2048, 3000), (20, 20_000), (2, 1000)])
def test_suffix_dedup(docs, monkeypatch, hot, block):
    monkeypatch.setattr(parsing, "HOT", hot)
    got = parsing.remove_repeats(docs, block_bytes=block).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == without_repeats([d[:2] for d in DOCS])


def test_suffix_dedup_in_pieces(docs, empty):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefgh") for _ in range(1_050_000))
    rows = [(1, long + long[:900] + "x" + long[1_048_000:1_049_000]), (2, "y" + long[1_048_300:1_048_900]), (3, "z" * 2000)]
    got = parsing.remove_repeats(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == without_repeats(rows)
    assert parsing.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_cover_dedup(docs, empty, block):
    assert {(a - b) % cover.PERIOD for a in cover.COVER for b in cover.COVER} == set(range(cover.PERIOD))
    seqs = [tuple(words(t)) for _, t, *_ in DOCS]
    want = [(d[0], len(s), sum(g), " ".join(w for w, y in zip(s, g) if not y)) for d, s, g in zip(DOCS, seqs, covered(seqs, 35))]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in cover.dedup_passages(docs, block_bytes=block).collect()]
    assert key(got) == key(want)
    assert cover.dedup_passages(empty).collect() == []


def test_hashed_words(monkeypatch):
    monkeypatch.setattr(common, "SEGMENT", 64)
    monkeypatch.setattr(common, "LONG_WORD", 20)
    rnd, seen, hashes = random.Random(1), {}, (common.Poly(1), common.Poly(2))
    for _ in range(300):
        texts = [b"".join(rnd.choice([b"a", b"bc", b" ", b"x" * rnd.randint(1, 200) if rnd.random() < 0.1 else b"q"]) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 6))]
        b, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        s, e, wo, (h1, h2) = common.hashed_words(b, off, *hashes)
        found = [b[x:y].tobytes() for x, y in zip(s, e)]
        assert [found[wo[i] : wo[i + 1]] for i in range(len(texts))] == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
        assert all(seen.setdefault(w, x) == x for w, x in zip(found, zip(h1, h2)))
    assert len(set(seen.values())) == len(seen)


def linked(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(x for x in (least.get(top(i)), d) if x is not None) if (least.get(top(i)), d) != (None, None) else None
    return key((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def near_copies(n, seed=4):
    rnd = random.Random(seed)
    base = [str(x) for x in range(160)]
    return [(i, " ".join(w if rnd.random() > r else f"z{rnd.randint(0, 9)}" for w in base[: rnd.randint(20, 160)])) for i, r in ((i, rnd.choice([0, 0.005, 0.02, 0.05])) for i in range(n))]


@pytest.mark.parametrize("few,block", [(24, 128), (2, 8)])
def test_jaccard(spark, monkeypatch, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(120)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked(rows)


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("few,block", [(24, 128), (2, 8)])
def test_jaccard_counts_every_link(docs, monkeypatch, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    near = near_copies(150)
    near += [(1000 + i, t) for i, (_, t) in enumerate(near[:40])]  # equal texts count one by one
    for rows, df in ((near, docs.sparkSession.createDataFrame(near, "doc_id long, text string").coalesce(1)), ([d[:2] for d in DOCS], docs.select("doc_id", "text"))):
        sets = shingle_sets(rows)
        want = key((d, sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if j != i and a)) for i, ((d, _), a) in enumerate(zip(rows, sets)))
        assert key((r["doc_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()) == want
    assert max(n for _, n in want) > 1


def test_jaccard_odd_rows(docs):
    got = jaccard.near_duplicates(docs.select("doc_id", "text")).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked([d[:2] for d in DOCS])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r["component_id"], r["rid"] if not r["n_shingles"] else -1) for r in got})


def test_jaccard_pairs_of_one_phrase_go_no_further(spark):
    """Texts that have one phrase in common are no candidates; texts that are similar enough are."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [text(200) + p for p in (text(7) for _ in range(20)) for _ in range(2)]
    near = text(200)
    rows += [near, near[:150] + ["other"] + near[151:]]
    d = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    found = jaccard.candidates(d.select("text"), np.zeros(1 << 20, np.uint8), 1 << 20, 5, 80)  # a sketch that tells nothing
    assert found.where("kind = 0").select("a", "b").distinct().count() > 2 and jaccard.enough(found).count() == 1
    assert {r["component_id"] for r in jaccard.near_duplicates(d).where("n_links > 0").collect()} == {40}


def test_jaccard_sketch_grows_with_the_corpus():
    assert [jaccard.slots_for(n) for n in (0, 1 << 20, 1 << 32, 1 << 40)] == [1 << 20, 1 << 20, 1 << 24, 1 << 24]
    assert all(jaccard.shared_tokens(n, 80) <= -(-80 * n // 100) for n in range(1, 2000))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(chain).collect()} == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def vectors(spark, n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("float32")
    x[10:40] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (1004, [0.0] * dim), (None, [1.0] * dim), (20, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


@pytest.mark.parametrize("cell,block", [(16384, 4096), (40, 2)])
def test_exact_topk(spark, cell, block):
    df, rows = vectors(spark)
    whole = df.where(topk.finite("embedding")).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("embedding"))
    got = {}
    for r in topk.exact_topk(whole, F.col("vec_id") % 50 == 0, 5, cell, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [int(np.floor(256 * float(v))) for v in e]) for i, e in rows if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)]
    asked = {}
    for i, q in ok:  # of two rows of one id the lesser vector asks
        if i % 50 == 0:
            asked[i] = min(asked.get(i, q), q)
    for i, q in asked.items():
        s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in ok if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert got.keys() == asked.keys()
    assert topk.exact_topk(whole.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_exact_topk_large_and_repeated(spark):
    rows = [(50, [2.0**40, 1.0]), (50, [2.0**40, 0.0]), (7, [3.0, 4.0]), (8, [2.0**40, 0.0]), (9, [-(2.0**60), 5.0]), (10, [1e300, 0.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, 5).collect()
    # a query's own are all rows of its id; what doesn't fit 64 bits stands at their end
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 8, 2**63 - 1), (2, 10, 2**63 - 1), (3, 7, 3 * 2**40), (4, 9, -(2**63))]
    ints = topk.search(np.arange(3), np.full((3, 2), 2.0**40), np.arange(1), np.full((1, 2), 2.0**20), 2)
    assert ints[2].tolist() == [2**61, 2**61] and ints[1].tolist() == [1, 2]


def recall(got, ok, queries, k=20):
    """Of the best k by brute force, how many were found; a found row as near as the k-th counts, too."""
    own, hit = {}, 0
    for r in got:
        own.setdefault(r["query_id"], []).append(r["score"])
    for i in queries:
        best = np.sort([float(np.dot(ok[i], e)) for j, e in ok.items() if j != i])[::-1][:k]
        hit += sum(s >= best[-1] - 1e-9 for s in own[i])
    return hit / (k * len(queries))


def test_ann(spark):
    df, rows = vectors(spark, 2000, 64)
    ok = {i: np.array(e, float) for i, e in rows[:2000]}
    df = df.where("vec_id IS NULL OR vec_id <> 20")
    ok.pop(20)
    got = ann.ann_topk(df, F.col("vec_id") % 20 == 0, 20).collect()
    queries = [i for i in range(0, 2000, 20) if i != 20]
    for i in queries:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [r for r, *_ in own] == list(range(1, 21)) and all(s == pytest.approx(float(np.dot(ok[i], ok[j]))) for _, j, s in own if j in ok)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(own, own[1:]))
    assert recall(got, ok, queries) >= 0.9  # the query's own parameters
    assert ann.ann_topk(df.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_ann_recall_on_the_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ok = {i: np.array(v, float) for i, v in zip(e.vec_id, e.embedding) if v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v)}
    got = ann.op3_ann_multi_index(spark, "/root/testdata/sf0.01").collect()
    assert recall(got, ok, [i for i in ok if i % 20 == 0]) >= 0.9


@pytest.mark.parametrize("block,groups", [(20_000, 192), (3000, 2)])
def test_bpe(docs, monkeypatch, block, groups):
    monkeypatch.setattr(bpe, "GROUPS", groups)
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d[0], np.array(enc.encode_ordinary(d[1] or ""), "<u4").tobytes(), (d[1] or "").encode()) for d in DOCS]
    got = bpe.encode(docs, block_bytes=block).collect()
    assert key((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == key(want)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and key((r["doc_id"], r["size"]) for r in got) == key((d[0], len(words(d[1]))) for d in DOCS)
    total = sum(r["size"] for r in got)
    by = {r["source"]: r for r in got}
    assert sum(r["target"] for r in by.values()) == pytest.approx(1.5 * total)
    for s, r in by.items():
        own = [x for x in got if x["source"] == s]
        assert sum(x["taken"] for x in own) == int(r["target"]) <= 2 * r["source_size"] and all(0 <= x["taken"] <= 2 * x["size"] for x in own)
    assert key(map(tuple, mixing.mix(docs).collect())) == key(map(tuple, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_url_filter(spark):
    import datetime

    d = lambda m: datetime.date(2024, m, 1)
    entries = spark.createDataFrame([("Bad.org", "a", d(2), "add"), ("bad.org", "a", d(4), "remove"), ("x.bad.org", "b", d(3), "add"), (None, "a", d(1), "add"), ("other.net", None, d(1), "add"), ("same.net", "a", d(5), "add"), ("same.net", "a", d(5), "remove")], "pattern string, list string, dated date, action string")
    urls = [("http://x.bad.org/p", m) for m in range(1, 6)] + [("https://u@BAD.ORG:8/", 2), ("notbad.org", 2), (None, 2), ("http://notbad.org/", 3), ("http://same.net", 6)]
    caps = spark.createDataFrame([(i, u, d(m), "k") for i, (u, m) in enumerate(urls)] + [(99, "http://bad.org/", None, "k")], "page_id long, url string, fetched date, list string")
    got = {r["page_id"]: r["lists"] for r in urlfilter.filter_captures(caps, entries).collect()}
    assert got == {0: "", 1: "a", 2: "a,b", 3: "b", 4: "b", 5: "a", 6: "", 7: "", 8: "", 9: "a", 99: ""}
    twice = caps.withColumn("lists", F.lit("mine")).union(caps.withColumn("lists", F.lit("mine")))
    found = urlfilter.filter_captures(twice, entries)
    assert found.columns == ["page_id", "url", "fetched", "list", "lists", "host", "uf_lists", "blocked"] and found.count() == 22
    assert {(r["page_id"], r["lists"], r["uf_lists"]) for r in found.collect()} == {(i, "mine", x) for i, x in got.items()}
    assert urlfilter.filter_captures(caps.limit(0), entries).collect() == []
    assert {r["lists"] for r in urlfilter.filter_captures(caps, entries.limit(0)).collect()} == {""}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans():
    rnd = random.Random(3)

    def luhn(x):
        return sum((v := int(c) * (2 if i % 2 else 1)) - (9 if v > 9 else 0) for i, c in enumerate(reversed(x))) % 10 == 0

    def brute(t):
        digits = lambda x: re.sub("[^0-9]", "", x)
        return [[m.span() for m in EMAIL.finditer(t)], [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))], [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))], [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]]

    for alphabet in ("12345 .-+@ab0(", "4 1-", "a@.b%", "+1 ()"):
        for _ in range(3000):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 45)))
            assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("1" * 200_000 + "@") == [[], [], [], []]


def test_pii_terms(spark, docs):
    told = [(i, f"{'abcdefgh'[i]}xyz note about Zorblat mail zor@mail.example.com more {'hgfedcba'[i]}uvw") for i in range(6)]
    rows = told + [(10 + i, f"plain words number {i} mail q{i}@other.example.com about note more") for i in range(40)] + [(90, "Zorblat is here"), (91, None), (92, "")]
    path = docs.sparkSession.conf.get("spark.checkpoint.dir") + "/pii-test"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    got = {r["doc_id"]: r for r in pii.find_pii(spark.read.parquet(path)).collect()}
    assert len(got) == len(rows) and got[0]["n_email"] == 1 and "term:" in got[0]["spans"] and got[90]["spans"].startswith("term:0:7")
    assert "term:" not in got[12]["spans"] and got[91]["spans"] == got[92]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.read.parquet(path)).collect()}
    assert "Zorblat" not in clean[90] and "<EMAIL>" in clean[12] and clean[91] is None


def test_pii_terms_anywhere(docs):
    # the name heads each letter, the address is at its foot, or near it once; a common word is in every letter too
    filler = lambda i: " ".join(f"word{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    rows = [(i, f"Quorvex writes often {filler(i)} mail quo@mail.example.com {'Brantol' if i == 0 else ''}") for i in range(6)]
    rows += [(6 + i, f"often {filler(10 + i)} {'Brantol' if i < 5 else ''}") for i in range(12)]
    path = docs.sparkSession.conf.get("spark.checkpoint.dir") + "/pii-far"
    docs.sparkSession.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    df = docs.sparkSession.read.parquet(path)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert all("term:0:7" in got[i] for i in range(6)) and not any("term" in got[i] for i in range(6, 18))
    n_e, n = Counter(), Counter()  # brute force: whole documents
    for _, t in rows:
        own = {w.lower() for w in re.findall(r"[^\W\d_]{4,}", EMAIL.sub(" ", t))}
        n.update(own), n_e.update(own if "@" in t else ())
    want = {w for w in n_e if n_e[w] >= 3 and n_e[w] / n[w] >= (6 / len(rows)) ** 0.1}
    assert {rows[i][1][int(a) : int(b)].lower() for i, s in got.items() for a, b in re.findall(r"term:(\d+):(\d+)", s)} == want


def test_pii_odd_rows(docs, empty):
    assert pii.find_pii(docs).count() == len(DOCS) and pii.sanitised(docs).columns == docs.columns and pii.find_pii(empty).count() == 0


def test_toxicity(spark):
    rnd = random.Random(5)
    bad = ["grumf", "slorb"]

    def text(toxic):
        w = ["".join(rnd.choice("aeioust") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        if toxic:
            for _ in range(3):
                b = rnd.choice(bad)
                w.insert(rnd.randint(0, 50), rnd.choice([b, b.upper(), b.replace("o", "0"), b.replace("o", "о"), b + "ing"]))
        return " ".join(w)

    truth = {i: int(i % 4 == 0) for i in range(400)}
    docs = spark.createDataFrame([(i, text(y), "k") for i, y in truth.items()] + [(1000, None, "k"), (1001, "", "k")], "doc_id long, text string, toxic string").coalesce(1)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items()] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model, "doc_id").withColumn("h", toxicity.held_out()).collect()}
    assert len(got) == 402 and all(0 <= r["tx_score"] <= 1 for r in got.values()) and got[1000]["tx_score"] == got[1001]["tx_score"] < 0.5
    held = [i for i in truth if got[i]["h"]]
    assert len(held) > 40 and sum((got[i]["tx_score"] >= 0.5) == truth[i] for i in held) / len(held) >= 0.95
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r["tx_score"] < 0.5 for r in toxicity.scored(docs, none, "doc_id").collect())


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T ЅТUРІD a1 $cum 77") == ["idiot", "stupid", "ai", "scum"]
    assert toxicity.fold("ｓｃｕｍ 𝓈𝒸𝓊𝓂 scúm s\u200bc\u00adum") == ["scum"] * 4
    lex = toxicity.Lexicon({"scum": 3.0}, [" scumble ", " old scum "])
    assert lex.features("scum old scum scumble")[0] == 3.0 and lex.features("")[0] == 0.0
    many = toxicity.Lexicon({"scum": 1.0}, [" old scum "])
    assert many.features("old scum " * 3000 + "scum")[2] == 1


def plain_score(text, model):
    """The score without Aho-Corasick: every word against every term and exception."""
    weights, exceptions, curve = model
    w = toxicity.fold(text or "")
    hits = []
    for i, x in enumerate(w):
        own = [v for t, v in weights.items() if (x == t[:-1] if t.endswith(" ") else x.startswith(t))]
        around = {f" {x} ", *([f" {w[i - 1]} {x} "] if i else []), *([f" {x} {w[i + 1]} "] if i + 1 < len(w) else [])}
        if own and not around & set(exceptions):
            hits.append(max(own))
    total = math.fsum(hits)
    f = [math.log1p(v) for v in (total, total / math.sqrt(len(w)) if w else 0.0, len(hits))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * c for a, c in zip(f, curve)) + curve[3]))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_toxicity_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts, toxic = docs.select("doc_id", "text").toPandas(), {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    own = [(toxicity.fold(t or ""), toxic[i]) for i, t in zip(texts.doc_id, texts.text) if i in toxic]
    n = Counter(y for _, y in own)

    def counts(kind):
        by = (Counter(), Counter())
        for w, y in own:
            by[y].update(kind(w))
        return {t: (by[1][t], by[0][t], math.log((by[1][t] + 0.5) / (n[1] + 1)) - math.log((by[0][t] + 0.5) / (n[0] + 1))) for t in by[0].keys() | by[1].keys()}

    found = counts(lambda w: toxicity.terms(set(w)))
    bar = 2 * math.log(max(2, sum(k >= 4 for k, _, _ in found.values()))) + 3
    g = lambda k, m, both: k * math.log(k * (n[0] + n[1]) / (both * m)) if k else 0.0
    want = {t: o for t, (k, c, o) in found.items() if k >= 4 and o > 1.5 and 2 * (g(k, n[1], k + c) + g(c, n[0], k + c)) > bar}
    short = {}
    for t in sorted(want, key=lambda t: (len(t), t)):
        if not any(t[:i] in short and want[t] <= short[t[:i]] + 1.0 for i in range(4, len(t))):
            short[t] = want[t]
    assert model[0].keys() == short.keys() and all(model[0][t] == pytest.approx(o) for t, o in short.items()) and short
    hit = lambda x: x + " " in short or any(x[:k] in short for k in range(4, min(7, len(x)) + 1))
    near = counts(lambda w: {e for i, x in enumerate(w) if hit(x) for e in (f" {x} ", *([f" {w[i - 1]} {x} "] if i else []), *([f" {x} {w[i + 1]} "] if i + 1 < len(w) else []))})
    assert sorted(model[1]) == sorted(e for e, (_, c, o) in near.items() if c >= 5 and o < 0)
    got = {(r["doc_id"]): r for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in zip(texts.doc_id, texts.text):
        assert got[i]["score"] == pytest.approx(plain_score(t, model)) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in got if got[i]["held_out"] and i in {r["doc_id"] for r in labels.collect()}]
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) >= 0.95


def test_toxicity_odd_tables(docs, empty):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.scored(docs, model, "doc_id").count() == len(DOCS) and toxicity.scored(empty, model, "doc_id").count() == 0
    for d, y in ((empty, labels), (docs, labels.limit(0)), (empty, labels.limit(0))):
        assert toxicity.train(d, y)[2][3] < 0 and toxicity.train(d, y)[:2] == ({}, [])


def plain_pii(rows):
    """doc_id and spans of every row, and the terms that disclose an entity, from counts over whole documents."""
    rows = [(d, t or "") for d, t in rows]
    spans = [pii.base_spans(t) for _, t in rows]
    ents, said, word = [], [], []
    for (_, t), sp in zip(rows, spans):
        ents.append({f"{k}:{t[a:b].lower() if k == 'email' else re.sub('[^0-9.]', '', t[a:b])}" for k, own in zip(pii.KINDS, sp) for a, b in own})
        flat = [s for own in sp for s in own]
        said.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{4,}", t) if not any(a < m.end() and m.start() < b for a, b in flat)])
        word.append(" ".join(re.findall(r"[^\W\d_]{4,}", t)).lower())
    n_e, n_t, both, wordings = Counter(), Counter(), Counter(), {}
    for e, s, w in zip(ents, said, word):
        own = {x for _, _, x in s}
        n_e.update(e), n_t.update(own)
        for pair in ((x, y) for x in e for y in own):
            both[pair] += 1
            wordings.setdefault(pair, set()).add(w)
    flagged = {t for (e, t), k in both.items() if len(wordings[e, t]) >= pii.MIN_CONTEXTS and k / n_t[t] >= (n_e[e] / len(rows)) ** (1 - pii.ALPHA) - 1e-12}
    return key((d, pii.written(pii.KINDS + ("term",), [*sp, [(a, b) for a, b, x in s if x in flagged]])) for (d, _), sp, s in zip(rows, spans, said)), flagged


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_pii_of_the_tables_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = plain_pii([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert key((r["doc_id"], r["spans"]) for r in pii.op9_pii(spark, "/root/testdata/sf0.01").collect()) == want


def test_pii_terms_by_brute_force(spark):
    rnd = random.Random(6)
    names, common = ["Zorblat", "Quorvex", "Brantol", "Fjeldar"], ["often", "writes", "letter", "house", "about"]
    rows = []
    for i in range(300):
        w = [rnd.choice(common) + rnd.choice("abcdefgh") * rnd.randint(0, 3) for _ in range(rnd.randint(3, 30))]
        who = rnd.randrange(6)
        if who < 4:
            w.insert(rnd.randint(0, len(w)), names[who] if rnd.random() < 0.9 else names[who].upper())
            if who < 3 or rnd.random() < 0.5:
                w.insert(rnd.randint(0, len(w)), (f"mail{who}@x.example.com", f"10.0.0.{who}", "+49 30 1234567", "4111 1111 1111 1111")[who])
        rows.append((i, " ".join(w)))
    rows += [(7, rows[7][1]), (None, "Zorblat alone"), (900, None)]
    want, flagged = plain_pii(rows)
    assert {"zorblat", "quorvex", "brantol"} <= flagged and "often" not in flagged
    assert key((r["doc_id"], r["spans"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_empty_tables(empty):
    for fn in (parsing.remove_repeats, cover.dedup_passages, jaccard.near_duplicates, bpe.encode, mixing.mix):
        assert fn(empty).collect() == []
    assert isinstance(empty.schema, ST.StructType) and hashlib.sha256(b"").hexdigest()
