"""Columns of a user that are called like the operators' own: nothing crashes, is overwritten or taken as a key."""

import pytest

import corpus_pipeline
from gridlore.llm import bpe, common, cover, dialogue, jaccard, minhash, mixing, parsing, pii, ranked, urlfilter

NAMES = [
    "rid", "tx_text", "tx_score", "mix_copy", "mix_rid", "mix_size", "mix_taken", "pii_rid", "pii_terms", "row", "dd_rid", "uf_found", "uf_key_host", "uf_key_at", "uf_salt", "uf_host",
    "host", "lists", "blocked", "block", "key", "size", "taken", "part", "cid", "own", "h", "n", "token", "slot", "rejoin_part", "a.b", "kept", "score", "ids",
]
TEXTS = ["one two three four five six seven", "one two three four five six seven", "mail me at a.b@c.example now please", None, "", "other words stand here in a row of ten, maybe more"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("names") / "d.parquet")
    rows = [(None if i == 5 else i, t, f"s{i % 2}", 5, *[None if i == 4 else f"{c}{i // 2}" for c in NAMES]) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    odd = spark.read.parquet(path)
    return odd, odd.select("doc_id", "text", "source", "n_chars"), rows


def same(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("run", [
    lambda d: jaccard.near_duplicates(d).drop("rid", "class_id"), lambda d: minhash.near_copies(d).drop("rid"), lambda d: parsing.remove_repeats(d, 70), lambda d: cover.dedup_passages(d, 3 + 21), bpe.encode, mixing.mix, pii.find_pii,
    lambda d: ranked.ranked(d, d.select(*[common.column(c) for c in d.columns if c != "item_id"], common.column("doc_id").alias("item_id"))),
])
def test_operators(tables, run):
    odd, plain, _ = tables
    a, b = run(odd), run(plain)
    assert a.columns == b.columns and same(a.collect()) == same(b.collect())


def test_stages(spark, tables, tmp_path):
    odd, plain, rows = tables
    sf = "file://" + str(tmp_path)
    spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, odd, sf), stage(spark, plain, sf)
        own = [c for c in b.columns if c != "ids"]
        assert same(a.select(*own).collect()) == same(b.select(*own).collect()), name
        if name == "bpe":
            continue
        assert a.columns == odd.columns, name
        before = {tuple(r[c] for c in NAMES) for r in odd.collect()}
        assert {tuple(r[c] for c in NAMES) for r in a.collect()} <= before, name
        if name in ("toxicity", "pii"):
            assert a.count() == len(rows)


def test_url_filter(spark, tables):
    odd, _, _ = tables
    captures = odd.selectExpr("*", "'http://www.bad.example/' AS url", "date'2024-02-01' AS fetched")
    entries = spark.createDataFrame([("bad.example", "spam", "2024-01-01", "add")], "pattern string, list string, dated string, action string").selectExpr("pattern", "list", "CAST(dated AS date) AS dated", "action")
    got = urlfilter.filter_captures(captures, entries)
    assert got.columns == [*captures.columns, "uf_host_", "uf_lists", "uf_blocked"]
    assert same(got.select(*[common.column(c) for c in captures.columns]).collect()) == same(captures.collect()) and {r["uf_lists"] for r in got.collect()} == {"spam"}


def test_conversations(spark):
    rows = [(1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Yes.", None)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, found string").selectExpr("*", "1 AS gone", "2 AS digest", "3 AS place", "4 AS chunk")
    assert same(dialogue.repaired(odd).collect()) == [(1, 1, "K", "user", "Hi."), (1, 2, "K", "assistant", "Yes.")]
