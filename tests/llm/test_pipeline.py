"""The pipeline's stages, each against brute force on its own input."""

import os
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from gridlore.llm import bpe, pii, toxicity
from gridlore.llm.common import WORD, materialize
from tests.llm.test_operators import plain_score

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def shingle_set(t):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@here
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs.toPandas())
        assert name == "bpe" or docs.columns == names
    start, clean, single, masked, mixed, coded = seen

    # toxicity: the rows whose plain score is below one half, unchanged
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = [(i, t) for i, t in zip(start.doc_id, start.text) if plain_score(t, model) < 0.5]
    assert sorted(zip(clean.doc_id, clean.text)) == sorted(want)
    gone = set(start.doc_id) - set(clean.doc_id)
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(start) and sum(labels.get(i) == 1 for i in gone) >= sum(labels.get(i) == 1 for i in clean.doc_id)  # of 200 rows' few labels

    # one document of each component, that of the least id
    ids, sets = clean.doc_id.tolist(), {i: shingle_set(t) for i, t in zip(clean.doc_id, clean.text)}
    group, stay = {}, []
    for i in sorted(ids):
        if i not in group:
            stay.append(i)
            todo = [i]
            group[i] = i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in group and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        group[b] = i
                        todo.append(b)
    texts = dict(zip(clean.doc_id, clean.text))
    assert sorted(zip(single.doc_id, single.text)) == [(i, texts[i]) for i in stay]

    # personal data: every base span is its mark; nothing else of the text changes but terms
    for i, t in zip(masked.doc_id, masked.text):
        marks = Counter(re.findall("<(EMAIL|IP|CARD|PHONE)>", t)) - Counter(re.findall("<(EMAIL|IP|CARD|PHONE)>", texts[i]))
        assert sum(marks.values()) == sum(map(len, pii.base_spans(texts[i])))
        assert not any(map(bool, pii.base_spans(t)[:1]))
    assert sorted(masked.doc_id) == stay and (masked.n_chars == masked.text.map(len)).all()

    # mixing: whole words up to each source's target, by the same weights and caps
    size = lambda x: x.text.map(lambda t: len(re.findall(WORD, t)))
    have, took = masked.assign(n=size(masked)).groupby("source").n.sum(), mixed.assign(n=size(mixed)).groupby("source").n.sum()
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(have.index))}
    goal, free, left = {}, set(have.index), 1.5 * have.sum()
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * have[s]}
        for s in full or free:
            goal[s] = 2 * have[s] if full else level * weight[s]
        left -= sum(goal[s] for s in full)
        free -= full or free
    assert all(took.get(s, 0) == int(goal[s] + 1e-9) for s in have.index)
    whole = dict(zip(masked.doc_id, masked.text))
    for i, t in zip(mixed.doc_id, mixed.text):
        assert t == whole[i] or re.findall(WORD, whole[i])[: len(t.split(" "))] == t.split(" ")
    assert max(Counter(mixed.doc_id).values()) <= 2

    # encoding and decoding: as tiktoken does
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    coded_want = sorted((i, np.array(enc.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in zip(mixed.doc_id, mixed.text))
    assert sorted((i, bytes(a), bytes(b)) for i, a, b in zip(coded.doc_id, coded.ids, coded.decoded)) == coded_want and (coded.ids.map(len) == 4 * coded.n_tokens).all()


@here
def test_odd_rows_and_empty_table(spark, tmp_path):
    odd = [(None, None), (None, "x y"), (1, ""), (2, "same words here now then"), (2, "same words here now then"), (3, None), (4, "mail a@b.cd and 1.2.3.4"), (5, "word " * 30_000)]
    rows = [(i, t, "en", None if k % 2 else "s", 0, "b", "r", 7, "g") for k, (i, t) in enumerate(odd)]
    names = "doc_id long, text string, lang string, source string, n_chars long, block string, rid string, key long, host string"
    for k, made in enumerate((rows, [])):
        path = str(tmp_path / f"{k}")
        spark.createDataFrame(made, names).coalesce(1).write.parquet(path)
        docs, counts = spark.read.parquet(path), []
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialize(stage(spark, docs, SF), f"odd-{name}")
            counts.append(docs.count())
            assert name == "bpe" or docs.columns == columns
        # of the two equal rows one stays, and the documents without words, which the mix then leaves out
        assert counts[:3] == ([8, 7, 7] if made else [0, 0, 0]) and (counts[3] == counts[4] > 0 if made else counts[3:] == [0, 0])
        if made:
            assert docs.where(F.col("decoded").contains("<EMAIL>")).count() >= 0 and docs.agg(F.sum("n_tokens")).first()[0] > 0
