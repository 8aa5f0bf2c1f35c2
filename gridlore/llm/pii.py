"""Personal data: base patterns, and information-theoretic sanitisation on top.

What the base patterns find are the protected entities. A term discloses an entity when it foretells it: with
probabilities as shares of documents, PMI(term; entity) >= ALPHA * IC(entity), that is P(entity | term) >=
P(entity) ^ (1 - ALPHA), and the two are in MIN_CONTEXTS differently worded documents at least, wherever they stand. Such
terms are found in every document, with the entity or without it: those that foretell an entity for certain are
removed, the others generalised.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import column, free, keyed, materialize, release

ALPHA, MIN_CONTEXTS = 0.9, 3
#: Distinct words that a task knows or counts at once.
WORDS = 500_000
#: Most slots of the bit map that terms are looked up in before the exact join; it has 16 a flagged term up to these.
SLOTS = 1 << 24
#: Flagged terms that every task knows one by one, so that it sends no others; beyond, the bit map lets some through.
EXACT = 1 << 20

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and tried at the start of a run of digits only: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an @ ends the only local part it can have, the run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind in KINDS, by start."""
    ip = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    card = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [emails(text), ip, card, phone]


def written(kinds, spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(kinds, spans) for a, b in own)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def entities(text: str, spans: list[list[tuple[int, int]]]) -> list[int]:
    found = set()
    for kind, own in zip(KINDS, spans):
        for a, b in own:
            value = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]", "", text[a:b])
            found.add(_hash(f"{kind}:{value}"))
    return sorted(found)


def terms_outside(text: str, spans: list[list[tuple[int, int]]]) -> Iterator[re.Match]:
    """The terms that no span touches."""
    start, end = [], []
    for a, b in sorted(s for own in spans for s in own):
        if end and a <= end[-1]:
            end[-1] = max(end[-1], b)
        else:
            start.append(a), end.append(b)
    for m in _TERM.finditer(text):
        k = bisect_left(start, m.end())
        if not k or end[k - 1] <= m.start():
            yield m


BASE = "rid string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, wording long, entities array<long>, terms array<long>, t long, n_t long"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document (rid, doc_id, text): base findings, and if there are any, its entities, its terms and a hash of its wording. And rows
    with t alone: in how many of a task's documents the term is."""

    def table(columns: dict, n: int) -> pa.RecordBatch:
        kinds = {"rid": pa.string(), "base": pa.string(), "entities": pa.list_(pa.int64()), "terms": pa.list_(pa.int64())}
        names = [c.split()[0] for c in BASE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        total: Counter = Counter()
        for b in batches:
            counts, base, wording, ents, terms = [[], [], [], []], [], [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                for c, own in zip(counts, spans):
                    c.append(len(own))
                base.append(written(KINDS, spans))
                said = set()
                for w in {m[0] for m in terms_outside(text, spans)} if base[-1] else set(_TERM.findall(text)):
                    h = known.get(w)
                    if h is None:
                        h = known[w] = _hash(w.lower())
                    said.add(h)
                total.update(said)
                if len(known) > WORDS:
                    known.clear()
                ents.append(entities(text, spans) if base[-1] else [])
                terms.append(sorted(said) if base[-1] else [])
                wording.append(_hash(" ".join(_TERM.findall(text)).lower()) if base[-1] else None)
            yield table({"rid": b.column("rid").to_pylist(), "doc_id": b.column("doc_id").to_pylist(), **dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts)), "base": base, "wording": wording, "entities": ents, "terms": terms}, len(base))
            if len(total) > WORDS:
                yield table({"t": list(total), "n_t": list(total.values())}, len(total))
                total.clear()
        yield table({"t": list(total), "n_t": list(total.values())}, len(total))
        release()

    return docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, BASE)


def flagged_terms(scanned: DataFrame) -> DataFrame | None:
    """t, sure: the terms that disclose an entity; None if there can't be any.

    All counts are of whole documents. What is left out early can't pass: an entity or a term is in as many documents as
    the two together at least.
    """
    base, counts = scanned.where("t IS NULL"), scanned.where("t IS NOT NULL")
    n_docs = base.count()
    said = base.where("base <> ''").select("rid", F.explode("entities").alias("e"))
    n_e = said.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= MIN_CONTEXTS)
    said = materialize(said.join(n_e, "e").withColumn("enough", F.pow(F.col("n_e") / F.lit(max(1, n_docs)), F.lit(1 - ALPHA))), "pii-entities")
    least = said.agg(F.min("enough")).first()[0]
    if least is None:
        return None
    held = base.join(said.select("rid").distinct(), "rid", "left_semi").select("rid", "wording", F.explode("terms").alias("t"))
    m_t = held.groupBy("t").agg(F.count(F.lit(1)).alias("m_t")).where(F.col("m_t") >= MIN_CONTEXTS)
    n_t = counts.groupBy("t").agg(F.sum("n_t").alias("n_t"))
    some = materialize(m_t.join(n_t, "t").where(F.col("m_t") / F.col("n_t") >= least).select("t", "n_t"), "pii-candidates")
    both = held.join(some, "t").join(said, "rid").where(F.col("n_e") / F.col("n_t") >= F.col("enough"))
    pairs = both.groupBy("e", "t", "wording").agg(F.count(F.lit(1)).alias("n"), F.min("n_t").alias("n_t"), F.min("enough").alias("enough"))
    pairs = pairs.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("wordings"), F.min("n_t").alias("n_t"), F.min("enough").alias("enough"))
    p = F.col("n_et") / F.col("n_t")
    return materialize(pairs.where((F.col("wordings") >= MIN_CONTEXTS) & (p >= F.col("enough"))).groupBy("t").agg((F.max(p) >= 1.0).alias("sure")), "pii-flagged")


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame | None:
    """rid, terms (array of start, end, sure): where terms that disclose an entity stand; None if there are none."""
    flagged = flagged_terms(scanned)
    if flagged is None:
        return None
    n = flagged.count()
    if n <= EXACT:  # 8 MB at most
        known = np.sort(flagged.select("t").toArrow()["t"].to_numpy())
        return _places(docs, flagged, docs.sparkSession.sparkContext.broadcast(known.tobytes()), None) if n else None
    size = min(SLOTS, 1 << (16 * n).bit_length())
    slots = flagged.select(F.pmod("t", F.lit(size)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()  # SLOTS at most
    bits = np.zeros(size, bool)
    bits[slots] = True
    return _places(docs, flagged, docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes()), size)


def _places(docs: DataFrame, flagged: DataFrame, packed: Broadcast, size: int | None) -> DataFrame:
    """Of disclosing(). packed: a bit map of `size` slots in which flagged terms have a bit, or without a size, the terms
    themselves, so that no row of another term is made."""
    arrow = pa.list_(pa.int32())

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packed.value
        terms = frozenset(np.frombuffer(own, np.int64).tolist()) if size is None else frozenset()
        known: dict[str, int | None] = {}
        for b in batches:
            rid, term, spots = [], [], []
            for r, t in enumerate(b.column("text")):
                text, found = t.as_py() or "", {}
                for w in set(_TERM.findall(text)):
                    if w not in known:
                        h = _hash(w.lower())
                        at = 0 if size is None else h % size
                        known[w] = h if (h in terms if size is None else own[at >> 3] >> (7 - (at & 7)) & 1) else None
                    if known[w] is not None:
                        found[w] = known[w]
                if len(known) > WORDS:
                    known.clear()
                if found:
                    by: dict[int, list[int]] = {}
                    for m in terms_outside(text, base_spans(text)):
                        if m[0] in found:
                            by.setdefault(found[m[0]], []).extend(m.span())
                    for h, spans in by.items():
                        rid.append(r), term.append(h), spots.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(rid, pa.int32())), pa.array(term, pa.int64()), pa.array(spots, arrow)], ["rid", "t", "at"])

    seen = docs.select("rid", "text").mapInArrow(occurrences, "rid string, t long, at array<int>")
    seen = materialize(seen, "pii-terms")
    spans = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.col("at")[i].alias("start"), F.col("at")[i + 1].alias("end"), F.col("sure").alias("sure")))
    return materialize(seen.join(flagged, "t").select("rid", spans.alias("s")).groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("terms")), "pii-spans")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans of each row of docs (doc_id, text).

    base and spans are kind:start:end in code points, comma-joined, by kind and start; spans adds kind term. Null text is
    empty; repeated rows are rows of their own; an empty table gives no rows.
    """
    rows = keyed(docs.select("doc_id", "text"), "rid")
    scanned = materialize(scan(rows), "pii-base")
    terms = disclosing(rows, scanned)
    base = scanned.where("t IS NULL").select("rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base")
    if terms is None:
        return base.withColumn("spans", F.col("base")).drop("rid")
    more = F.array_join(F.transform("terms", lambda s: F.concat(F.lit("term:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    rows = base.join(terms, "rid", "left")
    return rows.withColumn("spans", F.concat_ws(",", F.nullif("base", F.lit("")), more)).drop("terms", "rid")


MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind; terms that disclose an entity for certain removed, others
    generalised to <TERM>. Other columns stay, but for n_chars, which follows the text; null text stays null, repeated rows stay. A text is held whole, a few times."""
    columns, count = docs.columns, "n_chars" in docs.columns
    names = [f"c{i}" for i in range(len(columns))]  # mapInArrow takes plain names only
    key, found = free(docs, "pii_rid"), free(docs, "pii_terms")
    rows = keyed(docs, key)
    texts = rows.select(F.col(key).alias("rid"), "doc_id", "text")
    terms = disclosing(texts, materialize(scan(texts), "pii-base"))
    kind = "array<struct<start:int,end:int,sure:boolean>>"
    if terms is None:
        rows = rows.withColumn(found, F.lit(None).cast(kind))
    else:  # broadcast only if Spark's limit allows the written table
        rows = rows.join(terms.select(F.col("rid").alias(key), F.col("terms").alias(found)), key, "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, extra in zip(b.column(names[columns.index("text")]), b.column("terms").to_pylist()):
                text = t.as_py()
                if text is not None:
                    spans = sorted([(s, e, MARKS[k]) for k, own in zip(KINDS, base_spans(text)) for s, e in own] + [(x["start"], x["end"], "" if x["sure"] else "<TERM>") for x in extra or []])
                    parts, at = [], 0
                    for s, e, mark in spans:
                        if s >= at:
                            parts += [text[at:s], mark]
                        else:
                            parts.append(mark)
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            made = {"text": pa.array(out, pa.string())}
            if count:
                made["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(x) for c, x in zip(columns, names)], names)

    plain = rows.select(*[column(c).alias(x) for c, x in zip(columns, names)], F.col(found).alias("terms"))
    return plain.mapInArrow(clean, plain.drop("terms").schema).toDF(*columns)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


