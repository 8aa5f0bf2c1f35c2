"""Header matching, value evidence, fusion, and the one-to-one assignment of columns to target fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import similarity
from gridlore.functions import text as T
from gridlore.functions.vocabulary import TARGET_NAMES, aliases, targets
from gridlore.sources.tables import written

FUZZY, ELIGIBLE = 0.75, 0.50
# Methods by priority.
PRIORITY = {"exact": 6, "domain_alias": 6, "fuzzy": 5, "llm": 4, "semantic": 3, "value_evidence": 1}


def _lookup(spark: SparkSession, sources: tuple[int, ...], key) -> DataFrame:
    norm = aliases(spark).where(F.col("source").isin(*sources)).withColumn("norm", key(F.col("alias"))).where("norm <> ''")
    first = Window.partitionBy("norm").orderBy("pos")
    return norm.withColumn("n", F.row_number().over(first)).where("n = 1").select("norm", "pos", "target")


def exact_lookup(spark: SparkSession) -> DataFrame:
    """JN1's table: names and schema aliases, the first writer of a form wins."""
    return _lookup(spark, (0, 1), lambda c: T.mapping_header(c, nfkc=False))


def domain_lookup(spark: SparkSession) -> DataFrame:
    """JN2's table: names and domain aliases. A form of two targets is an error (AG18)."""
    found = alias_conflicts(aliases(spark).where("source = 2")).collect()
    if found:
        raise ValueError(f"alias conflict: {[r['norm'] for r in found]}")
    return _lookup(spark, (2,), T.alias_key)


def alias_conflicts(rows: DataFrame) -> DataFrame:
    """AG18: forms of (alias, target) rows that name more than one target."""
    norm = rows.withColumn("norm", T.alias_key(F.col("alias"))).where("norm <> ''")
    return norm.groupBy("norm").agg(F.count_distinct("target").alias("n_targets")).where("n_targets > 1")


def vocabulary(spark: SparkSession) -> DataFrame:
    """ST1: names, schema aliases, domain aliases; a form belongs to the first that has it, at that position."""
    a = aliases(spark)
    norm = F.when(F.col("source") == 2, T.alias_key(F.col("alias"))).otherwise(T.mapping_header(F.col("alias"), nfkc=False))
    first = Window.partitionBy("norm").orderBy("pos")
    return a.withColumn("norm", norm).where("norm <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").select("norm", "pos", "target")


def without(vocab: DataFrame, assigned: DataFrame) -> DataFrame:
    """FL8, JN10, ST3: the vocabulary less the targets that are taken."""
    return vocab.join(assigned.select("target").distinct(), "target", "left_anti")


def exact_match(headers: DataFrame) -> DataFrame:
    """JN1: headers (with norm) and their exact target; the table is bounded by the vocabulary and broadcast."""
    return headers.join(F.broadcast(exact_lookup(headers.sparkSession).select("norm", "target")), "norm", "left")


def alias_match(headers: DataFrame) -> DataFrame:
    """JN2."""
    keyed = headers.withColumn("alias_norm", T.alias_key(F.col("norm")))
    lookup = domain_lookup(headers.sparkSession).select(F.col("norm").alias("alias_norm"), "target")
    return keyed.join(F.broadcast(lookup), "alias_norm", "left").drop("alias_norm")


def exact_one_to_one(headers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """WN6: of the headers with one target the first keeps it, the others are exact_conflict. Headers without a target, which
    have no rivals, don't enter the window."""
    m = exact_match(headers)
    n = F.row_number().over(Window.partitionBy(*(keys or []), "target").orderBy("col_pos"))
    some = m.where("target IS NOT NULL").withColumn("status", F.when(n == 1, "exact").otherwise("exact_conflict"))
    some = some.withColumn("target", F.when(F.col("status") == "exact", F.col("target")))
    return some.unionByName(m.where("target IS NULL").withColumn("status", F.lit("unmatched")))


def _forms(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one row: alphabet, and forms, an array in order, with what bounds and compares them (its size is
    fixed by the code)."""
    letters = vocab.select(F.explode(similarity.characters(F.col("norm"))).alias("ch")).agg(F.array_sort(F.collect_set("ch")).alias("alphabet"))
    each = vocab.join(F.broadcast(letters)).select("pos", "norm", "target", "alphabet", similarity.masks(F.col("norm"), F.col("alphabet")).alias("masks"), F.struct(*[c.alias(k) for k, c in similarity.indexed("norm", "alphabet").items()]).alias("own"))
    form = F.struct("pos", "norm", "target", "masks", F.col("own.counts").alias("counts"), F.col("own.rest").alias("rest"))
    return each.agg(F.first("alphabet").alias("alphabet"), F.array_sort(F.collect_list(form)).alias("forms"))


def _compared(headers: DataFrame, vocab: DataFrame) -> DataFrame:
    """norm, own and forms of the distinct headers that aren't empty; there is no pair table."""
    distinct = headers.where("norm <> ''").select("norm").distinct().join(F.broadcast(_forms(vocab)))
    return distinct.select("norm", "forms", F.struct(*[c.alias(k) for k, c in similarity.indexed("norm", "alphabet").items()]).alias("own"))


def fuzzy_match(headers: DataFrame, threshold: float = FUZZY, vocab: DataFrame | None = None) -> DataFrame:
    """JN3 and FL9: the most similar form, of equal ones the first, and its target, which is null below the threshold.
    Empty headers, and all if the vocabulary is empty, have none."""
    vocab = vocabulary(headers.sparkSession) if vocab is None else vocab
    best = _compared(headers, vocab).select("norm", similarity.best_form(F.col("norm"), F.col("own"), F.col("forms")).alias("best")).where("best.text IS NOT NULL")
    best = best.select("norm", F.col("best.text").alias("matched_text"), F.when(F.col("best.similarity") >= threshold, F.col("best.target")).alias("target"), "best.similarity")
    return headers.join(best, "norm", "left")


def fuzzy_one_to_one(headers: DataFrame, keys: list[str], threshold: float = FUZZY) -> DataFrame:
    """WN7: headers in order take the best form that is left; a target that is taken leaves the vocabulary. Below the
    threshold the form is told, its target is null and stays free. Distinct headers are scored once, in the JVM, and keep
    each target's best form. Only rows that take a target change what is left: those are among a header's first rows (as many
    as there are targets; once a header gets none it never will), which are walked in order as a stream, and a workbook has
    at most one for each target. All rows then choose by themselves among what is left to them."""
    own = _compared(headers, vocabulary(headers.sparkSession))
    wanted = F.array(*map(F.lit, TARGET_NAMES))
    ranked = F.transform(wanted, lambda t: F.struct(similarity.best_form(F.col("norm"), F.col("own"), F.filter("forms", lambda f: f["target"] == t)).alias("b"), t.alias("t")))
    first = lambda text: F.filter("forms", lambda f: f["norm"] == text)[0]["pos"]
    near = F.transform(F.filter(ranked, lambda r: r["b"]["text"].isNotNull()), lambda r: F.struct((-r["b"]["similarity"]).alias("minus"), first(r["b"]["text"]).alias("pos"), r["b"]["text"].alias("text"), r["t"].alias("target")))
    near = written(own.select("norm", F.array_sort(near).alias("near")), "fuzzy-near")
    names, kinds = [f"k{i}" for i in range(len(keys))], dict(headers.dtypes)
    rows = headers.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "col_pos", "norm")
    place = Window.partitionBy(*names, "norm").orderBy("col_pos")
    fits = F.transform(F.filter("near", lambda v: -v["minus"] >= threshold), lambda v: v["target"])
    able = near.select("norm", fits.alias("fits")).where(F.size("fits") > 0)
    early = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= len(TARGET_NAMES)).join(able, "norm")

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, taken = None, set()
        for b in parts:
            at, got = [], []
            for i, (*key, fits) in enumerate(zip(*(b.column(c).to_pylist() for c in [*names, "fits"]))):
                if key != book:
                    book, taken = key, set()
                hit = next((t for t in fits if t not in taken), None)
                if hit is not None:
                    taken.add(hit)
                    at.append(i), got.append(hit)
            some = b.select([*names, "col_pos", "norm", "place"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.string())], [*names, "col_pos", "norm", "place", "target"])

    schema = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names)) + f", col_pos {kinds['col_pos']}, norm string, place int, target string"
    took = early.repartition(*names).sortWithinPartitions(*names, "col_pos", "norm", "place").mapInArrow(walk, schema)
    took = took.groupBy(*names).agg(F.collect_list(F.struct("col_pos", "norm", "place", "target")).alias("took"))
    took = written(took.select(*[F.col(n).alias(f"{n}_of") for n in names], "took"), "fuzzy-taken")
    out = rows.withColumn("place", F.row_number().over(place)).join(near, "norm", "left")
    same = [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names]
    out = out.join(took, reduce(lambda x, y: x & y, same, F.lit(True)), "left")
    me = F.struct("col_pos", "norm", "place")
    gone = F.transform(F.filter("took", lambda t: F.struct(t["col_pos"].alias("col_pos"), t["norm"].alias("norm"), t["place"].alias("place")) < me), lambda t: t["target"])
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast("array<string>")))
    hit = F.filter("near", lambda v: ~F.array_contains("gone", v["target"]))
    out = out.withColumn("hit", F.get(hit, F.lit(0)))
    sim = -F.col("hit.minus")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "col_pos", "norm", F.col("hit.text").alias("matched_text"), F.when(sim >= threshold, F.col("hit.target")).alias("target"), sim.alias("similarity"))


# What is said for a piece of evidence.
SAID = {
    "numeric": "Column is predominantly numeric.",
    "string": "Column is predominantly string-like.",
    "currency": "Values show monetary/currency-like formatting.",
    "place": "Values contain repetition consistent with geographic categories.",
    "identifier": "Values have high uniqueness, consistent with identifiers.",
    "some_string": "Values contain predominantly string-like data.",
    "address": "Values have meaningful uniqueness, consistent with addresses.",
    "zip": "Values follow a ZIP/postal-code-like pattern.",
    "year": "Values predominantly resemble construction years.",
    "floors": "Values are consistent with small building/floor counts.",
    "buildings": "Values are consistent with small building counts.",
    "occupancy": "Values contain repeated categories.",
    "construction": "Values contain repeated construction categories.",
    "sprinkler": "Values match supported fire sprinkler codes.",
    "boolean": "Values are predominantly boolean-like.",
    "exact": "Exact header match.",
    "domain_alias": "Domain alias match.",
    "fuzzy": "Fuzzy header match.",
    "no_candidate": "No valid target candidates were available.",
    "low": "Best candidate score is below the minimum assignment score of {:.2f}.",
    "taken": "No one-to-one target assignment was available above the minimum score of {:.2f}.",
    "assigned": "Assigned using evidence-aware global one-to-one optimization.",
}


def small_integers(n: Column, low: Column, high: Column) -> Column:
    """EV12."""
    return F.when(n == 0, 0.0).when(low.isNull() | high.isNull(), n).when((low >= 0) & (high <= 100), n).otherwise(0.25 * n)


Scorer = tuple[Column, dict[str, Column], list[tuple[Column, str]]]


def evidence_fields() -> dict[str, Scorer]:
    """EV1 to EV14: for every target in order its score, components and reasons, over a profile's columns. A registry:
    callers change or add entries and hand it to field_evidence."""
    n, s, u = (T.clip(F.col(f"{x}_ratio")) for x in ("numeric", "string", "unique"))
    cur, yr, boo, spr, zp = (T.clip(F.col(f"{x}_ratio")) for x in ("currency", "year", "boolean", "sprinkler", "zip"))
    small = T.clip(small_integers(n, F.col("min"), F.col("max")))
    mostly = (n >= 0.75, SAID["numeric"])
    words = (s >= 0.75, SAID["string"])
    money = (0.60 * n + 0.40 * cur, {"numeric_ratio": n, "currency_like_ratio": cur}, [mostly, (cur >= 0.50, SAID["currency"])])
    place = (0.65 * s + 0.35 * (1 - u), {"string_ratio": s, "categorical_ratio": 1 - u}, [words, (u <= 0.50, SAID["place"])])
    kinds = lambda text: (0.60 * s + 0.40 * (1 - u), {"string_ratio": s, "categorical_ratio": 1 - u}, [words, (1 - u >= 0.50, text)])
    counts = lambda text: (0.35 * n + 0.65 * small, {"numeric_ratio": n, "small_integer_ratio": small}, [mostly, (small >= 0.75, text)])
    by = {
        "Reference": (0.65 * u + 0.35 * s, {"unique_ratio": u, "string_ratio": s}, [(u >= 0.75, SAID["identifier"]), (s >= 0.50, SAID["some_string"])]),
        "Address": (0.55 * s + 0.45 * u, {"string_ratio": s, "unique_ratio": u}, [words, (u >= 0.50, SAID["address"])]),
        "Zip": (0.75 * zp + 0.25 * n, {"zip_like_ratio": zp, "numeric_ratio": n}, [(zp >= 0.75, SAID["zip"]), mostly]),
        "Year Built": (yr, {"year_like_ratio": yr}, [(yr >= 0.75, SAID["year"])]),
        "Storeys": counts(SAID["floors"]),
        "Number of Buildings": counts(SAID["buildings"]),
        "Occupancy": kinds(SAID["occupancy"]),
        "Construction": kinds(SAID["construction"]),
        "Fire Sprinklers (Y/N)": (spr, {"sprinkler_like_ratio": spr, "boolean_like_ratio": boo}, [(spr >= 0.75, SAID["sprinkler"]), (boo >= 0.75, SAID["boolean"])]),
        **dict.fromkeys(("Building Value", "Contents", "BI", "Other"), money),
        **dict.fromkeys(("City", "State", "County", "Country"), place),
    }
    return {t: by[t] for t in TARGET_NAMES}


def field_evidence(profiles: DataFrame, keys: list[str], scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """JN6, EV14: a row a target (17) for each profile, from one projection."""
    rows = []
    for pos, (target, (score, components, reasons)) in enumerate((evidence_fields() if scorers is None else scorers).items()):
        parts = F.create_map(*[x for k, v in components.items() for x in (F.lit(k), v)])
        said = F.array_compact(F.array(*[F.when(c, m) for c, m in reasons]))
        rows.append(F.struct(F.lit(pos).alias("target_pos"), F.lit(target).alias("target"), T.clip(score).alias("score"), parts.alias("components"), said.alias("reasons")))
    return profiles.select(*keys, F.explode(F.array(*rows)).alias("e")).select(*keys, "e.*")


def ranked_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """TK4."""
    return evidence.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "target_pos")))


def final_score(det: Column, fuzzy: Column, semantic: Column, llm: Column, value: Column) -> Column:
    """OP4: the first kind of evidence that is there decides; values alone stay below the assignment's bar."""
    det, fuzzy, semantic, llm, value = map(T.clip, (det, fuzzy, semantic, llm, value))
    return (
        F.when(det >= 0.97, det).when(fuzzy >= FUZZY, 0.80 * fuzzy + 0.20 * value).when(semantic > 0, 0.80 * semantic + 0.20 * value)
        .when(llm > 0, 0.80 * llm + 0.20 * value).otherwise(F.least(0.45 * value, F.lit(0.49)))
    )


def merge_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG15, ST4: a row for each column and target: the best of every kind of evidence, distinct reasons in order, and
    the method of the highest priority (of equal ones the earlier). rows: *keys, target, seq, method, det, fuzzy,
    semantic, llm, value, reasons."""
    prio = F.element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]), F.col("method"))
    best = [F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("det", "fuzzy", "semantic", "llm", "value")]
    said = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reasons"))), lambda x: x["reasons"])))
    out = rows.groupBy(*keys, "target").agg(*best, said.alias("reasons"), F.max_by("method", F.struct(F.coalesce(prio, F.lit(0)), -F.col("seq"))).alias("method"), F.min("seq").alias("seq"))
    return out.withColumn("score", final_score(*map(F.col, ("det", "fuzzy", "semantic", "llm", "value"))))


def column_candidates(headers: DataFrame, evidence: DataFrame, keys: list[str], extra: DataFrame | None = None) -> DataFrame:
    """OP1, OP2, OP3, OP5: all candidate rows of the columns. headers: *keys, norm; evidence: field_evidence(). extra: rows
    of a semantic step or an LLM, in the same form. Targets outside the schema are left out (FL10)."""
    def rows(df: DataFrame, seq: int, method: str, kind: str, score: Column, reasons: Column) -> DataFrame:
        made = {k: F.lit(None).cast("double") for k in ("det", "fuzzy", "semantic", "llm", "value")} | {kind: score}
        return df.select(*keys, "target", F.lit(seq).alias("seq"), F.lit(method).alias("method"), *[c.alias(k) for k, c in made.items()], reasons.alias("reasons"))

    exact = rows(exact_match(headers).where("target IS NOT NULL"), 0, "exact", "det", F.lit(1.0), F.array(F.lit(SAID["exact"])))
    alias = rows(alias_match(headers).where("target IS NOT NULL"), 1, "domain_alias", "det", F.lit(0.97), F.array(F.lit(SAID["domain_alias"])))
    # a form of the vocabulary is similar to itself, so the deterministic score takes the similarity in (as fuzzy matches do)
    near = fuzzy_match(headers).where("target IS NOT NULL").withColumn("is_form", F.col("similarity") >= 0.97)
    fuzzy = rows(near, 2, "fuzzy", "fuzzy", F.col("similarity"), F.array(F.lit(SAID["fuzzy"]))).withColumn("det", F.when(F.col("fuzzy") >= 0.97, F.col("fuzzy")))
    value = rows(evidence.withColumnRenamed("reasons", "why"), 3, "value_evidence", "value", F.col("score"), F.col("why"))
    out = exact.unionByName(alias).unionByName(fuzzy).unionByName(value)
    out = out if extra is None else out.unionByName(extra)
    return out.join(F.broadcast(targets(headers.sparkSession).select("target")), "target", "left_semi")


def hungarian(cost: list[list[float]]) -> list[int]:
    """The column of each row in a least-cost assignment (rows at most as many as columns), by shortest augmenting paths;
    of equal costs the lower column."""
    n, m = len(cost), len(cost[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign_pairs(scores: dict[tuple[int, int], float], minimum: float = ELIGIBLE) -> dict[int, int]:
    """OP7: source -> target of as many eligible pairs as possible, and of those the highest total score."""
    rows = sorted({s for s, _ in scores})
    cols = sorted({t for _, t in scores})
    if not rows:
        return {}
    cost = [[1 - s if (s := scores.get((r, c), 0.0)) >= minimum else 10.0 for c in cols] for r in rows]
    if len(rows) > len(cols):
        found = {(rows[i], cols[j]) for j, i in enumerate(hungarian([list(x) for x in zip(*cost)]))}
    else:
        found = {(rows[i], cols[j]) for i, j in enumerate(hungarian(cost))}
    return {r: c for r, c in found if scores.get((r, c), 0.0) >= minimum}


def score_matrix(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """AG21: a column for each target in order, 0 where there is no candidate; unknown targets are left out."""
    known = candidates.where(F.col("target").isin(*TARGET_NAMES))
    return known.groupBy(*keys).pivot("target", TARGET_NAMES).agg(F.max(T.clip(F.col("score")))).na.fill(0.0)


def assign(candidates: DataFrame, group: list[str], minimum: float = ELIGIBLE) -> DataFrame:
    """JN9, OP7, FL11, ST2: *group, col_pos, target, score of the chosen pairs. A workbook's eligible pairs (columns x 17
    at most) form one group; pairs that aren't eligible don't leave their partition."""
    pos = {t: i for i, t in enumerate(TARGET_NAMES)}
    best = candidates.where(F.col("target").isin(*TARGET_NAMES)).groupBy(*group, "col_pos", "target").agg(F.max(T.clip(F.col("score"))).alias("score"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = {(r.col_pos, pos[r.target]): r.score for r in pdf.itertuples()}
        pairs = assign_pairs(scores, minimum)
        chosen = pdf[[pairs.get(r.col_pos) == pos[r.target] for r in pdf.itertuples()]]
        return chosen[[*group, "col_pos", "target", "score"]]

    kinds = dict(best.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*group, "col_pos", "target", "score"])
    return best.where(F.col("score") >= minimum).groupBy(*group).applyInPandas(solve, schema)


def mapping_result(columns: DataFrame, candidates: DataFrame, chosen: DataFrame, group: list[str], minimum: float = ELIGIBLE) -> DataFrame:
    """OP8, ST5, FN27: every column, mapped or with the reason why not and for a person to review. Where no column of a
    workbook has an eligible candidate, scores are 0; elsewhere a column without a target shows its best score."""
    keys = [*group, "col_pos"]
    best = candidates.groupBy(*keys).agg(F.max(T.clip(F.col("score"))).alias("best_score"))
    books = best.groupBy(*group).agg(F.max("best_score").alias("book_score"))
    picked = chosen.select(*keys, "target", F.col("score").alias("mapped_score"))
    why = candidates.select(*keys, "target", F.array_join("reasons", "; ").alias("evidence"))
    out = columns.join(best, keys, "left").join(books, group, "left").join(picked, keys, "left").join(why, [*keys, "target"], "left")
    mapped = F.col("target").isNotNull()
    reason = (
        F.when(mapped, F.coalesce(F.nullif("evidence", F.lit("")), F.lit(SAID["assigned"]))).when(F.col("book_score").isNull(), SAID["no_candidate"])
        .when(F.col("book_score") < minimum, SAID["low"].format(minimum)).otherwise(SAID["taken"].format(minimum))
    )
    score = F.when(F.coalesce(F.col("book_score") < minimum, F.lit(True)), 0.0).otherwise(F.coalesce("mapped_score", "best_score", F.lit(0.0)))
    return out.select(*keys, "target", score.alias("score"), F.when(mapped, "global_assignment").otherwise("unresolved").alias("method"), (~mapped).alias("human_review_required"), reason.alias("reason"))


def mapping_report(mapping: DataFrame, group: list[str], warnings: DataFrame | None = None) -> DataFrame:
    """OP6, OP8: a row a workbook: its unresolved columns and assigned targets in the columns' order, and its warnings.
    mapping: *group, col_pos, col, target; warnings: *group, col_pos, warning."""
    listed = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("col_pos", F.col(v).alias("v"))))), lambda x: x["v"])
    free = F.col("target").isNull()
    out = mapping.groupBy(*group).agg(listed(free, "col").alias("unresolved_columns"), listed(~free, "target").alias("assigned_targets"))
    none = F.array().cast("array<string>")
    if warnings is None:
        return out.withColumn("warnings", none)
    said = warnings.groupBy(*group).agg(listed(F.col("warning").isNotNull(), "warning").alias("warnings"))
    return out.join(said, group, "left").withColumn("warnings", F.coalesce("warnings", none))


def normalized(headers: DataFrame) -> DataFrame:
    """headers (col, ...) with norm; only those that aren't ASCII go through Python."""
    plain = F.coalesce(F.col("col"), F.lit("")).rlike(r"\A[\x00-\x7F]*\z")
    return headers.where(plain).withColumn("norm", T.mapping_header(F.col("col"), nfkc=False)).unionByName(headers.where(~plain).withColumn("norm", T.mapping_header(F.col("col"))))


def map_columns(cells: DataFrame, extra: DataFrame | None = None, group: list[str] | None = None, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """OP6: from cells (*group, col_pos, col, row_idx, value; col is the header) to the mapping of every column. extra:
    candidate rows of a semantic step or a model, as semantic.evidence gives them."""
    return map_with_warnings(cells, extra, group, scorers)[0]


def map_with_warnings(cells: DataFrame, extra: DataFrame | None = None, group: list[str] | None = None, scorers: dict[str, Scorer] | None = None, detectors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """OP6 with its diagnostics: (mapping, warnings). detectors: for profile_columns, beside its own; where a Guarded one
    fails, the column has no value evidence and a warning (*group, col_pos, warning), and keeps its other evidence."""
    from gridlore.operators.profile import profile_columns

    group = group or []
    work = cells if group else cells.withColumn("workbook", F.lit("workbook"))
    own = group or ["workbook"]
    if extra is not None and not group:
        extra = extra.withColumn("workbook", F.lit("workbook"))
    keys = [*own, "col_pos"]
    profiles = profile_columns(work, (*own, "col_pos", "col"), None if detectors is None else T.DETECTORS | detectors)
    if "error" not in profiles.columns:
        profiles = profiles.withColumn("error", F.lit(None).cast("string"))
    profiles = written(profiles, "profiles")  # a row a column; the steps below read it, not the cells
    headers = written(normalized(profiles.select(*keys, "col")), "headers")
    evidence = field_evidence(profiles.where("error IS NULL"), keys, scorers)
    failed = profiles.where("error IS NOT NULL").select(*keys, F.concat(F.lit("Failed to process '"), F.col("col"), F.lit("': "), F.col("error")).alias("warning"))
    merged = merge_candidates(column_candidates(headers.select(*keys, "norm"), evidence, keys, extra), keys)
    out = mapping_result(headers.select(*keys, "col"), merged, assign(merged, own), own).join(headers.select(*keys, "col"), keys)
    drop = [] if group else ["workbook"]
    return out.drop(*drop), failed.drop(*drop)
