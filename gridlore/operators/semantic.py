"""Semantic evidence: retrieval by embeddings, reranking, evaluation, and the boundary to a language model.

Models are plug-ins. An embedder turns texts into unit vectors, a pair scorer turns pairs of texts into logits, and a
client turns a prompt into JSON. Without weights the default embedder hashes character trigrams (a stand-in that keeps
the plan runnable, not the same vectors a trained model gives), and without a scorer or client the fallbacks hold.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.functions.vocabulary import TARGET_NAMES, targets

TOP_K, DIM = 3, 256


def trigram_embedding(c: Column, dim: int = DIM) -> Column:
    """ML1's default: counts of hashed character trigrams, scaled to length 1. All in the JVM."""
    bind = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a lambda's variable is computed once
    padded = F.concat(F.lit("  "), F.lower(c), F.lit("  "))
    slots = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.pmod(F.hash(F.substring(padded, i, F.lit(3))), F.lit(dim)))
    counts = bind(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(own, lambda s: s == d)).cast("double")))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return bind(counts, lambda v: bind(length(v), lambda n: F.transform(v, lambda x: x / n)))


def target_embeddings(spark, embed: Callable[[Column], Column] = trigram_embedding) -> DataFrame:
    """FN28: 17 rows, embedded once and not once a header."""
    t = targets(spark).withColumn("text", T.target_text(F.col("target"), F.col("description"), F.col("aliases")))
    return t.select("target_pos", "target", "text", embed(F.col("text")).alias("target_vector"))


#: Gives, once a task, what turns texts into vectors.
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]


def embedded(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """ML1: rows with vector, or with error where the model fails: at once for all rows if it can't be made, else for the
    texts of a batch."""
    schema = rows.withColumn("vector", F.lit(None).cast("array<double>")).withColumn("error", F.lit(None).cast("string")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            try:
                model = model or embedder()
                yield pdf.assign(vector=[[float(x) for x in v] for v in model(pdf[text].tolist())], error=None)
            except Exception as e:  # told in the error column
                yield pdf.assign(vector=None, error=f"Semantic retrieval failed: {type(e).__name__}: {e}")

    return rows.mapInPandas(run, schema)


def retrieve(headers: DataFrame, keys: list[str], value_evidence: DataFrame | None = None, embed: Callable[[Column], Column] = trigram_embedding, top_k: int = TOP_K, assigned: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """ML1, JN4, JN5, TK2, FN22: the top_k targets of each header (*keys, norm) by combined score, with the reasons of the
    value evidence. The 17 targets stand beside each header as one array; value evidence that is missing is 0. embed
    builds a vector column in the JVM; an embedder is a model instead. A header that it fails for has one row, without a
    target and with error."""
    spark = headers.sparkSession
    if embedder is None:
        t = target_embeddings(spark, embed).withColumn("error", F.lit(None).cast("string"))
        h = headers.select(*keys, "norm", embed(F.col("norm")).alias("vector"), F.lit(None).cast("string").alias("error"))
    else:
        t = embedded(target_embeddings(spark, lambda c: F.lit(None)).drop("target_vector"), "text", embedder).withColumnRenamed("vector", "target_vector")
        h = embedded(headers.select(*keys, "norm"), "norm", embedder)
    if assigned is not None:
        t = t.join(assigned.select("target").distinct(), "target", "left_anti")
    all_targets = t.agg(F.max("error").alias("target_error"), F.collect_list(F.struct("target_pos", "target", "text", "target_vector")).alias("ts"))
    h = h.crossJoin(F.broadcast(all_targets)).withColumn("error", F.coalesce("error", "target_error"))
    near = F.transform("ts", lambda x: F.struct(x["target_pos"].alias("target_pos"), x["target"].alias("target"), x["text"].alias("target_text"), T.clip(T.cosine(F.col("vector"), x["target_vector"])).alias("embedding_score")))
    failed = F.array(F.struct(F.lit(None).cast("int").alias("target_pos"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("target_text"), F.lit(None).cast("double").alias("embedding_score")))
    pairs = h.select(*keys, "norm", "error", F.explode(F.when(F.col("error").isNull(), near).otherwise(failed)).alias("p")).select(*keys, "norm", "error", "p.*")
    if value_evidence is None:
        pairs = pairs.withColumn("value_score", F.lit(0.0)).withColumn("reasons", F.array().cast("array<string>"))
    else:
        pairs = pairs.join(value_evidence.select(*keys, "target", F.col("score").alias("value_score"), "reasons"), [*keys, "target"], "left").na.fill(0.0, ["value_score"])
        pairs = pairs.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    pairs = pairs.withColumn("combined_score", F.when(F.col("target").isNotNull(), T.retrieval_score(F.col("embedding_score"), F.col("value_score"))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("combined_score"), "target_pos"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top_k)


def rerank(candidates: DataFrame, keys: list[str], scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None) -> DataFrame:
    """ML2, ML3, FN20, FN21, TK3: candidates with rerank_score and their new rank. scorer() is called once a task and
    gives the pair scorer. Without one, or where it fails, the order stays, rerank_score is the combined score, and error
    says why."""
    if "error" in candidates.columns:
        candidates = candidates.withColumnRenamed("error", "retrieval_error")
    else:
        candidates = candidates.withColumn("retrieval_error", F.lit(None).cast("string"))
    if scorer is None:
        return candidates.withColumn("ce_score", F.lit(None).cast("double")).withColumn("rerank_score", F.col("combined_score")).withColumn("error", F.lit("no pair scorer"))
    schema = candidates.withColumn("logit", F.lit(None).cast("double")).withColumn("error", F.lit(None).cast("string")).schema

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, failed = None, None
        for pdf in parts:
            ok = pdf["target"].notna()
            try:
                model = model or scorer()
                logit = pd.Series(None, index=pdf.index, dtype="float64")
                logit[ok] = model(pdf["norm"][ok].tolist(), pdf["target_text"][ok].tolist())
                yield pdf.assign(logit=logit, error=None)
            except Exception as e:  # told in the error column
                failed = f"{type(e).__name__}: {e}"
                yield pdf.assign(logit=None, error=failed)

    out = candidates.mapInPandas(score, schema).withColumn("ce_score", T.sigmoid(F.col("logit"))).drop("logit")
    new = T.rerank_score(F.col("ce_score"), F.col("embedding_score"), F.col("value_score"))
    out = out.withColumn("rerank_score", F.when(F.col("error").isNull(), new).otherwise(F.col("combined_score")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), "rank")))


def category(top: Column, margin: Column, error: Column | None = None) -> Column:
    """FL12."""
    out = F.when(top.isNull(), "unresolved")
    out = out if error is None else out.when(error.isNotNull(), "unresolved")
    return out.when(top < 0.50, "weak").when((top >= 0.70) & (margin >= 0.20), "strong").when(margin >= 0.15, "moderate").otherwise("ambiguous")


def evaluate(candidates: DataFrame, keys: list[str], score: str = "combined_score") -> DataFrame:
    """ML4, WN4: top two of each header, their margin (6 places), the category and a summary in words; candidates whose
    retrieval failed are unresolved, with errors."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    failed = F.max("retrieval_error") if "retrieval_error" in candidates.columns else F.lit(None).cast("string")
    out = candidates.groupBy(*keys).agg(at("target", 1).alias("top"), at(score, 1).alias("top_score"), at("target", 2).alias("second"), at(score, 2).alias("second_score"), failed.alias("errors"))
    margin = F.round(F.greatest(F.lit(0.0), F.col("top_score") - F.coalesce("second_score", F.lit(0.0))), 6)
    three = lambda c: F.format_string("%.3f", F.col(c))
    summary = F.concat(F.lit("Top candidate: "), F.col("top"), F.lit(" (score "), three("top_score"), F.lit("). "), F.coalesce(F.concat(F.lit("Second candidate: "), F.col("second"), F.lit(" (score "), three("second_score"), F.lit("). ")), F.lit("")), F.lit("Margin: "), three("margin"), F.lit("."))
    out = out.withColumn("margin", margin)
    return out.withColumn("category", category(F.col("top_score"), F.col("margin"), F.col("errors"))).withColumn("summary", summary)


def packages(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """CX5's part that the retrieval fills: of each header its candidates by rank, and the evidence of the first."""
    six = lambda c: F.round(c, 6)
    one = F.struct("rank", F.struct(F.col("target").alias("target_field"), six(F.col("combined_score")).alias("score"), six(F.col("embedding_score")).alias("embedding_similarity"), six(F.col("value_score")).alias("value_evidence_score"), F.col("reasons").alias("evidence_reasons")).alias("c"))
    out = candidates.groupBy(*keys).agg(F.max("norm").alias("normalized_header"), F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), one))), lambda x: x["c"]).alias("candidates"))
    top = F.get("candidates", F.lit(0))
    profile = F.struct(top["target_field"].alias("top_target_field"), top["embedding_similarity"].alias("top_embedding_similarity"), top["value_evidence_score"].alias("top_value_evidence_score"))
    return out.withColumn("column_profile", F.when(top.isNotNull(), profile))


def prompt_context(evaluated: DataFrame, samples: DataFrame, keys: list[str], candidates: DataFrame | None = None, header: str | None = None, n: int = 5) -> DataFrame:
    """ML7, CX5, WN9: what a language model is told of each header, as JSON; n sample values at most. With the retrieval's
    candidates, theirs is the evidence: source and normalised header, candidates, column profile, samples; without, the
    evaluation's top two."""
    out = evaluated.join(samples.select(*keys, F.slice("samples", 1, n).alias("samples")), keys, "left")
    if candidates is None:
        return out.withColumn("context", F.to_json(F.struct("top", F.round("top_score", 6).alias("top_score"), "second", F.round("second_score", 6).alias("second_score"), "margin", "category", "samples")))
    own = F.col(header or keys[-1]).cast("string")
    told = F.struct(own.alias("source_header"), "normalized_header", "candidates", "column_profile", F.coalesce("samples", F.array().cast("array<string>")).alias("sample_values"))
    return out.join(packages(candidates, keys), keys, "left").withColumn("context", F.to_json(told)).drop("normalized_header", "candidates", "column_profile")


#: What a model is told to keep to, beside each prompt.
RULES = (
    "You map one column of a property schedule to one of the given target fields, or to none. Use the evidence alone: the header's meaning, the candidates and the column's values. "
    "Scores are not probabilities. Don't make up fields, change data or fill gaps. If the evidence leaves it open, say null with a low confidence, so that a person decides. Answer with the JSON object that is asked for and nothing else."
)


def prompt(context: Column) -> Column:
    """FN30."""
    return F.concat(F.lit("Choose the target field of a spreadsheet column, or null if none fits. Fields: " + ", ".join(TARGET_NAMES) + ". Evidence: "), context, F.lit('. Answer with JSON: {"target_field": ..., "confidence": 0 to 1, "reason": ...}.'))


def ask(contexts: DataFrame, client: Callable[[], Callable[..., str]] | None) -> DataFrame:
    """ML6: adds response, the client's JSON for each prompt, and error where the client fails for a prompt or can't be
    made; null without a client. No evidence is lost by any of these. What client() gives takes the prompt, or RULES and
    the prompt."""
    rows = contexts.withColumn("prompt", prompt(F.col("context")))
    if client is None:
        return rows.withColumn("response", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    schema = rows.withColumn("response", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send, broken = None, None
        try:
            made = client()
            send = made if len(inspect.signature(made).parameters) == 1 else lambda p: made(RULES, p)
        except Exception as e:  # told in the error column
            broken = f"{type(e).__name__}: {e}"
        for pdf in parts:
            got = []
            for p in pdf["prompt"]:
                try:
                    got.append((send(p), None) if send else (None, broken))
                except Exception as e:
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(response=[r for r, _ in got], error=[e for _, e in got])

    return rows.mapInPandas(call, schema)


def checked(response: Column) -> Column:
    """CX4, FL14: struct target, confidence, reason, problem of a response; problem is null only for an object of exactly
    the three keys, with a known or null target, a confidence in 0..1 and a reason."""
    d = F.from_json(response, "target_field string, confidence double, reason string")
    names = F.coalesce(F.array_sort(F.json_object_keys(response)), F.array().cast("array<string>"))
    problem = (
        F.when(response.isNull(), "no response").when(names != F.array(*map(F.lit, ("confidence", "reason", "target_field"))), "keys").when(d["target_field"].isNotNull() & ~d["target_field"].isin(*TARGET_NAMES), "unknown target")
        .when(d["confidence"].isNull() | ~d["confidence"].between(0, 1), "confidence").when(F.coalesce(F.trim(d["reason"]), F.lit("")) == "", "reason")
    )
    return F.struct(d["target_field"].alias("target"), d["confidence"].alias("confidence"), d["reason"].alias("reason"), problem.alias("problem"))


def needs_review(target: Column, confidence: Column) -> Column:
    """FL13."""
    return target.isNull() | (F.coalesce(confidence, F.lit(0.0)) < 0.50)


def decide(answered: DataFrame) -> DataFrame:
    """OP9: strong and moderate matches stand; else a valid answer of the model; else the top match, for review."""
    a, sure = checked(F.col("response")), F.col("category").isin("strong", "moderate")
    out = answered.withColumn("answer", a).withColumn("ok", F.col("answer.problem").isNull())
    target = F.when(sure, F.col("top")).when(F.col("ok"), F.col("answer.target"))
    confidence = F.when(sure, F.col("top_score")).when(F.col("ok"), F.col("answer.confidence")).otherwise(0.0)
    out = out.withColumn("decided", target).withColumn("confidence", confidence).withColumn("decided_by", F.when(sure, "semantic").when(F.col("ok"), "llm").otherwise("none"))
    return out.withColumn("human_review", needs_review(F.col("decided"), F.col("confidence"))).drop("ok")


def semantic_pipeline(headers: DataFrame, keys: list[str], scorer=None, embed=trigram_embedding, top_k: int = TOP_K, embedder: Embedder | None = None, value_evidence: DataFrame | None = None, assigned: DataFrame | None = None) -> DataFrame:
    """ML5: retrieve with value evidence among the targets that aren't assigned, rerank, evaluate: a row for each header
    (*keys, norm) with top, second, their scores, margin, summary, category, status and errors. A failing scorer leaves the
    retrieval's order; where retrieval fails or finds nothing, nothing is evaluated and the status is unresolved."""
    found = rerank(retrieve(headers, keys, value_evidence, embed, top_k, assigned, embedder), keys, scorer)
    unranked = found.groupBy(*keys).agg(F.max("error").alias("rerank_error"))
    judged = evaluate(found, keys, "rerank_score").withColumnRenamed("errors", "retrieval_error").join(unranked, keys)
    out = headers.select(*keys, "norm").join(judged, keys, "left")
    none = F.col("top").isNull()
    errors = F.array_compact(F.array(
        F.col("retrieval_error"), F.when(none & F.col("retrieval_error").isNull(), "No semantic candidates were retrieved."),
        F.when(~none, F.concat(F.lit("Cross-encoder reranking failed: "), F.col("rerank_error"))),
    ))
    status = F.when(none | F.col("retrieval_error").isNotNull(), "unresolved").otherwise(F.col("category"))
    return out.withColumn("status", status).withColumn("errors", errors).drop("retrieval_error", "rerank_error")


def evidence(headers: DataFrame, keys: list[str], samples: DataFrame | None = None, value_evidence: DataFrame | None = None, scorer=None, client=None, embedder: Embedder | None = None, weigh: bool = False) -> tuple[DataFrame, DataFrame]:
    """OP3, OP5, OP6: candidate rows for map_columns(extra=) from the semantic steps and, for headers that these leave
    open, from a language model; and warnings (*keys, warning) of what failed. headers: *keys, col, norm; samples: *keys,
    samples. A semantic candidate brings its value evidence and reasons, a model's its reason; their own scores count in
    the fusion only with weigh."""
    found = rerank(retrieve(headers, keys, value_evidence, embedder=embedder), keys, scorer)
    judged = evaluate(found, keys, "rerank_score")
    none = F.lit(None).cast("double")
    rows = found.where("target IS NOT NULL").select(
        *keys, "target", (F.lit(10) + F.col("rank")).alias("seq"), F.lit("semantic").alias("method"), none.alias("det"), none.alias("fuzzy"),
        (F.col("rerank_score") if weigh else none).alias("semantic"), none.alias("llm"), F.col("value_score").alias("value"), "reasons")
    failed = judged.where("errors IS NOT NULL").select(*keys, F.col("errors").alias("problem"))
    if client is not None:
        samples = headers.select(*keys, F.array().cast("array<string>").alias("samples")) if samples is None else samples
        told = prompt_context(judged.join(headers.select(*keys, "col"), keys), samples, keys, found, "col")
        answered = ask(told.where(~F.col("category").isin("strong", "moderate") & F.col("errors").isNull()), client)
        decided = decide(answered).where("decided_by = 'llm' AND decided IS NOT NULL")
        rows = rows.unionByName(decided.select(*keys, F.col("decided").alias("target"), F.lit(20).alias("seq"), F.lit("llm").alias("method"), none.alias("det"), none.alias("fuzzy"), none.alias("semantic"), (F.col("confidence") if weigh else none).alias("llm"), none.alias("value"), F.array("answer.reason").alias("reasons")))
        failed = failed.unionByName(answered.where("error IS NOT NULL").select(*keys, F.col("error").alias("problem")))
    warnings = failed.join(headers.select(*keys, "col"), keys).select(*keys, F.concat(F.lit("Failed to process '"), F.col("col"), F.lit("': "), F.col("problem")).alias("warning"))
    return rows, warnings
