"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within its source the keys are range-sorted, a distributed prefix sum of sizes
runs along them, and the source's budget cuts it exactly; budgets above a source's size run into a second epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import WORD, column, free, keyed, materialize

#: Ranges of the key space within a source. Keys are uniform, so equal ranges hold equal shares, whatever the source's size.
RANGES = 4096


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """60 random bits that depend on the document's id alone, or without one on its text."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(own, F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size, target of a table (source, size) with any number of rows a source.

    Sources in code-point order, null last, get the weights in turn. Filling the sources up to one level, a target is
    least(cap, level * weight). In order of cap / weight, the level is that of the first source that stays below its cap, and
    levels only fall after it, so it is the greatest of those. The windows run over one
    row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", (F.lit(epochs) * F.col("source_size")).cast("double")).withColumn("pool", F.lit(share) * F.sum("source_size").over(everything).cast("double"))
    ratio = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    by = by.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return by.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, *keep: str) -> DataFrame:
    """doc_id, *keep, size, source_size, target, taken: the words that the mix takes of each row.

    A row's taken words are those of its prefix range [p, p + size) below the budget floor(target), once for each epoch.
    Null text: size 0. Null doc_id: a key made from the text. Repeated rows are rows of their own; rows with equal keys
    are ordered by id, size and a hash of the text, after which they are alike. Empty table: no rows.
    """
    sized = docs.select("doc_id", *keep, "source", size_of().alias("size"), random_key().alias("key"), F.xxhash64("text").alias("said"))
    return mix_sized(materialize(sized, "mix-sized"), weights, share, epochs, *keep)


def mix_sized(sized: DataFrame, weights: tuple[int, ...], share: float, epochs: int, *keep: str) -> DataFrame:
    shift = (60 - RANGES.bit_length() + 1)
    # null sources are a source: joins and windows compare a struct that is never null
    sized = sized.withColumn("src", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))).withColumn("part", F.shiftright("key", shift))
    parts = sized.groupBy("src", "part").agg(F.sum("size").alias("words"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, share, epochs)
    goal = goal.select(F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("src"), "source_size", "target")
    upto = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset")).join(goal, "src")
    within = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.join(parts, ["src", "part"]).withColumn("start", F.col("offset") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target").cast("long")
    taken = sum((F.least(F.col("size"), F.greatest(F.lit(0), budget - F.lit(e) * F.col("source_size") - F.col("start"))) for e in range(epochs)), F.lit(0))
    return rows.select("doc_id", *keep, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The documents of the mix, with the columns of docs: a document taken twice is there twice, one that the budget
    cuts holds its first words up to the cut (joined by one space), one that isn't taken is gone."""
    rid, size, share_taken, copy = (free(docs, f"mix_{c}") for c in ("rid", "size", "taken", "copy"))
    numbered = keyed(docs, rid)
    taken = mix(numbered, weights, share, epochs, rid).where("taken > 0")
    rows = numbered.join(taken.select(rid, F.col("size").alias(size), F.col("taken").alias(share_taken)), rid)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(share_taken) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(share_taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    text = F.when(words < F.col(size), cut).otherwise(F.col("text"))
    n_chars = F.when(words < F.col(size), F.length(cut).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    changed = {"text": text} | ({"n_chars": n_chars} if n_chars is not None else {})
    return rows.select(*[changed[c].alias(c) if c in changed else column(c) for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|mix'), 1, 15))::BIGINT AS key
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, (2 * source_size)::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS pool
  FROM by_source),
levels AS (
  SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed),
goal AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN lv * weight <= cap THEN lv END) OVER ()) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (least(p.size, greatest(0, floor(g.target)::BIGINT - p.start))
        + least(p.size, greatest(0, floor(g.target)::BIGINT - g.source_size - p.start)))::BIGINT AS taken
FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
"""
