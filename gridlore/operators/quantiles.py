"""Exact quantiles of weighted values by distributed rank selection: no buffer grows with a column's distinct values.

Values fall into buckets of a monotone scale (a logarithm for each sign), of which a column has at most some 520,000 and
which are counted with partial aggregation. Prefix sums over a column's buckets tell which bucket holds each rank. Only
the values of these are looked at again, cut into 2^22 equal ranges, and the values of the ranges that hold the ranks
are then counted one by one; a range that narrow has fewer than 2^22 doubles. Buckets of one value end the search early.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.sources.tables import written

#: Buckets for each unit of the natural logarithm, an offset that makes them positive, and the ranges of a bucket.
SCALE, OFFSET, RANGES = 360, 300_000, 1 << 22


def bucket(x: Column) -> Column:
    """A whole number that never falls as x grows; null of null."""
    size = F.floor(F.least(F.ln(F.abs(x)) * SCALE, F.lit(OFFSET - 1.0))) + OFFSET
    return F.when(x > 0, size).when(x < 0, -size).when(x == 0, 0).cast("int")


def centre(b: Column) -> Column:
    """The middle of a bucket, on its scale."""
    return F.signum(b.cast("double")) * F.when(b == 0, 0.0).otherwise(F.exp((F.abs(b) - (OFFSET - 0.5)) / SCALE))


def ranks(n: Column, shares: tuple[float, ...]) -> Column:
    """The order statistics between which the quantiles of n values lie: structs of k and rank (from 0); the k-th share has
    those of 2 k and 2 k + 1."""
    at = [F.lit(p) * (n - 1) for p in shares]
    return F.array(*[F.struct(F.lit(2 * k + up).alias("k"), f(a).cast("long").alias("rank")) for k, a in enumerate(at) for up, f in ((0, F.floor), (1, F.ceil))])


def _held(before: Column, n: Column, wanted: Column) -> Column:
    """The ranks that lie in a bucket, counted from its first value."""
    own = F.filter(wanted, lambda r: (r["rank"] >= before) & (r["rank"] < before + n))
    return F.transform(own, lambda r: F.struct(r["k"].alias("k"), (r["rank"] - before).alias("rank")))


def _before(keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_ranks(buckets: DataFrame, keys: list[str], order: str = "bucket") -> DataFrame:
    """buckets (keys, order, n, ...) of numbers with `before`, how many values lie in earlier ones, and `total`."""
    return buckets.select("*", _before(keys, order).alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))


def select(values: DataFrame, buckets: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """keys and x0, x1, ...: the order statistics of ranks() of values (keys, bucket, x, cnt); buckets: with_ranks() of their
    buckets with n, lo and hi (least and largest value). Both are read more than once, so they should be tables."""
    first = buckets.select(*keys, "bucket", "lo", "hi", _held(F.col("before"), F.col("n"), ranks(F.col("total"), shares)).alias("held")).where(F.size("held") > 0)
    known = lambda df: df.where("lo = hi").select(*keys, "lo", "held")
    first = written(first, "quantile-buckets")
    at, opened = [*keys, "bucket"], first.where("lo < hi")
    part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1)).cast("int")
    inside = values.where("x IS NOT NULL").select(*at, (F.col("x") + 0.0).alias("x"), "cnt").join(opened.select(*at, "lo", "hi"), at).select(*at, part.alias("part"), "x", "cnt")
    parts = inside.groupBy(*at, "part").agg(F.sum("cnt").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    parts = parts.select("*", _before(at, "part").alias("before")).join(opened.select(*at, "held"), at)
    second = parts.select(*at, "part", "lo", "hi", _held(F.col("before"), F.col("n"), F.col("held")).alias("held")).where(F.size("held") > 0)
    second = written(second, "quantile-ranges")
    at, opened = [*at, "part"], second.where("lo < hi")
    single = inside.join(opened.select(*at), at).groupBy(*at, "x").agg(F.sum("cnt").alias("n"))
    single = single.select("*", _before(at, "x").alias("before")).join(opened.select(*at, "held"), at)
    third = single.select(*keys, F.col("x").alias("lo"), _held(F.col("before"), F.col("n"), F.col("held")).alias("held")).where(F.size("held") > 0)
    found = known(first).unionByName(known(second)).unionByName(third).select(*keys, F.col("lo").alias("x"), F.explode("held").alias("r"))
    each = [F.max(F.when(F.col("r.k") == k, F.col("x"))).alias(f"x{k}") for k in range(2 * len(shares))]
    return found.groupBy(*keys).agg(*each)


def interpolated(n: Column, shares: tuple[float, ...], at: Callable[[int], Column]) -> list[Column]:
    """The quantiles from the order statistics at(0), at(1), ... of ranks()."""
    out = []
    for k, p in enumerate(shares):
        pos, low, high = F.lit(p) * (n - 1), at(2 * k), at(2 * k + 1)
        out.append(F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high))
    return out


def quantiles(values: DataFrame, shares: tuple[float, ...], keys: list[str]) -> DataFrame:
    """keys, q: the exact quantiles at shares of each key's values (keys, x double, cnt: how often). Nulls don't count; keys
    without numbers have no row. Keys aren't null."""
    v = written(values.where("x IS NOT NULL").select(*keys, bucket(F.col("x")).alias("bucket"), "x", "cnt"), "quantile-values")
    b = v.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("n"), F.min(F.col("x") + 0.0).alias("lo"), F.max(F.col("x") + 0.0).alias("hi"))
    b = written(with_ranks(b, keys), "quantile-counts")
    found = select(v, b, keys, shares).join(b.groupBy(*keys).agg(F.first("total").alias("total")), keys)
    return found.select(*keys, F.array(*interpolated(F.col("total"), shares, lambda k: F.col(f"x{k}"))).alias("q"))
