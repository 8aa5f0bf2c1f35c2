"""Column profiles: one relation of cells for all columns, one aggregation for all profiles.

Cells are (col_pos, col, row_idx, value) with any further keys in front. Values are counted by (keys, column, stripped
text), with partial aggregation before the shuffle; patterns and parsing see each distinct text once, with its count, and
counting distinct ones is counting rows. Everything else is summed by bucket of the number that a text stands for: a
bucket's sums of powers are taken around its middle, so they lose nothing, and give mean, deviation and skewness of the
column without a second look; quantiles are found by rank selection over the same buckets (operators.quantiles).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.operators import quantiles as Q
from gridlore.sources.tables import written


#: Types whose values as text are plain numbers (so are finite doubles, which have a point), and those whose values as text
#: are no numbers and match no pattern.
_WHOLE, _NEVER = ("tinyint", "smallint", "int", "bigint"), ("boolean", "date", "timestamp", "timestamp_ntz")


def to_cells(df: DataFrame, row: Column, columns: list[str] | None = None) -> DataFrame:
    """CX6: a table's columns as long cells, nulls kept; row orders the rows."""
    return _long(df, row, list(enumerate(columns or df.columns)))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _long(df: DataFrame, row: Column, columns: list[tuple[int, str]]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), _column(c).cast("string").alias("value")) for i, c in columns])
    return df.select(row.cast("long").alias("row_idx"), F.explode(cells).alias("c")).select("c.col_pos", "c.col", "row_idx", "c.value")


def table_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """col_pos, col, value, cnt: value_counts() of to_cells() of a table. Whole numbers, doubles and times are counted in
    their own type; only distinct ones become text. Zeros are counted as text, as 0.0 and -0.0 are two."""
    columns, types = list(columns or df.columns), dict(df.dtypes)
    none = {k: F.lit(None).cast(k) for k in ("long", "double", "string")}

    def cell(i: int, c: str) -> Column:
        v, own = _column(c), dict(none)
        if types[c] in _WHOLE:
            own["long"] = v.cast("long")
        elif types[c] == "timestamp":
            own["long"] = F.unix_micros(v)
        elif types[c] == "double":
            own |= {"double": F.when(v != 0, v), "string": F.when(v == 0, v.cast("string"))}
        else:
            own["string"] = v.cast("string")
        return F.struct(F.lit(i).alias("col_pos"), *[k.alias(n) for n, k in own.items()])

    counts = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c")).select("c.*").groupBy("col_pos", *none).agg(F.count(F.lit(1)).alias("cnt"))
    times = [i for i, c in enumerate(columns) if types[c] == "timestamp"]
    whole = F.when(F.col("col_pos").isin(*times), F.timestamp_micros("long").cast("string")).otherwise(F.col("long").cast("string")) if times else F.col("long").cast("string")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col_pos") + 1)
    return counts.select("col_pos", name.alias("col"), F.coalesce(whole, F.col("double").cast("string"), F.col("string")).alias("value"), "cnt")


def _weighted(flag: Column) -> Column:
    return F.sum(F.when(flag, F.col("cnt")).otherwise(0))


def value_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"), F.min("row_idx").alias("first_row"))


def text_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, s (stripped text), cnt (cells) of every column."""
    return cells.groupBy(*keys, T.clean_string(F.col("value")).alias("s")).agg(F.count(F.lit(1)).alias("cnt"))


def form_counts(cells: DataFrame, keys: list[str], counted: bool = False) -> DataFrame:
    """text_counts() with forms, the distinct values of a text before it was stripped. counted: cells are table_counts()."""
    v = cells if counted else cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    return v.groupBy(*keys, T.clean_string(F.col("value")).alias("s")).agg(F.sum("cnt").alias("cnt"), F.count("value").alias("forms"))


_SHARES = (0.25, 0.5, 0.75)


def _summed(values: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Of values (keys, x, cnt, ...): keys, the sums (partial sums, least or largest ones, by name), numbers (cells that are
    one), min, max, mean, m2, m3 (central moments, not divided), and x0 to x5 (the quartiles' order statistics)."""
    x, b = F.col("x"), F.col("bucket")
    d = x - Q.centre(b)
    values = written(values.withColumn("bucket", Q.bucket(x)), "profile-texts")  # a row a distinct text, without the text
    powers = [F.sum(F.col("cnt") * F.pow(d, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3)]
    v = values.groupBy(*keys, "bucket").agg(F.sum(F.when(x.isNotNull(), F.col("cnt")).otherwise(0)).alias("n"), F.min(x + 0.0).alias("lo"), F.max(x + 0.0).alias("hi"), *powers, *[c.alias(k) for k, c in sums.items()])
    v = written(Q.with_ranks(v, keys), "profile-buckets")  # texts that are no numbers have the null bucket, and no n
    own = (F.col("lo") == F.col("hi"))
    n, s1, s2, s3 = (F.col(c) for c in ("n", "s1", "s2", "s3"))
    each = v.select(
        "*", F.when(own, F.col("lo")).otherwise(Q.centre(b) + s1 / F.nullif(n, F.lit(0))).alias("mean_b"), F.when(own, 0.0).otherwise(F.greatest(F.lit(0.0), s2 - s1 * s1 / F.nullif(n, F.lit(0)))).alias("m2_b"),
        F.when(own, 0.0).otherwise(s3 - 3 * s1 * s2 / F.nullif(n, F.lit(0)) + 2 * F.pow(s1, F.lit(3)) / F.nullif(n * n, F.lit(0))).alias("m3_b"),
    )
    each = each.withColumn("mean", F.sum(F.col("mean_b") * n / F.nullif("total", F.lit(0))).over(Window.partitionBy(*keys)))
    off = F.col("mean_b") - F.col("mean")
    final = {k: (F.max if k.startswith("max_") else F.sum)(k).alias(k) for k in sums}
    out = each.groupBy(*keys).agg(
        F.max("total").alias("numbers"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.max("mean").alias("mean"),
        F.sum(F.col("m2_b") + n * off * off).alias("m2"), F.sum(F.col("m3_b") + 3 * off * F.col("m2_b") + n * F.pow(off, F.lit(3))).alias("m3"), *final.values(),
    )
    return out.join(Q.select(values, v.where("bucket IS NOT NULL"), keys, _SHARES), keys, "left")


def _quartiles() -> list[Column]:
    return Q.interpolated(F.col("numbers"), _SHARES, lambda k: F.col(f"x{k}"))


def _part(sum_: str, of: str) -> Column:
    return F.coalesce(F.col(sum_) / F.nullif(of, F.lit(0)), F.lit(0.0))


def profile_columns(cells: DataFrame, keys: tuple[str, ...] = ("col_pos", "col"), detectors: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """AG8, AG9, AG11: the mapping profile of every column. Missing are null and texts that stand for it; ratios are of
    the values that are not missing, 0 without any; quantiles interpolate; std is that of a sample, 0 of one value.
    detectors: name -> test of a stripped text, each a ratio; by default those of functions.text. A test may be a Guarded
    one (operators.registry): there is then a column error, what it says of the texts it fails for, or null."""
    keys, detectors = list(keys), T.DETECTORS if detectors is None else detectors
    s = F.col("s")
    guarded = {n: f.udf() for n, f in detectors.items() if hasattr(f, "udf")}
    v = text_counts(cells, keys).select("*", *[f(s).alias(f"told_{n}") for n, f in guarded.items()])
    flags = [(F.coalesce(F.col(f"told_{n}.flag"), F.lit(False)) if n in guarded else f(s)).alias(f"is_{n}") for n, f in detectors.items()]
    v = v.select(*keys, "cnt", T.stands_for_missing(s).alias("missing"), T.number_of(s).alias("x"), *flags, *[F.col(f"told_{n}.error").alias(f"error_{n}") for n in guarded])
    here = ~F.col("missing")
    none = F.lit(None).cast("string")
    wrong = F.max(F.when(here, F.greatest(none, none, *[F.col(f"error_{n}") for n in guarded])))
    out = _summed(v, keys, {
        "total_count": F.sum("cnt"), "missing_count": _weighted(F.col("missing")), "unique_count": F.count_if(here), "present": _weighted(here),
        **{f"is_{n}": _weighted(here & F.col(f"is_{n}")) for n in detectors}, **({"max_error": wrong} if guarded else {}),
    })
    std = F.when(F.col("numbers") == 1, 0.0).when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1)))
    present, (q1, median, q3) = F.col("present") > 0, _quartiles()
    numeric = _part("numbers", "present")
    return out.select(
        *keys, "total_count", "missing_count", (F.col("missing_count") / F.col("total_count")).alias("missing_ratio"), "unique_count",
        F.when(present, F.col("unique_count") / F.col("present")).otherwise(0.0).alias("unique_ratio"), numeric.alias("numeric_ratio"),
        F.when(present, 1 - numeric).otherwise(0.0).alias("string_ratio"), "min", "max", "mean",
        median.alias("median"), std.alias("std"), q1.alias("q1"), q3.alias("q3"), *[_part(f"is_{n}", "present").alias(f"{n}_ratio") for n in detectors],
        *([F.col("max_error").alias("error")] if guarded else []),
    )


def top_values(cells: DataFrame, n: int = 10, keys: tuple[str, ...] = ("col_pos", "col")) -> DataFrame:
    """AG10 and TK6: the n most frequent present values of every column, of equal counts the first seen first."""
    v = cells.where(~T.is_missing(F.col("value"))).withColumn("value", T.clean_string(F.col("value")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), "first_row"))
    return value_counts(v, list(keys)).withColumn("rank", rank).where(F.col("rank") <= n)


def as_map(top: DataFrame, keys: tuple[str, ...] = ("col_pos", "col")) -> DataFrame:
    """CX1: the top values of a column as one map."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))), lambda e: F.struct(e["value"], e["cnt"]))
    return top.groupBy(*keys).agg(F.map_from_entries(entries).alias("top_values"))


# AG13, the posterior profile's patterns.
POSTERIOR_PATTERNS = {
    "zip_5_digit": lambda s: (F.octet_length(s) == 5) & s.rlike(r"\A\d{5}\z"),
    "year_4_digit": lambda s: (F.octet_length(s) == 4) & s.rlike(r"\A\d{4}\z"),
    "state_code": lambda s: (F.octet_length(s) == 2) & s.rlike(r"\A[A-Za-z]{2}\z"),
    "yes_no": lambda s: F.lower(s).isin("yes", "no", "y", "n"),
    "currency": lambda s: s.rlike(r"(?i)[$€£]|^\d+(\.\d+)?[KMB]$"),
    "decimal": lambda s: s.rlike(r"\A\d+\.\d+\z"),
}
_OF_NUMBERS = ("zip_5_digit", "year_4_digit", "decimal")  # what plain numbers can match; the others need no look at them


def _plain_number(s: Column) -> Column:
    return F.when(s.rlike(T._FLOAT), s.try_cast("double"))


def _told(s: Column, x: Column, patterns: list[str]) -> list[Column]:
    """The posterior's patterns of a stripped text s, of which x is the plain number."""
    tests = {n: F.coalesce(POSTERIOR_PATTERNS[n](s), F.lit(False)) for n in patterns}
    return [(t if n in _OF_NUMBERS else x.isNull() & t).alias(f"p_{n}") for n, t in tests.items()]


def _shares(sums: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame:
    return sums.select(*keys, _part("numbers", "present").alias("numeric_ratio"), "min", "max", *[_part(f"p_{n}", "present").alias(f"p_{n}") for n in patterns])


def posterior_shares(cells: DataFrame, keys: tuple[str, ...] = ("col_pos", "col"), patterns: tuple[str, ...] = tuple(POSTERIOR_PATTERNS)) -> DataFrame:
    """Of posterior_profile(): numeric_ratio, min, max and the patterns' shares. None of them needs distinct texts or an order,
    so cells are summed where they are read, by what is told of them; a task sends a few rows a column."""
    keys, patterns, s, x = list(keys), list(patterns), F.col("s"), F.col("x")
    v = cells.select(*keys, T.clean_string(F.col("value")).alias("s")).select("*", _plain_number(s).alias("x"))
    bits = [F.when(t, 1 << i).otherwise(0) for i, t in enumerate([s.isNotNull(), *_told(s, x, patterns)])]
    v = v.select(*keys, "x", reduce(Column.bitwiseOR, bits).alias("told")).groupBy(*keys, "told").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("numbers"), F.min(x + 0.0).alias("min"), F.max(x + 0.0).alias("max"))
    with_bit = [F.sum(F.when(F.col("told").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(["present", *[f"p_{n}" for n in patterns]])]
    return _shares(v.groupBy(*keys).agg(F.sum("numbers").alias("numbers"), F.min("min").alias("min"), F.max("max").alias("max"), *with_bit), keys, patterns)


#: What whole numbers have which a pattern of _OF_NUMBERS matches; no other pattern matches numbers.
_WHOLE_RANGES = {"zip_5_digit": (10_000, 99_999), "year_4_digit": (1000, 9999)}


def table_shares(df: DataFrame, columns: list[str] | None = None, patterns: tuple[str, ...] = tuple(POSTERIOR_PATTERNS)) -> DataFrame:
    """posterior_shares() of to_cells() of a table. Numbers and times are summed as they are, in one row and not as cells of
    text: what their text would match is known from their type and size. Strings and all other types are cells."""
    columns, patterns, types = list(columns or df.columns), [*patterns], dict(df.dtypes)
    typed = [(i, c) for i, c in enumerate(columns) if types[c] in (*_WHOLE, "double", *_NEVER)]
    texts = [(i, c) for i, c in enumerate(columns) if (i, c) not in typed]
    keys, out = ["col_pos", "col"], None
    if typed:
        sums, rows = [F.count(F.lit(1)).alias("rows")], []
        for i, c in typed:
            v, own = _column(c), {"present": F.count(_column(c))}
            if types[c] not in _NEVER:
                x = F.when(F.abs(v) < F.lit(float("inf")), v + 0.0) if types[c] == "double" else v  # NaN is above all numbers
                own |= {"numbers": F.count(x), "min": F.min(x), "max": F.max(x)}
            if types[c] in _WHOLE:
                own |= {f"p_{n}": F.count_if(v.between(*_WHOLE_RANGES[n])) for n in patterns if n in _WHOLE_RANGES}
            elif types[c] == "double" and "decimal" in patterns:  # some doubles are written with a sign or an exponent
                own["p_decimal"] = F.count_if(POSTERIOR_PATTERNS["decimal"](v.cast("string")))
            sums += [k.alias(f"{n}_{i}") for n, k in own.items()]
            got = {n: F.col(f"{n}_{i}") if n in own else F.lit(None if n in ("min", "max") else 0) for n in ("present", "numbers", "min", "max", *[f"p_{n}" for n in patterns])}
            rows.append(F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), *[k.cast("double" if n in ("min", "max") else "long").alias(n) for n, k in got.items()]))
        one = df.agg(*sums).where("rows > 0").select(F.explode(F.array(*rows)).alias("c")).select("c.*")
        out = _shares(one, keys, patterns)
    if texts:
        found = posterior_shares(_long(df, F.lit(0), texts), keys, patterns)
        out = found if out is None else out.unionByName(found)
    return out


def posterior_profile(cells: DataFrame, keys: tuple[str, ...] = ("col_pos", "col"), counted: bool = False) -> DataFrame:
    """AG12, AG13, AG14: the profile for the softmax mapping. Only nulls are missing, ratios are of all others, numbers
    are plain ones; std needs two numbers, skewness (bias-adjusted) three. dtype is what the values would be read as:
    int64 (whole numbers, none missing), float64 (numbers), else object. counted: cells are table_counts()."""
    keys = list(keys)
    s = F.col("s")
    v = form_counts(cells, keys, counted).select("*", _plain_number(s).alias("x"))
    v = v.select(*keys, "cnt", "forms", F.length(s).alias("chars"), "x", s.rlike(r"^[+-]?\d+$").alias("whole"), *_told(s, F.col("x"), list(POSTERIOR_PATTERNS)))
    there, x = F.col("chars").isNotNull(), F.col("x")
    out = _summed(v, keys, {
        "total_count": F.sum("cnt"), "present": _weighted(there), "unique_count": F.sum("forms"), "distinct_values": F.count("chars"), "zeros": _weighted(x == 0), "negatives": _weighted(x < 0), "whole": _weighted(F.col("whole")),
        "chars": F.sum(F.col("chars") * F.col("cnt")), "max_string_length": F.max("chars"), **{f"p_{n}": _weighted(F.col(f"p_{n}")) for n in POSTERIOR_PATTERNS},
    })
    n, numeric, (q1, median, q3) = F.col("numbers"), _part("numbers", "present"), _quartiles()
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(F.col("m2") / n, 1.5)).when(n > 2, 0.0)
    dtype = F.when(F.col("present") == 0, "object").when(F.col("whole") == F.col("total_count"), "int64").when(n == F.col("present"), "float64").otherwise("object")
    return out.select(
        *keys, dtype.alias("dtype"), "total_count", (1 - F.col("present") / F.col("total_count")).alias("missing_ratio"), "unique_count",
        _part("unique_count", "present").alias("unique_ratio"), numeric.alias("numeric_ratio"), (1 - numeric).alias("string_ratio"),
        _part("zeros", "present").alias("zero_ratio"), _part("negatives", "present").alias("negative_ratio"), "mean", median.alias("median"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "min", "max",
        q1.alias("q1"), q3.alias("q3"), skew.alias("skewness"), (F.col("chars") / F.nullif("present", F.lit(0))).alias("avg_string_length"), "max_string_length", "distinct_values",
        *[_part(f"p_{n}", "present").alias(f"p_{n}") for n in POSTERIOR_PATTERNS],
    )


def posterior_top_values(cells: DataFrame, n: int = 10, keys: tuple[str, ...] = ("col_pos", "col")) -> DataFrame:
    """AG12's top_values: the n most frequent texts of every column, of equal counts the first seen first; nulls alone
    are missing here."""
    v = cells.where("value IS NOT NULL").withColumn("value", T.clean_string(F.col("value")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), "first_row"))
    return value_counts(v, list(keys)).withColumn("rank", rank).where(F.col("rank") <= n)
