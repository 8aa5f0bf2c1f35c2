"""Rank selection against numpy, on values that fall into few and into many buckets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.operators import profile, quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def made():
    rnd = random.Random(3)
    yield "one", [(5.5, 1)]
    yield "same", [(7.0, 3), (7.0, 4)]
    yield "two", [(-1.0, 1), (1.0, 1)]
    yield "wide", [(rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300), rnd.randint(1, 5)) for _ in range(400)]
    yield "narrow", [(1e9 + i * 1e-6, 1) for i in range(3000)]
    yield "ulps", [(math.nextafter(3.0, 4.0, steps=i), 1 + i % 3) for i in range(500)]
    yield "tiny", [(i * 5e-324, 1) for i in range(-200, 200)]
    yield "whole", [(float(rnd.randint(-1000, 1000)), rnd.randint(1, 9)) for _ in range(900)]
    yield "zeros", [(0.0, 5), (-0.0, 5), (1e-320, 1), (-1e308, 1), (1e308, 1)]
    yield "skewed", [(1.0, 1_000_000_000_000), (2.0, 1), (3.0, 1_000_000_000_000)]


def plain(values, share):
    """The quantile of values with counts, by position."""
    values = sorted(values)
    n = sum(c for _, c in values)
    pos = share * (n - 1)

    def at(rank):
        for x, c in values:
            if rank < c:
                return x
            rank -= c

    low, high = at(math.floor(pos)), at(math.ceil(pos))
    return low if low == high else (math.ceil(pos) - pos) * low + (pos - math.floor(pos)) * high


def test_quantiles(spark):
    rows = [(name, x, c) for name, values in made() for x, c in values] + [("one", None, 9), ("none", None, 1)]
    df = spark.createDataFrame(rows, "name string, x double, cnt long").repartition(3)
    got = {r["name"]: r["q"] for r in quantiles.quantiles(df, SHARES, ["name"]).collect()}
    want = {name: [plain(values, p) for p in SHARES] for name, values in made()}
    assert got == want
    assert quantiles.quantiles(df.limit(0), SHARES, ["name"]).collect() == []
    small = [x for x, c in next(v for n, v in made() if n == "narrow")]
    assert want["narrow"] == pytest.approx(np.quantile(small, SHARES).tolist(), rel=1e-15)


def test_buckets_are_monotone(spark):
    rnd = random.Random(5)
    x = sorted({rnd.choice([-1, 1]) * 10 ** rnd.uniform(-320, 308) for _ in range(5000)} | {0.0, 1.7e308, -1.7e308, 5e-324})
    got = spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(quantiles.bucket(F.col("x")).alias("b"), quantiles.centre(quantiles.bucket(F.col("x"))).alias("c")).collect()
    assert all(a["b"] <= b["b"] for a, b in zip(got, got[1:]))
    assert all(r["c"] == pytest.approx(v, rel=1 / 300) for v, r in zip(x, got) if abs(v) > 1e-300)


def test_moments_of_close_numbers(spark):
    values = [1e6 + i / 100 for i in range(200)] + [1e6] * 300
    rows = [(i, f"{v:.2f}", f"{-v:.2f}", "12" if i else None) for i, v in enumerate(values)]
    cells = profile.to_cells(spark.createDataFrame(rows, "i long, a string, b string, c string"), F.col("i"), ["a", "b", "c"])
    got = {r["col"]: r for r in profile.profile_columns(cells).collect()}
    x = np.array([float(f"{v:.2f}") for v in values])
    assert got["a"]["std"] == pytest.approx(x.std(ddof=1), rel=1e-7) and got["a"]["mean"] == pytest.approx(x.mean(), rel=1e-14) and got["b"]["q1"] == np.quantile(-x, 0.25)
    assert got["c"]["std"] == 0 and got["c"]["median"] == got["c"]["max"] == 12.0
    skew = {r["col"]: r["skewness"] for r in profile.posterior_profile(cells).collect()}
    d, n = x - x.mean(), len(x)
    assert skew["a"] == pytest.approx((n * (n - 1)) ** 0.5 / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5, rel=1e-6) and skew["b"] == pytest.approx(-skew["a"]) and skew["c"] == 0


def test_clean_string(spark):
    odd = ["a", " a", "a ", " a b ", "\x1ca", "", " ", "é ", " é", "!", "~x~", "a\x85", "﻿a", None]
    got = [r["s"] for r in spark.createDataFrame([(v,) for v in odd], "v string").coalesce(1).select(T.clean_string(F.col("v")).alias("s")).collect()]
    assert got == [v if v is None else v.strip() for v in odd]
