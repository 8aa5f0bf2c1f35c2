"""Detectors and scorers by name: for profiles, for evidence, and as functions of SQL (the extension points).

What is built of Columns becomes a SQL function whose body Spark expands, so it stays in the JVM. A caller's Python test
becomes a detector that can fail for a value without ending the job: guarded() gives the flag and what went wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.operators.matching import Scorer, evidence_fields
from gridlore.sources.delimited import kind_of

PREFIX = "grid_"


@dataclass(frozen=True)
class Guarded:
    """A test of a stripped text in Python: test(text) -> bool. It runs once a distinct text of a column."""

    test: Callable[[str], bool]

    def udf(self):
        """What gives, for a column of texts, a struct of flag and error; both null for null."""
        test = self.test

        @F.pandas_udf("flag boolean, error string")
        def run(texts: pd.Series) -> pd.DataFrame:
            flags, errors = [], []
            for t in texts:
                flag = error = None
                try:
                    flag = None if t is None else bool(test(t))
                except Exception as e:  # noqa: BLE001  told beside the flag
                    error = f"{type(e).__name__}: {e}"
                flags.append(flag), errors.append(error)
            return pd.DataFrame({"flag": pd.Series(flags, dtype="boolean"), "error": pd.Series(errors, dtype="string")})

        return run


def _year(s: Column) -> Column:
    x = T.parse_numeric(s)
    return F.coalesce((x == F.floor(x)) & x.between(1700, 2100), F.lit(False))


#: Functions of a text, by name.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    **{f"is_{n}": (lambda s, f=f: f(T.strip(s))) for n, f in T.DETECTORS.items()}, "is_year": _year, "is_missing": lambda s: T.stands_for_missing(T.strip(s)), "number": T.parse_numeric,
    "mapping_header": lambda s: T.mapping_header(s, nfkc=False), "discovery_header": T.discovery_header, "alias_key": T.alias_key,
}
#: What a scorer of evidence reads of a profile.
PROFILE = ("numeric_ratio", "string_ratio", "unique_ratio", "currency_ratio", "year_ratio", "boolean_ratio", "sprinkler_ratio", "zip_ratio", "min", "max")


class GridCells:
    """UDTF: the cells of a grid, an array of rows of texts, by row and column, with their kinds."""

    def eval(self, grid: list) -> Iterator[tuple]:
        for i, row in enumerate(grid or []):
            for j, v in enumerate(row or []):
                kind = "null" if v is None else kind_of(v)
                yield i, j, kind, None if kind == "null" else v


def _body(spark: SparkSession, params: list[str], kind: str, made: Column) -> tuple[str, str]:
    """An expression over params as SQL, and its type."""
    df = spark.createDataFrame([], ", ".join(f"{p} {kind}" for p in params)).select(made.alias("made"))
    sql = df._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
    return sql, df.dtypes[0][1]


def register(spark: SparkSession, functions: dict[str, Callable[[Column], Column] | Guarded] | None = None, scorers: dict[str, Scorer] | None = None, prefix: str = PREFIX) -> list[str]:
    """Makes functions (text -> value), a score_<target> for each scorer (over PROFILE) and the table function cells known
    to SQL as temporary functions, and returns their names. Guarded detectors give a struct of flag and error."""
    names = []
    for name, f in (FUNCTIONS if functions is None else functions).items():
        names.append(prefix + name)
        if isinstance(f, Guarded):
            spark.udf.register(names[-1], f.udf())
        else:
            body, kind = _body(spark, ["s"], "string", f(F.col("s")))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[-1]}(s STRING) RETURNS {kind} RETURN {body}")
    for target, (score, _, _) in (evidence_fields() if scorers is None else scorers).items():
        names.append(prefix + "score_" + "".join(ch if ch.isalnum() else "_" for ch in target.lower()).strip("_"))
        body, kind = _body(spark, list(PROFILE), "double", T.clip(score))
        params = ", ".join(f"`{p}` DOUBLE" for p in PROFILE)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[-1]}({params}) RETURNS {kind} RETURN {body}")
    spark.udtf.register(prefix + "cells", F.udtf(GridCells, returnType="row_idx int, col_idx int, kind string, value string"))
    return [*names, prefix + "cells"]
