"""Golden values of the functions, profiles, matching and sheet discovery on small inputs."""

import datetime
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import similarity
from gridlore.functions import text as T
from gridlore.functions.vocabulary import TARGET_NAMES, alias_rows
from gridlore.operators import matching, posterior, profile, semantic, sheets
from gridlore.plans import catalogue
from gridlore.sources import workbooks

SAMPLE = "Location ID,Bldg Repl Cost New,Construction Yr,No. Floors,Sprk,Zip\nLOC001,450000,1998,2,Y,82601\nLOC002,720000,2005,3,N,80202\nLOC003,1200000,2010,5,Y,94105\nLOC004,300000,1985,1,Y,81301\n"


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "sample.csv").write_text(SAMPLE)
    workbooks.create_sample(str(d / "sample.xlsx"))
    cells, found = workbooks.load_workbooks(spark, str(d / "sample.csv"), str(d / "sample.xlsx"))
    return cells.cache(), found


def one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_normalizers(spark):
    assert one(spark, ["  Bldg_Repl-Cost (New) ", None, "Ｂuilding Value"], T.mapping_header) == ["bldg repl cost new", "", "building value"]
    assert one(spark, ["City / Town", None, "A_b-c"], T.discovery_header) == ["city town", "", "a b c"]
    assert one(spark, [None, " A\n b "], T.classifier_text) == ["nan", "a b"]


def test_parse_numeric(spark):
    assert one(spark, ["$100,000", "1.2M", "N/A", "", None, "abc", "5k", "1e400", "-3"], T.parse_numeric) == [100000.0, 1200000.0, None, None, None, None, 5000.0, None, -3.0]


def test_flags(spark):
    assert one(spark, ["12345", "12345-6789", "1234", None], T.is_zip) == [True, True, False, False]
    assert one(spark, ["Y", "y(13r)", "maybe"], T.is_sprinkler) == [True, True, False]
    assert one(spark, ["1998", "1998.5", "2200"], T.is_year) == [True, False, False]
    assert one(spark, ["3/4/2020", "2020-01-02", "4 jan 2020", "x"], T.is_date) == [True, True, True, False]
    assert one(spark, ["nan", "1,000%", "x"], T.is_numeric) == [True, True, False]


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abcd e", max_size=8), st.text("abcd e", max_size=8)), min_size=1, max_size=8))
def test_indel_ratio(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.select("i", similarity.indel_ratio(F.col("a"), F.col("b")).alias("o")).orderBy("i").select("o").collect()]
    assert got == pytest.approx([indel(a, b) for a, b in pairs])


def cells(spark, **columns):
    rows = [(i, c, r, v) for i, (c, vs) in enumerate(columns.items()) for r, v in enumerate(vs)]
    return spark.createDataFrame(rows, "col_pos int, col string, row_idx long, value string")


def test_profile(spark):
    p = {r["col"]: r for r in profile.profile_columns(cells(spark, a=["100", None, "", "N/A", "200"], q=["10", "20", "30", "40", "50"], m=["$100,000", "$250,000", "1.2M"], s=["Y", "N", "Y13", "Y(13R)"], one=["7"], none=[None])).collect()}
    assert (p["a"]["missing_count"], p["a"]["missing_ratio"]) == (3, 0.6)
    assert (p["q"]["q1"], p["q"]["q3"], p["q"]["mean"]) == (20, 40, 30)
    assert (p["m"]["numeric_ratio"], p["m"]["currency_ratio"], p["s"]["sprinkler_ratio"]) == (1, 1, 1)
    assert p["one"]["std"] == 0 and p["none"]["numeric_ratio"] == 0 and p["none"]["mean"] is None


def test_top_values_tie_by_first_row(spark):
    top = profile.top_values(cells(spark, a=["x", "y", "y", "z", "x", "w"]), 3).orderBy("rank").collect()
    assert [r["value"] for r in top] == ["x", "y", "z"]


def test_posterior_of_the_sample(spark, grid):
    d = sheets.header_at(grid[0].where("workbook = 'sample.csv'"), 0).select(F.col("col_idx").alias("col_pos"), F.col("label").alias("col"), "row_idx", "value")
    got = {r["col"]: (r["best"], round(r["p"], 4), r["second"], round(r["p2"], 4), r["decision"]) for r in posterior.analyze(d)[0].collect()}
    assert got["Bldg Repl Cost New"] == ("Building Value", 0.4700, "Storeys", 0.3900, "human_review_required")
    assert got["No. Floors"] == ("Storeys", 0.6419, "Building Value", 0.2560, "auto_map")
    assert got["Zip"] == ("Zip", 0.6670, "Building Value", 0.1488, "auto_map")
    assert got["Sprk"][:2] == ("Fire Sprinklers", 0.8097) and got["Location ID"][:2] == ("State", 0.2532)


def test_mapping_of_the_sample(spark, grid):
    d = sheets.header_at(grid[0].where("workbook = 'sample.csv'"), 0).select(F.col("col_idx").alias("col_pos"), F.col("label").alias("col"), "row_idx", "value")
    got = {r["col"]: (r["target"], round(r["score"], 4)) for r in matching.map_columns(d).collect()}
    assert got == {"Location ID": ("Reference", 1.0), "Bldg Repl Cost New": ("Building Value", 1.0), "Construction Yr": ("Year Built", 1.0), "No. Floors": ("Storeys", 0.84), "Sprk": (None, 0.45), "Zip": ("Zip", 1.0)}


def test_header_scores_of_the_sample(spark, grid):
    got = sheets.header_score(sheets.row_features(grid[0])).where("workbook = 'sample.csv'").orderBy("row_idx").collect()
    assert [round(r["score"], 6) for r in got] == [0.839167, 0.469583, 0.469583, 0.469583, 0.422083]
    found = {(r["workbook"], r["sheet"]): r for r in sheets.sheet_roles(grid[0]).collect()}
    csv = found["sample.csv", "CSV_Data"]
    assert (csv["header_row"], csv["header_confidence"], csv["role"], csv["reason"]) == (0, "high", "secondary", "partial_sov_structure")
    assert found["sample.xlsx", "Summary"]["reason"] == "sheet_name_indicates_non_sov_content"


def test_sheets_and_validation(spark, grid, tmp_path):
    assert {(r["sheet"], r["rows"], r["columns"]) for r in grid[1].collect()} == {("CSV_Data", 5, 6), ("Summary", 3, 1), ("Property Data", 5, 6), ("Notes", 3, 1)}
    (tmp_path / "x.txt").write_text("x")
    for path in (tmp_path / "none.csv", tmp_path, tmp_path / "x.txt"):
        with pytest.raises(workbooks.FileValidationError):
            workbooks.validate_file(spark, str(path))
    with pytest.raises(IndexError):
        sheets.header_at(grid[0], 99)


def test_vocabulary_sizes(spark):
    assert len(TARGET_NAMES) == 17 and matching.exact_lookup(spark).count() == 100
    assert matching.domain_lookup(spark).count() == 197 and matching.vocabulary(spark).count() == 208
    assert len([r for r in alias_rows() if r[0] == 1]) == 101 and len([r for r in alias_rows() if r[0] == 2]) == 194 + 17


def test_exact_conflict_and_fuzzy(spark):
    h = spark.createDataFrame([(0, "building value"), (1, "bldg repl cost new"), (2, "bulding value"), (3, "quarterly zebra")], "col_pos int, norm string")
    got = {r["col_pos"]: r["status"] for r in matching.exact_one_to_one(h).collect()}
    assert got == {0: "exact", 1: "exact_conflict", 2: "unmatched", 3: "unmatched"}
    near = {r["col_pos"]: (r["target"], r["similarity"]) for r in matching.fuzzy_match(h).collect()}
    assert near[2][0] == "Building Value" and near[2][1] == pytest.approx(0.963, abs=1e-3) and near[3] == (None, pytest.approx(4 / 9))  # below the bar the best form is told, without a target


def test_assignment():
    a = matching.assign_pairs
    assert a({(0, 7): 0.90, (0, 8): 0.80, (1, 7): 0.85, (1, 8): 0.82}) == {0: 7, 1: 8}
    assert a({(0, 7): 0.95, (0, 8): 0.80, (1, 7): 0.94, (1, 8): 0.10}) == {0: 8, 1: 7}
    assert a({(0, 7): 0.20}) == {} and a({}) == {}
    assert a({(r, 3): 0.5 + r / 100 for r in range(30)}) == {29: 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_assignment_is_best(n, m, rnd):
    import itertools

    s = {(i, j): round(rnd.random(), 2) for i in range(n) for j in range(m)}
    got = matching.assign_pairs(s)
    value = lambda pairs: (len(pairs), round(sum(s[p] for p in pairs), 6))
    best = max(value([p for p in zip(range(n), cols) if p[1] >= 0 and s[p] >= 0.5]) for cols in itertools.product(range(-1, m), repeat=n) if len({c for c in cols if c >= 0}) == sum(c >= 0 for c in cols))
    assert value(list(got.items())) == best


def test_semantic_fallback_and_answers(spark):
    h = spark.createDataFrame([(0, "street address")], "col_pos int, norm string")
    assert [r["top"] for r in semantic.semantic_pipeline(h, ["col_pos"]).collect()] == ["Address"]

    def broken():
        raise OSError("no model")

    c = semantic.rerank(semantic.retrieve(h, ["col_pos"]), ["col_pos"], broken).orderBy("rank").collect()
    assert all(r["error"] == "OSError: no model" and r["rerank_score"] == r["combined_score"] for r in c)
    assert one(spark, ['{"target_field": "Zip", "confidence": 1.1, "reason": "r"}', '{"target_field": "Zip", "confidence": 0.9, "reason": "r", "x": 1}', '{"target_field": null, "confidence": 0.4, "reason": "r"}', "junk"], lambda v: semantic.checked(v)["problem"]) == ["confidence", "keys", None, "keys"]
    assert [semantic_category(spark, *x) for x in ((0.953, 0.288), (0.696, 0.54), (0.564, 0.039), (0.495, 0.035))] == ["strong", "moderate", "ambiguous", "weak"]


def semantic_category(spark, top, margin):
    return spark.range(1).select(semantic.category(F.lit(top), F.lit(margin))).first()[0]


def test_dates_in_workbooks(spark, tmp_path):
    path = tmp_path / "dates.xlsx"
    when = datetime.datetime(2024, 2, 29, 13, 30)
    path.write_bytes(workbooks.xlsx_bytes({"S": [["Year Built", "Insured", "Value"], [1998, when, 1.5], [2001, datetime.datetime(1999, 12, 31), 7]]}))
    cells, _ = workbooks.load_workbooks(spark, str(path))
    got = {(r["row_idx"], r["col_idx"]): (r["kind"], r["value"]) for r in cells.collect()}
    assert got[1, 1] == ("ts", "2024-02-29 13:30:00") and got[2, 1] == ("ts", "1999-12-31 00:00:00") and got[1, 0] == ("int", "1998") and got[1, 2] == ("float", "1.5")
    f = {r["row_idx"]: r["date_like_ratio"] for r in sheets.row_features(cells).collect()}
    assert f[0] == 0.0 and f[1] == pytest.approx(1 / 3)


def test_settings_and_summary(spark, capsys):
    assert workbooks.setting(spark, "max_sample_values") == "5" and workbooks.setting(spark, "environment") == "development"
    spark.conf.set("spark.gridlore.max_sample_values", "3")
    assert workbooks.setting(spark, "max_sample_values") == "3"
    spark.conf.unset("spark.gridlore.max_sample_values")
    workbooks.show_summary(spark.createDataFrame([("w", "s", 2, 3, False)], "workbook string, sheet string, rows int, columns int, is_empty boolean"))
    assert "workbook" in capsys.readouterr().out


def mapped_cells(spark):
    rows = [(i, j, h, str(v)) for j, (h, vs) in enumerate({"Zip": [82601, 80202], "Fnord": ["a b", "c d"], "Storeys": [1, 2]}.items()) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "row_idx long, col_pos int, col string, value string")


def test_failures_become_warnings(spark):
    cells = mapped_cells(spark)
    headers = cells.select("col_pos", "col").distinct().withColumn("norm", T.mapping_header(F.col("col"), nfkc=False))

    def no_model():
        raise OSError("no model")

    def odd_texts():
        def embed(texts):
            if any("fnord" in t for t in texts):
                raise ValueError("odd text")
            return [[1.0, float(len(t))] for t in texts]

        return embed

    rows, warnings = semantic.evidence(headers, ["col_pos"], embedder=no_model)
    assert rows.count() == 0 and sorted(r["warning"] for r in warnings.collect()) == [f"Failed to process '{c}': Semantic retrieval failed: OSError: no model" for c in ("Fnord", "Storeys", "Zip")]
    rows, warnings = semantic.evidence(headers.repartition(3, "col_pos"), ["col_pos"], embedder=odd_texts)
    said = [r["warning"] for r in warnings.collect()]
    assert "Failed to process 'Fnord': Semantic retrieval failed: ValueError: odd text" in said
    # the mapping itself stands in any case, and its report carries the warnings
    mapping = matching.map_columns(cells.withColumn("workbook", F.lit("w")), rows.withColumn("workbook", F.lit("w")), ["workbook"])
    got = {r["col"]: r for r in mapping.collect()}
    assert got["Zip"]["target"] == "Zip" and got["Storeys"]["target"] == "Storeys" and got["Fnord"]["target"] is None
    assert [got[c]["human_review_required"] for c in ("Zip", "Storeys", "Fnord")] == [False, False, True]
    report = matching.mapping_report(mapping, ["workbook"], warnings.withColumn("workbook", F.lit("w"))).first()
    assert report["unresolved_columns"] == ["Fnord"] and report["assigned_targets"] == ["Zip", "Storeys"] and report["warnings"] == sorted(said, key=lambda w: ("Zip" not in w, "Fnord" not in w))


def test_failing_client_loses_no_column(spark):
    headers = mapped_cells(spark).select("col_pos", "col").distinct().withColumn("norm", T.mapping_header(F.col("col"), nfkc=False))

    def client():
        def answer(prompt):
            if "Fnord" in prompt:
                raise RuntimeError("too busy")
            return '{"target_field": "City", "confidence": 0.9, "reason": "it says so"}'

        return answer

    def broken():
        raise KeyError("no key")

    flat = lambda: lambda texts: [[1.0] for _ in texts]  # noqa: E731  all alike: ambiguous
    rows, warnings = semantic.evidence(headers, ["col_pos"], client=client, embedder=flat, weigh=True)
    told = {r["col_pos"]: r for r in rows.where("method = 'llm'").collect()}
    assert sorted(told) == [0, 2] and told[0]["target"] == "City" and told[0]["llm"] == 0.9 and told[0]["reasons"] == ["it says so"]
    assert [r["warning"] for r in warnings.collect()] == ["Failed to process 'Fnord': RuntimeError: too busy"]
    rows, warnings = semantic.evidence(headers, ["col_pos"], client=broken, embedder=flat)
    assert rows.where("method = 'llm'").count() == 0 and warnings.count() == 3 and rows.where("method = 'semantic'").count() == 9


def test_own_detectors_and_scorers(spark):
    cells = mapped_cells(spark)
    got = {r["col"]: r for r in profile.profile_columns(cells, detectors={**T.DETECTORS, "two_words": lambda t: t.contains(" ")}).collect()}
    assert got["Fnord"]["two_words_ratio"] == 1.0 and got["Zip"]["two_words_ratio"] == 0.0 and got["Zip"]["zip_ratio"] == 1.0
    own = {"Letters": (F.col("string_ratio"), {"string_ratio": F.col("string_ratio")}, [(F.col("string_ratio") > 0.5, "letters")])}
    rows = matching.field_evidence(profile.profile_columns(cells), ["col"], own).collect()
    assert {(r["col"], r["target"], r["score"], tuple(r["reasons"])) for r in rows} == {("Zip", "Letters", 0.0, ()), ("Storeys", "Letters", 0.0, ()), ("Fnord", "Letters", 1.0, ("letters",))}


def test_dtypes(spark):
    rows = [(i, c, c, v) for i, (c, v) in enumerate([(0, "1"), (0, "2"), (1, "1"), (1, None), (2, "1.5"), (2, "2"), (3, "x"), (3, "1"), (4, None)])]
    cells = spark.createDataFrame(rows, "row_idx long, col_pos int, col string, value string")
    assert {r["col_pos"]: r["dtype"] for r in profile.posterior_profile(cells).collect()} == {0: "int64", 1: "float64", 2: "float64", 3: "object", 4: "object"}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["by5_by6_decision_lineitem", "ag12_ag14_posterior_profile_lineitem", "ag8_ag11_profile_lineitem", "ev1_ev14_evidence_lineitem", "map_columns_op1_op6"])
def test_every_lineitem_column(spark, name):
    columns = spark.read.parquet(f"{SF}/lineitem.parquet").columns
    assert catalogue.LINEITEM == columns and "l_shipdate" in columns
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    own = got[got.workbook == "lineitem"] if "workbook" in got else got
    assert set(own.col) == set(columns)
    if name in catalogue.ORACLES:
        with duckdb.connect() as db:
            for t in ("lineitem", "customer", "part"):
                db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
            want = db.execute(catalogue.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        order = [c for c in ("col_pos", "col", "target_pos", "target") if c in got]
        got, want = (x[sorted(got.columns)].sort_values(order).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-4, atol=2e-5)


def test_mapping_scans_cells_for_the_profile_alone(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame([("b", i, c, r, str(1900 + r)) for i, c in enumerate(("Year Built", "Zip")) for r in range(5)], "workbook string, col_pos int, col string, row_idx long, value string").write.parquet(path)
    out = matching.map_columns(spark.read.parquet(path), group=["workbook"])
    assert not [f for f in out.inputFiles() if path in f]
    assert {r["col"]: r["target"] for r in out.collect()} == {"Year Built": "Year Built", "Zip": "Zip"}


def test_fuzzy_walk_holds_no_workbook(spark):
    """As a walk over each workbook's rows, one by one; headers repeat, are null and empty."""
    import random

    rng = random.Random(3)
    words = ["zip", "zip code", "city", "citty", "yr built", "year bult", "country", "county", "", None, "building value", "xyz"]
    rows = [(w, i, rng.choice(words)) for w in ("a", "b", None) for i in range(60)]
    out = matching.fuzzy_one_to_one(spark.createDataFrame(rows, "workbook string, col_pos int, norm string"), ["workbook"], 0.6)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().analyzed().toString()
    forms = [(r["norm"], r["pos"], r["target"]) for r in matching.vocabulary(spark).collect()]
    near = {n: {(f, t): s for f, _, t, s in spark.createDataFrame([(n, *f) for f in forms], "n string, f string, pos long, t string").select("f", "pos", "t", similarity.indel_ratio(F.col("n"), F.col("f"))).collect()} for n in {r[2] for r in rows} if n}
    pos, want = {f: p for f, p, _ in forms}, set()
    for book in ("a", "b", None):
        taken = set()
        for w, i, n in rows:
            if w == book:
                free = sorted((-s, pos[f], f, t) for (f, t), s in near.get(n, {}).items() if t not in taken)
                hit = free[0] if free else (None, None, None, None)
                fits = bool(free) and -hit[0] >= 0.6
                if fits:
                    taken.add(hit[3])
                want.add((w, i, n, hit[2], hit[3] if fits else None, None if hit[0] is None else round(-hit[0], 9)))
    assert {(*r[:5], None if r[5] is None else round(r[5], 9)) for r in out.collect()} == want and out.count() == len(rows)


def test_shares_are_the_profile_s(spark):
    """What the scores read, taken from typed columns and from texts, is what the profile has; and it needs one scan, no table."""
    big, nan, inf = 2**63 - 1, float("nan"), float("inf")
    texts = ["12345", " 1999 ", "-12345", "$5", "5M", "5m ", "1.5K", "yes", "N", "TX", "tx ", "1e400", "1e5", "", None, "٣٣٣٣٣", "ABC", "€", "é", "1234\n", "+.5", "12345-6789", "1,000", "a ", "\x01999"]
    longs = [big, -big - 1, 10000, 99999, 9999, 1000, 999, 100000, -12345, -1234, 0, None]
    doubles = [nan, inf, -inf, -0.0, 12345.0, 1999.0, 1e7, 1e-5, -2.5, 1.5, big * 1.0, None]
    floats, times = [0.1, 1.5, nan, None, 12345.0, -2.0], [datetime.datetime(*d) for d in ((1996, 9, 13), (1, 1, 1, 3, 4, 5, 6), (9999, 12, 31))]
    at = lambda v, i: v[i] if i < len(v) else None
    rows = [(at(texts, i), at(longs, i), i, at(doubles, i), at(floats, i), at(times, i), at([datetime.date(2020, 1, 2)], i), at([True, False], i), at([Decimal("12345"), Decimal("1999")], i), None, None, at(doubles[4:5], i)) for i in range(30)]
    df = spark.createDataFrame(rows, "t string, l long, `i.d` int, d double, f float, ts timestamp, dt date, b boolean, m decimal(10,0), no long, none string, one double")
    names = ["numeric_ratio", "min", "max", *[f"p_{n}" for n in profile.POSTERIOR_PATTERNS]]
    say = lambda f: sorted(tuple(map(str, r)) for r in f.select("col_pos", "col", *names).collect())
    cells = profile.to_cells(df, F.lit(0))
    whole = say(profile.posterior_profile(cells))
    assert len(whole) == 12 and say(profile.posterior_shares(cells)) == whole and say(profile.table_shares(df)) == whole
    assert profile.table_shares(df.limit(0)).count() == profile.posterior_profile(cells.limit(0)).count() == 0
    columns = df.columns
    flat = lambda f: sorted(map(str, f.collect()))
    assert flat(posterior.decisions(df, columns)) == flat(posterior.analyze(cells)[0])
    counts = lambda f: sorted(map(str, f.collect()))
    assert counts(profile.table_counts(df)) == counts(cells.groupBy("col_pos", "col", "value").agg(F.count(F.lit(1)).alias("cnt")))
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,), (7.0,)], "z double")  # two texts, one value
    assert sorted((r["value"], r["cnt"]) for r in profile.table_counts(zeros).collect()) == [("-0.0", 2), ("0.0", 1), ("7.0", 1)]
    assert profile.posterior_profile(profile.table_counts(zeros), counted=True).collect() == profile.posterior_profile(profile.to_cells(zeros, F.lit(0))).collect()


def test_rankings_write_no_tables(spark, tmp_path, monkeypatch):
    """the ranking of lineitem's columns has no step that grows with distinct texts: nothing is written for it."""
    written = []
    monkeypatch.setattr(profile, "written", lambda df, name: written.append(name) or df)
    numbers = [f"id % 7 AS {c}" for c in catalogue.LINEITEM[1:8]]
    spark.range(3000).selectExpr("id AS l_orderkey", *numbers, *[f"concat('T', id) AS {c}" for c in catalogue.LINEITEM[8:10]], "timestamp_seconds(id) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    ranked = catalogue.QUERIES["cx3_ranking_lineitem"](spark, str(tmp_path)).collect()
    assert len(ranked) == 11 and not written
