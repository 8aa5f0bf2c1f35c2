"""Detectors that fail, functions known to SQL, warnings of columns, and the semantic pipeline's short ends."""

from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.operators import matching, profile, registry, semantic, sheets
from gridlore.functions.vocabulary import TARGET_NAMES


def guarded():
    def picky(text):  # inside, so that workers get it by value
        if text == "bad":
            raise ValueError("won't say")
        return text.startswith("1")

    return registry.Guarded(picky)


def cells_of(spark, columns):
    rows = [("wb", i, c, j, v) for i, (c, values) in enumerate(columns.items()) for j, v in enumerate(values)]
    return spark.createDataFrame(rows, "workbook string, col_pos int, col string, row_idx long, value string")


def test_guarded_detectors(spark):
    cells = cells_of(spark, {"Zip": ["12345", "12346", None, "NA"], "Notes": ["bad", "1", "x"]})
    got = {r["col"]: r for r in profile.profile_columns(cells, detectors=T.DETECTORS | {"one": guarded()}).collect()}
    assert got["Zip"]["one_ratio"] == 1.0 and got["Zip"]["error"] is None and got["Notes"]["error"] == "ValueError: won't say" and got["Notes"]["one_ratio"] == 1 / 3
    mapping, warnings = matching.map_with_warnings(cells, group=["workbook"], detectors={"one": guarded()})
    assert [tuple(r) for r in warnings.collect()] == [("wb", 1, "Failed to process 'Notes': ValueError: won't say")]
    assert {r["col"]: r["target"] for r in mapping.collect()} == {"Zip": "Zip", "Notes": None}
    assert matching.map_with_warnings(cells, group=["workbook"])[1].collect() == []


def test_functions_of_sql(spark):
    names = registry.register(spark, {"number": T.parse_numeric, "picky": guarded()}, prefix="own_")
    assert names[:2] == ["own_number", "own_picky"] and len(names) == 3 + len(TARGET_NAMES)
    got = spark.sql("SELECT own_number(v) AS n, own_picky(v) AS p FROM VALUES ('$1,5k'), ('bad'), (NULL) AS t(v)").collect()
    assert [r["n"] for r in got] == [15000.0, None, None] and [tuple(r["p"]) for r in got] == [(False, None), (None, "ValueError: won't say"), (None, None)]
    cells = spark.sql("SELECT c.* FROM (SELECT array(array('a', NULL), array('1.5')) AS g) t, LATERAL own_cells(t.g) c").collect()
    assert [tuple(r) for r in cells] == [(0, 0, "str", "a"), (0, 1, "null", None), (1, 0, "float", "1.5")]


def test_semantic_pipeline_ends(spark):
    h = spark.createDataFrame([(0, "zip"), (1, "city")], "pos int, norm string")
    every = spark.createDataFrame([(t,) for t in TARGET_NAMES], "target string")
    none = semantic.semantic_pipeline(h, ["pos"], assigned=every).orderBy("pos").collect()
    assert [(r["status"], r["errors"], r["top"]) for r in none] == [("unresolved", ["No semantic candidates were retrieved."], None)] * 2
    value = spark.createDataFrame([(0, "County", 1.0, ["r"])], "pos int, target string, score double, reasons array<string>")
    some = semantic.semantic_pipeline(h, ["pos"], value_evidence=value, assigned=spark.createDataFrame([("Zip",)], "target string")).orderBy("pos").collect()
    assert all(r["top"] != "Zip" for r in some) and some[0]["errors"] == ["Cross-encoder reranking failed: no pair scorer"]

    def broken():
        raise OSError("gone")

    got = semantic.semantic_pipeline(h, ["pos"], embedder=broken).collect()
    assert {(r["status"], *r["errors"]) for r in got} == {("unresolved", "Semantic retrieval failed: OSError: gone")}


def test_clients_with_rules(spark):
    def client():
        return lambda rules, prompt: '{"target_field": null, "confidence": 0.1, "reason": "' + rules[:7] + '"}'

    got = semantic.ask(spark.createDataFrame([("{}",)], "context string"), client).first()
    assert got["response"].endswith('"You map"}') and got["error"] is None


def test_below_the_bar(spark):
    h = spark.createDataFrame([(0, "bldg"), (1, "qqqqqqqq"), (2, ""), (3, "buildings"), (4, "building value" * 6)], "col_pos int, norm string")
    got = {r["col_pos"]: r for r in matching.fuzzy_match(h).collect()}
    assert got[1]["target"] is None and got[1]["matched_text"] and got[1]["similarity"] < 0.75 and got[2]["matched_text"] is None and got[3]["similarity"] == 1.0
    one = {r["col_pos"]: r for r in matching.fuzzy_one_to_one(h.withColumn("workbook", F.lit("w")), ["workbook"]).collect()}
    assert one[1]["target"] is None and one[1]["matched_text"] is not None and one[3]["target"] == got[3]["target"]
    assert matching.fuzzy_match(h, vocab=matching.vocabulary(spark).limit(0)).where("matched_text IS NOT NULL").count() == 0


def test_best_form_by_plain_lcs(spark):
    import random

    rnd = random.Random(2)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    forms = [(i, "".join(rnd.choice("abcde é1") for _ in range(rnd.choice([1, 3, 8, 20, 61, 62, 70]))), f"t{i % 5}") for i in range(60)]
    texts = ["".join(rnd.choice("abcdefé1 ") for _ in range(rnd.randint(1, 40))) for _ in range(60)] + [f for _, f, _ in forms[:5]]
    got = matching.fuzzy_match(spark.createDataFrame([(t,) for t in texts], "norm string"), 0.0, spark.createDataFrame(forms, "pos int, norm string, target string")).collect()
    for r in got:
        best = min((-2 * lcs(r["norm"], f) / (len(r["norm"]) + len(f)), i, f) for i, f, _ in forms)
        assert (r["similarity"], r["matched_text"]) == (-best[0], best[2]), r


def test_header_rows(spark):
    rows = [("w", s, i, j, v) for s, grid in {"a": [["x", None], ["1", "2"]], "b": [["h"]], "c": [["h"]]}.items() for i, r in enumerate(grid) for j, v in enumerate(r)]
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row_idx long, col_idx int, value string")
    wanted = spark.createDataFrame([("w", "a", 0), ("w", "b", 5), ("w", "c", None), ("w", "d", -1)], "workbook string, sheet string, header_row int")
    labelled, refused = sheets.header_rows(cells, wanted)
    assert sorted((r["label"], r["value"]) for r in labelled.collect()) == [("Unnamed: 1", "2"), ("x", "1")]
    assert {(r["sheet"], r["reason"]) for r in refused.collect()} == {("b", "header row is not in the sheet"), ("c", "no header row"), ("d", "header row is negative")}
