"""Sheet discovery: profiles of sheets, features and scores of header rows, and the sheet's role.

Cells are (workbook, sheet, row_idx, col_idx, value), one row for every cell of the grid, null where it is empty. All
windows run within a sheet, over rows that are already aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.functions.vocabulary import TERMS
from gridlore.sources.workbooks import setting

SHEET = ["workbook", "sheet"]
HEADER_ROWS, LOOKAHEAD = 30, 3


def sheet_profile(cells: DataFrame) -> DataFrame:
    """AG1 to AG7: density, blank rows and columns, keyword score and counts of every sheet, in one pass and two shuffles."""
    filled = F.col("value").isNotNull()
    hit = T.contains_term(T.detector_text(F.col("value")), TERMS["keyword"])
    base = cells.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("total_cells"), F.count_if(filled).alias("non_empty_cells"), F.count_if(filled & hit).alias("keyword_cells"))
    rows = cells.groupBy(*SHEET, "row_idx").agg(F.max(filled).alias("any")).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"), F.count_if("any").alias("non_empty_rows"))
    cols = cells.groupBy(*SHEET, "col_idx").agg(F.max(filled).alias("any")).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("columns"), F.count_if(~F.col("any")).alias("blank_cols"))
    out = base.join(rows, SHEET).join(cols, SHEET)
    return out.select(
        *SHEET, "rows", "columns", "total_cells", "non_empty_cells", "non_empty_rows", (F.col("non_empty_cells") / F.col("total_cells")).alias("data_density"),
        (1 - F.col("non_empty_rows") / F.col("rows")).alias("blank_row_ratio"), (F.col("blank_cols") / F.col("columns")).alias("blank_col_ratio"),
        F.coalesce(F.col("keyword_cells") / F.nullif("non_empty_cells", F.lit(0)), F.lit(0.0)).alias("keyword_score"), (F.col("non_empty_cells") == 0).alias("is_empty"),
    )


def first_rows(cells: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of every sheet (row_idx, n filled cells), with data_below_score, the share of the rows below
    that aren't blank. Rows are counted; the windows see the first ones alone, by group limits before the shuffle."""
    rows = cells.groupBy(*SHEET, "row_idx").agg(F.count("value").alias("n"))
    totals = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > 0).alias("filled_rows"))
    order = Window.partitionBy(*SHEET).orderBy("row_idx")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    upto = F.sum((F.col("n") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = first.withColumn("upto", upto).join(totals, SHEET)
    below = (F.col("filled_rows") - F.col("upto")) / F.nullif(F.col("rows") - F.col("place"), F.lit(0))
    return first.select(*SHEET, "row_idx", F.coalesce(below, F.lit(0.0)).alias("data_below_score"))


def row_features(cells: DataFrame, max_rows: int = HEADER_ROWS, lookahead: int = LOOKAHEAD) -> DataFrame:
    """FL6, AG19, WN1, WN2: features of the first max_rows rows that aren't blank. Of the rows below the next `lookahead`
    show their pattern of numbers, the others whether they are blank."""
    t, v = T.detector_text(F.col("value")), F.col("value")
    cells = cells.join(first_rows(cells, max_rows + lookahead), [*SHEET, "row_idx"]).withColumn("t", t)
    t = F.col("t")
    filled, number = v.isNotNull(), T.is_numeric(v)
    date = T.is_date(v) | (F.col("kind") == "ts") if "kind" in cells.columns else T.is_date(v)
    pattern = T.is_numeric(t) | T.is_long_id(t) | T.has_letter_and_digit(t) | (T.word_count(t) >= 3)
    share = lambda flag: F.coalesce(F.avg(F.when(filled, flag.cast("double"))), F.lit(0.0))
    semantic = T.contains_term(t, TERMS["header"], 4)
    rows = cells.groupBy(*SHEET, "row_idx").agg(
        F.avg(filled.cast("double")).alias("non_empty_ratio"), share(~number).alias("text_ratio"), F.size(F.collect_set(F.when(filled, t))).cast("long").alias("distinct_values"), F.count_if(filled).alias("n"),
        share(number).alias("numeric_ratio"), share(semantic).alias("semantic"), share(date).alias("date_like_ratio"), share(T.is_long_id(t)).alias("long_identifier_ratio"),
        share(pattern).alias("value_pattern_score"), share(T.is_code(t)).alias("code_ratio"), share(T.is_long_text(t)).alias("long_text_ratio"),
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", number.alias("num")))), lambda x: x["num"]).alias("pattern"),
        F.transform(F.array_sort(F.collect_list(F.when(filled, F.struct("col_idx", v.alias("value"))))), lambda x: x["value"]).alias("header_values"),
        F.max("data_below_score").alias("data_below_score"),
    )
    order = Window.partitionBy(*SHEET).orderBy("row_idx")
    alike = []
    for k in range(1, lookahead + 1):
        nxt = F.lead("pattern", k).over(order)
        alike.append(F.aggregate(F.zip_with("pattern", nxt, lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size("pattern"))
    rows = rows.withColumn("alike", F.array_compact(F.array(*alike)))
    mean = F.aggregate("alike", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("alike"), F.lit(0))
    rows = rows.withColumn("row_similarity_score", F.when(F.col("n") > 0, F.coalesce(mean, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("unique_ratio", F.when(F.col("n") > 0, F.col("distinct_values") / F.col("n")).otherwise(0.0))
    rows = rows.withColumn("duplicate_ratio", F.when(F.col("n") > 1, 1 - F.col("unique_ratio")).otherwise(0.0))
    likely = 0.30 * F.col("numeric_ratio") + 0.25 * F.col("long_identifier_ratio") + 0.20 * F.col("code_ratio") + 0.15 * F.col("long_text_ratio") + 0.10 * (1 - F.col("semantic"))
    rows = rows.withColumn("data_row_likelihood", F.when(F.col("n") > 0, F.least(F.lit(1.0), likely)).otherwise(0.0))
    for name in ("non_empty_ratio", "semantic", "n"):  # WN5
        rows = rows.withColumn(f"prev_{name}", F.lag(name).over(order))
    return rows.where((F.col("row_idx") < max_rows) & (F.col("n") > 0)).drop("pattern", "alike", "code_ratio", "long_text_ratio", "distinct_values")


def header_score(rows: DataFrame) -> DataFrame:
    """Weighted structure and vocabulary, less what a data row shows; sparse rows count less."""
    c = F.col
    structure = (
        0.30 * c("non_empty_ratio") + 0.15 * c("text_ratio") + 0.10 * c("unique_ratio") + 0.15 * c("data_below_score") + 0.10 * (1 - c("numeric_ratio"))
        + 0.05 * (1 - c("duplicate_ratio")) + 0.05 * (1 - c("date_like_ratio")) + 0.05 * (1 - c("long_identifier_ratio")) + 0.05 * c("value_pattern_score")
    )
    score = 0.65 * structure + 0.35 * c("semantic") + 0.05 * (1 - c("row_similarity_score")) - 0.20 * c("data_row_likelihood")
    score = score * F.when(c("non_empty_ratio") < 0.25, 0.50).when(c("non_empty_ratio") < 0.50, 0.80).otherwise(1.0)
    return rows.withColumn("score", T.clip(score))


def header_confidence(best: Column, second: Column) -> Column:
    """FL16; without a runner-up only the score counts."""
    gap = F.coalesce(best - second, F.lit(1.0))
    return F.when((best >= 0.65) & (gap >= 0.08), "high").when((best >= 0.45) & (gap >= 0.04), "medium").otherwise("low")


def rejection(c=None) -> Column:
    """FL7: why the best row is no header; null if it is one."""
    c = F.col if c is None else c
    words = c("semantic") >= 0.10
    strong = (c("non_empty_ratio") >= 0.95) & (c("text_ratio") >= 0.90) & (c("unique_ratio") >= 0.90) & (c("data_below_score") >= 0.90) & (c("value_pattern_score") >= 0.75) & (c("data_row_likelihood") < 0.40)
    likely = c("data_row_likelihood")
    data = (
        ((likely >= 0.45) & (c("row_similarity_score") >= 0.85)) | ((likely >= 0.50) & (c("long_identifier_ratio") >= 0.20))
        | ((likely >= 0.45) & (c("value_pattern_score") >= 0.50) & (c("semantic") < 0.30)) | ((likely >= 0.40) & (c("semantic") < 0.15))
    )
    return F.when(~words & ~strong, "no_semantics").when(data, "data_like").when(c("score") < 0.30, "low_score")


def detect_headers(cells: DataFrame, max_rows: int = HEADER_ROWS) -> DataFrame:
    """WN3, WN4, TK1, FL7, FL16, FL17: a row for each sheet that has a candidate, with the best one's features."""
    ranked = header_score(row_features(cells, max_rows))
    by = Window.partitionBy(*SHEET).orderBy(F.desc("score"), "row_idx")
    best = ranked.withColumn("second_score", F.lead("score").over(by)).withColumn("rank", F.row_number().over(by)).where("rank = 1").withColumn("why_not", rejection())
    # a flag of the row above, whatever the cap on candidates
    multi = (F.col("row_idx") > 0) & (F.coalesce("prev_n", F.lit(0)) > 0) & (F.col("prev_non_empty_ratio") >= 0.25) & (F.col("non_empty_ratio") >= 0.50) & (F.col("semantic") >= 0.15) & (F.col("prev_semantic") >= 0.05)
    found = F.col("why_not").isNull()
    return best.select(
        *SHEET, F.when(found, F.col("row_idx")).alias("header_row"), F.col("row_idx").alias("best_row"), F.col("score").alias("header_score"),
        F.when(found, header_confidence(F.col("score"), F.col("second_score"))).otherwise("low").alias("header_confidence"),
        (found & F.coalesce(multi, F.lit(False))).alias("possible_multirow_header"), F.coalesce(F.col("why_not").isin("no_semantics", "data_like"), F.lit(False)).alias("header_rejected_as_data"), "header_values",
    )


def sheet_roles(cells: DataFrame) -> DataFrame:
    """Primary, secondary or reject, with the reason, for every sheet (FL4, FL5)."""
    out = sheet_profile(cells).join(detect_headers(cells), SHEET, "left")
    name = T.classifier_text(F.col("sheet"))
    texts = F.transform(F.coalesce("header_values", F.array().cast("array<string>")), T.classifier_text)
    out = out.withColumn("header_text", F.array_join(texts, " | ")).withColumn("name_text", name)
    h = F.col("header_text")
    any_of = lambda text, key: F.exists(F.array(*[F.lit(t) for t in TERMS[key]]), lambda t: F.contains(text, t))
    role_score = T.count_terms(h, TERMS["primary"]) / F.greatest(F.size(texts), F.lit(1))
    special = any_of(F.col("name_text"), "secondary_name") | h.contains("business interruption") | (h.contains("bi value") & ~h.contains("building value")) | (h.contains("notes") & F.col("name_text").contains("deleted"))
    out = out.withColumn("header_role_score", role_score).withColumn("has_location_identity", any_of(h, "identity")).withColumn("has_property_attributes", T.count_terms(h, TERMS["attribute"]) >= 3)
    # fixed values: the reasons
    reason = (
        F.when(any_of(F.col("name_text"), "deny_name"), "sheet_name_indicates_non_sov_content").when(F.col("header_row").isNull(), "no_plausible_header_detected")
        .when(special, "specialized_or_excluded_exposure_sheet").when(F.col("has_location_identity") & F.col("has_property_attributes") & (F.col("data_density") >= 0.15), "location_identity_and_property_attributes")
        .when((F.col("header_role_score") >= 0.10) & (F.col("data_density") >= 0.20), "partial_sov_structure").otherwise("insufficient_sov_structure")
    )
    role = F.when(F.col("reason") == "location_identity_and_property_attributes", "primary").when(F.col("reason").isin("specialized_or_excluded_exposure_sheet", "partial_sov_structure"), "secondary").otherwise("reject")
    return out.withColumn("reason", reason).withColumn("role", role).drop("header_text", "name_text")


def normalized_headers(headers: DataFrame) -> DataFrame:
    """FN7: (col_idx, value) with the discovery form, blank ones named by position."""
    return headers.withColumn("normalized", T.named(T.discovery_header(F.col("value")), F.col("col_idx")))


def duplicate_headers(normalized: DataFrame, keys: list[str]) -> DataFrame:
    """AG16: forms that occur more than once, with their positions."""
    return normalized.groupBy(*keys, "normalized").agg(F.sort_array(F.collect_list("col_idx")).alias("positions")).where(F.size("positions") > 1)


def header_summary(normalized: DataFrame, keys: list[str]) -> DataFrame:
    """AG17."""
    blank = T.discovery_header(F.col("value")) == ""
    return normalized.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_headers"), F.count_if(blank).alias("empty_headers"), F.count_distinct("normalized").alias("unique_headers"))


def header_at(cells: DataFrame, header_row: int) -> DataFrame:
    """FL18 and SRC8: the labels of one row by position, and the data below with their labels. Refuses a row that isn't there."""
    if header_row < 0 or cells.where(F.col("row_idx") == header_row).isEmpty():
        raise IndexError(f"header row {header_row} is not in the sheet")
    labels = cells.where(F.col("row_idx") == header_row).select(*SHEET, "col_idx", F.coalesce("value", F.concat(F.lit("Unnamed: "), F.col("col_idx").cast("string"))).alias("label"))
    return cells.where(F.col("row_idx") > header_row).join(F.broadcast(labels), [*SHEET, "col_idx"])


def header_rows(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC8 and FL18 for all sheets at once: (labelled, refused). headers has a header_row for each (workbook, sheet). The
    cells below it get the label above them, by position, so labels may repeat; blank ones are `Unnamed: <column>`. Sheets
    whose header_row is null or not a row of theirs are in refused, with the reason; sheets without a header are in neither."""
    found = headers.select(*SHEET, F.col("header_row").cast("long").alias("header_row"))
    first = cells.join(found, SHEET).where(F.col("row_idx") == F.col("header_row"))
    labels = first.select(*SHEET, "header_row", "col_idx", F.coalesce("value", F.concat(F.lit("Unnamed: "), F.col("col_idx").cast("string"))).alias("label"))
    labelled = cells.join(labels, [*SHEET, "col_idx"]).where(F.col("row_idx") > F.col("header_row")).drop("header_row")
    lost = found.join(labels.select(*SHEET, "header_row").distinct(), [*SHEET, "header_row"], "left_anti")
    reason = F.when(F.col("header_row").isNull(), "no header row").when(F.col("header_row") < 0, "header row is negative").otherwise("header row is not in the sheet")
    return labelled, lost.select(*SHEET, "header_row", reason.alias("reason"))


def samples(cells: DataFrame, n: int | None = None) -> DataFrame:
    """SRC9 and WN9: the first n present values of each column; by default as many as the session's setting says."""
    n = int(setting(cells.sparkSession, "max_sample_values")) if n is None else n
    v = cells.withColumn("value", T.clean_string(F.col("value"))).where("value IS NOT NULL AND value <> ''")
    rank = F.row_number().over(Window.partitionBy(*SHEET, "col_idx").orderBy("row_idx"))
    picked = v.withColumn("rank", rank).where(F.col("rank") <= n)
    return picked.groupBy(*SHEET, "col_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
