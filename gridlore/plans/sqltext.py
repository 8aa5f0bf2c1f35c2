"""Pieces of the SQL that the queries are held against."""

from __future__ import annotations

from gridlore.functions.vocabulary import TERMS, quoted


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings, by rows of the table as lists."""
    cell = f"CASE WHEN unicode(substr({b}, q[1]::INTEGER, 1)) = ch[1] THEN row_[q[1]] + 1 ELSE greatest(made[len(made)], row_[q[1] + 1]) END"
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda made, q: list_append(made, {cell}), [0::BIGINT])"
    chars = f"list_transform(range(1, length({a}) + 1), lambda i: [unicode(substr({a}, i::INTEGER, 1))::BIGINT])"
    zero = f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)"
    return f"(list_reduce({chars}, lambda row_, ch: {inner}, {zero}))[length({b}) + 1]"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END"


FLOAT = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def full(c: str, pattern: str) -> str:
    return f"regexp_full_match({c}, '{pattern}')"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def header(c: str, slash: str = "") -> str:
    return collapse(f"regexp_replace(regexp_replace(lower(trim({c})), '[-_{slash}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def missing(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ('', 'na', 'n/a', 'nan', 'none', 'null', '-', '--'))"


def number(c: str) -> str:
    """FN9."""
    t = f"lower(regexp_replace(trim({c}), '[$€£₹,]', '', 'g'))"
    times = f"CASE right({t}, 1) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1.0 END"
    body = f"trim(regexp_replace({t}, '[kmb]$', ''))"
    return f"(CASE WHEN NOT {missing(c)} AND {full(body, FLOAT)} THEN try_cast({body} AS DOUBLE) * ({times}) END)"


def numeric(c: str) -> str:
    """FN10."""
    t = f"trim(regexp_replace({c}, '[,$%]', '', 'g'))"
    return f"coalesce({full(t, FLOAT)} OR {full(f'lower({t})', '[+-]?(nan|inf|infinity)')}, false)"


def year(c: str) -> str:
    return f"coalesce({number(c)} = floor({number(c)}) AND {number(c)} BETWEEN 1700 AND 2100, false)"


def among(c: str, values: str) -> str:
    return f"coalesce(upper(trim({c})) IN ({values}), false)"


def boolean(c: str) -> str:
    return among(c, "'Y','N','YES','NO','TRUE','FALSE','T','F'")


def sprinkler(c: str) -> str:
    return among(c, "'Y','N','Y13','Y(13R)'")


def zipcode(c: str) -> str:
    return f"coalesce({full(f'trim({c})', '[0-9]{5}(-[0-9]{4})?')}, false)"


def currency(c: str) -> str:
    t = f"upper(trim({c}))"
    return f"coalesce(regexp_matches({t}, '[$€£₹]') OR regexp_matches({t}, '\\d[\\d,]*\\.\\d+') OR {full(t, '[0-9][0-9,]*')} OR regexp_matches({t}, '\\d+(\\.\\d+)?\\s*[KMB]$'), false)"


def dates(c: str) -> str:
    t = collapse(f"lower({c})")
    return "coalesce(" + " OR ".join(full(t, p) for p in (r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}-\d{1,2}-\d{2,4}", r"\d{1,2}\s+[a-z]{3,9}\s+\d{2,4}")) + ", false)"


DETECTORS = {"currency": currency, "year": year, "boolean": boolean, "sprinkler": sprinkler, "zip": zipcode}


def holds(text: str, key: str, least: int = 0) -> str:
    """Whether the text is one of the terms, or holds one of `least` characters or more."""
    long = [t for t in TERMS[key] if len(t) >= least]
    return f"({text} IN ({quoted(TERMS[key])}) OR len(list_filter([{quoted(long)}], lambda t_: contains({text}, t_))) > 0)"


def count_terms(text: str, key: str) -> str:
    return f"len(list_filter([{quoted(TERMS[key])}], lambda t_: contains({text}, t_)))"


def cells(table: str, columns: list[str], order: str, labels: list[str] | None = None) -> str:
    """A table's columns as long cells, under their names or labels."""
    return " UNION ALL ".join(f"SELECT {i} AS col_pos, '{n}' AS col, CAST({order} AS BIGINT) AS row_idx, CAST({c} AS STRING) AS value FROM {table}" for i, (c, n) in enumerate(zip(columns, labels or columns)))


def mapping_profile(source: str) -> str:
    """AG8 over a relation (col_pos, col, row_idx, value)."""
    here = f"NOT {missing('value')}"
    share = lambda flag: f"coalesce(avg(CASE WHEN {here} THEN ({flag})::INTEGER END), 0.0)"
    return f"""SELECT col_pos, col, count(*) AS total_count, count_if({missing('value')})::BIGINT AS missing_count, count_if({missing('value')}) / count(*)::DOUBLE AS missing_ratio,
      count(DISTINCT CASE WHEN {here} THEN trim(value) END) AS unique_count, coalesce(count(DISTINCT CASE WHEN {here} THEN trim(value) END) / nullif(count_if({here}), 0)::DOUBLE, 0.0) AS unique_ratio,
      {share('x IS NOT NULL')} AS numeric_ratio, CASE WHEN count_if({here}) > 0 THEN 1 - {share('x IS NOT NULL')} ELSE 0.0 END AS string_ratio,
      min(x) AS min, max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.5) AS median, CASE WHEN count(x) = 1 THEN 0.0 ELSE stddev_samp(x) END AS std, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
      {', '.join(f"{share(f('value'))} AS {n}_ratio" for n, f in DETECTORS.items())}
    FROM (SELECT *, {number('value')} AS x FROM ({source})) GROUP BY col_pos, col"""


PATTERNS = {
    "zip_5_digit": full("s", "[0-9]{5}"), "year_4_digit": full("s", "[0-9]{4}"), "state_code": full("s", "[A-Za-z]{2}"), "yes_no": "lower(s) IN ('yes', 'no', 'y', 'n')",
    "currency": r"regexp_matches(s, '(?i)[$€£]|^\d+(\.\d+)?[KMB]$')", "decimal": full("s", r"\d+\.\d+"),
}


def posterior_profile(source: str) -> str:
    """AG12 and AG13."""
    share = lambda flag: f"coalesce(avg(CASE WHEN s IS NOT NULL THEN coalesce({flag}, false)::INTEGER END), 0.0)"
    dtype = "CASE WHEN count(s) = 0 THEN 'object' WHEN count_if(regexp_matches(s, '^[+-]?[0-9]+$')) = count(*) THEN 'int64' WHEN count(x) = count(s) THEN 'float64' ELSE 'object' END"
    return f"""SELECT col_pos, col, {dtype} AS dtype, count(*) AS total_count, 1 - count(s) / count(*)::DOUBLE AS missing_ratio, count(DISTINCT value) AS unique_count, coalesce(count(DISTINCT value) / nullif(count(s), 0)::DOUBLE, 0.0) AS unique_ratio,
      {share('x IS NOT NULL')} AS numeric_ratio, 1 - {share('x IS NOT NULL')} AS string_ratio, {share('x = 0')} AS zero_ratio, {share('x < 0')} AS negative_ratio, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
      CASE WHEN count(x) > 1 THEN stddev_samp(x) END AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, CASE WHEN count(x) > 2 AND min(x) < max(x) THEN skewness(x) WHEN count(x) > 2 THEN 0.0 END AS skewness,
      avg(length(s)) AS avg_string_length, max(length(s)) AS max_string_length, count(DISTINCT s) AS distinct_values, {', '.join(f"{share(p)} AS p_{n}" for n, p in PATTERNS.items())}
    FROM (SELECT *, trim(value) AS s, CASE WHEN {full('trim(value)', FLOAT)} THEN try_cast(trim(value) AS DOUBLE) END AS x FROM ({source})) GROUP BY col_pos, col"""


def posterior_scores(source: str, expectations: list) -> str:
    """BY2 to BY4."""
    parts = []
    squeeze = "regexp_replace(lower(col), '[^a-z0-9]', '', 'g')"
    for i, (field, num, low, high, pattern) in enumerate(expectations):
        ratio = "numeric_ratio" if num else "(1 - numeric_ratio)"
        total, n = ratio, "1"
        if low is not None:
            total += f" + CASE WHEN min IS NOT NULL THEN ((min >= {low})::INTEGER + (max <= {high})::INTEGER) / 2.0::DOUBLE ELSE 0 END"
            n += " + (min IS NOT NULL)::INTEGER"
        if pattern:
            total, n = total + f" + p_{pattern}", n + " + 1"
        value = f"CASE WHEN numeric_ratio > 0.8 AND min >= {0 if i == 0 else 1} THEN 1.0 ELSE 0.0 END" if field in ("Building Value", "Storeys") else f"p_{pattern}"
        name = "".join(ch for ch in field.lower() if ch.isalnum())
        parts.append(f"SELECT col_pos, col, {i} AS field_pos, '{field}' AS field, {indel('sq', f'''('{name}')''')} AS header_evidence, ({total}) / ({n}) AS stat_evidence, {value} AS value_evidence FROM p_")
    return f"WITH p_ AS (SELECT *, {squeeze} AS sq FROM ({posterior_profile(source)})), s_ AS ({' UNION ALL '.join(parts)}) SELECT *, 0.40::DOUBLE * header_evidence + 0.30::DOUBLE * stat_evidence + 0.30::DOUBLE * value_evidence AS score FROM s_"
