"""URL filters: dated list entries as validity intervals, and an as-of join of captures with the entries active then.

Only DataFrame functions are used. Captures are reduced to distinct hosts and dates, and these to distinct patterns and
dates, before the join on pattern and time, so a host or a domain with many captures is one row a date there; what is
found goes back to the captures by a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import column, free, rejoin

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Slices that a host's captures are dealt to.
SALTS = 16


def host_of(url: str = "url") -> Column:
    """The host of an absolute URL, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1)), F.lit(""))


def suffixes(host: str) -> Column:
    """The host and its parent domains of two labels or more; a host of one label is itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, valid_from, valid_to (exclusive, null: open) of entries (pattern, list, dated, action).

    The action 'add' opens an interval and 'remove' closes it; of several on one date for a pattern and list, an add
    prevails. Adds while open are one interval each, up to the next entry. Null patterns, lists, dates: no interval.
    """
    e = entries.where("pattern IS NOT NULL AND list IS NOT NULL AND dated IS NOT NULL AND action IS NOT NULL")
    e = e.groupBy(F.lower("pattern").alias("pattern"), "list", "dated").agg(F.max(F.col("action") == "add").alias("on"))
    nxt = F.lead("dated").over(Window.partitionBy("pattern", "list").orderBy("dated"))
    return e.withColumn("valid_to", nxt).where("on").select("pattern", "list", F.col("dated").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """captures with host, lists (sorted names of the lists that held the host or a parent domain at the fetch) and
    blocked. All rows stay, in any number; null or odd URLs and null dates are on no list. Empty tables are fine. Where
    captures has a column of one of these names, that stays, and the new one is called uf_<name>.

    Each distinct host and date is looked up once, each distinct pattern and date joined once, on pattern and time.
    """
    key_host, key_at, salt, lists_of = (free(captures, f"uf_{c}") for c in ("key_host", "key_at", "salt", "found"))
    rows = captures.withColumns({key_host: host_of(url), key_at: F.col(at), salt: F.pmod(F.xxhash64(url, at, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")})
    asked = captures.select(host_of(url).alias("host"), F.col(at).alias("at")).where("host IS NOT NULL AND at IS NOT NULL").distinct()
    asked = asked.select("host", "at", F.explode(suffixes("host")).alias("pattern"))
    # a large domain's fetch times are dealt to several tasks, each with the domain's intervals
    met = rejoin(asked.select("pattern", "at").distinct(), intervals(entries), ["pattern"], "at")
    active = met.where("valid_from <= at AND (valid_to IS NULL OR at < valid_to)").select("pattern", "at", "list").distinct()
    lists = asked.join(active, ["pattern", "at"]).groupBy("host", "at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("found"))
    lists = lists.select(F.col("host").alias(key_host), F.col("at").alias(key_at), F.col("found").alias(lists_of), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    rows = rows.join(lists, [key_host, key_at, salt], "left")
    found = F.coalesce(lists_of, F.lit(""))
    made = {"host": F.col(key_host), "lists": found, "blocked": found != ""}
    return rows.select(*map(column, captures.columns), *[c.alias(n if n not in captures.columns else free(captures, f"uf_{n}")) for n, c in made.items()])


def dated_entries(pages: DataFrame) -> DataFrame:
    """Entries for the query: a third of the hosts, by hash, are on one of three lists from a date in 2024 on, half of
    these for 90 days only; and a fixed parent domain is on a list for part of the year."""
    spark = pages.sparkSession
    h = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    hosts = pages.select(host_of().alias("host")).where("host IS NOT NULL").distinct().withColumn("h", h).where("h % 3 = 0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.floor(F.col("h") / 3)) % 300).cast("int"))
    names = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.floor(F.col("h") / 7) % 3 + 1).cast("int"))
    added = hosts.select(F.col("host").alias("pattern"), names.alias("list"), day.alias("dated"), F.lit("add").alias("action"), "h")
    gone = added.where("floor(h / 11) % 2 = 0").select("pattern", "list", F.date_add("dated", 90).alias("dated"), F.lit("remove").alias("action"))
    fixed = spark.sql("SELECT 'example.org' AS pattern, 'parent' AS list, date'2024-03-01' AS dated, 'add' AS action UNION ALL SELECT 'example.org', 'parent', date'2024-04-01', 'remove'")
    return added.drop("h").unionByName(gone).unionByName(fixed)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")))
    return filter_captures(captures, dated_entries(pages)).select("page_id", "host", "fetched", "lists", "blocked")


ORACLE = r"""
WITH cap AS (
  SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         (DATE '2024-01-01' + (page_id * 7 % 366)::INTEGER)::DATE AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM cap WHERE host IS NOT NULL),
added AS (
  SELECT host AS pattern, (['adult', 'malware', 'spam'])[(h // 7) % 3 + 1] AS list, (DATE '2024-01-01' + ((h // 3) % 300)::INTEGER)::DATE AS dated, h
  FROM hosts WHERE h % 3 = 0),
spans AS (
  SELECT pattern, list, dated AS f, CASE WHEN (h // 11) % 2 = 0 THEN (dated + 90)::DATE END AS t FROM added
  UNION ALL SELECT 'example.org', 'parent', DATE '2024-03-01', DATE '2024-04-01'),
keys AS (
  SELECT host, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS pattern
  FROM hosts),
found AS (SELECT k.host, s.list, s.f, s.t FROM keys k JOIN spans s USING (pattern)),
hit AS (
  SELECT c.page_id, string_agg(DISTINCT f.list, ',' ORDER BY f.list) AS lists
  FROM cap c JOIN found f ON c.host = f.host AND f.f <= c.fetched AND (f.t IS NULL OR c.fetched < f.t) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.fetched, coalesce(h.lists, '') AS lists, h.lists IS NOT NULL AS blocked
FROM cap c LEFT JOIN hit h USING (page_id)
"""
