"""URL filters: temporal list join.

List entries are dated events (pattern, category, day, action ``add`` or ``remove``). They become
validity intervals [day of add, day of the next event); of several events of a pattern and
category on one day, ``remove`` wins. A pattern is a domain, which holds for its subdomains too, or a
domain with a first path segment. An as-of join evaluates every capture against the entries
that were active on its day of fetching.

Built-in expressions only. Intervals are gathered by pattern, so that the join has one
list row for a pattern whatever its history, and adaptive execution may split captures of a
pattern that holds a third of all rows; nothing multiplies.

Nulls: a null url has no host and matches nothing; a capture without a day matches nothing; events
with a null pattern, day or action don't count, a null category is a category of its own
(written as empty). Repeated captures (page_id, url, day) give one row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trunkline.llm.common import documents

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def validity(events: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to); valid_to is null while the entry is listed."""
    known = events.where("pattern is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("pattern", F.coalesce("category", F.lit("")).alias("category"), "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("pattern", "category").orderBy("day"))
    return daily.select("pattern", "category", "action", F.col("day").alias("valid_from"), after.alias("valid_to")).where("action = 'add'").drop("action")


def filtered(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched_on, host, n_active, categories, patterns, blocked) for every distinct capture."""
    lists = validity(events).groupBy("pattern").agg(F.collect_list(F.struct("valid_from", "valid_to", "category")).alias("history"))
    rows = captures.select("page_id", "url", "fetched_on").distinct().withColumn("host", host_of(F.col("url")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.coalesce("url", F.lit("")), SEGMENT, 1)
    keys = F.when(F.col("host") == "", F.array(F.lit(""))).when(segment == "", suffixes).otherwise(F.concat(suffixes, F.array(F.concat_ws("/", "host", segment))))
    tried = rows.withColumn("pattern", F.explode(keys))
    day = F.col("fetched_on")
    active = F.filter("history", lambda h: (h["valid_from"] <= day) & (h["valid_to"].isNull() | (day < h["valid_to"])))
    met = tried.join(lists, "pattern", "left").withColumn("active", F.when(F.col("host") != "", F.transform(active, lambda h: h["category"])))
    some = F.size(F.coalesce("active", F.array().cast("array<string>")))
    out = met.groupBy("page_id", "url", "fetched_on", "host").agg(
        F.sum(some).cast("long").alias("n_active"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("active")))).alias("categories"),
        F.array_sort(F.collect_set(F.when(some > 0, F.col("pattern")))).alias("patterns"),
    )
    return out.withColumn("blocked", F.col("n_active") > 0)


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A list made from the table itself: MD5 digits of a host, or of host and first segment, say when it is added, removed and added again."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(F.coalesce("url", F.lit("")), SEGMENT, 1).alias("segment")).where("host <> ''")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    patterns = rows.select(F.explode(F.array(F.col("host"), domain, F.concat_ws("/", "host", "segment"))).alias("pattern")).where("pattern <> ''").distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5("pattern"), at, n), 16, 10).cast("int")
    chosen = patterns.where(digit(1, 1) < 8).select(
        "pattern", F.when(digit(2, 1) < 8, "spam").otherwise("adult").alias("category"), (digit(3, 2)).alias("a"), (digit(5, 2) + 1).alias("b"), (digit(7, 2) + 1).alias("c")
    )
    event = lambda offset, action: F.struct(offset.alias("n"), F.lit(action).alias("action"))
    steps = F.array(event(F.col("a"), "add"), event(F.col("a") + F.col("b"), "remove"), event(F.col("a") + F.col("b") + F.col("c"), "add"))
    return chosen.select("pattern", "category", F.explode(steps).alias("e")).select("pattern", "category", F.date_add(F.lit("2023-01-01").cast("date"), F.col("e.n")).alias("day"), "e.action")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of 2023 to 2024 (its day follows from page_id), against a list made from hosts."""
    pages = documents(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"))
    out = filtered(pages.select("page_id", "url", day.alias("fetched_on")), listed_hosts(pages))
    return out.select("page_id", "host", "fetched_on", "n_active", F.array_join("categories", ",").alias("categories"), F.array_join("patterns", " ").alias("patterns"), "blocked")


_HOST = r"regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_SEGMENT = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"
_HEX = "('0x' || substr(md5(pattern), {}, {}))::INT"
ORACLE = f"""
WITH c AS (SELECT DISTINCT page_id, url, DATE '2023-01-01' + ((page_id * 37) % 730)::INT AS fetched_on, {_HOST} AS host, {_SEGMENT} AS segment FROM pages),
p AS (SELECT DISTINCT pattern FROM (SELECT unnest([host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1), host || '/' || segment]) AS pattern FROM c WHERE host <> '') WHERE pattern <> ''),
l AS (SELECT pattern, CASE WHEN {_HEX.format(2, 1)} < 8 THEN 'spam' ELSE 'adult' END AS category, {_HEX.format(3, 2)} AS a, {_HEX.format(5, 2)} + 1 AS b, {_HEX.format(7, 2)} + 1 AS c FROM p WHERE {_HEX.format(1, 1)} < 8),
v AS (SELECT pattern, category, DATE '2023-01-01' + a AS f, DATE '2023-01-01' + (a + b) AS t FROM l UNION ALL SELECT pattern, category, DATE '2023-01-01' + (a + b + c), NULL FROM l),
k AS (SELECT page_id, url, fetched_on, host, unnest(list_concat(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), CASE WHEN segment = '' THEN [] ELSE [host || '/' || segment] END)) AS pattern FROM c WHERE host <> ''),
m AS (SELECT k.page_id, k.url, v.pattern, v.category FROM k JOIN v ON k.pattern = v.pattern AND v.f <= k.fetched_on AND (v.t IS NULL OR k.fetched_on < v.t))
SELECT c.page_id, c.host, c.fetched_on, count(m.pattern) AS n_active,
  coalesce(string_agg(DISTINCT m.category, ',' ORDER BY m.category), '') AS categories,
  coalesce(string_agg(DISTINCT m.pattern, ' ' ORDER BY m.pattern), '') AS patterns, count(m.pattern) > 0 AS blocked
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.url IS NOT DISTINCT FROM c.url GROUP BY c.page_id, c.url, c.host, c.fetched_on
"""
