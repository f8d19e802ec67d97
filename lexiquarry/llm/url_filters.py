"""URL filters: a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals, one row for each pattern. A capture's URL gives the patterns that can
match it (its host and the domains above, each with the path's leading segments), these meet the list by equality,
and the interval that holds at fetch time is the entry in force. The most specific pattern decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup_join, stash

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a dot at its end; null where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def patterns_of(host: Column, path: Column, deepest: int) -> Column:
    """Structs (labels, segments, pattern): all domains of at least two labels that the host is in (a single label is itself), each alone and with every run of at most `deepest` leading path segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((n - i + 1).alias("labels"), F.array_join(F.slice(labels, i, n), ".").alias("domain")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(deepest))), lambda k: F.struct(k.alias("segments"), F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))).alias("path")))
    both = F.transform(domains, lambda d: F.transform(paths, lambda p: F.struct(d["labels"].alias("labels"), p["segments"].alias("segments"), F.concat(d["domain"], p["path"]).alias("pattern"))))
    return F.flatten(both)


def intervals(entries: DataFrame) -> DataFrame:
    """One row for each pattern of entries(pattern, action, listed): spans, an array of (since, until, action) in order.

    An entry holds from its date until the pattern's next one. Of entries of one pattern and date, "allow" wins over
    "block". Rows with a null pattern, action or date are no entries. A pattern's host is in lower case, its path as it is.
    """
    good = entries.filter(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("listed").isNotNull())
    pattern = F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "(?s)^[^/]*(/.*)$", 1))
    dated = good.groupBy(pattern.alias("pattern"), "listed").agg(F.min("action").alias("action"))
    by = dated.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("listed", "action"))).alias("dates"))
    spans = F.transform("dates", lambda x, k: F.struct(x["listed"].alias("since"), F.get("dates", k + 1)["listed"].alias("until"), x["action"].alias("action")))
    return by.select("pattern", spans.alias("spans"))


def decided(captures: DataFrame, entries: DataFrame, prefix: str = "url_") -> DataFrame:
    """captures(url, fetched, ...) with <prefix>host, pattern, action and blocked.

    A URL without a host, a null fetch time, and a URL that no entry in force matches are not blocked, with null pattern
    and action. Rows that repeat are decided each. Longer domains win, then longer paths. Empty tables stay empty. Paths
    are taken as deep as the list's deepest entry, which loses no match and bounds the work on very long URLs. Columns of
    captures may have any name that doesn't start with the prefix.
    """
    c = lambda name: F.col(prefix + name)
    rows = captures.withColumns({prefix + "row": F.monotonically_increasing_id(), prefix + "host": host_of(F.col("url"))})
    rows = stash(rows, "captures")
    lists = cut(intervals(entries))
    deepest = lists.agg(F.max(F.size(F.filter(F.split("pattern", "/"), lambda s: s != "")) - 1)).first()[0] or 0
    keys = rows.filter(c("host").isNotNull() & F.col("fetched").isNotNull()).select(c("row").alias("row"), "fetched", F.explode(patterns_of(c("host"), F.regexp_extract("url", PATH, 1), deepest)).alias("p"))
    keys = keys.select("row", "fetched", "p.labels", "p.segments", "p.pattern")
    # captures for each listed pattern, from which the join knows its hot keys
    n = keys.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    met = lookup_join(keys, cut(lists.join(n, "pattern")), "pattern", "n")
    inside = F.filter("spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (F.col("fetched") < s["until"])))
    met = met.withColumn("action", F.get(inside, F.lit(0))["action"]).filter("action IS NOT NULL")
    best = met.groupBy("row").agg(F.max(F.struct("labels", "segments", "pattern", "action")).alias(prefix + "best"))
    out = rows.join(best.withColumnRenamed("row", prefix + "row"), prefix + "row", "left")
    out = out.withColumns({prefix + "pattern": c("best.pattern"), prefix + "action": c("best.action"), prefix + "blocked": F.coalesce(c("best.action") == "block", F.lit(False))})
    return out.drop(prefix + "row", prefix + "best")


def keep(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures without the blocked ones."""
    return decided(captures, entries).filter("NOT url_blocked").select(*captures.columns)


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch date. The table has none: 1461 days are dealt out by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(1461)).cast("int")).alias("fetched"))


def list_by_rule(pages: DataFrame) -> DataFrame:
    """A dated list for the query, as no table holds one: two to four entries for two of every five hosts and for their first
    path segment, of which the hash of the host sets dates and actions."""
    host = host_of(F.col("url"))
    first = F.regexp_extract("url", r"^[^:]+://[^/?#]*(/[^/?#]+)", 1)
    names = pages.select(host.alias("host"), first.alias("first")).filter("host IS NOT NULL")
    labels = F.split("host", r"\.")
    above = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")).otherwise(F.col("host"))
    names = names.select(F.explode(F.array("host", F.concat("host", "first"), above)).alias("pattern")).distinct()
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), "pattern").cast("binary")), 1, 8), 16, 10).cast("long")
    listed = names.filter(number("in:") % 5 < 2).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), 1 + number("n:") % 3)))
    day = F.pmod(number("day:") + F.col("k") * 397, F.lit(1461)).cast("int")
    action = F.when((number("first:") + F.col("k")) % 2 == 0, "block").otherwise("allow")
    return listed.select("pattern", action.alias("action"), F.date_add(F.lit("2020-01-01").cast("date"), day).alias("listed"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the verdict on every page's URL at its fetch date."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = decided(dated_captures(pages), cut(list_by_rule(pages)))
    return out.select("page_id", "fetched", F.col("url_host").alias("host"), F.col("url_pattern").alias("pattern"), F.col("url_action").alias("action"), F.col("url_blocked").alias("blocked"))


_NUMBER = "CAST('0x' || substr(md5('{}:' || pattern), 1, 8) AS BIGINT)"
SQL = rf"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS row, DATE '2020-01-01' + CAST(((page_id % 1461) + 1461) % 1461 AS INTEGER) AS fetched,
           nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\.+$', ''), '') AS host,
           regexp_extract(url, '{PATH}', 1) AS path, regexp_extract(url, '^[^:]+://[^/?#]*(/[^/?#]+)', 1) AS first FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels, [s FOR s IN string_split(path, '/') IF s <> ''] AS segments FROM u WHERE host IS NOT NULL),
n AS (SELECT DISTINCT unnest([host, host || first, CASE WHEN len(labels) > 2 THEN array_to_string(labels[2:], '.') ELSE host END]) AS pattern FROM l),
i AS (SELECT pattern, unnest(range(0, 2 + {_NUMBER.format('n')} % 3)) AS k FROM n WHERE {_NUMBER.format('in')} % 5 < 2),
e AS (SELECT lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1) AS pattern, CASE WHEN ({_NUMBER.format('first')} + k) % 2 = 0 THEN 'block' ELSE 'allow' END AS action,
      DATE '2020-01-01' + CAST(({_NUMBER.format('day')} + k * 397) % 1461 AS INTEGER) AS listed FROM i),
d AS (SELECT pattern, listed, min(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS until FROM d),
a AS (SELECT row, fetched, labels, segments, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS f FROM l),
b AS (SELECT *, unnest(range(0, len(segments) + 1)) AS t FROM a),
c AS (SELECT row, fetched, len(labels) - f + 1 AS depth, t, array_to_string(labels[f:], '.') || CASE WHEN t = 0 THEN '' ELSE '/' || array_to_string(segments[1:t], '/') END AS pattern FROM b),
m AS (SELECT row, c.pattern, action, row_number() OVER (PARTITION BY row ORDER BY depth DESC, t DESC, c.pattern DESC) AS place
      FROM c JOIN v ON c.pattern = v.pattern AND c.fetched >= v.listed AND (v.until IS NULL OR c.fetched < v.until))
SELECT u.page_id, u.fetched, u.host, m.pattern, m.action, coalesce(m.action = 'block', false) AS blocked FROM u LEFT JOIN m ON u.row = m.row AND m.place = 1
"""

QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": SQL}
