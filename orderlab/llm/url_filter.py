"""URL filters: a temporal join of captures with dated block lists.

List entries are (list, pattern, action ``add`` or ``remove``, dated_at).  A pattern
is a host, which also covers its subdomains, or a host and a first path segment
(``host/segment``).  The entries of a pattern become validity intervals [from, to)
with one window over that pattern's entries; a capture is blocked by the entries
active at its fetch time.

The as-of join is an equality join on (pattern, month) plus the interval test:
intervals are repeated per month they touch up to the last capture, so a capture
meets only the intervals near its time, whatever the length of a pattern's history.
Only ids, URLs and times go through the join; AQE splits the partition of a host
that holds a third of all captures, and broadcasts the intervals only when their
measured size is under its threshold.

DataFrame expressions only.  Edge cases: a null or unparsable URL or a null fetch
time matches nothing; entries with a null pattern, list or date are ignored; of
entries of one pattern with the same date ``remove`` wins; repeated entries change
nothing; repeated captures are each reported; an ``add`` after an ``add`` continues
the interval; empty lists block nothing; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
KEY = ["page_id", "url", "fetched_at"]


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def patterns(url: Column) -> Column:
    """Patterns that cover a URL: its host and parent domains of two labels or more,
    each alone and with the first path segment."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    count = F.when((host(url) != "") & (n >= 2), n - 1).otherwise(F.lit(0))
    domains = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(
        F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    segment = F.regexp_extract(url, SEGMENT, 1)
    deep = F.when(segment != "", F.transform(domains, lambda d: F.concat(d, F.lit("/"), segment))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, deep))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) of the active times; valid_to is null
    while an entry is still active."""
    # a host has no case, a path segment has: normalised before the entries of a pattern are put in order
    name = F.substring_index("pattern", "/", 1)
    e = (entries.where("list is not null and pattern is not null and dated_at is not null")
         .where(F.col("action").isin("add", "remove"))
         .withColumn("pattern", F.concat(F.lower(name), F.expr("substr(pattern, length(substring_index(pattern, '/', 1)) + 1)")))
         .groupBy("list", "pattern", "dated_at").agg(F.max("action").alias("action")))  # remove > add
    order = Window.partitionBy("list", "pattern").orderBy("dated_at")
    return (e.withColumn("valid_to", F.lead("dated_at").over(order)).where("action = 'add'")
            .select("list", "pattern", F.col("dated_at").alias("valid_from"), "valid_to"))


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) plus host, blocked and matches: the
    active ``list:pattern`` entries, sorted and comma-joined."""
    captures = captures.select(*KEY)
    active = intervals(entries)
    last = captures.agg(F.max("fetched_at").alias("last"))
    months = active.crossJoin(F.broadcast(last)).where("valid_from <= last").select(  # one row
        "list", "pattern", "valid_from", "valid_to",
        F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least("valid_to", "last"), "month"),
                             F.expr("interval 1 month"))).alias("month"))
    asked = captures.where("fetched_at is not null").select(
        *KEY, F.trunc("fetched_at", "month").alias("month"), F.explode(patterns(F.col("url"))).alias("pattern"))
    hits = (asked.join(months, ["pattern", "month"])
            .where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
            .groupBy(*KEY).agg(F.array_sort(F.collect_set(F.concat_ws(":", "list", "pattern"))).alias("found")))
    hits = hits.toDF("p", "u", "f", "found")
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & F.col("fetched_at").eqNullSafe(
        F.col("f"))
    return captures.join(hits, same, "left").select(
        *KEY, host(F.col("url")).alias("host"), F.col("found").isNotNull().alias("blocked"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("matches"))


def keep_allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no active entry covers."""
    return blocked(captures, entries).where("not blocked").select(*KEY)


# --- the dated lists and fetch times that the registered query derives from ``pages`` ---

START = "2024-01-01 00:00:00"


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time spread over 2024 by the page id."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.pmod(F.col("page_id") * 7919, F.lit(527040)) * 60)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts that occur: ``spam`` lists hosts named for spam or
    pills, ``audit`` a quarter of all hosts; each is added, removed and added again on
    days given by the host's hash; ``section`` lists one path segment per host."""
    hosts = pages.select(host(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    n = _number(F.col("pattern"))
    spam = hosts.where("pattern like '%spam%' or pattern like '%pills%'").select(F.lit("spam").alias("list"), "pattern",
                                                                               n.alias("n"))
    audit = hosts.where(_number(F.concat(F.lit("audit:"), F.col("pattern"))) % 4 == 0).select(
        F.lit("audit").alias("list"), "pattern", n.alias("n"))
    section = hosts.select(F.lit("section").alias("list"), F.concat("pattern", F.lit("/de")).alias("pattern"), n.alias("n"))
    steps = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(k).alias("k")) for k, a in
                      enumerate(("add", "remove", "add"))])
    days = F.pmod(F.col("n"), F.lit(120)) + F.col("s.k") * (30 + F.pmod(F.col("n"), F.lit(7)) * 10)
    return (spam.union(audit).union(section).select("list", "pattern", "n", F.explode(steps).alias("s"))
            .select("list", "pattern", "s.action",
                    F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + days * 86400).alias("dated_at")))


PAGES_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 7919 % 527040 AS BIGINT)) AS fetched_at,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
h AS (SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS n FROM c WHERE host <> ''),
l AS (SELECT 'spam' AS list, pattern, n FROM h WHERE pattern LIKE '%spam%' OR pattern LIKE '%pills%'
      UNION ALL SELECT 'audit', pattern, n FROM h WHERE CAST('0x' || substr(md5('audit:' || pattern), 1, 8) AS BIGINT) % 4 = 0
      UNION ALL SELECT 'section', pattern || '/de', n FROM h),
e AS (SELECT list, pattern, action, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(n % 120 + k * (30 + n % 7 * 10) AS INTEGER)) AS dated_at
      FROM l, (VALUES (0, 'add'), (1, 'remove'), (2, 'add')) AS s(k, action)),
p AS (SELECT page_id, url, fetched_at, host, seg, string_split(host, '.') AS ls FROM c),
d AS (SELECT page_id, url, fetched_at, seg, array_to_string(ls[i:], '.') AS dom
      FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM p WHERE host <> '')),
q AS (SELECT page_id, url, fetched_at, dom AS pattern FROM d
      UNION SELECT page_id, url, fetched_at, dom || '/' || seg FROM d WHERE seg <> ''),
lists AS (SELECT DISTINCT list, pattern FROM e),
asof_hit AS (SELECT q.page_id, q.url, q.fetched_at, a.list, a.pattern,
        (SELECT arg_max(action, dated_at) FROM e WHERE e.list = a.list AND e.pattern = a.pattern AND e.dated_at <= q.fetched_at) AS act
      FROM q JOIN lists a USING (pattern)),
m AS (SELECT page_id, url, fetched_at, string_agg(list || ':' || pattern, ',' ORDER BY list || ':' || pattern) AS matches
      FROM asof_hit WHERE act = 'add' GROUP BY ALL)
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, c.host, m.matches IS NOT NULL AS blocked,
       coalesce(m.matches, '') AS matches
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url = m.url AND c.fetched_at = m.fetched_at"""
