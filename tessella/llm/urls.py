"""URL filtering against a dated list, in DataFrame operations only.

List entries (domain, action, day) become validity intervals: an entry holds
until the domain's next entry. A capture is evaluated against the entry that
was in force at its fetch time, for its host and for every parent domain. All
intervals of a domain form one row, so the as-of join is an equi-join on the
domain and a search in that row; the list is broadcast while it is small and
shuffled (with skewed domains split) beyond. Captures never meet each other.

Defined results: URLs without a host (null, empty, malformed) and captures
without a fetch time are not blocked; entries at the same instant of a domain
count in the order add, remove, so the removal decides; repeated entries and
repeated captures are harmless; entries with a null domain or time are
ignored; an empty list blocks nothing; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.base import written

#: Up to so many intervals the list is broadcast (some tens of MB at most, as domains have at most 253 characters).
BROADCAST_INTERVALS = 200_000


def host(url: Column) -> Column:
    """The lower-case host without user, port and a last dot; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.$", "")


def intervals(entries: DataFrame, domain: str = "domain", action: str = "action", at: str = "at") -> DataFrame:
    """(domain, spans array<struct<since, until>>) in which each domain is listed."""
    clean = entries.select(F.lower(F.col(domain)).alias("domain"), F.col(action).alias("action"), F.col(at).alias("at")).dropna().distinct()
    order = Window.partitionBy("domain").orderBy("at", "action")
    spans = clean.withColumn("until", F.lead("at").over(order)).where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    return spans.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("spans"))


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, and the longest listed ``matched_domain`` with its ``since``.

    The host's parent domains are looked up one by one in the joined list, so
    no capture is multiplied beyond its number of labels. ``key`` must tell
    captures apart, except for repeated rows.
    """
    listed = written(intervals(entries), "intervals")
    count = listed.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    names = [x for x in captures.columns if x not in ("host", "blocked", "matched_domain", "since")]
    hosts = captures.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{url}`").alias("__url"), F.col(f"`{fetched}`").alias("__at"), host(F.col(f"`{url}`")).alias("__host"))
    labels = F.split("__host", r"\.")
    suffixes = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = hosts.where("__host <> '' and __at is not null").distinct().withColumn("domain", F.explode(suffixes))
    met = asked.join(F.broadcast(listed) if count <= BROADCAST_INTERVALS else listed, "domain")
    inside = F.filter("spans", lambda s: (s["since"] <= F.col("__at")) & (s["until"].isNull() | (s["until"] > F.col("__at"))))
    hits = met.withColumn("__hit", F.get(inside, 0)["since"]).where("__hit is not null")
    best = hits.groupBy("__key", "__url", "__at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", F.col("__hit").alias("since"))).alias("__best"))
    left = captures.select(*[f"`{x}`" for x in names])
    on = left[key].eqNullSafe(best["__key"]) & left[url].eqNullSafe(best["__url"]) & left[fetched].eqNullSafe(best["__at"])
    return left.join(best, on, "left").select(
        *[left[x] for x in names],
        host(left[url]).alias("host"),
        F.col("__best").isNotNull().alias("blocked"),
        F.col("__best.domain").alias("matched_domain"),
        F.col("__best.since").alias("since"),
    )


def demo_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A dated list for the test tables, which have none: entries follow from a digest of each host and of each parent domain.

    Listed on day d, released 20 days later, and for some listed again.
    """
    hosts = pages.select(host(F.col(url)).alias("h")).where("h like '%.%'").distinct()
    names = hosts.select(F.explode(F.array("h", F.regexp_replace("h", r"^[^.]*\.", ""))).alias("domain")).where("domain like '%.%.%'").distinct()
    mark = F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01").cast("timestamp"))
    entry = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    made = names.withColumn("mark", mark).withColumn("e", F.explode(F.array(entry("add", F.col("mark") % 30), entry("remove", F.col("mark") % 30 + 20), F.when(F.col("mark") % 2 == 0, entry("add", F.col("mark") % 30 + 45)))))
    return made.where("mark % 3 = 0 and e is not null").select("domain", "e.action", "e.at")


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time, which the table lacks: one every 37 minutes from 2024 on, over and again through 90 days."""
    return pages.select("page_id", "url", F.timestamp_add("MINUTE", (F.col("page_id") * 37 % 129600).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"))


#: DuckDB twin of ``evaluate`` over the pages and the list above.
ORACLE_SQL = r"""
WITH caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 37 % 129600) AS fetched_at,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') AS host FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM caps WHERE host LIKE '%.%'),
names AS (SELECT DISTINCT domain FROM (SELECT unnest([h, regexp_replace(h, '^[^.]*\.', '')]) AS domain FROM hosts) WHERE domain LIKE '%.%.%'),
marked AS (SELECT domain, CAST(('0x' || substr(md5(domain), 1, 4)) AS INT) AS mark FROM names),
entries AS (
  SELECT domain, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(mark % 30) AS moment FROM marked WHERE mark % 3 = 0
  UNION ALL SELECT domain, 'remove', TIMESTAMP '2024-01-01' + to_days(mark % 30 + 20) FROM marked WHERE mark % 3 = 0
  UNION ALL SELECT domain, 'add', TIMESTAMP '2024-01-01' + to_days(mark % 30 + 45) FROM marked WHERE mark % 6 = 0),
spans AS (SELECT * FROM (SELECT domain, action, moment AS since, lead(moment) OVER (PARTITION BY domain ORDER BY moment, action) AS until FROM entries) WHERE action = 'add'),
hits AS (SELECT c.page_id, max({'n': length(s.domain), 'domain': s.domain, 'since': s.since}) AS best FROM caps c JOIN spans s
  ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND s.since <= c.fetched_at AND (s.until IS NULL OR s.until > c.fetched_at) GROUP BY c.page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, h.best IS NOT NULL AS blocked, h.best.domain AS matched_domain, h.best.since AS since FROM caps c LEFT JOIN hits h USING (page_id)
"""
