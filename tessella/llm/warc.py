"""Not-modified revisit resolution for web archive records.

A revisit record (status 304) has no body: it stands for the latest earlier
full response of its canonical URL. Finding that is an as-of join. It runs as
a two-level scan, so that a URL with a third of all captures is not one task:
time is cut into ``BUCKETS`` equal spans, the last full response of each (URL,
span) is aggregated, carried over the at most ``BUCKETS`` spans of a URL, and
only captures of one (URL, span) are then put in order.

Validators are checked: the revisit's ETag must equal the full response's
(weakly compared, without ``W/``); where the revisit has none, Last-Modified
must be equal; with neither the revisit stays unverified. The merged headers
are those of the full response, replaced by the revisit's where a 304 may
update them; framing headers of the 304 describe its empty body and are not
merged.

Defined results, in ``resolution``: 'full' for successful responses with the
whole body (status 200 to 299 but for 204, 205 and 206); for revisits
'resolved', 'mismatch', 'unverified' and 'orphan' (no earlier full response);
'other' for any other status or none, which is neither resolved nor a source;
and 'invalid' for captures without URL, time or key, which take part in nothing.
Captures at the same instant are ordered by key; a full response of the same
instant and a lower key counts as earlier. Null header lists count as
empty, names and values may be null. Repeated rows give repeated rows; other
columns of the captures are left out, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
#: Fixed by the protocol: fields that describe the message at hand, and so never come from a 304.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that only track visitors.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """Scheme and user dropped, host in lower case without default port, no fragment, no tracking parameters, no last slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "")
    place = F.regexp_extract(u, r"^([^/?]*)", 1)
    rest = F.substring(u, F.length(place) + 1, F.length(u))
    place = F.regexp_replace(F.lower(place), r":(80|443)$", "")
    rest = F.regexp_replace(rest, rf"(?<=[?&]){TRACKING}=[^&]*(&|$)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/$", "")
    return F.concat(place, rest)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever its case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def merge_headers(full: Column, revisit: Column) -> Column:
    allowed = F.filter(revisit, lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(*NOT_MERGED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(full, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), allowed)


def resolve(captures: DataFrame, key: str = "capture_id", url: str = "url", at: str = "fetched_at", status: str = "status", headers: str = "headers") -> DataFrame:
    """(key, url, canonical_url, fetched_at, status, resolution, source_key, headers) for every capture.

    ``headers`` is array<struct<name, value>>; ``at`` a timestamp. Bodies stay
    where they are: join them by ``source_key``.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    base = captures.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(at).alias("t"), F.col(status).alias("s"), F.coalesce(F.col(headers), none).alias("h"), canonical(F.col(url)).alias("c"))
    valid = base.where("c <> '' and t is not null and k is not null")
    rest = base.where("not coalesce(c <> '' and t is not null and k is not null, false)")
    lo, hi = valid.agg(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // BUCKETS))
    full = F.coalesce(F.col("s").between(200, 299) & ~F.col("s").isin(204, 205, 206), F.lit(False))
    revisit = F.coalesce(F.col("s") == 304, F.lit(False))
    valid = valid.withColumns({"b": F.expr(f"cast((unix_micros(t) - {lo or 0}L) div {width}L as int)"), "f": F.when(full, F.struct("t", "k", "h"))})
    per_span = valid.where(full).groupBy("c", "b").agg(F.max(F.struct("t", "k")).alias("m"))
    spans = valid.groupBy("c", "b").agg(F.max(F.when(full, F.struct("t", "k"))).alias("m"))
    carried = spans.select("c", "b", F.max("m").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = Window.partitionBy("c", "b").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, -1)
    met = valid.withColumn("own", F.max("f").over(inside)).join(carried, ["c", "b"], "left")
    # Only the full responses that close a span of their URL are carried on; their headers are looked up by key.
    closing = valid.where(full).join(per_span.select("c", "b", F.col("m.k").alias("k"), F.col("m.t").alias("t")), ["c", "b", "k", "t"], "left_semi").groupBy(F.col("c").alias("cc"), F.col("k").alias("ck"), F.col("t").alias("ct")).agg(F.max("h").alias("ch"))
    met = met.withColumn("ask", F.when(F.col("own").isNull() & revisit, F.col("before")))
    met = met.join(closing, (met["c"] == closing["cc"]) & (met["ask.k"] == closing["ck"]) & (met["ask.t"] == closing["ct"]), "left")
    met = met.withColumns({"src": F.when(revisit, F.coalesce(F.col("own.k"), F.col("ask.k"))), "sh": F.coalesce(F.col("own.h"), F.col("ch"))})
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    ours, theirs = tag(F.col("h")), tag(F.col("sh"))
    since, then = header(F.col("h"), "last-modified"), header(F.col("sh"), "last-modified")
    verdict = (
        F.when(full, "full")
        .when(~revisit, "other")
        .when(F.col("src").isNull(), "orphan")
        .when(ours.isNotNull(), F.when(ours == theirs, "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(since == then, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    done = met.withColumn("r", verdict).select(
        F.col("k").alias(key), F.col("u").alias(url), F.col("c").alias("canonical_url"), F.col("t").alias(at), F.col("s").alias(status), F.col("r").alias("resolution"), F.col("src").alias("source_key"),
        F.when(F.col("r") == "resolved", merge_headers(F.col("sh"), F.col("h"))).otherwise(F.col("h")).alias(headers),
    )
    lost = rest.select(F.col("k").alias(key), F.col("u").alias(url), F.col("c").alias("canonical_url"), F.col("t").alias(at), F.col("s").alias(status), F.lit("invalid").alias("resolution"), F.lit(None).cast(dict(captures.dtypes)[key]).alias("source_key"), F.col("h").alias(headers))
    return done.unionByName(lost)


def demo_captures(pages: DataFrame) -> DataFrame:
    """Captures for the pages table, which has neither times nor headers: every page is asked for up to six times, every tenth one's site instead of the page, so that many captures share a canonical URL.

    The first and the fourth answer are full ones with validators of their own,
    but every fourth page is only ever a revisit; every eleventh answer is a
    404; every seventh revisit carries another ETag, every fifth only
    Last-Modified.
    """
    p, n = F.col("page_id"), F.col("n")
    url = F.when(p % 10 == 0, F.regexp_replace("url", r"^([a-z]+://[^/]*).*$", "$1/")).otherwise(F.col("url"))
    asked = pages.select("page_id", url.alias("url"), F.explode(F.sequence(F.lit(0), (p % 6).cast("int"))).alias("n"))
    status = F.when((p + n) % 11 == 0, 404).when((p % 4 != 0) & (n % 3 == 0), 200).otherwise(304)
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    digest = F.md5(F.concat(canonical(F.col("url")), F.lit(":"), F.floor(n / 3).cast("string")))
    etag = F.when((status != 200) & ((p + n) % 7 == 0), F.lit("other")).otherwise(digest)
    listed = F.array(
        item("Date", p * 10 + n),
        F.when((p + n) % 5 != 0, item("ETag", etag)).otherwise(item("X-Note", F.lit("none"))),
        item("Last-Modified", digest),
        item("Content-Length", F.when(status == 200, p).otherwise(F.lit(0))),
    )
    return asked.select(
        (p * 8 + n).alias("capture_id"), "url",
        F.timestamp_add("MINUTE", (p * 13 % 5000 + n * 1440).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"),
        status.alias("status"), listed.alias("headers"),
    )


#: DuckDB twin of ``resolve`` over the captures above.
ORACLE_SQL = rf"""
WITH asked AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN regexp_replace(url, '^([a-z]+://[^/]*).*$', '\1/') ELSE url END AS url FROM pages),
canon AS (
  SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?', '') AS u FROM asked),
c1 AS (SELECT *, regexp_extract(u, '^([^/?]*)', 1) AS place FROM canon),
c2 AS (SELECT page_id, url, regexp_replace(lower(place), ':(80|443)$', '') || regexp_replace(regexp_replace(
  regexp_replace(substr(u, length(place) + 1), '([?&]){TRACKING}=[^&]*(&|$)', '\1', 'g'), '[?&]+$', ''), '/$', '') AS c FROM c1),
times AS (SELECT *, CASE WHEN (page_id + n) % 11 = 0 THEN 404 WHEN page_id % 4 <> 0 AND n % 3 = 0 THEN 200 ELSE 304 END AS status, md5(c || ':' || (n // 3)) AS lm
  FROM (SELECT *, unnest(range(0, page_id % 6 + 1)) AS n FROM c2)),
caps AS (SELECT page_id * 8 + n AS k, url, c, TIMESTAMP '2024-01-01' + to_minutes(page_id * 13 % 5000 + n * 1440) AS t, status, page_id, n, lm,
    CASE WHEN (page_id + n) % 5 <> 0 THEN CASE WHEN status <> 200 AND (page_id + n) % 7 = 0 THEN 'other' ELSE lm END END AS etag FROM times),
src AS (SELECT *, max(CASE WHEN status = 200 THEN {{'t': t, 'k': k, 'page_id': page_id, 'etag': etag, 'lm': lm}} END) OVER (PARTITION BY c ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM caps),
done AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN status <> 304 THEN 'other' WHEN f IS NULL THEN 'orphan' WHEN etag IS NOT NULL THEN CASE WHEN coalesce(etag = f.etag, false) THEN 'resolved' ELSE 'mismatch' END
  WHEN lm = f.lm THEN 'resolved' ELSE 'mismatch' END AS r FROM src)
SELECT k AS capture_id, url, c AS canonical_url, t AS fetched_at, CAST(status AS INT) AS status, r AS resolution, CASE WHEN status = 304 THEN f.k END AS source_key,
  CASE WHEN r = 'resolved' THEN 'Content-Length=' || f.page_id || ';' ELSE 'Content-Length=' || (CASE WHEN status = 200 THEN page_id ELSE 0 END) || ';' END
  || 'Date=' || (page_id * 10 + n) || ';'
  || CASE WHEN etag IS NOT NULL THEN 'ETag=' || etag || ';' WHEN r = 'resolved' AND f.etag IS NOT NULL THEN 'ETag=' || f.etag || ';' ELSE '' END
  || 'Last-Modified=' || lm || ';'
  || CASE WHEN etag IS NULL OR (r = 'resolved' AND f.etag IS NULL) THEN 'X-Note=none;' ELSE '' END AS headers
FROM done
"""
