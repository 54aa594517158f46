"""WARC: resolving not-modified revisits to the response that they stand for.

A revisit (HTTP 304, or a WARC revisit record) has no payload. resolve() finds for each the latest earlier full response
of its canonical URL, checks the validators of both, and merges the header fields that a 304 may update into the
stored ones (RFC 9111, 3.2 and 4.3.4).

The as-of join is a window by (canonical URL, time bucket) with a carry between buckets, so a URL with a third of all
captures is dealt to many tasks: buckets are quantiles of the captures' times; the carry is one row a bucket and URL.
Payloads aren't shuffled: a resolved revisit names its response, to whose payload payloads() joins.

Order is (ts, record id); the id decides ties, and rows that are equal in both never resolve to one another: revisits
stand before full responses of equal (ts, id), and of several such responses the one with the largest digest, then hash
of its headers, is the latest. Repeated rows stay. A null or unusable URL matches nothing, null times come first, null headers count
as none. Long headers are kept whole. Outcomes: full, resolved, mismatch
(validators differ), unmatched (no earlier full response). An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
HEADERS = "array<struct<name:string,value:string>>"

# Fields that a 304 must not update (framing, content coding, hop by hop), and query parameters that name no resource.
NOT_MERGED = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade")
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)="


def canonical_url(url: Column) -> Column:
    """Host without www. and default port, path without closing slashes, query without tracking and in order; no scheme, no fragment. Null without '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, pattern, 2), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, pattern, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(url.contains("://") & (host != ""), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def field(headers: str | Column, name: str) -> Column:
    """The first value of a field, null if there is none."""
    return F.try_element_at(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(1))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged(stored: Column, new: Column) -> Column:
    """Stored fields, those updated that the revisit's headers may update (not the ones that its Connection field names)."""
    hop = F.coalesce(F.split(F.lower(field(new, "connection")), r"\s*,\s*"), F.array().cast("array<string>"))
    fields = F.filter(new, lambda h: ~F.lower(h["name"]).isin(*NOT_MERGED) & ~F.array_contains(hop, F.lower(h["name"])))
    names = F.transform(fields, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), fields)


def resolve(records: DataFrame, id_col: str = "record_id", buckets: int = BUCKETS) -> DataFrame:
    """records: id, url string, ts (ordered type, numeric), full boolean, headers HEADERS, digest string (of the payload).

    Gives for every row: id, canonical_url, full, outcome, response_id (the row's own id if full), headers (merged if resolved).
    """
    ts = F.col("ts").cast("double")
    cuts = records.select(ts.alias("ts")).agg(F.percentile_approx("ts", [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + F.coalesce((ts > c).cast("int"), F.lit(0))
    headers = F.coalesce(F.col("headers"), F.array().cast(HEADERS))
    canonical = canonical_url(F.col("url"))
    rows = records.select(
        F.col(id_col).alias("id"), canonical.alias("canonical_url"), F.coalesce(F.col("full"), F.lit(False)).alias("full"), "ts", headers.alias("headers"), "digest",
        F.coalesce(canonical, F.concat(F.lit(" "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"), bucket.alias("bucket"),
    )
    response = F.struct(F.col("id").alias("id"), "headers", "digest")
    own = F.when(F.col("full"), response)
    headers_hash = F.xxhash64(F.transform("headers", lambda h: F.concat_ws(":", h["name"], h["value"])))
    order = [F.col("ts").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("full").asc(), F.col("digest").asc_nulls_first(), headers_hash]
    before = Window.partitionBy("key", "bucket").orderBy(*order)
    local = F.last(own, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("local", local)
    last = rows.where("full").groupBy("key", "bucket").agg(F.max_by(response, F.struct("ts", "id", "digest", headers_hash.alias("h"))).alias("last"))
    # every bucket of a key takes the last response of the buckets before it
    seen = rows.select("key", "bucket").distinct().join(last, ["key", "bucket"], "left")
    over = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.withColumn("carry", F.last("last", ignorenulls=True).over(over)).where("carry IS NOT NULL").select("key", "bucket", "carry")
    found = rows.join(carry, ["key", "bucket"], "left").withColumn("stored", F.coalesce("local", "carry"))
    stored = F.col("stored.headers")
    tag, had_tag = field("headers", "etag"), field(stored, "etag")
    date, had_date = field("headers", "last-modified"), field(stored, "last-modified")
    same = (
        F.when(tag.isNotNull() & had_tag.isNotNull(), weak(tag) == weak(had_tag))
        .when(date.isNotNull() & had_date.isNotNull(), date == had_date)
        .when(F.col("digest").isNotNull() & F.col("stored.digest").isNotNull(), F.col("digest") == F.col("stored.digest"))
        .otherwise(tag.isNull() & date.isNull() & F.col("digest").isNull() & had_tag.isNull() & had_date.isNull())
    )
    outcome = F.when(F.col("full"), "full").when(F.col("stored").isNull(), "unmatched").when(same, "resolved").otherwise("mismatch")
    out = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return out.select(
        F.col("id").alias(id_col), "canonical_url", "full", "outcome",
        F.when(F.col("full"), F.col("id")).when(resolved, F.col("stored.id")).alias("response_id"),
        F.when(resolved, merged(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def payloads(resolved: DataFrame, records: DataFrame, body_col: str = "body", id_col: str = "record_id") -> DataFrame:
    """resolved with the payload of the response that each row stands for; null without one."""
    bodies = records.where("full").select(F.col(id_col).alias("response_id"), F.col(body_col))
    return resolved.join(bodies, "response_id", "left")
