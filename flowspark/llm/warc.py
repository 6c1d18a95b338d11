"""Revisit records of web archives resolved to the responses that they left unchanged.

A server that answers "not modified" leaves a revisit record without a body. Its body is that of
the latest earlier full response for the same canonical URL, if the validators agree; its headers
are that response's, updated by those of the revisit that a 304 answer may carry.

The as-of join is one window in time order over responses and revisits together, in DataFrame
operations: no pair of records is ever built. A URL's records are dealt by URL and time bucket, and
what a bucket takes over from those before it comes from one row per URL and bucket, so a URL with
very many records is spread over its buckets. Bodies are not moved; a result names the record that
holds the body.

Records: record_id, kind ('response' or 'revisit'), url, ts (seconds), status, headers (array of
name and value), body_id. Full responses are those with status 200. Of records of one second the
larger record_id is later. A revisit with ``etag`` must agree with the response's, compared without
the mark of weak tags; without one, its ``last-modified`` must be equal; with neither it is taken
as it is. Outcomes: ``resolved``, ``unchecked`` (no validator), ``changed`` (validators differ; no
original is given) and ``missing`` (no earlier response, or the record has no URL or time). Null
headers count as none. Repeated records give repeated results. An empty table gives an empty table,
and further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The headers that a 304 answer sends to update a stored response.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
# Query parameters that say where a visitor came from, not what is asked for.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user, fragment or tracking parameter; sorted query."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    asked = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, path, query)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, null where there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, with those of the update that a 304 answer may send in place of their namesakes."""
    sent = F.filter(update, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(sent, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), sent)


def resolve(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row per revisit: record_id, url (canonical), ts, outcome, original_id, body_id, headers."""
    rows = records.select(
        "record_id",
        (F.col("kind") == "revisit").alias("revisit"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
        canonical(F.col("url")).alias("url"),
        F.col("ts").cast("long").alias("ts"),
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"),
        "body_id",
    ).where("revisit OR full")
    timed = rows.where(F.col("url").isNotNull() & F.col("ts").isNotNull()).withColumn("_b", F.floor(F.col("ts") / bucket_seconds))
    original = F.when(F.col("full"), F.struct("ts", "record_id", "headers", "body_id"))
    # the last response of each bucket, and of all buckets before it
    last = timed.where("full").groupBy("url", "_b").agg(F.max_by(F.struct("ts", "record_id", "headers", "body_id"), F.struct("ts", "record_id")).alias("_l"))
    wanted = timed.groupBy("url", "_b").agg(F.bool_or("revisit").alias("_any"))
    earlier = Window.partitionBy("url").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = wanted.join(last, ["url", "_b"], "left").withColumn("_carry", F.last("_l", ignorenulls=True).over(earlier)).where("_any").select("url", "_b", "_carry")
    before = Window.partitionBy("url", "_b").orderBy("ts", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = timed.withColumn("_o", F.last(original, ignorenulls=True).over(before)).where("revisit")
    found = seen.join(carry, ["url", "_b"], "left").withColumn("_o", F.coalesce("_o", "_carry"))
    cols = ["record_id", "url", "ts", "headers", "_o"]
    lost = rows.where(F.col("revisit") & (F.col("url").isNull() | F.col("ts").isNull())).withColumn("_o", F.lit(None).cast(found.schema["_o"].dataType))
    both = found.select(*cols).unionByName(lost.select(*cols))
    tag, stored_tag = (F.regexp_replace(header(h, "etag"), "^W/", "") for h in (F.col("headers"), F.col("_o.headers")))
    changed, stored_changed = (header(h, "last-modified") for h in (F.col("headers"), F.col("_o.headers")))
    agrees = F.when(tag.isNotNull(), tag.eqNullSafe(stored_tag)).when(changed.isNotNull(), changed.eqNullSafe(stored_changed))
    outcome = F.when(F.col("_o").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    good = F.col("outcome").isin("resolved", "unchecked")
    return both.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "ts",
        "outcome",
        F.when(good, F.col("_o.record_id")).alias("original_id"),
        F.when(good, F.col("_o.body_id")).alias("body_id"),
        F.when(good, merged(F.col("_o.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
