"""Resolution of not-modified (304) revisit records of web archives.

A revisit is matched with the latest earlier full response of the same canonical URL (earlier: a smaller pair of time
and record id). The two fit if their entity tags are equal (weakly compared), or, where the revisit has no tag, their
modification dates are, or if neither has a validator. The headers of a fitting revisit replace those of the response, but
for the headers that describe the stored body or one connection.

All of it is DataFrame operations. The as-of join runs in two levels so that one URL with a third of all rows does not
meet in one task. Records are range-partitioned by (URL, time, id) once, so a busy URL, or a busy URL and second, spreads
over many parts. Within (URL, time bucket, part) a window finds the last response; a second window over one row for each
of them carries it to later ones.

Defined results: a revisit without an earlier response is `orphan`, one that does not fit is `changed`; both keep their
own headers. A null or empty URL resolves to nothing. Records of equal time are ordered by id; a null time is before all
others; repeated records are resolved each, and of responses with equal time and id any may be taken. Null headers count
as none; an empty table gives an empty result; further columns, also clashing ones, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import materialize

#: Headers of a 304 that never replace stored ones.
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "content-md5", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization")
#: Query parameters that do not change what a URL shows.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and the last slash; host lowered, query sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _header(headers: str, name: str) -> Column:
    return F.col(headers)[name]


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """(record_id, canonical_url, refers_to, outcome, headers) of every revisit of records.

    records: record_id long, kind ('response' or 'revisit'), url, ts (seconds, long), headers map<string,string> with
    lower-case names. outcome: resolved, changed or orphan.
    """
    empty = F.create_map().cast("map<string,string>")
    ts = F.coalesce("ts", F.lit(-(1 << 60)).cast("long"))
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), ts.alias("ts"), F.coalesce("headers", empty).alias("headers"))
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    # written once, as the ranges of two scans need not be the same
    rows = materialize(rows.repartitionByRange("canonical_url", "ts", "record_id").withColumn("part", F.spark_partition_id()))
    key = ["canonical_url", "bucket", "part"]
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    usable = rows.where(F.col("canonical_url") != "").withColumn("full", full)
    inside = Window.partitionBy(*key).orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = usable.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("full", "ts")
    latest = usable.where("full is not null").groupBy(*key).agg(F.max_by("full", F.struct("ts", "record_id")).alias("last_full"))
    buckets = usable.select(*key).distinct().join(latest, key, "left")
    before = Window.partitionBy("canonical_url").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("far", F.last("last_full", ignorenulls=True).over(before)).drop("last_full")
    found = here.join(carried, key, "left").withColumn("full", F.coalesce("near", "far"))
    tag, stored_tag = _strong(_header("headers", "etag")), _strong(F.col("full.headers")["etag"])
    date, stored_date = _header("headers", "last-modified"), F.col("full.headers")["last-modified"]
    fits = F.when(tag.isNotNull(), F.coalesce(tag == stored_tag, F.lit(False))).when(date.isNotNull(), F.coalesce(date == stored_date, F.lit(False))).otherwise(stored_tag.isNull() & stored_date.isNull())
    outcome = F.when(F.col("full").isNull(), "orphan").when(fits, "resolved").otherwise("changed")
    found = found.withColumn("outcome", outcome)
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    stored = F.map_filter(F.col("full.headers"), lambda k, v: ~F.map_contains_key(fresh, k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(stored, fresh)).otherwise(F.col("headers"))
    lost = rows.where("kind = 'revisit' and coalesce(canonical_url, '') = ''").select(
        "record_id", "canonical_url", F.lit(None).cast("long").alias("refers_to"), F.lit("orphan").alias("outcome"), "headers"
    )
    refers = F.when(F.col("outcome") == "resolved", F.col("full.record_id"))
    return found.select("record_id", "canonical_url", refers.alias("refers_to"), "outcome", merged.alias("headers")).unionByName(lost)


def header_text(headers: Column) -> Column:
    """name: value lines in order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of the pages table: a full response for each page and a later revisit of its URL.

    Record ids are 2 * page_id and 2 * page_id + 1; a page is seen at 600 * page_id seconds and checked again 2.5 days
    later. The tag is a digest of the page. Of the revisits every seventh has only a date, every eleventh a new tag.
    """
    html, page = F.coalesce("html", F.lit("")), F.col("page_id").cast("long")
    tag, date = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"')), F.concat(F.lit("day "), (page % 365).cast("string"))
    response = F.struct(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 600).alias("ts"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (page * 600).cast("string")).alias("headers"),
    )
    again = (page * 600 + 216_000).cast("string")
    weak = F.when(page % 11 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (page * 600 + 216_000).alias("ts"),
        F.when(page % 7 == 0, F.create_map(F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/plain"), F.lit("date"), again))
        .otherwise(F.create_map(F.lit("etag"), weak, F.lit("content-type"), F.lit("text/plain"), F.lit("date"), again)).alias("headers"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")
