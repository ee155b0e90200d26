"""WARC not-modified revisits: each is resolved by an as-of join to the latest earlier full response of its
canonical URL. Validators are checked and the headers that a 304 may update are merged.

The as-of join has two levels: within (URL, time bucket) a window carries the last response forward, and a
table of one row per (URL, bucket) carries it across buckets. So a URL that holds a third of all records is
dealt over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import lower_ascii

#: Header fields that a 304 response carries to update a stored response (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Buckets of about equally many records that time is cut into.
BUCKETS = 64


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, ``www.``, default ports, tracking parameters and trailing slashes are dropped, the
    host is lower-cased and parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(lower_ascii(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header map with lower-cased names; of names that differ by case only, the last value holds."""
    e = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda x: F.struct(lower_ascii(x["key"]).alias("key"), x["value"].alias("value")))
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e) + 1), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (record_id, url, ts long, kind, etag, last_modified, headers map,
    payload_digest, ...): record_id, url_key, original_id, status, headers, payload_digest.

    ``kind`` is ``response`` or ``revisit``; other kinds are ignored. Earlier means a smaller (ts, record_id).
    Entity tags decide if both sides have one (weak comparison), else last-modified dates. status:
    ``resolved``; ``mismatch`` (validators differ); ``unverified`` (none in common); ``no_original``.
    Only a resolved revisit gets the response's digest and merged headers, others keep their own headers.
    Null urls and null times never match. Repeated rows are resolved alike.
    """
    r = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long"), "kind",
        F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", _lowered(F.col("headers")).alias("headers"), "payload_digest",
    )
    edges = r.agg(F.percentile_approx("ts", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
    r = r.withColumn("bucket", sum((F.coalesce((F.col("ts") > q).cast("int"), F.lit(0)) for q in dict.fromkeys(edges)), F.lit(0)))
    matched = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = F.when((F.col("kind") == "response") & matched, F.struct("ts", "record_id", "etag", "last_modified", "headers", "payload_digest"))
    r = r.withColumn("full", full)
    order = F.struct("ts", "record_id")
    latest = r.groupBy("url_key", "bucket").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("latest"))
    over = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(F.col("url_key").alias("c_key"), F.col("bucket").alias("c_bucket"), F.last("latest", ignorenulls=True).over(over).alias("carried"))
    within = Window.partitionBy("url_key", "bucket").orderBy("ts", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'")
    r = r.join(carried, F.col("url_key").eqNullSafe(F.col("c_key")) & (F.col("bucket") == F.col("c_bucket")))
    o = F.when(matched, F.coalesce("near", "carried"))
    r = r.withColumn("o", o)
    same = F.coalesce(F.col("etag") == F.col("o.etag"), F.col("last_modified") == F.col("o.last_modified"))
    status = F.when(F.col("o").isNull(), "no_original").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    r = r.withColumn("status", status)
    own = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    base = F.map_filter(F.col("o.headers"), lambda k, _: ~F.array_contains(F.map_keys(own), k))
    ok = F.col("status") == "resolved"
    return r.select(
        "record_id", "url_key", F.col("o.record_id").alias("original_id"), "status",
        F.when(ok, F.map_concat(base, own)).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("o.payload_digest")).alias("payload_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records made from pages (page_id, url, html): the id is the time, ids of remainder 1 modulo 3
    are revisits, and validators alternate between two versions of each URL or are missing."""
    i, key = F.col("page_id").cast("long"), canonical_url(F.col("url"))
    version = F.substring(F.sha2(F.concat(key, F.lit("|"), (i % 2).cast("string")).cast("binary"), 256), 1, 16)
    etag = F.when(i % 7 != 0, F.concat(F.lit('W/"'), version, F.lit('"')))
    revisit = i % 3 == 1
    fields = {"Content-Type": F.lit("text/html"), "ETag": etag, "Date": i.cast("string"), "Cache-Control": F.concat(F.lit("max-age="), (i % 60).cast("string")), "Set-Cookie": F.concat(F.lit("s="), i.cast("string"))}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return pages.select(
        i.alias("record_id"), "url", i.alias("ts"), F.when(revisit, "revisit").otherwise("response").alias("kind"), etag.alias("etag"),
        F.when(i % 5 != 0, F.concat(F.lit("2024-01-0"), (1 + i % 2).cast("string"))).alias("last_modified"),
        F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("headers"),
        F.when(~revisit, F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).alias("payload_digest"),
    )


def header_lines(headers: Column) -> Column:
    """The headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


ORACLE = r"""
WITH b AS (SELECT page_id, html, url, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(translate(regexp_extract(bare, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(bare, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref)(=|$)'))) AS q FROM b),
k AS (SELECT page_id AS i, html, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM c),
r AS (SELECT i, url_key, i % 3 = 1 AS revisit, CASE WHEN i % 7 <> 0 THEN '"' || substr(sha256(url_key || '|' || (i % 2)::VARCHAR), 1, 16) || '"' END AS etag,
             CASE WHEN i % 5 <> 0 THEN '2024-01-0' || (1 + i % 2)::VARCHAR END AS lm, sha256(coalesce(html, '')) AS digest FROM k),
o AS (SELECT v.i, v.url_key, v.etag, v.lm, max(f.i) AS original_id FROM r v LEFT JOIN r f ON f.url_key = v.url_key AND NOT f.revisit AND f.i < v.i
      WHERE v.revisit GROUP BY ALL),
s AS (SELECT o.*, f.etag AS fe, f.digest, CASE WHEN original_id IS NULL THEN 'no_original'
             WHEN coalesce(o.etag = f.etag, o.lm = f.lm) THEN 'resolved' WHEN NOT coalesce(o.etag = f.etag, o.lm = f.lm) THEN 'mismatch' ELSE 'unverified' END AS status
      FROM o LEFT JOIN r f ON f.i = o.original_id)
SELECT i AS record_id, url_key, original_id, status,
       array_to_string(list_filter(['cache-control: max-age=' || (i % 60)::VARCHAR, 'content-type: text/html', 'date: ' || i::VARCHAR,
         'etag: W/' || CASE WHEN status = 'resolved' THEN coalesce(etag, fe) ELSE etag END,
         'set-cookie: s=' || (CASE WHEN status = 'resolved' THEN original_id ELSE i END)::VARCHAR], lambda x: x IS NOT NULL), chr(10)) AS header_lines,
       CASE WHEN status = 'resolved' THEN digest END AS payload_digest FROM s"""
