"""Not-modified revisit resolution for web archive captures.

A revisit record says that a page had not changed and carries no body. It is
resolved by an as-of join: per canonical URL, the latest full response strictly
before it. Their validators are compared (entity tags weakly, else modification
dates), and the response's headers are updated with those a not-modified answer
may change.

Captures are sorted by URL and time over range partitions; each partition is
scanned on its own and one value per URL and partition is carried on, so a URL
with any share of the captures is spread over tasks. Bodies take no part;
only their digest and length do.

Outcomes: ``etag`` or ``last-modified`` (resolved, by what), ``unchecked`` (resolved,
no validator in common), ``mismatch`` (the latest response has other
validators: not resolved, no body) and ``orphan`` (no earlier response). Defined
results: a null URL or record_id is never matched; a null time comes before all others; of
responses at one time the one with the greatest record_id counts, and a revisit at the
same time does not see it; null headers are empty; header names are compared
without case and, of names that differ in case only, the first in order is used;
repeated revisits are each resolved, repeated responses (same URL, time and
record_id) count once; one record_id may stand for several captures; an empty
table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.scan import exclusive_scan
from veilframe.llm.common import let, look_up
from veilframe.llm.registry import query
from veilframe.session import checkpoint

#: Headers that describe the stored body or one connection, which a
#: not-modified answer must not replace.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that only track visits.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref|sessionid"


def canonical_url(url: Column) -> Column:
    """One form for addresses of the same page: no scheme, www, default port,
    fragment, tracking parameters or trailing slash; host in lower case,
    parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lower_names(headers: Column) -> Column:
    """Headers with lower-case names, the first of equal ones."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                          lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value")))
    return let(F.array_sort(entries), lambda es: F.map_from_entries(F.transform(
        F.filter(es, lambda e, i: (i == 0) | (e["key"] != F.coalesce(F.get(es, i - 1)["key"], F.lit("")))),
        lambda e: F.struct(e["key"], e["value"]))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by those of a not-modified answer that may do so."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit. ``captures`` has record_id, url, ts, kind ('response' or
    'revisit'), headers (a map), body_sha256 and body_length."""
    base = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", (F.col("kind") == "response").alias("full"),
        _lower_names(F.col("headers")).alias("headers"), "body_sha256", "body_length")
    named = base.filter(F.col("canonical").isNotNull())
    order = ["canonical", "ts", "full", "record_id"]
    sorted_ = checkpoint(named.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    seen = F.when(F.col("full") & F.col("record_id").isNotNull(), F.struct(F.col("ts"), F.col("record_id")))
    narrow = sorted_.select(*order, "_part")
    scanned = exclusive_scan(narrow, ["canonical"], F.col("_part"), ["ts", "full", "record_id"], {"latest": ("max", seen)})
    # A record_id alone may be used twice; URL, time and record_id name a capture.
    name_of = lambda ts, i: F.to_json(F.struct(F.col("canonical"), F.col(ts).alias("ts"), F.col(i).alias("id")))
    pointers = checkpoint(scanned.filter("not full and latest is not null").select(
        "canonical", "ts", "record_id", F.col("latest.record_id").alias("base_id"), name_of("latest.ts", "latest.record_id").alias("base")).distinct())
    # Captures of one name that differ: the one with the greatest digest, length and headers.
    stored = F.struct(F.col("headers").alias("stored"), "body_sha256", "body_length")
    rank = F.struct("body_sha256", "body_length", F.to_json(F.array_sort(F.map_entries("headers"))))
    full = sorted_.filter("full").groupBy(name_of("ts", "record_id").alias("base")).agg(F.max_by(stored, rank).alias("_stored")).select("base", "_stored.*")
    # A response that answers most revisits is hot, so it is looked up by weight.
    uses = pointers.groupBy("base").agg(F.count("*").alias("uses"))
    total = max(1, pointers.count())
    table = checkpoint(full.join(uses, "base"))
    answered = look_up(pointers, table, "base", "uses", total)
    revisits = base.filter("not full").select("record_id", "canonical", "ts", F.col("headers").alias("fresh"))
    met = revisits.join(answered, ["canonical", "ts", "record_id"], "left")
    weak = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    a, b = weak(F.col("fresh")), weak(F.col("stored"))
    c, d = F.element_at("fresh", "last-modified"), F.element_at("stored", "last-modified")
    outcome = F.when(F.col("base_id").isNull(), "orphan").when(a.isNotNull() & b.isNotNull(), F.when(a == b, "etag").otherwise("mismatch")).when(
        c.isNotNull() & d.isNotNull(), F.when(c == d, "last-modified").otherwise("mismatch")).otherwise("unchecked")
    out = met.withColumn("outcome", outcome)
    good = F.col("outcome").isin("etag", "last-modified", "unchecked")
    return out.select(
        "record_id", "canonical", "ts", "outcome", F.when(good, F.col("base_id")).alias("base_id"),
        F.when(good, merged_headers(F.col("stored"), F.col("fresh"))).alias("headers"),
        F.when(good, F.col("body_sha256")).alias("body_sha256"), F.when(good, F.col("body_length")).alias("body_length"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures derived from raw pages: each page is fetched in full and asked for
    again later, under another spelling of its address, with good, weak, stale or no
    validators."""
    html, i = F.coalesce("html", F.lit("")), F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    date = F.concat(F.lit("day "), (i % 1000).cast("string"))
    base = pages.select(i.alias("page_id"), "url", tag.alias("tag"), date.alias("date"), F.sha2(html, 256).alias("sha"),
                        F.length(html).cast("bigint").alias("size"))
    i = F.col("page_id")
    text = lambda *parts: F.create_map(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    full = F.struct(
        (i * 2).alias("record_id"), F.col("url"), (i * 100).alias("ts"), F.lit("response").alias("kind"),
        text("ETag", F.col("tag"), "Last-Modified", F.col("date"), "Content-Type", "text/html", "Content-Length", F.col("size").cast("string"),
             "Cache-Control", "max-age=600", "Server", "a").alias("headers"), F.col("sha").alias("body_sha256"), F.col("size").alias("body_length"))
    asked = F.when(i % 7 == 0, '"stale"').when(i % 5 == 0, None).when(i % 3 == 0, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    spelled = F.when(i % 4 == 0, F.concat("url", F.lit("#part"))).when(i % 4 == 1, F.regexp_replace("url", "^https?://", "http://WWW.")).when(
        i % 4 == 2, F.regexp_replace("url", "^https?://", "HTTPS://")).otherwise(F.col("url"))
    again = F.struct(
        (i * 2 + 1).alias("record_id"), spelled.alias("url"), (i * 100 + 50 + i % 97 * 1000).alias("ts"), F.lit("revisit").alias("kind"),
        F.map_filter(text("etag", asked, "Last-Modified", F.when(i % 11 != 0, F.col("date")), "Cache-Control", "max-age=60", "Content-Length", "0",
                          "Connection", "close", "Date", (i % 97).cast("string")), lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("body_sha256"), F.lit(None).cast("bigint").alias("body_length"))
    return base.select(F.inline(F.array(full, again)))


CHECK = f"""
WITH p AS (SELECT page_id AS i, url, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id % 1000)::VARCHAR AS day,
  sha256(coalesce(html, '')) AS sha, length(coalesce(html, ''))::BIGINT AS size FROM pages),
c AS (SELECT i * 2 AS record_id, url, i * 100 AS ts, true AS full_, tag AS etag, day, sha, size, i FROM p
  UNION ALL SELECT i * 2 + 1, CASE i % 4 WHEN 0 THEN url || '#part' WHEN 1 THEN regexp_replace(url, '^https?://', 'http://WWW.')
    WHEN 2 THEN regexp_replace(url, '^https?://', 'HTTPS://') ELSE url END, i * 100 + 50 + i % 97 * 1000, false,
    CASE WHEN i % 7 = 0 THEN '"stale"' WHEN i % 5 = 0 THEN NULL WHEN i % 3 = 0 THEN 'W/' || tag ELSE tag END,
    CASE WHEN i % 11 <> 0 THEN day END, NULL, NULL, i FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
k AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)'))) AS args FROM b),
n AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical FROM k),
j AS (SELECT r.*, f.record_id AS found, f.etag AS tag, f.day AS stored_day, f.sha AS stored_sha, f.size AS stored_size
  FROM (FROM n WHERE NOT full_) r ASOF LEFT JOIN (FROM n WHERE full_) f ON r.canonical = f.canonical AND r.ts > f.ts),
o AS (SELECT *, CASE WHEN found IS NULL THEN 'orphan'
  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = tag THEN 'etag' ELSE 'mismatch' END
  WHEN day IS NOT NULL THEN CASE WHEN day = stored_day THEN 'last-modified' ELSE 'mismatch' END ELSE 'unchecked' END AS outcome FROM j)
SELECT record_id, canonical, ts, outcome, CASE WHEN outcome NOT IN ('orphan', 'mismatch') THEN found END AS base_id,
  CASE WHEN outcome NOT IN ('orphan', 'mismatch') THEN 'cache-control: max-age=60|content-length: ' || stored_size::VARCHAR
    || '|content-type: text/html|date: ' || (i % 97)::VARCHAR || '|etag: ' || coalesce(etag, tag) || '|last-modified: '
    || coalesce(day, stored_day) || '|server: a' END AS headers,
  CASE WHEN outcome NOT IN ('orphan', 'mismatch') THEN stored_sha END AS body_sha256,
  CASE WHEN outcome NOT IN ('orphan', 'mismatch') THEN stored_size END AS body_length
FROM o
"""


@query("op2_warc_revisits", CHECK)
def _revisits(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolve(captures_of(spark.read.parquet(f"{folder}/pages.parquet"))).withColumn("headers", F.array_join(lines, "|"))
