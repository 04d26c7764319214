"""WARC: revisit records that a server answered with "not modified" get the headers and payload they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may carry and that replace the stored ones; the rest of the stored ones stays.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that don't choose a document.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid"
#: Captures of a URL are cut at such multiples of seconds; a block needs only what the block before hands on.
BLOCK_SECONDS = 3600

RECORD = "record_id long, warc_type string, uri string, warc_date timestamp, status int, headers map<string,string>, payload string"


def _percent(text: Column) -> Column:
    """Percent escapes in one form: letters, digits and -._~ stand for themselves, other escapes have upper-case digits."""

    def piece(p: Column, i: Column) -> Column:
        code, rest = F.conv(F.left(p, F.lit(2)), 16, 10).cast("int"), F.substring(p, 3, 2**31 - 1)
        plain = F.char(code).rlike("^[A-Za-z0-9._~-]$")
        escape = F.when(plain, F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("%"), F.upper(F.left(p, F.lit(2))), rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), escape).otherwise(F.concat(F.lit("%"), p))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%", -1), piece), "")).otherwise(text)


def canonical_url(url: Column) -> Column:
    """A URL as a key: no scheme, user, www, default port, fragment, tracking parameters or final slash; host in lower
    case; query sorted; escapes as _percent() has them. A port is the scheme's default, or 80 or 443 without a scheme."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    u = F.regexp_replace(u, "(?i)^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "^[^/?@]*@", "")
    u = F.regexp_replace(u, "(?i)^www[0-9]*\\.", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").when(scheme == "", ":(80|443)$").otherwise("(?!)")
    host = F.regexp_replace(F.regexp_replace(host, port, F.lit("")), ":$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&")
    query = F.filter(query, lambda q: (q != "") & ~F.lower(q).rlike(f"^(?:{TRACKING})(?:=|$)"))
    query = F.array_sort(F.transform(query, _percent))
    return F.concat(host, _percent(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the first stays."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(pairs, lambda p: F.lower(p["key"]))
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: F.array_position(names, p["key"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def resolve_revisits(records: DataFrame, *, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Resolve not-modified revisits against the latest earlier full response of the same canonical URL.

    records: RECORD (other columns are left out). A full response is a response of status 200 with a date; a revisit is a
    record of type revisit or of status 304. It is resolved if the response's validators agree: equal ETags (weak
    comparison) where both have one, or else Last-Modified of the response not after the revisit's, if both have it; a
    revisit without validators is taken at the server's word. Then its headers are the response's with PERMITTED ones of
    the revisit put over them, and its status 200.

    The as-of join is one of time blocks: in a block of a URL a running last response, and for its start the last one of
    the blocks before, found among one row a block. So a URL of very many captures is spread over its blocks. Only
    record ids and validators take part; payloads stay where they are, by response_id. Equal dates: a response
    comes before a revisit, records of one kind by record_id; so a revisit sees a response of its own second.

    Returns one row for each revisit: record_id, canonical_url, response_id (null without an earlier one), outcome
    (resolved, mismatch, orphan), status, headers. A null URL, date or status can't be joined: such revisits are orphans. Repeated
    records are resolved each. An empty table gives an empty one.
    """
    rows = records.select(
        "record_id", "warc_date", "status", canonical_url(F.col("uri")).alias("url"), lower_keys(F.col("headers")).alias("headers"),
        (F.lower("warc_type").eqNullSafe(F.lit("revisit")) | F.col("status").eqNullSafe(F.lit(304))).alias("revisit"),
        (F.lower("warc_type").eqNullSafe(F.lit("response")) & F.col("status").eqNullSafe(F.lit(200))).alias("full"),
    )
    rows = rows.where("revisit OR full")
    lost = rows.where("revisit AND (url IS NULL OR warc_date IS NULL)").select(
        "record_id", "url", "headers", "status", F.lit(None).cast("struct<d:timestamp,r:bigint,h:map<string,string>>").alias("last")
    )
    rows = rows.where("url IS NOT NULL AND warc_date IS NOT NULL").withColumn("block", F.floor(F.unix_timestamp("warc_date") / block_seconds))
    response = F.when(F.col("full") & ~F.col("revisit"), F.struct(F.col("warc_date").alias("d"), F.col("record_id").alias("r"), F.col("headers").alias("h")))
    rows = rows.withColumn("response", response)
    # one row for each block with its last response, and what the blocks before hand on to it
    order = F.when(F.col("response").isNotNull(), F.struct("warc_date", "record_id"))
    ends = rows.groupBy("url", "block").agg(F.max_by("response", order).alias("end"))
    w = Window.partitionBy("url").orderBy("block")
    ends = ends.select(F.col("url").alias("u"), F.col("block").alias("b"), F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    in_block = Window.partitionBy("url", "block").orderBy("warc_date", F.when(F.col("revisit"), 1).otherwise(0), "record_id")
    rows = rows.withColumn("own", F.last("response", True).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.where("revisit").join(ends, (F.col("url") == F.col("u")) & (F.col("block") == F.col("b")))
    found = found.select("record_id", "url", "headers", "status", F.coalesce("own", "before").alias("last")).unionByName(lost)
    mine, theirs = F.col("headers"), F.col("last.h")
    tag, their_tag = F.regexp_replace(mine["etag"], "^W/", ""), F.regexp_replace(theirs["etag"], "^W/", "")
    since, changed = http_date(mine["last-modified"]), http_date(theirs["last-modified"])
    agree = (
        F.when(tag.isNotNull() & their_tag.isNotNull(), tag == their_tag)
        .when(since.isNotNull() & changed.isNotNull(), changed <= since)
        .otherwise(F.lit(True))
    )
    outcome = F.when(F.col("last").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    over = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        F.col("url").alias("canonical_url"),
        F.col("last.r").alias("response_id"),
        "outcome",
        F.when(resolved, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(resolved, merged).otherwise(mine).alias("headers"),
    )


def http_date(text: Column) -> Column:
    """The time of an HTTP date such as "Tue, 15 Nov 1994 12:45:26 GMT"; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(text, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The payloads of resolved revisits, from their responses; response_id of the others is passed over."""
    body = records.select(F.col("record_id").alias("__r"), F.col("payload"))
    return resolved.join(body, (F.col("response_id") == F.col("__r")) & (F.col("outcome") == "resolved"), "left").drop("__r")


def captures_of(pages: DataFrame) -> DataFrame:
    """Crawl records of a table of pages, RECORD: each page was fetched, then asked for again by a conditional request.

    Page p is a response p minutes after the epoch, with the SHA-1 of its HTML as ETag. Its revisit comes p modulo 7 days
    later, with the ETag that the crawler then held (each tenth one is stale), and is record -1 - p.
    """
    at = F.timestamp_seconds(F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), F.lit('"'))
    stale = F.when(F.col("page_id") % 10 == 0, F.lit('"stale"')).otherwise(tag)
    first = pages.select(
        F.col("page_id").alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("uri"), at.alias("warc_date"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        (-1 - F.col("page_id")).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("uri"),
        F.timestamp_seconds(F.col("page_id") * 60 + (F.col("page_id") % 7) * 86400).alias("warc_date"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), stale, F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Type"), F.lit("text/plain")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    # digests instead of the payloads themselves go through the join
    digests = records.where("payload IS NOT NULL").withColumn("payload", F.sha2(F.encode("payload", "UTF-8"), 256))
    out = with_payload(resolve_revisits(records), digests)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda p: F.concat_ws("=", p["key"], p["value"]))
    return out.select(
        "record_id", "canonical_url", "response_id", "outcome", F.col("status").cast("int").alias("status"), F.array_join(pairs, ";").alias("headers"), F.col("payload").alias("payload_sha256")
    )


_HOST = r"""regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')),
  CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' WHEN '' THEN ':(80|443)$' ELSE 'a^' END, ''), ':$', '')"""


def _plain(text: str) -> str:
    """Escapes in one form, piece by piece: what follows a percent sign begins with two hexadecimal digits or not."""
    first = "TRY_CAST('0x' || left(p, 2) AS INTEGER)"
    plain = f"{first} BETWEEN 48 AND 57 OR {first} BETWEEN 65 AND 90 OR {first} BETWEEN 97 AND 122 OR {first} IN (45, 46, 95, 126)"
    piece = f"CASE WHEN i = 1 THEN p WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN '%' || p WHEN {plain} THEN chr({first}) || p[3:] ELSE '%' || upper(left(p, 2)) || p[3:] END"
    return f"array_to_string(list_transform(string_split({text}, '%'), lambda p, i: {piece}), '')"


ORACLE = f"""
WITH p AS (
  SELECT page_id, '"' || sha1(coalesce(html, '')) || '"' AS tag, sha256(html) AS body, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^[^/?@]*@', ''), '^[wW][wW][wW][0-9]*[.]', '') AS u
  FROM pages
), q AS (
  SELECT page_id, tag, body, {_HOST} || {_plain("regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')")} AS base,
    list_sort(list_transform(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)')), lambda x: {_plain("x")})) AS args
  FROM p
), r AS (
  SELECT page_id, tag, body, base || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url,
    page_id * 60 AS fetched, page_id * 60 + (page_id % 7) * 86400 AS again
  FROM q
), j AS (
  SELECT a.page_id, a.url, CASE WHEN a.page_id % 10 = 0 THEN '"stale"' ELSE a.tag END AS own_tag,
    b.page_id AS response_id, b.tag AS response_tag, b.body
  FROM r a JOIN r b ON a.url = b.url AND b.fetched <= a.again
  QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY b.fetched DESC, b.page_id DESC) = 1
)
SELECT -1 - page_id AS record_id, url AS canonical_url, response_id,
  CASE WHEN own_tag = response_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN own_tag = response_tag THEN 200 ELSE 304 END AS status,
  'cache-control=no-cache;content-type=' || CASE WHEN own_tag = response_tag THEN 'text/html' ELSE 'text/plain' END || ';etag=' || own_tag AS headers,
  CASE WHEN own_tag = response_tag THEN body END AS payload_sha256
FROM j
"""
