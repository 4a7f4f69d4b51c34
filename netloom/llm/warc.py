"""Not-modified revisit records resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of a stored response that a not-modified answer must not
# replace (they describe the body), and headers that belong to one connection.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "etag")
HOP_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"
)
# Query parameters that name a visit and not a page.
VISIT_PARAMETERS = ("phpsessid", "jsessionid", "sid", "ref", "fbclid", "gclid", "utm_[a-z]+")
BUCKET_SECONDS = 86_400

RESOLVED, MISMATCH, MISSING = "resolved", "validator_mismatch", "no_earlier_response"


def canonical_url(url: Column) -> Column:
    """One spelling per page.

    Scheme and host in lower case, without `www.`, default port, fragment, visit
    parameters and a closing slash; the other parameters in order. http and
    https are one. Null stays null; a text that is no http address is trimmed only.
    """
    text = F.trim(url)
    shape = r"(?i)^https?://([^/?#]+)([^?#]*)(?:[?]([^#]*))?(?:#.*)?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(text, shape, 1)), r"^www[.]|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(text, shape, 2), "/+$", "")
    visit = rf"^(?i:{'|'.join(VISIT_PARAMETERS)})(=|$)"
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(text, shape, 3), "&"), lambda p: (p != "") & ~p.rlike(visit)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(text.rlike(shape), F.concat(host, path, query)).otherwise(text)


def headers_of(block: Column) -> Column:
    """Header block (`Name: value` lines) as a map with lower-case names; of equal names the last counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+\s*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"),
            F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column) -> Column:
    """Headers of the stored response, freshened by those that a not-modified answer may carry."""
    barred = F.array(*[F.lit(h) for h in (*BODY_HEADERS, *HOP_HEADERS)])
    allowed = F.map_filter(update, lambda k, v: ~F.array_contains(barred, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def _etag(headers: Column) -> Column:
    """Entity tag for the weak comparison: without the W/ mark."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def validators_agree(stored: Column, update: Column) -> Column:
    """Entity tags decide if both have one, then the dates of change; with neither, nothing speaks against it."""
    tags, dates = (_etag(stored), _etag(update)), (stored["last-modified"], update["last-modified"])
    return (
        F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1])
        .when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
        .otherwise(F.lit(True))
    )


def latest_earlier(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add `prior`: the latest full response before each record, per canonical address.

    Records: page, at (seconds), full (boolean), id and what to carry in `own`.
    An address that holds a large part of all records is cut into time buckets:
    windows see the records of one (address, bucket), and one row per bucket
    carries its last response on.
    """
    cell = records.withColumn("_bucket", F.floor(F.col("at") / bucket_seconds))
    response = F.when(F.col("full"), F.struct("at", "id", "own"))
    # A response is no earlier record of its own second, so whole seconds are left out.
    inside = Window.partitionBy("page", "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("page").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    best = cell.where("full").groupBy("page", "_bucket").agg(F.max(F.struct("at", "id")).alias("last"))
    near = cell.withColumn("_near", F.max(F.when(F.col("full"), F.struct("at", "id"))).over(inside))
    cells = near.where("_near IS NULL").select("page", "_bucket").distinct()
    # The buckets of an address, not its records, are put in order.
    filled = (
        cells.withColumn("last", F.lit(None).cast(best.schema["last"].dataType)).withColumn("ask", F.lit(True))
        .unionByName(best.withColumn("ask", F.lit(False)))
        .groupBy("page", "_bucket").agg(F.max("last").alias("last"), F.max("ask").alias("ask"))
        .withColumn("_far", F.last("last", ignorenulls=True).over(before))
        .where("ask").select("page", "_bucket", "_far")
    )
    found = near.join(filled, ["page", "_bucket"], "left").withColumn("_pick", F.coalesce("_near", "_far"))
    source = cell.where("full").select(F.col("id").alias("_id"), response.alias("prior"))
    return found.withColumn("_id", F.col("_pick.id")).join(source, "_id", "left").select(*records.columns, "prior")


def resolve_revisits(
    df: DataFrame,
    key: str = "record_id",
    url: str = "url",
    at: str = "at",
    kind: str = "kind",
    headers: str = "headers",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One row per revisit: record_id, page, status, response_id, response_at, headers (a map).

    `df` holds a row per record: a unique key, address, time (timestamp), kind
    ('response' or 'revisit'; others are passed over) and header block. A revisit
    is resolved by the latest response of its canonical address in an earlier
    second; of responses in one second the largest key counts. Its status tells
    if the validators disagree or no earlier response exists; then the headers
    are the revisit's own. A null address or time is resolved by nothing and
    resolves nothing.
    """
    rows = df.where(F.col(kind).isin("response", "revisit")).select(
        canonical_url(F.col(url)).alias("page"),
        F.unix_seconds(F.col(at).cast("timestamp")).alias("at"),
        (F.col(kind) == "response").alias("full"),
        F.col(key).alias("id"),
        F.col(headers).alias("own"),
    )
    known = rows.where("page IS NOT NULL AND at IS NOT NULL")
    asked = latest_earlier(known, bucket_seconds).where("NOT full")
    lost = rows.where("NOT full AND (page IS NULL OR at IS NULL)").withColumn(
        "prior", F.lit(None).cast(asked.schema["prior"].dataType)
    )
    both = asked.unionByName(lost).select(
        "page", "id", "prior", headers_of(F.col("own")).alias("update"), headers_of(F.col("prior.own")).alias("stored")
    )
    agree = F.col("prior").isNotNull() & validators_agree(F.col("stored"), F.col("update"))
    return both.select(
        F.col("id").alias("record_id"),
        "page",
        F.when(F.col("prior").isNull(), MISSING).when(agree, RESOLVED).otherwise(MISMATCH).alias("status"),
        F.when(agree, F.col("prior.id")).alias("response_id"),
        F.when(agree, F.timestamp_seconds("prior.at").cast("timestamp_ntz")).alias("response_at"),
        F.when(agree, merged_headers(F.col("stored"), F.col("update"))).otherwise(F.col("update")).alias("headers"),
    )


# Capture records from the pages: a response each, and two revisits of it, some
# with other validators, some before any response. {spread} makes three rows of
# a page; the rest of the text is the same in Spark and DuckDB.
RECORDS_SQL = """SELECT 3 * page_id + k AS record_id, url,
  CASE k WHEN 0 THEN 'response' ELSE 'revisit' END AS kind,
  1700000000 + (page_id % 97) * 86400 + (page_id % 1009) * 61 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 3600 ELSE page_id % 7 * 90000 - 90000 END AS seconds,
  concat('Date: ', CAST(page_id + k AS STRING), chr(10),
    CASE WHEN page_id % 5 < 3 THEN concat('ETag: ', CASE WHEN k = 1 THEN 'W/' ELSE '' END, '"', substr(md5(concat(CAST(page_id AS STRING), CASE WHEN k = 2 AND page_id % 11 = 0 THEN 'x' ELSE '' END)), 1, 8), '"', chr(10)) ELSE '' END,
    CASE WHEN page_id % 5 > 1 THEN concat('Last-Modified: ', CAST(page_id - page_id % 3 AS STRING), chr(10)) ELSE '' END,
    'Content-Length: ', CAST(CASE k WHEN 0 THEN length(html) ELSE 0 END AS STRING), chr(10),
    'Cache-Control: max-age=', CAST(60 * (k + 1) AS STRING)) AS headers
FROM (SELECT *, {spread} AS k FROM {pages}) AS p"""


def revisit_report(pages: DataFrame) -> DataFrame:
    """Resolution of every revisit record derived from a table of pages."""
    spark = pages.sparkSession
    records = spark.sql(RECORDS_SQL.replace("{spread}", "explode(array(0, 1, 2))"), pages=pages).withColumn("at", F.timestamp_seconds("seconds"))
    found = resolve_revisits(records)
    value = lambda name: F.col("headers")[name]
    return found.select(
        "record_id", "page", "status", "response_id", "response_at",
        value("etag").alias("etag"), value("last-modified").alias("last_modified"),
        value("content-length").alias("content_length"), value("cache-control").alias("cache_control"),
        value("date").alias("date"),
    )


REPORT_SQL = rf"""WITH records AS ({RECORDS_SQL.format(pages="pages", spread="unnest([0, 1, 2])")}),
shaped AS (SELECT *, regexp_matches(trim(url), '^(?i)https?://[^/?#]+') AS http,
  regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?i)https?://([^/?#]+)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(trim(url), '^(?i)https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*[?]([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({'|'.join(VISIT_PARAMETERS)})(=|$)'))) AS query FROM records),
r AS (SELECT record_id, kind, seconds, CASE WHEN http THEN host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END ELSE trim(url) END AS page,
  nullif(regexp_extract(headers, 'ETag: ([^\n]*)', 1), '') AS etag, nullif(regexp_extract(headers, 'Last-Modified: ([^\n]*)', 1), '') AS lm,
  regexp_extract(headers, 'Content-Length: ([^\n]*)', 1) AS cl, regexp_extract(headers, 'Cache-Control: ([^\n]*)', 1) AS cc,
  regexp_extract(headers, 'Date: ([^\n]*)', 1) AS date FROM shaped),
best AS (SELECT page, seconds, max(record_id) AS rid FROM r WHERE kind = 'response' GROUP BY page, seconds),
j AS (SELECT v.*, b.rid FROM (SELECT * FROM r WHERE kind = 'revisit') v ASOF LEFT JOIN best b ON v.page = b.page AND v.seconds > b.seconds),
k AS (SELECT j.*, s.seconds AS s_at, s.etag AS s_etag, s.lm AS s_lm, s.cl AS s_cl,
  CASE WHEN s.etag IS NOT NULL AND j.etag IS NOT NULL THEN regexp_replace(s.etag, '^W/', '') = regexp_replace(j.etag, '^W/', '')
    WHEN s.lm IS NOT NULL AND j.lm IS NOT NULL THEN s.lm = j.lm ELSE true END AND j.rid IS NOT NULL AS agree
  FROM j LEFT JOIN r s ON s.record_id = j.rid)
SELECT record_id, page, CASE WHEN rid IS NULL THEN '{MISSING}' WHEN agree THEN '{RESOLVED}' ELSE '{MISMATCH}' END AS status,
  CASE WHEN agree THEN rid END AS response_id, CASE WHEN agree THEN make_timestamp(s_at * 1000000) END AS response_at,
  CASE WHEN agree THEN s_etag ELSE etag END AS etag, CASE WHEN agree THEN coalesce(lm, s_lm) ELSE lm END AS last_modified,
  CASE WHEN agree THEN s_cl ELSE cl END AS content_length, cc AS cache_control, date FROM k"""
