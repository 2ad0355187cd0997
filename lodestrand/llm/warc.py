"""Not-modified revisits in web archives: each finds the response whose body it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header fields of a not-modified answer that replace the stored response's. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that track a visit and do not choose a page. Fixed values.
TRACKING = r"^(?:utm_[^=]*|gclid|fbclid|ref)(?:=|$)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, the other parameters sorted.

    Scheme, user and fragment are left out: they do not choose another page. An empty
    or null address stays as it is.
    """
    host, path, query = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r":(?:80|443)$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), tail)


def _entries(headers: Column) -> Column:
    """A map as a sorted array with names in lower case; of a repeated name the largest value."""
    lower = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    ordered = F.sort_array(lower)
    return F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i + 1)["key"] != e["key"], F.lit(True)))


def _named(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), 0)["value"]


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's entries, with those of the revisit that a not-modified answer may replace or add."""
    new = F.filter(revisit, lambda e: e["key"].isin(*PERMITTED))
    old = F.filter(response, lambda e: ~F.exists(new, lambda n: n["key"] == e["key"]))
    return F.sort_array(F.concat(old, new))


def resolve_revisits(records: DataFrame, time_slices: int | None = None) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), status (int),
    headers (map of strings); other columns are ignored. A full response has status
    200. Earlier means a smaller ts; of responses at one time the larger record_id counts.

    Returns, for each revisit: record_id, canonical, ts, refers_to, verdict, headers
    (sorted array of key and value). The validators decide: the entity tags must be equal
    (weak comparison), or without a tag in the revisit the times of last modification.
    verdict: 'resolved'; 'mismatch' (the response found has other validators);
    'no_validator' (the revisit has none); 'no_response'. refers_to and the merged
    headers are null unless resolved. The body stays where it is, see ``with_body``.

    An as-of join without a range join: a window within (URL, slice of time), and for
    each URL the last response of each earlier slice, carried in. A URL with a third of
    all records is spread over the slices, each of which has its share of the records.

    Nulls: a null url or ts finds nothing ('no_response'); null headers count as none.
    Repeated rows are resolved alike. An empty table gives no rows.
    """
    n = time_slices or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(records.approxQuantile("ts", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    at = F.size(F.filter(F.lit(bounds or [0.0]), lambda b: b <= F.col("ts"))) if bounds else F.lit(0)
    entries = _entries(F.col("headers"))
    plain = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "status", entries.alias("entries")).withColumn("slice", at)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    rows = plain.where(full | (F.col("kind") == "revisit")).withColumn("full", F.when(full, F.struct("ts", "record_id", "entries")))
    earlier = Window.partitionBy("canonical", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("near", F.max("full").over(earlier)).where("kind = 'revisit'").drop("full")
    lasts = rows.where(full).groupBy("canonical", "slice").agg(F.max("full").alias("full"))
    asked = within.select("canonical", "slice").distinct()
    stops = lasts.unionByName(asked.withColumn("full", F.lit(None).cast(lasts.schema["full"].dataType))).groupBy("canonical", "slice").agg(F.max("full").alias("full"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stops.withColumn("carried", F.max("full").over(before)).select("canonical", "slice", "carried")
    found = within.join(carried, ["canonical", "slice"], "left").withColumn("found", F.when(F.col("ts").isNotNull(), F.coalesce("near", "carried")))
    tag = lambda e: F.regexp_replace(_named(e, "etag"), "^W/", "")
    mine, theirs = F.col("entries"), F.col("found.entries")
    modified = lambda e: _named(e, "last-modified")
    agrees = F.when(tag(mine).isNotNull(), tag(mine) == tag(theirs)).otherwise(modified(mine) == modified(theirs))
    verdict = F.when(F.col("found").isNull(), "no_response").when(tag(mine).isNull() & modified(mine).isNull(), "no_validator").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    told = found.withColumn("verdict", verdict)
    resolved = F.col("verdict") == "resolved"
    return told.select("record_id", "canonical", "ts", F.when(resolved, F.col("found.record_id")).alias("refers_to"), "verdict", F.when(resolved, merged_headers(theirs, mine)).alias("headers"))


def with_body(resolved: DataFrame, records: DataFrame, body_column: str = "body") -> DataFrame:
    """``resolved`` with the body of the record that each row refers to; null where unresolved."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col(body_column))
    return resolved.join(bodies.dropDuplicates(["refers_to"]), "refers_to", "left")


#: Captures of a page lie so many ids before the revisit that is made from it.
REVISIT_AFTER = 500


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages (page_id, url, html): a response of each, and a later revisit.

    page_id is the time of a capture. A page's revisit comes ``REVISIT_AFTER`` later with
    the tag of the page it saw; of every third page with its time of modification alone,
    and of every seventh with a tag that nothing has.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    made = F.concat(F.lit("time "), F.col("page_id").cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    response = F.map_from_arrays(F.array(*map(F.lit, ("Content-Type", "Content-Length", "ETag", "Last-Modified", "Date"))), F.array(F.lit("text/html"), size, tag, day, made))
    date, cookie = F.concat(F.lit("time "), (F.col("page_id") + REVISIT_AFTER).cast("string")), F.concat(F.lit("visit "), F.col("page_id").cast("string"))
    base = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("Date", date), ("Content-Length", F.lit("0")), ("Set-Cookie", cookie), ("Cache-Control", F.lit("max-age=60")))]
    own = F.when(F.col("page_id") % 7 == 0, F.struct(F.lit("ETag").alias("key"), F.lit('"none"').alias("value"))).when(F.col("page_id") % 3 == 0, F.struct(F.lit("Last-Modified").alias("key"), day.alias("value"))).otherwise(F.struct(F.lit("ETag").alias("key"), F.concat(F.lit("W/"), tag).alias("value")))
    visit = F.map_from_entries(F.array(*base, own))
    kinds = F.array(
        F.struct(F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.col("page_id").cast("long").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), response.alias("headers")),
        F.struct(F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), (F.col("page_id") + REVISIT_AFTER).cast("long").alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), visit.alias("headers")),
    )
    return pages.select("page_id", "url", F.explode(kinds).alias("r")).select("page_id", "url", "r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit made from ``pages`` with its verdict, the response it refers to and the merged headers."""
    records = records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    found = resolve_revisits(records)
    told = F.array_join(F.transform("headers", lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select("record_id", "canonical", "ts", "refers_to", "verdict", told.alias("merged_headers"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '^www\.', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(regexp_extract(url, '{_URL}', 2), '/+$', '') AS path,
    list_sort([q for q in string_split(regexp_extract(url, '{_URL}', 3), '&') if q <> '' AND NOT regexp_matches(q, '{TRACKING}')]) AS params
  FROM pages
),
c AS (
  SELECT page_id, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
    '"' || md5(body) || '"' AS tag, 'day ' || (page_id % 97) AS day, strlen(body) AS size
  FROM p
),
v AS (SELECT *, page_id + {REVISIT_AFTER} AS ts, CASE WHEN page_id % 7 = 0 THEN '"none"' WHEN page_id % 3 <> 0 THEN tag END AS asked_tag, CASE WHEN page_id % 7 <> 0 AND page_id % 3 = 0 THEN day END AS asked_day FROM c),
j AS (
  SELECT v.*, r.page_id AS found, r.tag AS found_tag, r.day AS found_day, r.size AS found_size
  FROM v ASOF LEFT JOIN c r ON v.canonical = r.canonical AND v.ts > r.page_id
),
t AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_response' WHEN asked_tag = found_tag OR (asked_tag IS NULL AND asked_day = found_day) THEN 'resolved' ELSE 'mismatch' END AS verdict FROM j
)
SELECT 'v' || page_id AS record_id, canonical, ts, CASE WHEN verdict = 'resolved' THEN 'r' || found END AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || found_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: time ' || ts || chr(10) ||
    'etag: ' || CASE WHEN asked_tag IS NULL THEN found_tag ELSE 'W/' || asked_tag END || chr(10) || 'last-modified: ' || coalesce(asked_day, found_day) END AS merged_headers
FROM t
"""
