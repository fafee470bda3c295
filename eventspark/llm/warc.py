"""Resolution of not-modified (304) revisit records against earlier full responses.

For every revisit the latest earlier full response with the same canonical URL is found by an as-of join. Its validators are
checked, and where they agree the record gets that response's payload and its headers, updated by those headers of the
revisit that may be.

The as-of join sorts narrow rows by (URL, time) into ranges, so one URL's captures may lie in many tasks. Inside a range the
latest response is a running maximum; what lies before it comes from a table with one row per URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm.session import stored, tasks

#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"
#: Headers of a 304 that never replace those of the stored response.
FIXED_HEADERS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authorization te trailer transfer-encoding upgrade"
).split()


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and final slashes; host in lower case, parameters
    sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(bare, r"\?.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(place, "^[^/]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(bare, r"\?(.*)$", 1)), f"&({TRACKING})=[^&]*", "")
    query = F.array_join(F.array_sort(F.split(F.substring(query, 2, 1 << 30), "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(name: str) -> Column:
    return F.element_at("headers", F.lit(name))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_before(records: DataFrame) -> DataFrame:
    """``records (record_id, key, ts, full, ..)`` -> ``record_id, original``: the id of the latest full record of the key with
    an earlier ``ts`` (of equal times the greatest id), for those that are not full. Null keys and times have none."""
    n = tasks(records.sparkSession)
    rows = records.select("record_id", "key", "ts", "full").filter("key is not null and ts is not null")
    ranged = rows.repartitionByRange(n, "key", "ts", "full", "record_id").withColumn("slice", F.spark_partition_id())
    ranged = stored(ranged)
    mark = F.when(F.col("full"), F.struct("ts", "record_id"))
    # at one time, records that are not full come first: they do not see a full one of the same time
    inside = W.partitionBy("key", "slice").orderBy("ts", "full", "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per_slice = ranged.groupBy("key", "slice").agg(F.max(mark).alias("last"))
    carried = per_slice.select("key", "slice", F.max("last").over(before).alias("carried"))
    local = ranged.withColumn("seen", F.max(mark).over(inside)).filter(~F.col("full"))
    joined = local.join(carried, ["key", "slice"])
    return joined.select("record_id", F.coalesce("seen", "carried")["record_id"].alias("original"))


def resolve(records: DataFrame) -> DataFrame:
    """``records (record_id, url, ts, kind, headers, payload, ..)`` -> a row per revisit:
    ``record_id, state, original_id, headers, payload``.

    ``kind`` is ``response`` or ``revisit``; header names are in lower case. States: ``resolved``; ``changed`` (the validators
    differ); ``no_validator`` (the revisit has neither etag nor last-modified); ``no_original`` (no earlier response, or no
    URL or time). Only a resolved record has headers and payload. An etag, compared weakly, counts before last-modified. Null
    headers are none; of repeated rows each is resolved. record_id has to identify responses; should one repeat, the least
    payload counts. Other columns are ignored. An empty table gives no rows.
    """
    none = F.create_map().cast("map<string,string>")
    records = records.select(
        F.col("record_id").cast("long"),
        canonical_url(F.col("url").cast("string")).alias("key"),
        F.col("ts").cast("long"),
        F.coalesce(F.col("kind") == "response", F.lit(False)).alias("full"),
        (F.col("kind") == "revisit").alias("revisit"),
        F.coalesce(F.col("headers"), none).alias("headers"),
        F.col("payload").cast("string"),
    )
    revisits = records.filter("revisit").select("record_id", "headers")
    pointers = latest_before(records.filter("full or revisit")).filter("original is not null").distinct()
    pointed = revisits.join(pointers, "record_id", "left")
    wanted = records.filter("full").groupBy(F.col("record_id").alias("original"))
    wanted = wanted.agg(F.min(F.struct("payload", F.array_sort(F.map_entries("headers")).alias("h"))).alias("of"))
    full = pointed.join(wanted, "original", "left").withColumn("stored", F.map_from_entries("of.h"))
    old = lambda name: F.element_at("stored", F.lit(name))
    state = (
        F.when(F.col("original").isNull(), "no_original")
        .when(_header("etag").isNotNull(), F.when(_weak(_header("etag")) == _weak(old("etag")), "resolved").otherwise("changed"))
        .when(
            _header("last-modified").isNotNull(),
            F.when(_header("last-modified") == old("last-modified"), "resolved").otherwise("changed"),
        )
        .otherwise("no_validator")
    )
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(FIXED_HEADERS))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k))
    judged = full.withColumn("state", state)
    ok = F.col("state") == "resolved"
    return judged.select(
        "record_id",
        "state",
        F.when(ok, F.col("original")).alias("original_id"),
        F.when(ok, F.map_concat(kept, fresh)).alias("headers"),
        F.when(ok, F.col("of.payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: a full response of every page, and a later (for some an earlier) revisit that
    names the validators of that response, or none."""
    base = F.col("page_id") * 4
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    when = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    head = lambda *pairs: F.map_from_arrays(
        F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v if isinstance(v, Column) else F.lit(v) for _, v in pairs])
    )
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        base.alias("ts"),
        F.lit("response").alias("kind"),
        head(
            ("content-type", "text/html"),
            ("content-length", F.length("html").cast("string")),
            ("etag", tag),
            ("last-modified", when),
            ("cache-control", "max-age=60"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    turn = F.col("page_id") % 10
    validators = (
        F.when(turn == 0, head(("date", "later"), ("content-length", "0")))
        .when(turn < 4, head(("date", "later"), ("last-modified", when), ("cache-control", "no-cache")))
        .otherwise(head(("date", "later"), ("etag", F.concat(F.lit("W/"), tag)), ("content-length", "0")))
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat(F.col("url"), F.lit("#again")).alias("url"),
        (base + F.when(turn == 9, F.lit(-2)).otherwise(F.col("page_id") * 7919 % 400_000 + 1)).alias("ts"),
        F.lit("revisit").alias("kind"),
        validators.alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


SQL = rf"""
with bare as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages),
parts as (
  select page_id, html, regexp_replace(b, '\?.*$', '') as place,
    regexp_replace('&' || regexp_extract(b, '\?(.*)$', 1), '&({TRACKING})=[^&]*', '', 'g') as q from bare),
keyed as (
  select page_id, html, array_to_string(list_sort(string_split(substr(q, 2), '&')), '&') as params,
    regexp_replace(lower(regexp_extract(place, '^[^/]*')), '^www\.|:(80|443)$', '', 'g')
      || regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '') as host_path from parts),
pages_ as (
  select page_id, html, host_path || case when params <> '' then '?' || params else '' end as key,
    '"' || substr(md5(html), 1, 16) || '"' as tag, 'day ' || (page_id % 1000) as day, page_id * 4 as ts,
    page_id * 4 + case when page_id % 10 = 9 then -2 else page_id * 7919 % 400000 + 1 end as later from keyed),
found as (
  select r.*, s.page_id as o, s.tag as o_tag, s.day as o_day, s.html as o_html
  from pages_ r asof left join pages_ s on r.key = s.key and r.later > s.ts),
judged as (
  select *, case when o is null then 'no_original' when page_id % 10 = 0 then 'no_validator'
    when page_id % 10 < 4 then case when day = o_day then 'resolved' else 'changed' end
    when tag = o_tag then 'resolved' else 'changed' end as state from found)
select page_id * 2 + 1 as record_id, state, case when state = 'resolved' then o * 2 end as original_id,
  case when state = 'resolved' then
    'cache-control: ' || case when page_id % 10 < 4 then 'no-cache' else 'max-age=60' end
    || chr(10) || 'content-length: ' || length(o_html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: later'
    || chr(10) || 'etag: ' || case when page_id % 10 < 4 then o_tag else 'W/' || tag end
    || chr(10) || 'last-modified: ' || o_day end as headers,
  case when state = 'resolved' then length(o_html) end as payload_chars,
  case when state = 'resolved' then md5(o_html) end as payload_md5
from judged"""


def digests(resolved: DataFrame) -> DataFrame:
    """Headers as sorted lines, payload as length and digest."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(
        "record_id",
        "state",
        "original_id",
        F.array_join(lines, "\n").alias("headers"),
        F.length("payload").cast("long").alias("payload_chars"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )
