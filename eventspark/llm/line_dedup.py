"""Removal of lines that are boilerplate of their site.

A line's frequency is the number of pages of a host that contain it, divided by the host's pages. Lines above the ratio
are dropped from all pages of the host. Only hashes of pages and lines are shuffled to count them. The lines to drop, at
most ``BROADCAST`` of them, go to where the texts are, so that texts stay in place; if there are more, the numbers of a
text's lines to drop are found by joins on (host, line) and brought to the texts by (host, digest of the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.joins import join_unique
from eventspark.llm.session import fresh, stored

RATIO, MIN_PAGES = 0.02, 5
SPACE = " \t\r\x0b\x0c"
#: Lines to drop that are broadcast at most, and buckets in which the lines of a host are looked up.
BROADCAST, BUCKETS = 200_000, 64


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def _hashed(body: Column) -> Column:
    """The hash of every line in order, null for a blank one."""
    return F.transform(_lines(body), lambda x: F.when(_bare(x) != "", F.xxhash64(_bare(x))))


def frequent_lines(
    pages: DataFrame, host: str, body: Column, ratio: float, min_pages: int, copies: DataFrame | None, doc_id: str
) -> DataFrame:
    """``(host, line)``, the hashes of the lines to drop."""
    hashes = F.array_distinct(F.filter(_hashed(body), lambda h: h.isNotNull())).alias("lines")
    own_id = [] if copies is None else [F.col(doc_id).alias("id")]
    narrow = pages.select(F.col(host).alias("host"), F.xxhash64(body).alias("page"), hashes, *own_id)
    if copies is not None:
        of = stored(copies.groupBy(F.col("doc_id").alias("id")).agg(F.min("copy_of").alias("copy_of"), F.count("*").alias("n")))
        narrow = join_unique(narrow, of, "id", "n")
        narrow = stored(narrow.select("host", F.coalesce("copy_of", "page").alias("page"), "lines"))
    seen = narrow.select("host", "page", F.explode("lines").alias("line")).distinct()
    counted = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = narrow.select(F.col("host").alias("of"), "page").distinct().groupBy("of").agg(F.count("*").alias("pages"))
    often = counted.join(totals, F.col("host").eqNullSafe(F.col("of")))
    return stored(often.filter(F.col("n") / F.col("pages") > ratio).select("host", "line"))


def without_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies: DataFrame | None = None,
    doc_id: str = "doc_id",
) -> DataFrame:
    """``pages`` with ``text`` less its host's boilerplate lines, and ``n_lines``, ``n_dropped``; all rows are kept.

    A line counts once per page, without white space at its ends; blank lines are neither counted nor dropped. It is
    dropped if at least ``min_pages`` pages of the host hold it, and more than ``ratio`` of them. Equal texts of a host are
    one page, so that a text is not boilerplate for being copied. With ``copies (doc_id, copy_of)``, rows whose ids have the
    same ``copy_of`` are one page too, and a line of one of them is a line of that page; a row whose id is null or not there
    goes by its text. Pages with a null host are a site of their own. A null text stays null with no lines. Columns already
    named ``n_lines`` or ``n_dropped`` are replaced, all others stay. An empty table gives no rows.
    """
    pages = pages.drop("n_lines", "n_dropped")
    body = F.col(text).cast("string")
    often = frequent_lines(pages, host, body, ratio, min_pages, copies, doc_id)
    of, gone, kept = (fresh(x, pages) for x in ("host", "gone", "kept"))
    if often.count() <= BROADCAST:
        upto = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
        bucket = lambda h: F.pmod(h, F.lit(BUCKETS))
        drops = often.groupBy(F.col("host").alias(of)).agg(F.collect_list("line").alias(gone))
        spread = F.transform(upto, lambda b: F.filter(gone, lambda h: bucket(h) == b))
        joined = pages.join(F.broadcast(drops.withColumn(gone, spread)), F.col(host).eqNullSafe(F.col(of)), "left")
        dropped = lambda h: F.array_contains(F.get(F.col(gone), bucket(h).cast("int")), h)
        marked = F.transform(_hashed(body), lambda h: F.coalesce(dropped(h), F.lit(False)))
    else:
        digest = fresh("digest", pages)
        named = pages.withColumn(digest, F.md5(body.cast("binary")))
        each = named.select(F.col(host).alias("host"), F.col(digest).alias("of"), F.posexplode(_hashed(body)).alias("at", "line"))
        # null hosts meet like any other
        each, often = (x.withColumn("host", F.struct("host")) for x in (each, often))
        found = each.join(often, ["host", "line"], "left_semi").groupBy("host", "of").agg(F.collect_set("at").alias(gone))
        of_text = fresh("of_text", named)
        found = found.select(F.col("host").alias(of), F.col("of").alias(of_text), gone)
        joined = named.join(found, (F.struct(F.col(host)) == F.col(of)) & (F.col(digest) == F.col(of_text)), "left")
        joined = joined.drop(digest, of_text)
        marked = F.transform(_hashed(body), lambda h, i: F.coalesce(F.array_contains(gone, i), F.lit(False)))
    rest = F.filter(F.arrays_zip(_lines(body).alias("line"), marked.alias("drop")), lambda x: ~x["drop"])
    size = lambda c: F.coalesce(F.when(F.col(text).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    out = joined.withColumn(kept, rest["line"])
    out = out.withColumns({"n_lines": size(_lines(body)), "n_dropped": size(_lines(body)) - size(F.col(kept))})
    return out.withColumn(text, F.array_join(kept, "\n")).drop(kept, gone, of)


SQL = rf"""
with pages as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
parts as (select doc_id, source, text, unnest(ls) as line, generate_subscripts(ls, 1) as pos from pages),
bare as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as b from parts),
totals as (select source, count(distinct text) + max(case when text is null then 1 else 0 end) as pages
  from documents group by source),
often as (
  select source, b from (select distinct source, text, b from bare where b <> '') join totals using (source)
  group by source, b, pages having count(*) >= {MIN_PAGES} and count(*) / pages > {RATIO}),
marked as (select m.*, o.b is not null as gone from bare m left join often o on m.source = o.source and m.b = o.b),
joined as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
  from marked group by doc_id)
select d.doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, md5(j.text) as text_md5
from documents d join joined j using (doc_id)"""
