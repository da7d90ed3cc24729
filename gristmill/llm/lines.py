"""Line deduplication by how many of a site's pages hold a line, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import FEW_ROWS, Scratch, broadcast_if_few, fresh, named

RATIO, LEAST_PAGES = 0.05, 5
#: Where hosts' lists are too large to broadcast, a host's pages meet its list in this many parts.
SALTS = 64


def with_lists(docs: DataFrame, lists: DataFrame, host_col: str, text_col: str, most: int = FEW_ROWS) -> DataFrame:
    """docs with the columns of their host's row in the saved ``lists`` (host first, then arrays), null where it has none.

    Lists of at most ``most`` lines in all are broadcast. Others are joined by host and salt, so a
    host with any share of the pages is SALTS groups.
    """
    host, *arrays = lists.columns
    sizes = [F.size(F.coalesce(F.col(c), F.array().cast(lists.schema[c].dataType))) for c in arrays]
    entries = lists.agg(F.sum(sum(sizes, F.lit(1)))).first()[0] or 0
    if entries <= most:
        return docs.join(F.broadcast(lists), F.col(host_col) == F.col(host), "left")
    salt, part = fresh(docs.join(lists.limit(0), F.lit(False)), "salt", "part")
    lists = lists.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(text_col), F.lit("salt")), F.lit(SALTS)).cast("int"))
    return dealt.join(lists, (F.col(host_col) == F.col(host)) & (F.col(salt) == F.col(part)), "left").drop(salt, part)


def drop_site_lines(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    dropped_col: str | None = None,
) -> DataFrame:
    """docs whose text is without the lines that more than ``ratio`` of the pages of their host hold.

    A line is what line ends part, compared without spaces and tabs around it; blank lines stay.
    A line must also be on ``least_pages`` pages of the host. Every row counts as a page, and a
    line counts once a page. Line hashes (two of 64 bits) are summed before and after one shuffle,
    so a line or host with any share of the rows costs no task more than others. At most
    (mean lines a page) / ratio lines of a host can exceed the ratio, which bounds the list that
    meets its pages (``with_lists``).

    Null hosts are no site: their lines stay. Null texts stay null, empty ones empty, and texts of
    any length are taken whole. Repeated rows are pages of their own. Empty input gives no rows.
    ``dropped_col`` names a column for the number of dropped lines, which docs must not have yet.
    """
    if dropped_col and dropped_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {dropped_col} already")
    scratch = Scratch(docs.sparkSession, "lines")
    lines, keys, dropped, host = fresh(docs, "site_lines", "line_keys", "boilerplate", "site_host")
    split = F.split(F.col(text_col), "\n", -1)
    slim = docs.where(F.col(host_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(host_col).alias("h"), split.alias("l"))
    pages = docs.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("h")).agg(F.count("*").alias("pages"))
    counted = (
        slim.select("h", F.explode(F.array_distinct(F.transform(F.filter("l", lambda x: bare(x) != ""), key))).alias("k"))
        .groupBy("h", "k")
        .agg(F.count("*").alias("on"))
        .where(F.col("on") >= least_pages)
    )
    pages = broadcast_if_few(scratch.save(pages, "pages"))  # a row a host
    over = (
        counted.join(pages, "h")
        .where(F.col("on") > F.col("pages") * F.lit(ratio))
        .groupBy(F.col("h").alias(host))
        .agg(F.collect_set("k").alias(dropped))
    )
    joined = with_lists(docs, scratch.save(over, "lists"), host_col, text_col).withColumn(lines, F.split(F.col(text_col), "\n", -1))
    kept = F.filter(lines, lambda x: (bare(x) == "") | ~F.array_contains(F.col(dropped), key(x)))
    joined = joined.withColumn(keys, F.when(F.col(dropped).isNull(), F.col(lines)).otherwise(kept))
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(F.array_join(keys, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(named(c)) for c in docs.columns]
    if dropped_col:
        columns.append((F.size(F.coalesce(lines, F.array())) - F.size(F.coalesce(keys, F.array()))).cast("long").alias(dropped_col))
    return joined.select(*columns)


def drop_site_lines_of_pages(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    copied: float = 0.5,
) -> DataFrame:
    """drop_site_lines where copies are no pages of their own, so that no group of copies loses its text.

    Rows of a host with equal texts are one page, for a line as for the host. Of the other pages,
    those with lines over the ratio that are at least the share ``copied`` of their characters are
    taken for near copies: the ones that share their longest such line count as one page. So a
    line that only copies share stays, and near-duplicate removal finds them as they were, while
    a site's header goes from all pages that say something else besides. (Pages that hold hardly
    more than the header keep it, unless other pages of the site are many enough.)

    Row counts find the few lines that can be over the ratio, and only these are counted by page.
    Null hosts and texts, repeats, long texts and empty input as in drop_site_lines.
    """
    scratch = Scratch(docs.sparkSession, "site_lines")
    host, page = F.col(host_col), F.xxhash64(F.col(text_col))
    known = docs.where(host.isNotNull())
    pages = scratch.save(known.groupBy(host.alias("h")).agg(F.countDistinct(page).alias("pages")), "pages")
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col("t"), "\n", -1), lambda x: bare(x) != ""), lambda x: F.struct(key(x).alias("k"), F.length(bare(x)).alias("n"))))
    slim = known.where(F.col(text_col).isNotNull()).select(host.alias("h"), page.alias("page"), F.col(text_col).alias("t"))

    def over(counted: DataFrame, units: DataFrame) -> DataFrame:
        counted = counted.where(F.col("on") >= least_pages).join(broadcast_if_few(units), "h").where(F.col("on") > F.col("pages") * F.lit(ratio))
        return counted.groupBy("h").agg(F.collect_set("k").alias("ks"))

    by_row = slim.select("h", F.explode(lines).alias("x")).groupBy("h", F.col("x.k").alias("k")).agg(F.count("*").alias("on"))
    maybe = scratch.save(over(by_row, pages), "maybe").withColumnRenamed("h", "host")
    held = with_lists(slim, maybe, "h", "t").where("ks is not null").select("h", "page", "ks", lines.alias("x"))
    held = held.select("h", "page", "x", F.filter("x", lambda x: F.array_contains("ks", x["k"])).alias("ks")).where(F.size("ks") > 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    longest = F.array_max(F.transform("ks", lambda x: F.struct(x["n"], x["k"])))
    heavy = total("ks") >= F.lit(copied) * total("x")
    unit = F.when(heavy, F.xxhash64(F.lit("copies"), longest)).otherwise(F.col("page"))
    held = scratch.save(held.select("h", "page", heavy.alias("heavy"), unit.alias("unit"), F.transform("ks", lambda x: x["k"]).alias("ks")), "held")
    copies = held.where("heavy").groupBy("h").agg((F.countDistinct("page") - F.countDistinct("unit")).alias("less"))
    units = pages.join(copies, "h", "left").select("h", (F.col("pages") - F.coalesce("less", F.lit(0))).alias("pages"))
    units = scratch.save(units, "units")
    by_unit = held.select("h", "unit", F.explode("ks").alias("k")).groupBy("h", "k").agg(F.countDistinct("unit").alias("on"))
    lists = scratch.save(over(by_unit, units), "lists")

    names = fresh(docs, "site_host", "site_lines")
    joined = with_lists(docs, lists.toDF(*names), host_col, text_col)
    gone = F.col(names[1])
    text = F.when(gone.isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), gone))
    return joined.select(*(text.alias(c) if c == text_col else F.col(named(c)) for c in docs.columns))


def without(text: Column, dropped: Column) -> Column:
    """A text without the lines whose keys an array holds."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: (bare(x) == "") | ~F.array_contains(dropped, key(x))), "\n")


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def key(line: Column) -> Column:
    return F.struct(F.xxhash64(bare(line)).alias("a"), F.xxhash64(F.lit("line"), bare(line)).alias("b"))


def page_text(html: Column) -> Column:
    """The text of a page with one line for each run between tags; scripts, styles and comments go."""
    text = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "\n")
    for entity, plain in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"[ \t]*\n\s*", "\n"), F.lit("\n"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def pages_without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the text of all pages without the lines of their hosts; texts are taken from the HTML once and written."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), page_text(F.coalesce("html", F.lit(""))).alias("text"))
    pages = Scratch(spark, "pages").save(pages, "texts")
    return drop_site_lines(pages, host_col="host", dropped_col="n_dropped")


SQL = rf"""
with raw as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as h,
         regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') as t
  from pages),
plain as (
  select page_id, nullif(h, '') as host,
         trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'),
              '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g'), chr(10)) as text
  from raw),
lines as (
  select page_id, host, i, line, trim(line, ' ' || chr(9) || chr(13)) as bare
  from (select page_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from plain)),
boiler as (
  select host, bare
  from (select host, bare, count(distinct page_id) as n from lines where host is not null and bare <> '' group by all)
  join (select host, count(*) as pages from plain where host is not null group by all) using (host)
  where n >= {LEAST_PAGES} and n > pages * {RATIO}::double)
select page_id, p.host, coalesce(k.text, '') as text, n_all - coalesce(n, 0) as n_dropped
from (select page_id, host, count(*) as n_all from lines group by all) p
left join (select page_id, string_agg(line, chr(10) order by i) as text, count(*) as n
           from lines where not exists (select 1 from boiler b where b.host = lines.host and b.bare = lines.bare) group by all) k using (page_id)
"""
