"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if it stands on more than ``ratio`` of the host's pages, and on ``min_pages`` at least; pages of a
host with equal texts count once, so that being copied makes no line boilerplate. Pages are counted by (host, line hash) with
partial aggregation, so a large host or a frequent line is no single task's. A host has at most (mean lines of its pages) / ratio
boilerplate lines, so they join back as one short array for each host. The arrays are written first and counted: up to FEW hashes
they are broadcast, so that no text is shuffled; beyond that the join is an ordinary one, whose skewed hosts adaptive execution
splits.

With ``near_copies`` a line counts once for each family of near copies, as do pages in the host's total: a text that has been
copied with small changes is no boilerplate either, whatever its share of the host. Families are those of pages with a line over
the ratio; the smallest hashes of their word shingles, one for each class of a hash, are compared with those of one page for each
bucket of equal runs of them, and pages alike are connected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, dropped, free, materialise
from .jaccard_join import components

#: The share decides at every size; only lines of one or two pages never are boilerplate.
RATIO = 0.05
MIN_PAGES = 3
#: Hashes that are broadcast at most (8 bytes each), and hosts.
FEW = 1_000_000
#: Words of a shingle, classes of shingle hashes, how many classes make a bucket, and the share of equal smallest hashes of near copies
#: (of sets that are similar at 0.8 all but a few in a hundred reach it).
WIDTH, CLASSES, RUN, ALIKE = 5, 64, 4, 0.7
_SPACE = WORD_PATTERN.replace("^", "", 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\v\f\r", "    ")) == ""


def _page() -> Column:
    return F.xxhash64("host", "text")


def _pages(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(host, page, hashes), a row for each different text of a host: its distinct lines' hashes, without blank ones."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).filter("text is not null")
    lines = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: ~_blank(x))
    return pages.select("host", _page().alias("page"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes")).dropDuplicates(["host", "page"])


def _frequent(counted: DataFrame, totals: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """Of counted (host, hash, n) the lines over the ratio of totals (host, pages)."""
    known = counted.filter(F.col("n") >= min_pages).join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return known.filter(F.col("n") > ratio * F.col("pages")).select("host", "hash")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def families(docs: DataFrame, lines: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(page, family): pages with one of lines (host, hash) that are near copies of another page of their host."""
    of_host = lines.groupBy("host").agg(F.collect_list("hash").alias("known")).withColumnRenamed("host", "h")
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(_small(of_host), F.col("host").eqNullSafe(F.col("h"))).filter(F.arrays_overlap(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)), "known"))
    words = rows.select(_page().alias("page"), "host", F.split("text", _SPACE).alias("w"))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WIDTH + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WIDTH)))
    least = words.select("page", "host", F.explode(shingles).alias("s")).groupBy("host", "page", F.pmod("s", F.lit(CLASSES)).cast("int").alias("class")).agg(F.min("s").alias("s"))
    entries = F.map_from_entries(F.collect_list(F.struct("class", "s")))  # CLASSES at most
    sketches = least.groupBy("host", "page").agg(F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.try_element_at(entries, k)).alias("sketch"))
    sketches = materialise(sketches, "sketches")
    runs = F.array(*[F.when(F.exists(F.slice("sketch", k + 1, RUN), lambda x: x.isNotNull()), F.xxhash64("host", F.lit(k), F.slice("sketch", k + 1, RUN))) for k in range(0, CLASSES, RUN)])
    buckets = sketches.select("page", F.explode(runs).alias("bucket")).filter("bucket is not null")
    first = buckets.groupBy("bucket").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = buckets.join(first, "bucket").filter("page <> first").select("page", "first").distinct()
    one, other = sketches.select("page", F.col("sketch").alias("a")), sketches.select(F.col("page").alias("first"), F.col("sketch").alias("b"))
    either = F.filter(F.arrays_zip("a", "b"), lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    alike = F.size(F.filter(either, lambda x: x["a"].eqNullSafe(x["b"]))) >= ALIKE * F.size(either)
    edges = pairs.join(one, "page").join(other, "first").filter(alike).select(F.col("page").alias("u"), F.col("first").alias("v"))
    out = components(edges).select(F.col("node").alias("page"), F.col("component").alias("family"))
    dropped(sketches)
    return out


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, near_copies: bool = False) -> DataFrame:
    """(host, lines): for each host that has any, the sorted 64-bit hashes of its boilerplate lines. Blank lines never are, and null
    texts are no pages."""
    pages = _pages(docs, text_col, host_col)
    pages = materialise(pages, "pages") if near_copies else pages
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counted = pages.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    known = _frequent(counted, totals, ratio, min_pages)
    if near_copies:
        known = materialise(known, "frequent")
        family = materialise(pages.select("host", "page").join(families(docs, known, text_col, host_col), "page", "left").select("host", "page", F.coalesce("family", "page").alias("family")), "families")
        totals = family.groupBy("host").agg(F.count_distinct("family").alias("pages"))
        listed = _small(known.select(F.col("host").alias("h"), F.col("hash").alias("k")))
        again = pages.select("host", "page", F.explode("hashes").alias("hash")).join(listed, (F.col("hash") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")), "left_semi")
        counted = again.join(family.select("page", "family"), "page").groupBy("host", "hash").agg(F.count_distinct("family").alias("n"))
        known = _frequent(counted, totals, ratio, min_pages)
    return known.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("lines"))


def deduplicated(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, mark: str = "__lines", near_copies: bool = False) -> DataFrame:
    """docs, all rows and columns, with boilerplate lines taken out of the text, and a struct ``mark``: n_lines, n_dropped.

    near_copies: a line counts once for each family of near copies of a host, and each family as one page. Lines end at \\n; blank ones are neither counted as boilerplate nor dropped. All places of a boilerplate line go; a page
    counts once for a line, however often it repeats it, and repeated texts of a host are one page. Null texts stay null with 0
    lines; empty ones stay empty, with one blank line. Very long texts are read whole. Null hosts are one host. An empty table gives
    an empty result. A column of docs named like the mark raises an error.
    """
    host, known_col, kept_col = (free(docs, f"{mark}_{x}") for x in ("host", "known", "kept"))
    found = materialise(boilerplate(docs, text_col, host_col, ratio, min_pages, near_copies), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0))).first()[0]
    found = found.select(F.col("host").alias(host), F.col("lines").alias(known_col))
    joined = docs.join(F.broadcast(found) if size <= FEW else found, F.col(host_col).eqNullSafe(F.col(host)), "left")
    all_lines, known = _lines(F.col(text_col)), F.col(known_col)
    here = F.array_intersect(F.transform(all_lines, lambda x: F.xxhash64(x)), known)  # a page's own few, by a hash table
    left_over = F.when(known.isNull() | (F.size(here) == 0), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains(here, F.xxhash64(x)) | _blank(x)))
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    rows = joined.withColumn(kept_col, left_over)
    size = F.when(F.col(text_col).isNull(), 0).otherwise(n(all_lines)).cast("long")
    left = F.when(F.col(text_col).isNull(), 0).otherwise(n(F.col(kept_col))).cast("long")
    rows = rows.withColumn(free(docs, mark), F.struct(size.alias("n_lines"), (size - left).alias("n_dropped")))
    text = F.when(F.col(mark)["n_dropped"] == 0, F.col(text_col)).otherwise(F.array_join(kept_col, "\n"))
    return rows.withColumn(text_col, text).select(*docs.columns, mark)


def oracle_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The digest of ``deduplicated`` over documents, in DuckDB's SQL."""
    blank = r"trim(translate({0}, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') = ''"
    return f"""
with cut as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
pages as (select distinct source, text, ls from cut where text is not null),
totals as (select source, count(*) as pages from pages group by source),
each as (select source, unnest(list_distinct(ls)) as line from pages),
known as (select e.source, e.line from each e join totals t on e.source is not distinct from t.source
          where not ({blank.format('e.line')}) group by e.source, e.line, t.pages having count(*) >= {min_pages} and count(*) > {ratio} * t.pages),
sets as (select source, list(line) as lines from known group by source),
kept as (select c.doc_id, c.text, coalesce(len(c.ls), 0) as n_lines,
         case when s.lines is null then c.ls else list_filter(c.ls, lambda x: not list_contains(s.lines, x)) end as ks
         from cut c left join sets s on c.source is not distinct from s.source)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_lines - coalesce(len(ks), 0) as bigint) as n_dropped,
       md5(case when n_lines = coalesce(len(ks), 0) then text else array_to_string(ks, chr(10)) end) as text_md5 from kept"""
