"""URL filters: given rules first, then a tree of path templates for each host, judged by labelled purity.

The tree stands on the distinct (host, segments) of the urls with counts of rows and labels, not on the rows. Downwards, level by
level, the segments under one template prefix are counted; where they vary (many distinct ones that seldom repeat) all of them
become a wildcard, else each stays a branch. Segments that are numbers, hexadecimal strings or dates in digits are wildcards from
the start, file extensions apart. Upwards, from the deepest level, sibling branches whose labelled shares don't differ
significantly from what they have together are merged into a wildcard; branches without labels have shown no likeness and stay. A
template's purity is its share of bad labels, smoothed towards its host's, and that towards the share in all; templates at or
above the limit are blocked. Only counts by template are shuffled, and one join gives the templates back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, materialise

#: Wildcards begin with it in the tree. A slash can't be in a segment, so no real one is taken for a wildcard.
WILDCARD = "/*"


@dataclass(frozen=True)
class Settings:
    #: A node's children are variable from so many distinct ones on ...
    distinct: int = 20
    #: ... of which there are this many for each url.
    variety: float = 0.2
    #: Branches merge if their share of bad labels is within so many standard errors of that of all siblings.
    deviations: float = 3.0
    #: Pseudo-labels by which a share is drawn to that of the level above.
    smoothing: float = 10.0
    #: Templates are blocked from this purity on, or from so many times the share of bad labels in all if that is less.
    purity: float = 0.5
    lift: float = 2.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://, or for a null url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://, or for a null url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (verdict, rule) whose host is host or a parent domain of it and whose path begins path, as a struct."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, rule_path = _rule_parts(rule)
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _first_form(segment: Column) -> Column:
    """A wildcard for segments of digits, dates and long hexadecimal strings, with their extension."""
    form = F.regexp_replace(segment, r"^(?:[0-9][0-9_.\-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4,12}){2,4})(\.[A-Za-z]{1,5})?$", r"/*$1")
    return F.when(form.startswith(WILDCARD), form).otherwise(segment)


def segments(path: str) -> Column:
    """The path's segments in their first form, all of them."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _first_form)


def tree(urls: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[int]]:
    """(host, segs, template, merged, n, labels, bad), written: the distinct segments of urls (host, path, bad: 1, 0 or null) with
    their template, an array; merged is the same, before branches are merged. And the levels at which nodes branch: chains of
    single children are passed over, however long. Null and empty paths have no segments. An empty table has an empty tree."""
    rows = urls.select("host", segments("path").alias("segs"), "bad")
    rows = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    rows = materialise(rows.withColumn("template", F.col("segs")), "tree")
    levels, level = [], _next_level(rows, 0)
    while level is not None:
        levels.append(level)
        # What may vary: literal segments. A group's children are counted by their distinct values first.
        here = rows.withColumns({"__up": F.slice("template", 1, level), "__seg": F.get("template", F.lit(level))})
        literal = here.filter(F.col("__seg").isNotNull() & ~F.col("__seg").startswith(WILDCARD))
        children = literal.groupBy("host", "__up", "__seg").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "__up").agg(F.count("*").alias("distinct"), F.sum("n").alias("n"))
        variable = nodes.filter((F.col("distinct") >= settings.distinct) & (F.col("distinct") >= settings.variety * F.col("n"))).select("host", "__up", F.lit(True).alias("__varies"))
        here = here.join(variable, ["host", "__up"], "left")
        wild = F.col("__varies") & F.col("__seg").isNotNull() & ~F.col("__seg").startswith(WILDCARD)
        rows = _replaced(rows, here, "template", wild, level)
        level = _next_level(rows, level + 1)
    return rows.withColumn("merged", F.col("template")), levels


def _next_level(rows: DataFrame, level: int) -> int | None:
    """The first level from the given one on at which some node has more than one child, or a child and an end; None if there is
    none. What the least and the greatest path under a node have in common, all its paths have."""
    nodes = rows.groupBy("host", F.slice("template", 1, level)).agg(F.min("template").alias("low"), F.max("template").alias("high")).filter("low <> high")
    same = F.aggregate(F.arrays_zip("low", "high"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x["low"].eqNullSafe(x["high"])).cast("int")).alias("n"), (a["on"] & x["low"].eqNullSafe(x["high"])).alias("on")))
    return nodes.agg(F.min(same["n"])).first()[0]


def _replaced(rows: DataFrame, here: DataFrame, column: str, wild: Column, level: int) -> DataFrame:
    """rows, written anew, with a wildcard in the column's place level where wild holds."""
    template = F.when(wild, F.transform(column, lambda x, i: F.when(i == level, WILDCARD).otherwise(x))).otherwise(F.col(column))
    out = materialise(here.withColumn(column, template).select(*rows.columns), "tree")
    dropped(rows)
    return out


def merged(rows: DataFrame, levels: Sequence[int], settings: Settings = Settings()) -> DataFrame:
    """The tree with branches merged in its column merged, from the deepest level up: a branch whose bad labels are within ``deviations`` standard errors
    of the share of all siblings together joins the others for which that holds, if there are any."""
    for level in reversed(levels):
        here = rows.withColumns({"__up": F.slice("merged", 1, level), "__seg": F.get("merged", F.lit(level))})
        branches = here.filter("__seg is not null").groupBy("host", "__up", "__seg").agg(F.sum("labels").alias("l"), F.sum("bad").alias("b"))
        parents = branches.groupBy("host", "__up").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        share = F.col("pb") / F.col("pl")
        z = F.abs(F.col("b") - F.col("l") * share) / F.sqrt(F.greatest(F.col("l") * share * (1 - share), F.lit(1e-9)))
        alike = branches.filter("l > 0").join(parents, ["host", "__up"]).filter(z <= settings.deviations).select("host", "__up", "__seg")
        several = alike.groupBy("host", "__up").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
        joins = alike.join(several, ["host", "__up"]).withColumn("__joins", F.lit(True))
        rows = _replaced(rows, here.join(joins, ["host", "__up", "__seg"], "left"), "merged", F.coalesce("__joins", F.lit(False)), level)
    return rows


def judged_templates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, merged, labels, bad, purity, blocked) from rows (host, merged, labels, bad)."""
    groups = rows.groupBy("host", "merged").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    hosts = groups.groupBy("host").agg(F.sum("labels").alias("hl"), F.sum("bad").alias("hb"))
    overall = hosts.agg((F.sum("hb") / F.greatest(F.sum("hl"), F.lit(1))).alias("base"))
    k = F.lit(settings.smoothing)
    base = F.coalesce("base", F.lit(0.0))
    hosts = hosts.join(F.broadcast(overall), F.lit(True)).select("host", base.alias("base"), ((F.col("hb") + k * base) / (F.col("hl") + k)).alias("host_purity"))  # overall: one row
    purity = (F.col("bad") + k * F.col("host_purity")) / (F.col("labels") + k)
    limit = F.when(F.col("base") > 0, F.least(F.lit(settings.purity), settings.lift * F.col("base"))).otherwise(F.lit(settings.purity))
    return groups.join(hosts, "host").select("host", "merged", "labels", "bad", purity.alias("purity"), (purity >= limit).alias("blocked"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", settings: Settings = Settings()) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, merged, purity), a row for each row of pages.

    labels: (key, bad), where key is the number that ends a url's path (the document the page carries) and bad 1 or 0;
    null and repeated keys are left out (of repeated ones the worst label stays). A rule decides where one fits; else the
    template's purity. Null urls and ones without :// have an empty host and path and the template /. Without labels
    nothing is blocked but by rules. Repeated rows are judged each, and weigh as often. An empty table gives an empty result. Other
    columns aren't read. Very long paths count whole.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"))
    key = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/?$", 1)
    known = labels.filter("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    labelled = rows.withColumn("key", F.when(key != "", key.cast("long"))).join(known, "key", "left")
    with kept("verdicts"):
        found = merged(*tree(labelled, settings), settings)
        shown = lambda x: F.when(x.startswith(WILDCARD), F.substring(x, 2, 1 << 30)).otherwise(F.regexp_replace(x, r"^\*", "%2A"))
        path_form = lambda c: F.concat(F.lit("/"), F.array_join(F.transform(c, shown), "/")).alias(c)
        judged_ones = judged_templates(found, settings).drop("labels", "bad")
        verdicts = materialise(found.join(judged_ones, ["host", "merged"]).select("host", "segs", path_form("template"), path_form("merged"), "purity", "blocked"), "verdicts")
    rule = F.col("__rule")
    out = rows.withColumn("segs", segments("path")).join(verdicts, ["host", "segs"], "left").withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(rule["verdict"], F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"), "template", "merged", "purity")
