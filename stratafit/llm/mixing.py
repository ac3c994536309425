"""Mixing sources to target weights.

Words are counted by source, in one aggregation. Each source's target is a share by weight of a budget, limited to a multiple of
its size; what a limit takes away goes to the others by weight. The repetition rate of a source is its target over its size:
each document is emitted floor(rate) times, and once more by a Bernoulli draw, seeded by a hash of the document, with the
fraction as its probability. The water level that settles the targets is found by aggregations over the table of sources, of
which five numbers reach the driver each time; sources are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.data import numbered
from .common import WORD_PATTERN, dropped, free, materialise

#: Weights of the sources in their order, repeating; null is the last source.
CYCLE = (3, 1, 2)
#: All that the mix takes, as a multiple of all words, and the most it takes of a source, as a multiple of its words.
SHARE, MOST = 1.5, 2.0
#: Rates of so many sources are broadcast (some 100 bytes each).
FEW_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of WORD_PATTERN; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """sizes (source, ...) with weight: of the cycle, by the source's place in the order of code points, null last."""
    k = F.pmod(F.col("__place") - 1, F.lit(len(cycle))).cast("int")
    placed = numbered(sizes, [F.col("source").isNull(), F.col("source")], "__place")
    return placed.withColumn("weight", F.get(F.array(*[F.lit(float(c)) for c in cycle]), k)).drop("__place")


def source_sizes(counted: DataFrame) -> DataFrame:
    """(source, source_size), written, from (source, size): partial sums first, so a hot source is a row for each task."""
    return materialise(counted.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, weight) with target and rate. Targets add up to share times all sizes, by weight, where limits
    allow: none is over ``most`` times its source's size. Without any weight left the rest stays untaken; a source without words has target 0.

    The level is raised until the sources at their limits stay the same; each round settles at least one more, most often many.
    """
    limit = F.lit(most) * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, level, full = share * (whole["size"] or 0), 0.0, -1
    if whole["weight"]:
        level = budget / whole["weight"]
        while True:
            at = sources.filter(limit <= level * F.col("weight")).agg(F.count("*").alias("n"), F.sum(limit).alias("taken"), F.sum("weight").alias("weight")).first()
            left = whole["weight"] - (at["weight"] or 0.0)
            if at["n"] == full or left <= 0:
                break
            full, level = at["n"], (budget - (at["taken"] or 0.0)) / left
    target = F.least(limit, F.lit(float(level)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return sources.withColumns({"target": target, "rate": rate})


def uniform(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the seed, the document's id as text and its text (a null: the empty one)."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digits = F.md5(F.concat(F.lit(f"{seed}:"), empty(id_col), F.lit(":"), F.md5(empty(text).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def planned(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", mark: str = "__mix") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: size, source_size, target, rate and copies, how often the mix takes the row.

    weights: (source, weight), none negative; sources without have weight 0. None: CYCLE in the order of sources. A null text has no words, a null
    source is a source. Rows with equal id and text draw alike, whatever their places; a null id counts as the empty text. Sources
    without words have rate 0, so that their rows aren't taken. Very long texts are counted whole and taken whole. An empty table gives an empty
    result. A column of docs named like the mark raises an error.
    """
    source = F.col(source_col).cast("string")
    key, about = free(docs, f"{mark}_key"), free(docs, f"{mark}_source")
    sizes = source_sizes(docs.select(source.alias("source"), word_count(F.col(text_col)).alias("size")))
    if weights is None:
        weighted = cyclic_weights(sizes)
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighted = materialise(weighted, "weights")
    rates = targets(weighted, share, most)
    few = weighted.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    rates = rates.select(F.col("source").alias(key), F.struct("source_size", "target", "rate").alias(about))
    joined = docs.join(F.broadcast(rates) if few else rates, source.eqNullSafe(F.col(key)), "left")
    dropped(sizes)
    rate = F.col(about)["rate"]
    extra = uniform(F.col(id_col), F.col(text_col), seed) < rate - F.floor(rate)
    fields = {"size": word_count(F.col(text_col)), **{f: F.col(about)[f] for f in ("source_size", "target", "rate")}, "copies": F.floor(rate) + extra.cast("long")}
    return joined.withColumn(free(docs, mark), F.struct(*[c.alias(f) for f, c in fields.items()])).select(*docs.columns, mark)


def mixed(docs: DataFrame, weights: DataFrame | None = None, mark: str = "__mix", **options: object) -> DataFrame:
    """The mix: each row of docs as often as ``planned`` says, with its columns; one more, ``<mark>_copy``, numbers the copies from 0."""
    copy = free(docs, f"{mark}_copy")
    rows = planned(docs, weights, mark=mark, **options).filter(F.col(mark)["copies"] > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(mark)["copies"] - 1))).select(*docs.columns, copy)


ORACLE_SQL = r"""with counted as (select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sizes as (select source, sum(size) as s from counted group by source),
weighted as (select source, cast(s as double) as s, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as double) as w from sizes),
budget as (select 1.5 * sum(s) as t from weighted),
filled as (select a.source, a.s, a.w, (select sum(least(2 * b.s, 2 * a.s / a.w * b.w)) from weighted b) <= (select t from budget) as is_full from weighted a),
level as (select ((select t from budget) - coalesce(sum(2 * s) filter (is_full), 0)) / sum(w) filter (not is_full) as v from filled),
rates as (select source, s, case when is_full then 2 * s else w * (select v from level) end as target from filled),
drawn as (select c.doc_id, c.size, r.s, r.target, case when r.s > 0 then r.target / r.s else 0 end as rate,
  cast('0x' || substr(md5('mix:' || cast(c.doc_id as varchar) || ':' || md5(c.text)), 1, 13) as bigint) / 4503599627370496.0 as u
  from counted c join rates r on c.source is not distinct from r.source)
select doc_id, cast(size as bigint) as size, cast(s as bigint) as source_size, target,
  cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from drawn"""
