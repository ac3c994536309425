"""Exact quantiles of groups of any size, by rounds of selection: splitters, a histogram between them, and on with the cells that hold
the ranks. No task holds a group's values; only how many groups are still open is known to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.paths import delete, own_folders, written

#: Values of a group that one task may hold.
HELD = 100_000
#: Cells of a round, each between two splitters: with distinct values none is much larger than its share.
CELLS = 32
_POSITION, _BELOW = "__position", "__below"


def _joined(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside their group's bracket, which is open below and closed above; null groups are groups."""
    other = brackets.withColumnsRenamed({k: f"{k}b" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]
    return values.join(other, same).filter("(__low is null or __v > __low) and (__high is null or __v <= __high)").drop(*[f"{k}b" for k in keys])


def _ranks(total: Column) -> tuple[Column, Column]:
    """Whether values up to and with total rows hold the lower, and the upper of the two ranks."""
    return total > F.floor(_POSITION), total > F.ceil(_POSITION)


def _narrowed(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The brackets after one more round."""
    cuts = F.percentile_approx("__v", [c / CELLS for c in range(1, CELLS)], CELLS * 100)
    told = _joined(values, brackets, keys).groupBy(*keys).agg(cuts.alias("__cuts"))
    mine = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    told = written(brackets.alias("b").join(told.alias("c"), mine).select("b.*", "c.__cuts"), "splitters")
    cell = F.size(F.filter("__cuts", lambda x: x < F.col("__v")))
    state = [*keys, "__position", "__below", "__low"]
    cells = _joined(values, told, keys).groupBy(*state, cell.alias("__cell")).agg(F.sum("__n").alias("n"), F.count("*").alias("d"), F.max("__v").alias("top"))
    order = Window.partitionBy(*keys).orderBy("__cell")  # a row for each cell
    cells = cells.withColumns({"total": F.col(_BELOW) + F.sum("n").over(order), "floor": F.coalesce(F.lag("top").over(order), "__low")})
    lower, _ = _ranks(F.col("total"))
    _, before = _ranks(F.col("total") - F.col("n"))
    return cells.filter(lower & ~before).groupBy(*keys, "__position").agg(
        F.min(F.col("total") - F.col("n")).alias("__below"), F.min_by("floor", "__cell").alias("__low"), F.max("top").alias("__high"), F.sum("d").alias("__d")
    )


def exact_quantile(df: DataFrame, column: str, q: float, by: tuple[str, ...] = (), held: int = HELD) -> DataFrame:
    """(by..., value): the quantile q of column in each group, with linear interpolation at (n - 1) q.

    Nulls are left out; a group of nulls has a null value, a null group is a group, NaN counts as infinity. Ties and repeated rows count
    each. Empty tables give no groups, without by one null. Groups of up to held rows are aggregated at once; with larger ones, distinct
    values are counted and all groups go by selection.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile is between 0 and 1")
    v = F.nanvl(F.col(column).cast("double"), F.lit(float("inf")))
    if df.groupBy(*by).agg(F.count(column).alias("__n")).filter(F.col("__n") > held).isEmpty():
        return df.groupBy(*by).agg(F.percentile(v, F.lit(q)).alias("value"))
    before, keys = own_folders(), [f"__key{k}" for k in range(len(by) or 1)]
    groups = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]
    values = written(df.select(*groups, v.alias("__v")).filter("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n")), "values")
    null = F.lit(None).cast("double")
    start = values.groupBy(*keys).agg((F.lit(q) * (F.sum("__n") - 1)).alias("__position"), F.count("*").alias("__d"))
    now = written(start.select(*keys, "__position", F.lit(0).cast("long").alias("__below"), null.alias("__low"), null.alias("__high"), "__d"), "brackets")
    narrow = now.filter(F.col("__d") <= held)
    while not (wide := now.filter(F.col("__d") > held)).isEmpty():
        now = written(_narrowed(values, wide.drop("__d"), keys), "brackets")
        narrow = narrow.unionByName(now.filter(F.col("__d") <= held))
    order = Window.partitionBy(*keys).orderBy("__v")  # held distinct values at most
    rows = _joined(values, narrow, keys).withColumn("__total", F.col(_BELOW) + F.sum("__n").over(order))
    lower, upper = _ranks(F.col("__total"))
    found = rows.groupBy(*keys, "__position").agg(F.min(F.when(lower, F.col("__v"))).alias("a"), F.min(F.when(upper, F.col("__v"))).alias("b"))
    part = F.col(_POSITION) - F.floor(_POSITION)
    value = F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    found = found.select(*keys, value.alias("value"))
    if by:
        all_groups = df.select(*groups).distinct().alias("g")
        found = all_groups.join(found.alias("f"), [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left")
        found = found.select(*[F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], "f.value")
    else:
        found = found.select("value")
    used = own_folders() - before
    out = written(found, "quantiles")
    for path in used:
        delete(path)
    return out
