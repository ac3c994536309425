"""Information over many covariates: weighted sums of outer products, by pairs of blocks of covariates.

Covariates are numbered by their ids and dealt to blocks of BLOCK. A worker turns a batch of sparse vectors into a dense piece for
each pair of blocks that it touches, multiplies, and adds the product to an array for the task and pair; arrays leave a worker when it ends,
or before when it holds too many. They are added up in an aggregation by task and pair. No row is ever exploded into pairs of its
entries, and what is shuffled are arrays, whose number doesn't grow with the rows of a task.

For risk sets the vectors are running sums over falling time. Distinct times are rows with sparse sums; a worker runs through them in
order and keeps the running sum as an array over a pair's covariates. Strata with many times are cut into ranges, each of which begins
with the sums of the later ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import ship

#: Covariates of a block, bytes of arrays that a worker holds, and entries of a dense piece.
BLOCK, HELD, PIECE = 256, 64 << 20, 1 << 21
_OUT = "task int, i long, j long, value double"
_PARTS = "task int, pair int, sums array<double>"


def block_pairs(n: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """Pairs (a, b), a <= b, of the blocks of n covariates."""
    blocks = -(-n // block)
    return [(a, b) for a in range(blocks) for b in range(a, blocks)]


class Sums:
    """Products by task and pair, kept in a worker."""

    def __init__(self):
        self.of: dict[tuple[int, int], np.ndarray] = {}

    def add(self, task: int, pair: int, product: np.ndarray) -> None:
        key = task, pair
        if key in self.of:
            self.of[key] += product
        else:
            self.of[key] = product

    def emitted(self, all_of: bool = False) -> Iterator[pa.RecordBatch]:
        if self.of and (all_of or sum(v.nbytes for v in self.of.values()) > HELD):
            for (task, pair), v in self.of.items():
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([pair], pa.int32()), pa.array([v.ravel()], pa.list_(pa.float64()))], ["task", "pair", "sums"])
            self.of = {}


class Sparse:
    """Lists of (i, x) of a batch: the row and place (among the sorted ids) of each entry."""

    def __init__(self, lists: pa.Array, ids: np.ndarray, fields: Sequence[str] = ("x",)):
        flat = lists.flatten()
        self.rows = len(lists)
        self.row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.place = np.searchsorted(ids, flat.field("i").to_numpy(zero_copy_only=False))
        self.x = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in fields}

    def dense(self, field: str, places: np.ndarray, rows: slice) -> np.ndarray:
        """The rows of the slice, with columns for the given places (rising)."""
        at = np.searchsorted(places, self.place).clip(max=len(places) - 1)
        inside = (places[at] == self.place) & (self.row >= rows.start) & (self.row < rows.stop)
        out = np.zeros((rows.stop - rows.start, len(places)))
        out[self.row[inside] - rows.start, at[inside]] = self.x[field][inside]
        return out


def _pieces(starts: np.ndarray, end: int, width: int) -> Iterator[tuple[int, slice]]:
    """(group, rows): runs of rows between starts, in pieces."""
    most = max(1, PIECE // max(width, 1))
    for g, (a, b) in enumerate(zip(starts, np.append(starts[1:], end), strict=True)):
        for k in range(a, b, most):
            yield g, slice(k, min(k + most, b))


def _added(parts: DataFrame, ids: np.ndarray, block: int) -> DataFrame:
    """(task, i, j, value), i <= j, from the workers' arrays."""
    pairs = block_pairs(len(ids), block)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("sums"):
                one = v.values.to_numpy(zero_copy_only=False)
                total = one.copy() if total is None else total + one
        a, b = pairs[key[1].as_py()]
        left, right = ids[a * block : (a + 1) * block], ids[b * block : (b + 1) * block]
        value = total.reshape(len(left), len(right))
        i, j = np.nonzero(np.triu(value) if a == b else value)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(i), pa.int32()), pa.array(left[i]), pa.array(right[j]), pa.array(value[i, j])], ["task", "i", "j", "value"])

    return parts.groupBy("task", "pair").applyInArrow(add, _OUT)


def weighted_products(rows: DataFrame, weight: Column, covariates: Sequence[int], vector: str = "xs", block: int = BLOCK) -> DataFrame:
    """(task, i, j, value), i <= j: the sums over rows of weight * x_i * x_j, from vectors of (i, x) over covariates. Sums of exactly
    nothing are left out."""
    ship(rows.sparkSession)
    ids = np.array(sorted(covariates), np.int64)
    pairs = block_pairs(len(ids), block)
    of = lambda b: np.arange(b * block, min((b + 1) * block, len(ids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            table = pa.Table.from_batches([b]).sort_by("task")
            task, w = table.column("task").to_numpy(), table.column("w").to_numpy()
            if not len(task):
                continue
            x = Sparse(table.column("xs").combine_chunks(), ids)
            touched = {int(v) for v in np.unique(x.place // block)}
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            for number, (p, q) in enumerate(pairs):
                if p in touched and q in touched:
                    for g, rows_of in _pieces(starts, len(task), len(of(p)) + len(of(q))):
                        left = x.dense("x", of(p), rows_of)
                        right = left if p == q else x.dense("x", of(q), rows_of)
                        sums.add(int(task[starts[g]]), number, (left * w[rows_of, None]).T @ right)
            yield from sums.emitted()
        yield from sums.emitted(all_of=True)

    return _added(rows.select("task", weight.cast("double").alias("w"), F.col(vector).alias("xs")).mapInArrow(work, _PARTS), ids, block)


def risk_set_products(times: DataFrame, covariates: Sequence[int], cuts: Sequence[float], tie: str | None = None, fine_gray: bool = False, block: int = BLOCK) -> DataFrame:
    """(task, i, j, value), i <= j: minus the sums over times of n * mean_i * mean_j.

    times: a row for each task, stratumId, time (and tie), with n events, the sum D over those at risk, cwt, and xs, an array of (i, x, c): the sums over
    the time's rows of e * x, and of e * x / weight of rivals. A mean is the running sum of x from the latest time down, plus, with fine_gray,
    cwt times the running sum of c over earlier times, over D. cuts: times at which ranges end.
    """
    ship(times.sparkSession)
    ids = np.array(sorted(covariates), np.int64)
    pairs = block_pairs(len(ids), block)
    keys = ["task", "stratumId"]
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    rows = times.withColumn("__range", F.size(F.filter(bounds, lambda x: x < F.col("time")))) if cuts else times.withColumn("__range", F.lit(0))
    columns = [*keys, "__range", "time", *([tie] if tie else []), "n", "D", "cwt", "xs"]
    rows = rows.withColumn("xs", F.coalesce("xs", F.array().cast("array<struct<i:bigint,x:double,c:double>>"))).select(*columns)
    if cuts or fine_gray:
        # A row before each range: of x the sums of the later ranges, of c minus those of this range and the earlier ones.
        totals = rows.select(*keys, "__range", F.explode("xs").alias("e")).groupBy(*keys, "__range", F.col("e.i").alias("i")).agg(F.sum("e.x").alias("x"), F.sum("e.c").alias("c"))
        every = rows.groupBy(*keys).agg(F.collect_set("__range").alias("ranges")).select(*keys, F.explode("ranges").alias("__range"))  # as many as cuts
        seen = totals.groupBy(*keys, "i").agg(F.collect_list(F.struct(F.col("__range").alias("r"), "x", "c")).alias("parts"))  # as many as cuts
        zero = F.lit(0.0)
        later = F.aggregate(F.filter("parts", lambda p: p["r"] > F.col("__range")), zero, lambda a, p: a + p["x"])
        before = F.aggregate(F.filter("parts", lambda p: p["r"] <= F.col("__range")), zero, lambda a, p: a - p["c"])
        first = every.join(seen, keys).select(*keys, "__range", F.struct("i", later.alias("x"), before.alias("c")).alias("e")).groupBy(*keys, "__range").agg(F.collect_list("e").alias("xs"))
        first = first.select(*keys, "__range", F.lit(None).cast("double").alias("time"), *([F.lit(None).cast("long").alias(tie)] if tie else []), F.lit(0.0).alias("n"), F.lit(1.0).alias("D"), F.lit(0.0).alias("cwt"), "xs")
        rows = rows.union(first)
    of = lambda b: np.arange(b * block, min((b + 1) * block, len(ids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at, running = Sums(), None, {}
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", *keys, "__range")]
            n, d, cwt = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "D", "cwt"))
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            xs = b.column("xs")
            x = Sparse(xs, ids, ("x", "c"))
            width = 2 * block
            for g, rows_of in _pieces(starts, b.num_rows, width):
                here = tuple(int(k[starts[g]]) for k in key)
                p, q = pairs[here[0]]
                places = of(p) if p == q else np.concatenate([of(p), of(q)])
                if here != at:
                    at, running = here, {f: np.zeros(len(places)) for f in ("x", "c")}
                cumulated = {}
                for f in ("x", "c") if fine_gray else ("x",):
                    cumulated[f] = np.cumsum(x.dense(f, places, rows_of), axis=0) + running[f]
                    running[f] = cumulated[f][-1].copy()
                mean = cumulated["x"] - cwt[rows_of, None] * cumulated["c"] if fine_gray else cumulated["x"]
                some = n[rows_of] > 0
                if some.any():
                    mean = mean[some] / d[rows_of][some, None]
                    left, right = mean[:, : len(of(p))], mean if p == q else mean[:, len(of(p)) :]
                    sums.add(here[1], here[0], -(left * n[rows_of][some, None]).T @ right)
            yield from sums.emitted()
        yield from sums.emitted(all_of=True)

    def placed(a: int, b: int):
        low, high = ([int(ids[of(k)[end]]) for k in (a, b)] for end in (0, -1))
        return lambda e: e["i"].between(low[0], high[0]) | e["i"].between(low[1], high[1])

    if len(pairs) > 1:
        split = F.array(*[F.struct(F.lit(k).alias("pair"), F.filter("xs", placed(a, b)).alias("xs")) for k, (a, b) in enumerate(pairs)])
        rows = rows.withColumn("__split", F.explode(split)).withColumns({"pair": F.col("__split.pair"), "xs": F.col("__split.xs")}).drop("__split")
    else:
        rows = rows.withColumn("pair", F.lit(0))
    together = ["pair", *keys, "__range"]
    order = [*together, F.desc_nulls_first("time"), *([F.asc_nulls_first(tie)] if tie else [])]
    parts = rows.repartition(*together).sortWithinPartitions(*order).mapInArrow(work, _PARTS)
    return _added(parts, ids, block)
