"""N-gram Jaccard join by token-combination prefixes, exact, as connected groups.

Each document is its set of distinct word shingles (64-bit hashes). A set of n shingles that is similar to another at
the threshold shares all but ``slack = n - ceil(threshold * n)`` of them with it. The shingles are put in one global
order: by blocks of their hash range, in a block those found once, then the rare, then the frequent ones. A set's prefix
is extended until

    single shingles in it  +  sum over sub-classes of max(0, frequent shingles of the sub-class in it - 1)  >  slack

and is indexed by its rare shingles and by pairs of frequent shingles of one sub-class: a similar pair then shares at least
one of these signatures, because each missing shingle lowers that sum by one at most. Shingles found once meet nobody and
need no index entry. The frequent shingles are dealt to about slack / 2 sub-classes by hash, so that a set has O(slack)
pairs; as both sides must use the same sub-classes, a set is indexed under its own size class and the next, and similar
sets share one of the two. Frequencies are counted over all documents in the first block of the hash range, which holds
the whole prefix of nearly every set. How shingles are classed is a matter of cost only, never of the result, so the
classes are looked up in bitmaps of fixed size, where hashes may collide.

Large groups of near copies are not expanded into pairs. In a bucket (sets with the same signature) every member is compared
with one pivot, the member with the fewest shingles of its own (the text of which the others are copies, if it is there).
For a member a let diff(a) be the shingles in which it differs from its pivot, those that it lacks and those that it has besides.
Two members differ in |diff(a)| + |diff(b)| - 2 |diff(a) and diff(b)| shingles, and are similar if that is at most
c (|a| + |b|), c = (1 - t) / (1 + t) for the threshold t; with excess(a) = |diff(a)| - c |a|, if they share at least
(excess(a) + excess(b)) / 2 shingles of their diffs. Only pairs in which one isn't similar to the pivot are still in question:

* where the excesses of a pair add up to nothing or less it is similar for certain. Each member is linked to the bucket's member of
  least excess where that is so; all such pairs are connected through it.
* other similar pairs share shingles of their diffs, and meet in second signatures: the pivot with shingles of the prefix of the
  diff. Its length follows from the least excess of the possible partners, which are not much nearer to the pivot. The order of a diff is that of the first signatures, its
  rare shingles first and what the pivot has and a member lacks behind, and last of all those that many members of the pivot have
  in their diffs. Pairs that meet where enough of both diffs lies behind are verified by their diffs. Where a second signature
  brings many together, each is held against one of least excess first, and what is connected then makes no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, bounded_batches, dropped, free, in_bitmap, kept, materialise, mixed, release, shingle_sets, slices

#: A shingle is rare up to this number of documents, and frequent beyond.
RARE_UP_TO = 8
#: How many bits of a bitmap may be set: classes begin at higher frequencies in larger corpora.
LOAD = 1 << 25
#: A shingle is frequent among the diffs of a pivot's members beyond this number of them.
OFTEN_IN_DIFFS = 8
#: Where a sign of the diffs brings more members together, they are linked in stars before they are in pairs.
CROWD = 16
#: Ids of sets that may be broadcast (8 bytes each). Candidate search uses the upper 48 bits of the hashes; the blocks are these shares of their range.
FEW = 100_000
SHIFT, BLOCK = np.uint64(16), int(0.3 * (1 << 48))


def slack(n: int, percent: int) -> int:
    """How many of its n shingles a set may miss in a similar one."""
    return n - (percent * n + 99) // 100


def set_id(h: np.ndarray) -> int | None:
    """Equal sets, equal ids; None for the empty set."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None


def _sub_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(size class, number of sub-classes) under which a set of n shingles is indexed: its own and the next. Sizes of similar
    sets differ by less than one class."""
    ratio = percent / 100 - 0.01
    own = int(np.log(n) / -np.log(ratio))
    return [(k, max(1, int((1 - ratio) / 2 * ratio**-k))) for k in (own, own + 1)]


def _dealt(tokens: np.ndarray, classes: int) -> np.ndarray:
    return mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)


def stored_tokens(h: np.ndarray, percent: int) -> np.ndarray:
    """The sorted 48-bit tokens in as many whole blocks as hold the set's prefix, whatever the tokens' classes."""
    n = len(h)
    tokens = h >> SHIFT
    if n > 1:
        tokens = tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]
        need = slack(n, percent) + 1 + max(g for _, g in _sub_classes(n, percent))
        for end in range(BLOCK, 1 << 48, BLOCK):
            upto = int(np.searchsorted(tokens, np.uint64(end)))
            if upto >= need:
                return tokens[:upto]
    return tokens


def signatures(tokens: np.ndarray, n: int, percent: int, twice: np.ndarray, often: np.ndarray, singles_meet: bool = False) -> np.ndarray:
    """The signatures of a set of n shingles from its stored tokens, see above.

    twice, often: bitmaps of the tokens that are rare or frequent, and that are frequent. singles_meet: whether tokens
    outside ``twice`` may be shared too.
    """
    if not n:
        return tokens
    need = slack(n, percent) + 1
    cls = in_bitmap(twice, tokens) + in_bitmap(often, tokens)
    block = (tokens // np.uint64(BLOCK)).astype(np.int64)
    order = np.lexsort((tokens, cls, block))
    cls, tokens = cls[order], tokens[order]
    out, frequent = [], cls == 2
    for key, classes in _sub_classes(n, percent) if frequent.any() else [(0, 1)]:
        gain = np.ones(len(tokens), bool)
        at = np.flatnonzero(frequent)
        dealt = _dealt(tokens[at], classes)
        gain[at[np.unique(dealt, return_index=True)[1]]] = False
        end = min(int(np.searchsorted(np.cumsum(gain), need)) + 1, len(tokens))
        out.append(tokens[:end][(cls[:end] == 1) | ((cls[:end] == 0) & (singles_meet | (block[order][:end] > 0)))])
        at = at[at < end]
        by = np.argsort(dealt[: len(at)], kind="stable")
        token, cl = tokens[at][by], dealt[: len(at)][by]
        for step in range(1, len(at)):
            same = cl[:-step] == cl[step:]
            if not same.any():
                break
            a, b = token[:-step][same], token[step:][same]
            out.append(mixed(mixed(a + np.uint64(key + 1)) ^ (b * np.uint64(0xD6E8FEB86659FD93))))
    return np.unique(np.concatenate(out))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _described(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    def describe(batches):
        try:
            for b in batches:
                at = 0
                for texts in slices(b.column(1)):
                    sets = shingle_sets(texts, width)
                    columns = [b.column(0).slice(at, len(texts)), pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.int64()), _lists([stored_tokens(h, percent) for h in sets]), texts]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sid", "tokens", "text"])
                    at += len(texts)
        finally:
            release()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(describe, f"id {id_type}, n long, sid long, tokens array<long>, text binary")


def _classes(described: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The bitmaps for ``signatures`` from the number of documents with each token of the first block."""
    tokens = described.select(F.explode("tokens").alias("token")).filter(F.col("token") < BLOCK)
    counted = materialise(tokens.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1"), "tokens")
    sizes = {r["c"]: r["n"] for r in counted.groupBy(F.least("docs", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).collect()}
    above = lambda c: sum(n for k, n in sizes.items() if k >= c)
    least = lambda start: next((c for c in range(start, 1001) if above(c) <= LOAD), 1001)
    low, high = least(2), least(RARE_UP_TO + 1)
    out = *(bitmap(counted.filter(F.col("docs") >= c), "token", above(c)) for c in (low, high)), low > 2
    dropped(counted)
    return out


def _buckets(described: DataFrame, percent: int, shared: Broadcast) -> DataFrame:
    """(bucket, low, high, sid, once), written: sets that share a signature; buckets with the same members are one. once: the
    set's shingles that no other set has, in the first block. shared: what ``_classes`` gives."""

    def signed(batches):
        twice, often, singles_meet = shared.value
        try:
            for b in batches:
                lists = b.column(2)
                flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
                sigs = [signatures(flat[i:j], n, percent, twice, often, singles_meet) for i, j, n in zip(ends[:-1], ends[1:], b.column(1).to_pylist(), strict=True)]
                once = [int(((in_bitmap(twice, flat[i:j]) == 0) & (flat[i:j] < BLOCK)).sum()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(once, pa.int32()), _lists(sigs)], ["sid", "once", "sigs"])
        finally:
            release()

    each = described.filter("sid is not null").select("sid", F.col("n").cast("int"), "tokens").mapInArrow(signed, "sid long, once int, sigs array<long>").select(F.explode("sigs").alias("sig"), "sid", "once")
    postings = materialise(each.groupBy("sig", "sid").agg(F.first("once").alias("once")), "postings")  # equal texts have one
    groups = postings.groupBy("sig").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.sum(F.shiftright(F.xxhash64("sid"), 33)).alias("bucket")).filter("low < high")
    out = materialise(postings.join(groups, "sig").select("bucket", "low", "high", "sid", "once").distinct(), "buckets")
    dropped(postings)
    return out


def _only(texts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of texts whose key is among ids (key, distinct), and perhaps some more. Up to FEW ids are broadcast;
    of more a bitmap is, whose size is bounded. Either way the other texts aren't shuffled."""
    count = ids.count()
    if count <= FEW:
        return texts.join(F.broadcast(ids), key, "left_semi")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(ids, key, count))

    @F.arrow_udf(T.BooleanType())
    def likely(values: pa.Array) -> pa.Array:
        values = values.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(in_bitmap(shared.value, values.view(np.uint64)) == 1)

    return texts.filter(likely(key))


def _texts_of(described: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, text), one row for each member, and perhaps some more. Of equal sets the text of one row is shuffled, and texts stand dealt
    by sid afterwards, so that a join by it doesn't shuffle them a second time."""
    rows = described.select("sid", "row", "text").filter("sid is not null")
    first = rows.groupBy("sid").agg(F.min("row").alias("row")).join(members, "sid", "left_semi").select("row")
    return _only(rows, first, "row").select("sid", "text").dropDuplicates(["sid"])


_COMPARED = T.StructType([T.StructField("o", T.IntegerType()), T.StructField("np", T.IntegerType()), T.StructField("nm", T.IntegerType()), T.StructField("diff", T.ArrayType(T.LongType())), T.StructField("quiet", T.IntegerType())])


def ordered_diff(left: np.ndarray, right: np.ndarray, twice: np.ndarray, often: np.ndarray, singles_meet: bool) -> tuple[np.ndarray, int]:
    """The shingles of right that left lacks, those found once in the corpus first, then the rare, the unknown (outside the first
    block) and the frequent ones; then those of left that right lacks. And how many at the beginning meet nobody."""
    rest, missing = np.setdiff1d(right, left, assume_unique=True), np.setdiff1d(left, right, assume_unique=True)
    tokens = rest >> SHIFT
    rank = np.where(tokens < BLOCK, np.array([0, 1, 3])[in_bitmap(twice, tokens) + in_bitmap(often, tokens)], 2)
    return np.concatenate([rest[np.argsort(rank, kind="stable")], missing]), 0 if singles_meet else int((rank == 0).sum())


def _compared(width: int, shared: Broadcast):
    """Of a pair of texts: the shingles in common, both sizes, and, where they are wanted, the shingles that only one has."""

    @F.arrow_udf(_COMPARED)
    def compared(a: pa.Array, b: pa.Array, wanted: pa.Array) -> pa.Array:
        numbers, diffs, quiets, at = [], [], [], 0
        left = a.dictionary_encode()  # a pivot stands with many members
        pivots = [s for x in slices(left.dictionary) for s in shingle_sets(x, width)]
        for texts in slices(b):
            for p, wide, right in zip(left.indices.slice(at, len(texts)).to_pylist(), wanted.slice(at, len(texts)).to_pylist(), shingle_sets(texts, width), strict=True):
                both = np.sort(np.concatenate([pivots[p], right]), kind="stable")
                numbers.append((int((both[1:] == both[:-1]).sum()), len(pivots[p]), len(right)))
                diff, quiet = ordered_diff(pivots[p], right, *shared.value) if wide else (right[:0], 0)
                diffs.append(diff)
                quiets.append(quiet)
            at += len(texts)
        columns = list(zip(*numbers, strict=True)) or [[]] * 3
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int32()) for c in columns], _lists(diffs), pa.array(quiets, pa.int32())], ["o", "np", "nm", "diff", "quiet"])

    return compared


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: each u has one v, which is no u. Each star is a component then, v its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 or (up = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component), written: the smallest node reachable, for nodes of undirected edges (u, v) of longs.

    Alternates large-star and small-star steps, each one aggregation and one join, until the edges are stars.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")

    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        with_low = lowest(down)
        small = with_low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(with_low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, edges = edges, materialise(small, "stars")
        dropped(before)
        if _stars(edges):
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialise(nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    dropped(edges)
    return out


def _linked(described: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, component) over the set ids that are similar to another set; None if no sets share a signature."""
    shared = described.sparkSession.sparkContext.broadcast(_classes(described))
    buckets = _buckets(described, percent, shared)
    compared = _compared(width, shared)
    key = ["bucket", "low", "high"]
    rows = buckets.join(buckets.groupBy("sid").agg(F.count("*").alias("degree")), "sid")
    pivots = rows.groupBy(*key).agg(F.max(F.struct(-F.col("once"), "degree", "sid"))["sid"].alias("p"), (F.count("*") > 2).alias("wide"))
    pairs = materialise(buckets.select(*key, "sid").join(pivots, key).filter("sid <> p").groupBy("p", F.col("sid").alias("m")).agg(F.max("wide").alias("wide")), "pairs")
    dropped(buckets)
    of = lambda c, name: _texts_of(described, pairs.select(F.col(c).alias("sid")).distinct()).select(F.col("sid").alias(c), F.col("text").alias(name))
    both = pairs.join(of("m", "b"), "m").join(of("p", "a"), "p").withColumn("c", compared("a", "b", "wide"))
    is_link = (100 + percent) * F.col("o") >= percent * (F.col("np") + F.col("nm"))
    done = materialise(both.select(*pairs.columns, "c.*").withColumn("linked", is_link), "compared")
    shared.destroy()
    dropped(pairs)
    if done.isEmpty():
        return None
    links = done.filter("linked").select(F.col("p").alias("u"), F.col("m").alias("v"))
    comp = components(links)
    more = _links_of_members(done, comp, percent)
    if more is None:
        dropped(done)
        return comp
    known = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
    out = components(materialise(known.union(more), "links"))
    dropped(done, comp)
    return out


def _links_of_members(done: DataFrame, comp: DataFrame, percent: int) -> DataFrame | None:
    """(u, v): links of members of one pivot of which one isn't similar to it, of different components; None if there are no such
    members. See the module's beginning."""
    left = done.filter("wide and not linked")
    if left.isEmpty():
        return None
    # In units of 1 / (100 + percent): (100 + percent) |diff| - (100 - percent) |a|.
    excess = ((100 + percent) * F.size("diff").cast("long") - (100 - percent) * F.col("nm")).alias("excess")
    members = done.filter("wide").join(left.select("p").distinct(), "p", "left_semi").join(comp.select(F.col("node").alias("m"), "component"), "m", "left")
    members = materialise(members.select("p", "m", "nm", "linked", "diff", "quiet", F.coalesce("component", "m").alias("component"), excess), "members")
    often = members.select("p", F.explode("diff").alias("sign")).groupBy("p", "sign").agg(F.count("*").alias("n")).filter(F.col("n") > OFTEN_IN_DIFFS)
    often = often.groupBy("p").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "sign"))), lambda x: x["sign"]).alias("often"))  # an eighth of all at most
    least = members.groupBy("p").agg(F.min(F.struct("excess", "m")).alias("low"), F.min(F.when(~F.col("linked"), F.col("excess"))).alias("least_left"), F.min(F.when(F.col("linked"), F.col("excess"))).alias("least_linked"), F.min("component").alias("first"), F.max("component").alias("last"))
    with_least = members.join(least.filter("first <> last"), "p")  # links are missing between components only
    sure = with_least.filter((F.col("excess") + F.col("low.excess") <= 0) & (F.col("m") != F.col("low.m"))).select(F.col("m").alias("u"), F.col("low.m").alias("v"))
    last = F.array_intersect("often", "diff")  # in the order of often
    with_order = with_least.join(often, "p", "left").withColumn("diff", F.when(F.col("often").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "often"), last)))
    rows = materialise(with_order.select(*members.columns, "least_left", "least_linked"), "ordered")  # read many times: plans stay small

    def signs(rows: DataFrame, partner: str) -> DataFrame:
        """(p, m, its component and excess, sign, behind: the shingles behind the sign) of the prefixes for partners with the excess of the
        column partner or more."""
        # Similar sets differ little, so a partner's diff isn't much shorter: 100 |b| <= 100 |a| * 100 / percent bounds its excess from below.
        reach = F.col("excess") - 2 * (100 - percent) * F.floor(100 * F.col("nm").cast("long") / percent)
        need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.greatest(partner, reach)) / (2.0 * (100 + percent))).cast("int"))
        # Quiet shingles, the first ones, meet nobody.
        prefix = F.slice("diff", F.col("quiet") + 1, F.greatest(F.lit(0), F.size("diff") - need + 1 - F.col("quiet")))
        rows = rows.filter(F.col(partner).isNotNull())
        rows = rows.select("p", "m", "component", "excess", (F.size("diff") - F.col("quiet") - 1).alias("behind"), F.posexplode(prefix).alias("at", "sign"))
        return rows.withColumn("behind", F.col("behind") - F.col("at")).drop("at")

    def of_side(x: str, signs: DataFrame) -> DataFrame:
        return signs.select("p", "sign", F.col("m").alias(x), F.col("component").alias(f"c{x}"), F.col("excess").alias(f"e{x}"), F.col("behind").alias(f"l{x}"))

    def meeting(a: DataFrame, b: DataFrame, further: Column) -> DataFrame:
        # With the shingles behind the first one that a similar pair shares there must be as many as it has to share.
        enough = 2 * (100 + percent) * (F.least("la", "lb") + 1) >= F.col("ea") + F.col("eb")
        return of_side("a", a).join(of_side("b", b), ["p", "sign"]).filter((F.col("ca") != F.col("cb")) & further & enough).select("p", "a", "b").distinct()

    side = lambda x: members.select("p", F.col("m").alias(x), F.col("nm").alias(f"n{x}"), F.col("diff").alias(f"d{x}"))
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    similar = (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))

    def links_of(meet: DataFrame) -> DataFrame:
        return meet.join(side("a"), ["p", "a"]).join(side("b"), ["p", "b"]).filter(similar).select(F.col("a").alias("u"), F.col("b").alias("v"))

    each = materialise(signs(rows.filter("not linked"), "least_left"), "signs")
    centres = each.groupBy("p", "sign").agg(F.min(F.struct("excess", "m", "component")).alias("low"), F.count("*").alias("n"))
    if not centres.filter(F.col("n") > CROWD).isEmpty():
        # Stars first: of the members that a sign brings together each is held against that of least excess, and of these against the one
        # with which it shares most signs. A group of similar members is connected so, before pairs across components are made.
        stars = each.join(centres, ["p", "sign"]).filter(F.col("component") != F.col("low.component")).groupBy("p", F.col("m").alias("a"), F.col("low.m").alias("b")).agg(F.count("*").alias("shared"))
        stars = stars.groupBy("p", "a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))
        sure = materialise(sure.union(links_of(stars)), "stars")
        grouped = components(sure.union(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        now = grouped.select(F.col("node").alias("m"), F.col("component").alias("now"))
        placed = lambda df, name: materialise(df.join(now, "m", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), name)
        before, rows, each = (rows, each), placed(rows, "placed"), placed(each, "signs")
        dropped(*before, grouped)
    rest, linked = rows.filter("not linked"), rows.filter("linked")
    meet = meeting(each, each, F.col("a") < F.col("b"))
    meet = meet.union(meeting(signs(rest, "least_linked"), signs(linked, "least_left"), F.lit(True)))
    out = materialise(sure.union(links_of(meet)), "links")
    dropped(members, rows, each, sure)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs.

    Two rows are linked when 100 * |intersection| >= percent * |union| of their sets of distinct ``width``-word shingles
    (A-Z lower-cased; a text with fewer words is one shingle). component_id is the smallest id reachable by links.
    Null and empty texts have the empty set and are linked with nothing: their component is their own id. Repeated rows
    and rows with equal texts or ids are linked by their sets as any others. Null ids are rows like others, but never
    a component's id unless the component has no other. Columns of docs other than the two aren't read. An empty table
    gives an empty result.
    """
    rows = _grouped(docs, id_col, text_col, width, percent)
    lowest = rows.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    out = rows.join(lowest, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, digest, comp) of all rows, written; digest is the hash of the text, comp null without shingles."""
    bounded_batches(docs.sparkSession)
    with kept("grouped"):
        # A number of each row, scrambled for bitmaps; where two should be equal a row more is read.
        described = materialise(_described(docs, id_col, text_col, width, percent).withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "sets")
        comp = _linked(described, width, percent)
        rows = described.select("id", "n", "sid", F.xxhash64("text").alias("digest"))
        if comp is not None:
            rows = rows.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left")
        else:
            rows = rows.withColumn("component", F.lit(None).cast("long"))
        return materialise(rows.select("id", "n", "digest", F.coalesce("component", "sid").alias("comp")), "grouped")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: of each component the row with the smallest id stays.

    An id may stand on several texts: a row is known by its id and text, and of equal ids the text with the least hash stays.
    Of rows alike in both, one stays (which one is undefined where other columns differ). Null ids come after all others. Rows
    without shingles (null, empty and blank texts) are no copies: all of them stay. An empty table gives an empty result. Columns
    named like the two that mark rows here raise an error.
    """
    rows = _grouped(docs, id_col, text_col, width, percent).filter("comp is not null")
    alike = rows.groupBy("comp", "id", "digest").agg(F.count("*").alias("n"))
    first = alike.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "digest")).alias("k"))
    alike = alike.join(first, "comp").select("id", "digest", "n", (F.col("id").eqNullSafe(F.col("k.id")) & (F.col("digest") == F.col("k.digest"))).alias("stays"))
    mark = free(docs, "__digest")
    known = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("binary")))
    same = lambda x: known[id_col].eqNullSafe(x["id"]) & (known[mark] == x["digest"])
    others, repeated = alike.filter("not stays or n > 1"), alike.filter("stays and n > 1")
    single = known.join(others, same(others), "left_anti")  # with the rows without shingles: their digests are of no other
    return single.unionByName(known.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, mark])).drop(mark)
