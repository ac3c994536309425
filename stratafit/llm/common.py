"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.paths import delete, new_folder, own_folders, ship

#: Words of the contracts: runs of anything but ASCII white space. ``bytes.split`` cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratafit_folder = path
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Delete what ``materialise`` has written of frames that nothing reads any more."""
    for df in frames:
        delete(getattr(df, "_stratafit_folder", ""))


@contextmanager
def kept(*names: str) -> Iterator[None]:
    """Folders written inside are deleted at its end, but for those of the given names."""
    before = own_folders()
    yield
    for path in own_folders() - before:
        if not path.rsplit("/", 1)[1].startswith(tuple(f"{n}-" for n in names)):
            delete(path)


#: Rows and bytes of an Arrow batch, which a Python worker holds whole, and bytes of text that are worked on at once.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 5000, 16 << 20, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as rows, as texts may be long. It lowers two settings of the session, and leaves
    them alone where they are lower already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """column in parts of about SLICE_BYTES, of a row at least."""
    at = 0
    ends = np.cumsum(np.maximum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), 1)) if len(column) else np.empty(0)
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield column.slice(at, upto - at)
        at = upto


def release() -> None:
    """At the end of a task: the worker process lives on and serves other operators, so it gives back what it held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def free(df: DataFrame, name: str) -> str:
    """name, which must not be that of a column of df."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already: choose another mark")
    return name


def text_udf(ddl: str | T.DataType, work: Callable[[pa.Array], pa.Array], forget: Callable[[], None] = lambda: None) -> Callable[..., Column]:
    """An Arrow function of a text or binary column, run on parts of bounded size. forget: called at the end of a task."""

    @F.arrow_udf(struct_type(ddl) if isinstance(ddl, str) else ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                done = [work(x) for x in slices(batch)]
                yield pa.concat_arrays(done) if len(done) != 1 else done[0]
        finally:
            forget()
            release()

    return run


class Known:
    """What was worked out for strings before, as Arrow arrays; starts anew when it has grown beyond a limit of bytes."""

    LIMIT = 24 << 20

    def __init__(self, work: Callable[[pa.Array], pa.Array]):
        self.work, self.keys, self.values = work, None, None

    def of(self, unique: pa.Array) -> pa.Array:
        """The values of distinct strings."""
        if self.keys is None or self.keys.nbytes + self.values.nbytes > self.LIMIT:
            self.keys, self.values = unique, self.work(unique)
            return self.values
        at = pc.index_in(unique, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        new = at < 0
        if new.any():
            fresh = unique.filter(pa.array(new))
            at[new] = len(self.keys) + np.arange(len(fresh))
            self.keys, self.values = pa.concat_arrays([self.keys, fresh]), pa.concat_arrays([self.values, self.work(fresh)])
        return self.values.take(pa.array(at))


def parts(texts: pa.Array, separator: str = "\0") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of texts between separators, the number of each part of each text among them, and where each text
    ends; all without a Python object for a part."""
    lists = pc.split_pattern(texts, separator)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _P)
#: Longer words are hashed one by one.
_LONG = 64


@dataclass(frozen=True)
class Words:
    """The words of some texts: bytes of all texts, each text's end in them, and the words' hashes, places and number by text."""

    data: np.ndarray
    text_ends: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def by_text(self) -> list[np.ndarray]:
        """The word hashes of each text."""
        return np.split(self.hashes, self.counts.cumsum()[:-1]) if len(self.counts) else []

    def histograms(self) -> np.ndarray:
        """How often each text has each byte: a row of 256 numbers for each text."""
        return np.array([np.bincount(x, minlength=256) for x in np.split(self.data, self.text_ends[:-1])]).reshape(len(self.counts), 256)

    def counted(self, places: np.ndarray) -> np.ndarray:
        """How many of the places (in the bytes, rising) each text has."""
        return np.diff(np.searchsorted(places, self.text_ends), prepend=0)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the bounds of each; a null has none."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(values or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, made letter by letter for all runs at once."""
    sizes = stops - starts
    order = np.argsort(np.minimum(sizes, 255).astype(np.uint8), kind="stable")[::-1]
    at, h = starts[order], np.full(len(order), _A)
    active = np.searchsorted(-sizes[order].clip(max=255), -np.arange(_LONG), side="left")
    for k, m in enumerate(active):
        if not m:
            break
        h[:m] = (h[:m] ^ _VALUES[data[at[:m] + k]]) * _B
        h[:m] ^= h[:m] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = mixed(h + sizes[order].astype(np.uint64))
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]])
    return out


def string_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text as a whole."""
    data, bounds = bytes_of(texts)
    return _hashes(data, bounds[:-1], bounds[1:])


def spaced(texts: pa.Array) -> pa.Array:
    """texts with a space for each byte of white space (of WORD_PATTERN)."""
    data, bounds = bytes_of(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.where(_SPACES[data], np.uint8(32), data)))


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words (of WORD_PATTERN) of texts, strings or binary, as UTF-8; lower: with A-Z in lower case. A null has none."""
    data, bounds = bytes_of(texts)
    data = _LOWER[data] if lower else data
    first, last = ~_SPACES[data], ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first[1:] &= ~last[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    inside = last.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    stops = np.flatnonzero(last) + 1
    return Words(data, bounds[1:], _hashes(data, starts, stops), starts, stops, np.diff(np.searchsorted(starts, bounds)))


def window_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive word hashes."""
    count = len(w) - width + 1
    if count <= 0:
        return w[:0]
    h = w[:count].copy()
    for i in range(1, width):
        h *= _P
        h += w[i : i + count]
    return mixed(h + np.uint64(width))


def distinct(h: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the lines (cut at \\n) with a word, and how many different ones there are."""
    lines, at, ends = parts(texts.cast(pa.string()).fill_null(""), "\n")
    worded = pc.match_substring_regex(lines, WORD_PATTERN).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    chosen = worded[at]
    text, at = text[chosen], at[chosen]
    different = np.unique(text * max(len(lines), 1) + at) // max(len(lines), 1)
    return np.bincount(text, minlength=len(texts)), np.bincount(different, minlength=len(texts))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the word shingles, A-Z lower-cased; a text with fewer words is one shingle."""
    return [distinct(window_hashes(w, min(width, len(w)))) for w in words_of(texts, lower=True).by_text()]


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


#: Bits of a bitmap (16 MB) at most.
BITS = 1 << 27


def in_bitmap(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """1 for each unsigned token whose bit is set."""
    at = (tokens & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def bitmap(rows: DataFrame, column: str, count: int) -> np.ndarray:
    """The bits of the column's values, or-ed together on the executors: 8 bits or more for each of ``count`` values, up to BITS
    (16 MB) for any number of rows."""
    size = min(BITS, 1 << max(10, (8 * count - 1).bit_length()))
    bit = F.pmod(column, F.lit(size))
    words = rows.select(F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("place"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    del words
    release()  # the driver, too, gives back what it held
    return out.view(np.uint8)


def struct_type(ddl: str) -> T.StructType:
    """A struct of plain fields and arrays of them; unlike Spark's own parser it needs no session, so modules can be imported anywhere."""
    out = T.StructType()
    for part in ddl.split(", "):
        name, kind = part.split()
        out.add(name, T.ArrayType(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind])
    return out
