"""Packing: token sequences filled first-fit decreasing, in randomised groups of documents.

Each document is tokenised once. It is cut into full sequences and a remainder; a remainder of half a sequence or more is
cut once more at the half, as small pieces leave less padding. Full pieces are sequences of their own. The others are
dealt to groups by a hash of their document's place, so that any group is a random draw of documents; in each group the pieces,
longest first, go to the first sequence with room, which a tournament tree over the free room of the sequences finds in
logarithmic time. Only (piece, length) rows are shuffled, no ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, bounded_batches, materialise, parts, release, slices

#: Pieces in a group, in the mean.
GROUP_PIECES = 4000
#: The id after each document's text.
END_ID = 0

#: White space next to white space, at an end, or the separator of ``parts``. Where there is none, the byte-level pre-tokenizer
#: cuts before each space and around each line end, so that words are encoded on their own, once for all their places.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = rf"\A{_SPACE}|{_SPACE}\z|{_SPACE}{_SPACE}|\x00|\A\z"
#: Marks that the pre-tokenizer parts from a letter or digit before them.
_MARKS = ".,;:!?&%$#*|"
_MARKED = r"[\p{L}\p{N}][.,;:!?&%$#*|]+\z"
#: Words are encoded in lines of this many, which is faster than one by one.
_LINE = 2000


class Encoder:
    """ids of texts by a tokenizers file with a byte-level pre-tokenizer."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are tokens of their own wherever they stand, across words too: texts with one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._plain(["\n"])[0]
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and file."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def forget(self) -> None:
        self.words = Known(self._words)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words; marks after a letter or digit are encoded apart."""
        marked = pc.match_substring_regex(words, _MARKED)
        core = pc.if_else(marked, pc.utf8_rtrim(words, _MARKS), words)
        cores, tails = core.dictionary_encode(), self._tails(words, core).dictionary_encode()
        first, last = self._lines(cores.dictionary).take(cores.indices), self._lines(tails.dictionary).take(tails.indices)
        return joined(first, last)

    @staticmethod
    def _tails(words: pa.Array, core: pa.Array) -> pa.Array:
        return pa.array([w[len(c) :] for w, c in zip(words.to_pylist(), core.to_pylist(), strict=True)], pa.string())

    def _lines(self, words: pa.Array) -> pa.Array:
        """The ids of each word, encoded in lines of many words."""
        texts = words.to_pylist()
        plain = [x not in ("", "\n") for x in texts]
        chosen = [x for x, p in zip(texts, plain, strict=True) if p]
        flat, sizes = [], []
        for lot in (chosen[i : i + _LINE] for i in range(0, len(chosen), _LINE)):
            ids = self._plain(["\n".join(lot)])[0]
            ends = np.flatnonzero(ids == self.line_end[0]) if len(self.line_end) == 1 else ids[:0]
            if len(ends) + 1 == len(lot):
                flat.append(np.delete(ids, ends))
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
            else:  # line ends that aren't one token of their own
                each = self._plain(lot)
                flat += each
                sizes.append(np.array([len(x) for x in each]))
        out = np.zeros(len(texts), np.int64)
        out[np.flatnonzero(plain)] = np.concatenate([np.empty(0, np.int64), *sizes])
        values = np.concatenate([np.empty(0, np.uint32), *flat])
        if "\n" in texts:
            at = texts.index("\n")
            out[at] = len(self.line_end)
            values = np.insert(values, int(out[:at].sum()), self.line_end)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], out.cumsum()]), pa.int32()), pa.array(values, pa.uint32()))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; of none for a null."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        for token in self.added:
            whole = whole | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        rest = texts.filter(pa.array(~whole))
        marked = pc.replace_substring(pc.replace_substring(rest, "\n", "\0\n\0"), " ", "\0 ")
        words, at, ends = parts(marked)
        known = self.words.of(words)
        sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False)
        flat = known.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes[at], dtype=np.int64)])[ends]
        by_words = iter(np.split(flat, bounds[:-1])) if len(rest) else iter(())
        plain = iter(self._plain(texts.filter(pa.array(whole)).to_pylist()))
        return [next(plain) if w else next(by_words) for w in whole]


def joined(first: pa.Array, second: pa.Array) -> pa.Array:
    """The lists of both, one after the other in each row."""
    a, b = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, second))
    out = np.empty(int(a.sum() + b.sum()), np.uint32)
    ends = (a + b).cumsum()
    in_second = np.zeros(len(out) + 1, np.int64)
    np.add.at(in_second, ends - b, 1)
    np.add.at(in_second, ends, -1)
    chosen = in_second[:-1].cumsum().astype(bool)
    out[~chosen], out[chosen] = first.flatten().to_numpy(zero_copy_only=False), second.flatten().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    full, rest = divmod(n, capacity)
    half = capacity // 2
    tail = [half, rest - half] if rest > half else [rest]
    return [capacity] * full + [x for x in tail if x]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc, start, length, ids_crc32, doc_tokens), a row for each piece of each row of docs. doc: the row's place, by partition
    and number in it; it tells rows apart, whatever they hold, once the result is written."""

    def cut(batches):
        encoder = Encoder.of(tokenizer)
        end = np.array([END_ID], np.uint32)
        doc = TaskContext.get().partitionId() << 40
        try:
            for b in batches:
                at = 0
                for texts in slices(b.column(1)):
                    out = []
                    for i, ids in zip(b.column(0).slice(at, len(texts)).to_pylist(), encoder.encode(texts), strict=True):
                        ids = np.concatenate([ids, end])
                        start, n = 0, len(ids)
                        for size in cuts(n, capacity):
                            out.append((i, doc, start, size, zlib.crc32(ids[start : start + size]), n))
                            start += size
                        doc += 1
                    at += len(texts)
                    columns = list(zip(*out, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["id", "doc", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            encoder.forget()  # the worker process lives on and serves other operators
            release()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {id_type}, doc long, start long, length long, ids_crc32 long, doc_tokens long")


class TournamentTree:
    """The free room of bins 0, 1, ...; finds the first one with enough of it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Take size from the first bin with that room: the bin, and the room it had."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        best[node] = room - size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there."""
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        found, room = tree.place(int(sizes[i]))
        bins[i], offsets[i] = found, capacity - room
    return bins, offsets


def packed(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    The ids of a document are those of its text and END_ID; a null text is an empty one, and gives END_ID alone. Each id
    lies in exactly one piece. offset is the piece's place in its sequence, gapless from 0. Each row of docs is a document
    of its own, whatever its id (also null), and repeated rows go to different groups. Very long texts are cut like others. Other columns of docs aren't read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    cut = materialise(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    small = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-small.count() // GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc"), F.lit(groups))

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "doc", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(x["length"].to_numpy(), capacity)
        return x.drop(columns="g").assign(sequence_id=bins * groups + int(key[0]), offset=offsets)

    columns = f"{cut.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long"
    mixed = small.withColumn("g", group).groupBy("g").applyInPandas(pack, columns)
    # Negative numbers: sequences of one full piece. Their ids need only differ.
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return mixed.union(full).drop("doc").withColumnRenamed("id", id_col)
