"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here (wire format, the fields needed); from it the tokenizers pipeline is rebuilt: the
normaliser (precompiled map, extra spaces, marker for spaces, dummy prefix), the unigram model with its scores or the
byte-pair model whose merges are ordered by the scores, and byte fallback. What stands between two places where no piece
of the vocabulary can cross is encoded once for all its occurrences, in multithreaded batches, and checked against the
sentencepiece library when it is first seen.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Known, bounded_batches, free, parts, text_udf

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or bytes for the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        return cls(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece, best piece first; for one piece by its parts' ids."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for p, i in ids.items():
            found += [(-self.pieces[i][1], i, ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(found)]

    def tokenizer(self, first: bool = True):
        """A tokenizers pipeline for whole texts; with first False for chunks that have their first mark or continue others."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unknown = self.pieces[self.unknown][0]
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE(vocab, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"models of kind {self.kind} aren't supported")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Replace(" ", MARK)]
        if self.dummy_prefix and first:
            steps += [normalizers.Prepend(MARK)]
        out.normalizer = normalizers.Sequence(steps)
        end = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix and first else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
        return out

    @property
    def separable(self) -> bool:
        """Whether texts can be encoded in parts, cut before the spaces: no piece goes on past a later mark."""
        return self.kind == BPE and not self.trim and not self.charsmap and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED))


#: Where a text may be cut: before the first of a run of spaces or marks.
_CUT = f"([^ {MARK}])([ {MARK}])"
_CODED = pa.struct([("ids", pa.list_(pa.uint32())), ("parity", pa.bool_()), ("round_trip", pa.bool_())])


class Codec:
    """Encodes batches of texts and decodes batches of ids."""

    _by_path: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = Model.parse(data)
        self.whole, self.part = self.model.tokenizer(), self.model.tokenizer(first=False)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Codec:
        """One for each worker process and file."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def forget(self) -> None:
        self.chunks = Known(self._chunks)

    def _coded(self, ids: list[list[int]], parity: list[bool], round_trip: list[bool]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(ids, _CODED.field(0).type), pa.array(parity, pa.bool_()), pa.array(round_trip, pa.bool_())], fields=list(_CODED))

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """Distinct chunks: ids, whether the sentencepiece library gives the same, and whether they decode to the chunk."""
        texts, led = chunks.to_pylist(), self.model.dummy_prefix
        ids = [x.ids for x in self.part.encode_batch_fast(texts)]
        # The library puts the first mark before a text itself. A mark alone is nothing to it: that goes behind a letter.
        own = self.own.encode([x[1:] if led else x for x in texts])
        for i in [i for i, x in enumerate(texts) if led and len(x) == 1]:
            before = self.own.encode("a")
            behind = self.own.encode("a" + texts[i])
            own[i] = behind[len(before) :] if behind[: len(before)] == before else None
        back = self.part.decode_batch(ids, skip_special_tokens=False)
        return self._coded(ids, [a == b for a, b in zip(ids, own, strict=True)], [a == x.replace(MARK, " ") for a, x in zip(back, texts, strict=True)])

    def _whole(self, texts: list[str]) -> pa.Array:
        ids = [x.ids for x in self.whole.encode_batch_fast(texts)]
        back = self.decode(ids)
        return self._coded(ids, [a == b for a, b in zip(ids, self.own.encode(texts), strict=True)], [a == x.replace(MARK, " ") for a, x in zip(back, texts, strict=True)])

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each text its ids, whether the sentencepiece library gives the same, and whether they decode to the text
        again; a null is an empty text.

        Texts of separable models are coded by chunks: no piece can cross a cut, and a chunk begins with a piece that begins
        with a mark, so neither ids nor decoded bytes depend on what stands before.
        """
        texts = texts.fill_null("")
        if not self.model.separable:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring_regex(texts, r"\x00|\A\z").to_numpy(zero_copy_only=False)
        rest = texts.filter(pa.array(~whole))
        if self.model.dummy_prefix:
            rest = pc.binary_join_element_wise(pa.scalar(" "), rest, pa.scalar(""))
        single = pc.invert(pc.match_substring_regex(rest, f"  |{MARK}"))  # a plain replacement is faster
        cut = pc.replace_with_mask(pc.replace_substring(rest, " ", "\0 "), pc.invert(single), pc.replace_substring_regex(rest.filter(pc.invert(single)), _CUT, r"\1" + "\0" + r"\2"))
        if self.model.dummy_prefix:  # the first space begins a text
            cut = pc.if_else(single, pc.replace_substring(cut, "\0", "", max_replacements=1), cut)
        chunks, at, ends = parts(cut)
        known = self.chunks.of(chunks)
        taken = known.take(pa.array(at))
        ids, parity, back = (taken.field(i) for i in range(3))
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[ends]
        by_chunks = iter(np.split(ids.flatten().to_numpy(zero_copy_only=False), bounds[:-1])) if len(rest) else iter(())
        wrong = lambda x: np.diff(np.concatenate([[0], np.cumsum(~x.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])]) > 0
        at_once = self._whole(texts.filter(pa.array(whole)).to_pylist())
        plain = iter(np.array(x, np.uint32) for x in at_once.field(0).to_pylist())
        same, again = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for out, part, name in ((same, parity, 1), (again, back, 2)):
            out[whole] = at_once.field(name).to_numpy(zero_copy_only=False)
            out[~whole] = ~wrong(part)
        return [next(plain) if w else next(by_chunks) for w in whole], same, again

    def decode(self, ids: list) -> list[str]:
        return self.whole.decode_batch([list(map(int, x)) for x in ids], skip_special_tokens=False)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", mark: str = "__pieces") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: ids (packed little-endian unsigned 32-bit integers), parity and
    round_trip.

    A null text is an empty one, which has no ids. Repeated rows are coded alike; an empty table gives an empty result. A
    column of docs named like the mark raises an error. The model file must stand at that path on every executor.
    """
    return docs.withColumn(free(docs, mark), _coding(model_path, lambda ids: {"ids": pa.array(map(_packed, ids), pa.binary())}, "ids binary")(F.col(text_col)))


def _coding(model_path: str, made: Callable[[list[np.ndarray]], dict[str, pa.Array]], ddl: str) -> Callable[..., Column]:
    def work(texts: pa.Array) -> pa.Array:
        ids, parity, round_trip = Codec.of(model_path).encode(texts)
        columns = made(ids) | {"parity": pa.array(parity), "round_trip": pa.array(round_trip)}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return text_udf(f"{ddl}, parity boolean, round_trip boolean", work, lambda: Codec.of(model_path).forget())


def decoded(rows: DataFrame, model_path: str, ids_col: str, mark: str = "__decoded") -> DataFrame:
    """rows, all columns, with a string ``mark``: the text of the packed ids; null for null. A column of rows named like the
    mark raises an error."""

    def decode(ids: pa.Array) -> pa.Array:
        values = ids.to_pylist()
        out = Codec.of(model_path).decode([np.frombuffer(x or b"", "<u4") for x in values])
        return pa.array([None if v is None else x for v, x in zip(values, out, strict=True)], pa.string())

    return rows.withColumn(free(rows, mark), text_udf(T.StringType(), decode)(F.col(ids_col)))


def through_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_crc32, parity, round_trip), a row for each row of docs, repeated ones and null ids too.

    round_trip: the decoded ids are the text again (marks count as the spaces that they stand for; a null text is empty). An
    empty table gives an empty result; other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    digest = _coding(model_path, lambda ids: {"n_tokens": pa.array(map(len, ids), pa.int64()), "ids_crc32": pa.array([zlib.crc32(_packed(x)) for x in ids], pa.int64())}, "n_tokens long, ids_crc32 long")
    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("__digest")).select(id_col, "__digest.*")
