"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A unit is a run of ASCII letters or one other code point. One automaton over bytes, laid down as a table, knows where units and
code points start (continuation bytes of UTF-8 start nothing) and where a sentinel string ends. A first pass runs it over all
texts of a batch and counts the marks that its transitions emit; a second pass finds the bytes of the drawn cuts from them.
The run is data-parallel: states are settled for all bytes at once, by applying the table to the states before until
nothing changes, which takes as many rounds as the longest beginning of a sentinel in the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, free, release, slices, struct_type

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut, and of a hundred that are cut so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: What a transition emits: a unit starts, a code point starts, a sentinel ends.
UNIT, POINT, SENTINEL = 1, 2, 4


@dataclass(frozen=True)
class Automaton:
    """step[state * 256 + byte] is the next state, marks[state * 256 + byte] what the transition emits. State 0: the start, or after a
    byte that is no letter; 1: inside a run of letters; others: after a beginning of a sentinel."""

    step: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, sentinels: Sequence[str]) -> Automaton:
        words = [s.encode() for s in sentinels]
        if not all(words):
            raise ValueError("a sentinel must not be empty")
        begun = sorted({w[:k] for w in words for k in range(1, len(w))}, key=lambda w: (len(w), w))
        state = {w: 2 + k for k, w in enumerate(begun)}
        if len(state) > 253:
            raise ValueError("the sentinels are too long")
        letter = lambda b: chr(b).isascii() and chr(b).isalpha()
        step, marks = np.zeros((2 + len(begun), 256), np.uint8), np.zeros((2 + len(begun), 256), np.uint8)
        for read, s in [(b"", 0), (b"a", 1), *state.items()]:
            for byte in range(256):
                now = (b"" if s < 2 else read) + bytes([byte])
                longest = next((now[k:] for k in range(len(now)) if now[k:] in state), None)
                step[s, byte] = state[longest] if longest else int(letter(byte))
                if not 0x80 <= byte < 0xC0:
                    within = letter(byte) and s > 0 and letter(read[-1])
                    marks[s, byte] = POINT | (0 if within else UNIT)
                marks[s, byte] |= SENTINEL * any(now.endswith(w) for w in words)
        return cls(step.ravel(), marks.ravel())

    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The marks of each byte's transition; the automaton is at its start before each of the bytes ``starts``."""
        before = np.zeros(len(data), np.uint8)
        while len(data):
            after = self.step[(before.astype(np.uint16) << 8) | data]
            settled = np.concatenate([[np.uint8(0)], after[:-1]])
            settled[starts] = 0
            if np.array_equal(settled, before):  # each state follows from the one before it, so this is the run
                break
            before = settled
        return self.marks[(before.astype(np.uint16) << 8) | data]


@dataclass(frozen=True)
class Scan:
    """What the first pass has counted: bytes of all texts, each text's bounds in them, units and code points before each byte's place
    at the bounds, and whether a text contains a sentinel."""

    data: np.ndarray
    bounds: np.ndarray
    unit_starts: np.ndarray
    units: np.ndarray
    points: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, automaton: Automaton) -> Scan:
        data, bounds = bytes_of(texts)
        marks = automaton.run(data, bounds[:-1][np.diff(bounds) > 0])
        starts = np.flatnonzero(marks & UNIT)
        points = np.concatenate([[0], np.cumsum((marks & POINT) > 0)])
        ends = np.flatnonzero(marks & SENTINEL)
        return cls(data, bounds, starts, np.searchsorted(starts, bounds), points, np.diff(np.searchsorted(ends, bounds)) > 0)

    def counts(self) -> np.ndarray:
        """How many units each text has."""
        return np.diff(self.units)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The second pass: the byte at which that many units of each text end."""
        at = self.units[:-1] + units
        inside = np.minimum(at, max(len(self.unit_starts) - 1, 0))
        found = self.unit_starts[inside] if len(self.unit_starts) else np.zeros_like(at)
        return np.where(units < self.counts(), found, self.bounds[1:])


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2 ** 32 from the seed and the id as text: of the hash's first groups of eight digits. A null id counts as the
    empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(texts: pa.Array, h: Sequence[np.ndarray], automaton: Automaton, sentinels: Sequence[str] = SENTINELS, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> pa.Array:
    """A struct of _FIELDS for each text and its draws."""
    scan = Scan.of(texts, automaton)
    n = scan.counts()
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = scan.cut(np.minimum(a, b)), scan.cut(np.maximum(a, b))
    plain = (n == 0) | scan.marked | (h[2] % 100 >= cut_percent)
    first = h[3] % 100 < suffix_first
    prefix_chars = scan.points[low] - scan.points[scan.bounds[:-1]]
    middle_chars = scan.points[high] - scan.points[low]
    p, s, m = (x.encode() for x in sentinels)
    raw, out = scan.data.tobytes(), []
    for start, x, y, end, whole, spm in zip(scan.bounds[:-1].tolist(), low.tolist(), high.tolist(), scan.bounds[1:].tolist(), plain.tolist(), first.tolist(), strict=True):
        if whole:
            out.append(raw[start:end])
        elif spm:
            out.append(b"".join((s, raw[y:end], p, raw[start:x], m, raw[x:y])))
        else:
            out.append(b"".join((p, raw[start:x], s, raw[y:end], m, raw[x:y])))
    form = np.where(plain, "plain", np.where(first, "spm", "psm"))
    counts = [pa.array(c, pa.int64(), mask=plain) for c in (prefix_chars, middle_chars)]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())], [x.split()[0] for x in _FIELDS.split(", ")])


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", sentinels: Sequence[str] = SENTINELS, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT, mark: str = "__fim") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: n units, form (plain, psm or spm), prefix_chars and middle_chars (code points,
    null where plain), and output.

    Cuts and forms are drawn from a hash of the id, so that reruns agree and rows with equal ids draw alike; a null id counts as the
    empty text. A null text counts as an empty one, which stays plain, as do texts that contain a sentinel. Very long texts are read
    whole. Repeated rows are transformed each. An empty table gives an empty result. A column of docs named like the mark raises
    an error.
    """
    if len(sentinels) != 3 or any(a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in sentinels for b in sentinels) or any(a.endswith(a[:k]) for a in sentinels for k in range(1, len(a))):
        raise ValueError("three sentinels, of which none has an end that begins one")
    bounded_batches(docs.sparkSession)
    automaton = Automaton.of(sentinels)

    @F.arrow_udf(struct_type(_FIELDS))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for text, *h in batches:
                done, at, drawn = [], 0, [x.to_numpy(zero_copy_only=False) for x in h]
                for part in slices(text):
                    done.append(rearranged(part, [x[at : at + len(part)] for x in drawn], automaton, sentinels, cut_percent, suffix_first))
                    at += len(part)
                yield pa.concat_arrays(done) if done else pa.array([], struct_arrow())
        finally:
            release()

    return docs.withColumn(free(docs, mark), run(F.col(text_col).cast("string"), *draws(F.col(id_col), seed)))


def struct_arrow() -> pa.DataType:
    return pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _FIELDS.split(", ")])


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from an output and its form, by functions of the JVM: a sentinel's first place is where it was put, as the texts
    between have none."""
    p, s, m = sentinels
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring(x, F.char_length(before(x, mark)) + len(mark) + 1, F.char_length(x))
    rest = after(output, p)  # behind the prefix's sentinel
    psm = F.concat(before(rest, s), after(rest, m), before(after(rest, s), m))
    spm = F.concat(before(rest, m), after(rest, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE_SQL = r"""with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || cast(doc_id as varchar)) as h from documents),
drawn as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
  cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
  cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from hashed),
placed as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
       when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
cut as (select doc_id, text, n, form, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle,
  array_to_string(units[high + 1:n], '') as suffix from placed)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from cut"""
