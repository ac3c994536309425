"""Toxicity: a linear-chain conditional random field over words, tagging toxic spans.

Training: documents are labelled, words aren't. A document is toxic if at least one of its words is, so the field (two tags, weights of
hashed features of the word and of its neighbours, transitions) is fitted to the likelihood of the documents' labels: of a clean
document that of the path without toxic tags, of a toxic one that of all other paths. Its gradient is the difference of
forward-backward sums over the paths that the label allows and over all paths. That likelihood has many modes, so the fit begins
at tags of words: among the features of words (the word, its beginnings of 4 and 5 letters) those are chosen, one after another, that
stand in the most toxic documents not yet explained and in next to no others, and the field is first fitted to the words with a
chosen feature. Features of fewer than SUPPORT documents say nothing.
Scoring: the marginal probability of the toxic tag of each word, and of a document the probability that any of its words has it, that
is one less that of the path without toxic tags; maximal runs of words with a marginal of a half or more are its offending spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Known, bounded_batches, distinct, free, mixed, parts, spaced, string_hashes, text_udf

#: At most so many documents of each label are learned from (those with the least hashes of their ids), of so many words in all.
SAMPLE, SAMPLE_WORDS = 1500, 800_000
#: They are cut to sequences of so many words.
SEQUENCE = 400
#: Weights are hashed to so many buckets.
BUCKETS = 1 << 18
#: Toxic documents that a feature must explain, and the share of other documents that may have it.
SUPPORT, LEAK = 3, 0.002
STEPS = 60
#: Steps on the likelihood of the documents' labels, after those on tags.
LABEL_STEPS = 40
#: Ridge penalties, for each word of the sample: of weights, and of those of neighbours.
PENALTY, NEAR_PENALTY = 1e-6, 1e-4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z"
#: Salts of the kinds of features: the word, its beginnings, and the word as the one before and after.
_KINDS = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 6)]


def feature_hashes(words: pa.Array) -> np.ndarray:
    """The features of distinct words, a row each: itself without marks at its ends and in lower case, its beginnings of 4 and 5
    letters (0 where the word is no longer)."""
    bare = pc.utf8_lower(pc.replace_substring_regex(words, _EDGE, ""))
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    out = [mixed(string_hashes(bare) + _KINDS[0])]
    for kind, n in ((1, 4), (2, 5)):
        out.append(np.where(size > n, mixed(string_hashes(pc.utf8_slice_codeunits(bare, 0, n)) + _KINDS[kind]), np.uint64(0)))
    return np.column_stack(out)


def neighbour_hashes(features: np.ndarray) -> np.ndarray:
    """The features of words as the ones before and after another, a row each."""
    return np.column_stack([mixed(features[:, 0] + k) for k in _KINDS[3:]])


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word of each text among them, and how many words each text has."""
    words, at, ends = parts(spaced(texts), " ")
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[at]
    counts = np.diff(np.concatenate([[0], real.cumsum()])[np.concatenate([[0], ends])])
    return words, at[real], counts


def _by_time(lengths: np.ndarray) -> list[np.ndarray]:
    """For each time t the sequences, longest first, that have a word there; as counts into the sorted order."""
    longest = int(lengths.max()) if len(lengths) else 0
    return np.searchsorted(np.sort(-lengths), -np.arange(1, longest + 1), side="right")


@dataclass(frozen=True)
class Chain:
    """log-odds form: emission of the toxic tag against the other; log weights of the moves between tags."""

    #: Moves other-other, other-toxic, toxic-other, toxic-toxic.
    moves: tuple[float, float, float, float]

    def marginals(self, emission: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """The toxic marginal of each word of sequences laid end to end, and log Z of each sequence that isn't empty; with pairs, between
        them, the places of the words after a sequence's first, and the expected moves there, a column each."""
        oo, ot, to, tt = np.exp(self.moves)
        e = np.exp(np.clip(emission, -30, 30))
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        begin, active = starts[order], _by_time(lengths)
        forward, backward = np.empty_like(e), np.ones_like(e)  # weights toxic : other
        scale = np.ones_like(e)
        for t, k in enumerate(active):
            at = begin[:k] + t
            if t == 0:
                forward[at] = e[at]
            else:
                r = forward[at - 1]
                low = oo + to * r
                forward[at] = e[at] * (ot + tt * r) / low
                scale[at] = low
        ends = begin + lengths[order]
        for t, k in enumerate(active[1:], 2):
            at = ends[:k] - t
            b = backward[at + 1] * e[at + 1]
            backward[at] = (to + tt * b) / (oo + ot * b)
        odds = forward * backward
        p = odds / (1 + odds)
        some = lengths > 0
        log_z = np.add.reduceat(np.log(scale), starts[some]) + np.log1p(forward[(starts + lengths - 1)[some]]) if some.any() else np.zeros(0)
        if not pairs:
            return p, log_z
        inner = np.ones(len(e), bool)
        inner[starts[lengths > 0]] = False
        i = np.flatnonzero(inner)
        left, right = forward[i - 1], backward[i] * e[i]
        w = np.stack([np.full(len(i), oo), ot * right, to * left, tt * left * right])
        return p, i, w / w.sum(0), log_z


@dataclass(frozen=True)
class Tagger:
    #: By bucket; the last one is the same for all words.
    weights: np.ndarray
    chain: Chain

    def parts_of(self, words: pa.Array) -> pa.Array:
        """What distinct words add to the emission of their own place, of the place after them and of that before."""
        own = feature_hashes(words)
        weigh = lambda h: np.where(h != 0, self.weights[(h % np.uint64(BUCKETS)).astype(np.int64)], 0.0)
        near = weigh(neighbour_hashes(own))
        return pa.StructArray.from_arrays([pa.array(weigh(own).sum(1) + self.weights[-1]), pa.array(near[:, 0]), pa.array(near[:, 1])], ["own", "after", "before"])


def emissions(known: pa.Array, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The emission of each word of texts laid end to end, from parts_of their distinct words."""
    own, after, before = (known.field(i).to_numpy(zero_copy_only=False)[at] for i in range(3))
    first = np.zeros(len(at) + 1, bool)
    first[np.cumsum(lengths) - lengths] = True
    first = first[:-1]
    own = own.copy()
    own[1:] += np.where(first[1:], 0.0, after[:-1])
    own[:-1] += np.where(first[1:], 0.0, before[1:])
    return own


def choose_features(features: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The features that explain the toxic documents, greedily; features and their documents go in pairs."""
    names, f = np.unique(features, return_inverse=True)
    f, d = np.divmod(distinct(f * len(toxic) + document), max(len(toxic), 1))
    others = np.bincount(f[~toxic[d]], minlength=len(names))
    allowed = others <= LEAK * max(1, int((~toxic).sum()))
    f, d = (x[allowed[f] & toxic[d]] for x in (f, d))
    chosen, open_docs = [], toxic.copy()
    while len(names):
        counts = np.bincount(f[open_docs[d]], minlength=len(names)) - 20 * others * (others > 0)
        best = int(counts.argmax())
        if counts[best] < SUPPORT:
            break
        chosen.append(names[best])
        open_docs[d[f == best]] = False
    return np.array(chosen, np.uint64)


class _Sample:
    """The words of sequences laid end to end, by their numbers among distinct words, and the features that have weights."""

    def __init__(self, words: pa.Array, at: np.ndarray, lengths: np.ndarray, document: np.ndarray | None = None):
        """document: of each word; features of fewer than SUPPORT documents have no weight then."""
        self.at, self.lengths, self.n = at, lengths, len(at)
        own = feature_hashes(words)
        near = neighbour_hashes(own)
        bucket = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
        self.words = len(own)
        self.first = np.zeros(self.n, bool)
        self.first[np.cumsum(lengths) - lengths] = True
        self.inner = np.flatnonzero(~self.first)
        # Sums go by distinct words first: (word, bucket) of their own features, and of those of neighbours. Neighbours that are rare
        # say nothing: their weights stay at zero.
        self.word, self.own = np.nonzero(own)[0], bucket(own[own != 0])
        if document is not None:
            docs = int(document.max(initial=-1)) + 1
            word, of = np.divmod(distinct(at.astype(np.int64) * docs + document), docs)
            order = np.argsort(self.word, kind="stable")
            begin = np.searchsorted(self.word[order], word)
            many = np.searchsorted(self.word[order], word, side="right") - begin
            pairs = order[np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            seen = distinct(self.own[pairs].astype(np.int64) * docs + np.repeat(of, many)) // docs
            kept = (np.bincount(seen, minlength=BUCKETS) >= SUPPORT)[self.own]
            self.word, self.own = self.word[kept], self.own[kept]
        self.before, self.after = bucket(near[:, 0]), bucket(near[:, 1])
        i = self.inner
        common = (np.bincount(self.before[at[i - 1]], minlength=BUCKETS) >= 4 * SUPPORT), (np.bincount(self.after[at[i]], minlength=BUCKETS) >= 4 * SUPPORT)
        self.before_used, self.after_used = common[0][self.before].astype(float), common[1][self.after].astype(float)
        self.penalty = np.full(BUCKETS + 5, PENALTY)
        self.penalty[:BUCKETS][common[0] | common[1]] = NEAR_PENALTY
        self.penalty[self.own] = PENALTY

    def emission(self, x: np.ndarray) -> np.ndarray:
        i, at = self.inner, self.at
        out = (np.bincount(self.word, x[self.own], minlength=self.words) + x[BUCKETS])[at]
        out[i] += (self.before_used * x[self.before])[at[i - 1]]
        out[i - 1] += (self.after_used * x[self.after])[at[i]]
        return out

    def gradient(self, left: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """By the weights, from the gradient by the words' emissions and by the moves."""
        i = self.inner
        in_word = lambda where, what: np.bincount(self.at[where], what, minlength=self.words)
        out = np.bincount(self.own, in_word(slice(None), left)[self.word], minlength=BUCKETS)
        out += np.bincount(self.before, self.before_used * in_word(i - 1, left[i]), minlength=BUCKETS) + np.bincount(self.after, self.after_used * in_word(i, left[i - 1]), minlength=BUCKETS)
        return np.concatenate([out, [left.sum()], moves])


def _climbed(x: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """x after Adam steps, moves within bounds."""
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        x[-4:] = np.clip(x[-4:], -6, 6)
    return x


def _tagger(x: np.ndarray) -> Tagger:
    return Tagger(x[: BUCKETS + 1], Chain(tuple(x[-4:])))


def _begin() -> np.ndarray:
    x = np.zeros(BUCKETS + 5)
    x[BUCKETS] = -4.0
    return x


def fit_chain(words: pa.Array, at: np.ndarray, lengths: np.ndarray, tags: np.ndarray, steps: int = STEPS, transitions: bool = True) -> Tagger:
    """Maximum likelihood with small ridge penalties, by Adam steps on the whole sample, for the words (numbers of distinct words)
    of sequences laid end to end and their tags. transitions False: without weights of moves."""
    lengths = lengths[lengths > 0]
    if not len(lengths):
        x = _begin()
        x[BUCKETS] = -10.0
        return _tagger(x)
    sample, y = _Sample(words, at, lengths), tags.astype(float)
    i = sample.inner
    seen = np.bincount((2 * y[i - 1] + y[i]).astype(int), minlength=4)

    def gradient(x: np.ndarray) -> np.ndarray:
        p, _, moves, _ = Chain(tuple(x[-4:])).marginals(sample.emission(x), lengths, pairs=True)
        return sample.gradient(y - p, seen - moves.sum(1) if transitions else np.zeros(4)) - sample.penalty * sample.n * x

    return _tagger(_climbed(_begin(), gradient, steps, 0.3))


def label_gradient(chain: Chain, emission: np.ndarray, lengths: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of documents' labels, and its gradient by each word's emission and by the moves. document: of each sequence
    (none empty); toxic: of each document.

    The path without toxic tags has the weight exp(moves from other to other) and the probability P, over a document's sequences. A clean
    document's likelihood is P, a toxic one's 1 - P; a sum over the paths that are left is that over all less P times the one path's.
    """
    p, inner, moves, log_z = chain.marginals(emission, lengths, pairs=True)
    log_p = np.bincount(document, (lengths - 1) * chain.moves[0] - log_z, minlength=len(toxic))
    log_p = np.minimum(log_p, -1e-12)
    rest = np.log(-np.expm1(log_p))
    weight = np.where(toxic, np.exp(log_p - rest), -1.0)
    of_word = np.repeat(document, lengths)
    steps = moves * weight[of_word[inner]]
    by_move = steps.sum(1)
    by_move[0] -= weight[of_word[inner]].sum()
    return float(np.where(toxic, rest, log_p).sum()), weight[of_word] * p, by_move


def refine(tagger: Tagger, words: pa.Array, at: np.ndarray, lengths: np.ndarray, document: np.ndarray, toxic: np.ndarray, steps: int = LABEL_STEPS, transitions: bool = True) -> Tagger:
    """The tagger after steps on the likelihood of the documents' labels. document: of each sequence; toxic: of each document. Empty
    sequences are passed over."""
    document, lengths = document[lengths > 0], lengths[lengths > 0]
    if not len(lengths):
        return tagger
    sample = _Sample(words, at, lengths, np.repeat(document, lengths))

    def gradient(x: np.ndarray) -> np.ndarray:
        _, left, moves = label_gradient(Chain(tuple(x[-4:])), sample.emission(x), lengths, document, toxic)
        return sample.gradient(left, moves if transitions else np.zeros(4)) - sample.penalty * sample.n * x

    return _tagger(_climbed(np.concatenate([tagger.weights, tagger.chain.moves]), gradient, steps, 0.1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, words: int = SAMPLE_WORDS, transitions: bool = True) -> Tagger:
    """Learn from at most ``sample`` labelled documents of each label, of at most ``words`` words together.

    Null labels and ids are left out; so is a document whose words don't fit in any more. A document that stands or is labelled
    more than once counts as often. Empty texts teach nothing. Without toxic documents no word is toxic.
    """
    label = F.col(label_col).cast("int")
    known = labels.filter(F.col(id_col).isNotNull() & label.isNotNull())
    halves = [known.filter(label == x).select(F.col(id_col).alias("__id"), label.alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(2 * sample) for x in (0, 1)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(halves[0].union(halves[1])), "__id")  # 4 * sample short rows
    rows = rows.withColumn("__size", F.size(F.split("__text", r"[\x20\x09-\x0D]+"))).filter(F.col("__size") <= words)
    got = []
    for x in (0, 1):
        room = words
        for r in rows.filter(F.col("__label") == x).orderBy(F.xxhash64("__id"), "__id", "__text").limit(sample).toLocalIterator():
            if r["__size"] <= room:
                room -= r["__size"]
                got.append((r["__text"], x == 1))
    vocabulary, at, lengths = words_in(pa.array([t for t, _ in got], pa.string()))
    toxic = np.array([x for _, x in got], bool)
    document = np.repeat(np.arange(len(got)), lengths)
    word, of = np.divmod(distinct(at.astype(np.int64) * len(got) + document), max(len(got), 1))
    features = feature_hashes(vocabulary)
    own = features[word]
    chosen = choose_features(own[own != 0], np.repeat(of, (own != 0).sum(1)), toxic)
    bad_word = np.isin(features, chosen).any(1)
    tags = bad_word[at] & toxic[document]
    cut = [(n, d) for d, size in enumerate(lengths) for n in [SEQUENCE] * (size // SEQUENCE) + [size % SEQUENCE] if n]
    sizes, document = (np.array([c[k] for c in cut], np.int64) for k in (0, 1))
    return refine(fit_chain(vocabulary, at, sizes, tags, transitions=transitions), vocabulary, at, sizes, document, toxic, transitions=transitions)


def tag_batch(texts: pa.Array, chain: Chain, known: Known) -> tuple[np.ndarray, list[list[dict]]]:
    """The score and the offending spans (characters, end exclusive) of each text; texts without words score 0."""
    words, at, lengths = words_in(texts)
    scores, starts, some = np.zeros(len(texts)), np.cumsum(lengths) - lengths, lengths > 0
    if len(at):
        p, log_z = chain.marginals(emissions(known.of(words), at, lengths), lengths)
        scores[some] = -np.expm1(np.minimum((lengths[some] - 1) * chain.moves[0] - log_z, 0.0))
    else:
        p = np.zeros(0)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(scores >= 0.5):
        offsets, hot = [m.span() for m in _WORD.finditer(texts[i].as_py())], p[starts[i] : starts[i] + lengths[i]] >= 0.5
        for j in np.flatnonzero(hot):
            if j and hot[j - 1]:
                spans[i][-1]["end"] = offsets[j][1]
            else:
                spans[i].append({"start": offsets[j][0], "end": offsets[j][1]})
    return scores, spans


def tagged(docs: DataFrame, tagger: Tagger, text_col: str = "text", mark: str = "__toxicity") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: score (0 to 1) and spans (array of start, end).

    Null and empty texts score 0 and have no spans. Whole texts are scored, however long. Repeated rows score alike; an empty
    table gives an empty result. A column of docs named like the mark raises an error.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((tagger.weights.astype(np.float32), tagger.chain))  # 1 MB whatever the corpus
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    state: list[Known] = []

    def tag(texts: pa.Array) -> pa.Array:
        weights, chain = shared.value
        if not state:
            state.append(Known(Tagger(weights, chain).parts_of))
        scores, spans = tag_batch(texts, chain, state[0])
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(spans, kind)], ["score", "spans"])

    return docs.withColumn(free(docs, mark), text_udf(_TAGGED, tag, state.clear)(F.col(text_col).cast("string")))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_TAGGED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", _SPANS)])
