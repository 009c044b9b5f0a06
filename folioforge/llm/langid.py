"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
in a language is the sum over all its segmentations into pieces (the forward algorithm), so no
single segmentation is chosen; a text's is the product over its words. The pieces' probabilities
are learned by expectation maximisation (forward and backward sums over the words of the sample).
Words may be of any length: the sums are rescaled on the way, and no word is cut or left out.

The model is fitted on a bounded sample: ``SAMPLE_PER_LANGUAGE`` rows for each language, chosen by
a hash of their ids, and of each the first ``SAMPLE_CHARS`` characters. Whole texts are scored;
the results for words are memoised in a table of bounded size.

Defined results: a text that is null or has no letter is ``und`` with score 0; without labelled
texts every result is that. Ties go to the smaller language name. Rows that repeat get equal
results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import in_hash_sample, map_batches, strings

SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 300, 20_000
#: Rounds of expectation maximisation, and words that are learned from at once.
ROUNDS, FIT_WORDS = 3, 4096
#: Pseudo-count of a piece, and the probability of a character outside the vocabulary.
PRIOR, UNKNOWN = 0.05, 1e-6
#: Entries of the memo table; tokens of more characters are not kept in it.
MEMO_WORDS, MEMO_CHARS = 150_000, 64
#: Characters whose words are looked up at once, and steps after which the forward sums are rescaled.
BLOCK_CHARS, RESCALE = 1_000_000, 16
UNDETERMINED = "und"

_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTERS = re.compile(r"[^\W\d_]+")
_FIELD, _SCALE = 48, 1 << 12  # fixed-point costs of all languages in one integer: bits of each, units of one nat


def _codes(some: list[str], n: int) -> np.ndarray:
    """The characters of words of length ``n``, one row each."""
    return np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n).astype(np.uint64)


def read_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary that consist of letters; U+2581 marks the start of a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in found if p.removeprefix("▁").isalpha() and p == p.lower()})


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased, each with the mark of a word's start before it."""
    text = text.lower()
    return ["▁" + text] if text.isalpha() else ["▁" + w for w in _LETTERS.findall(text)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _STEP
    return h ^ h >> np.uint64(29)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Column j holds a sum over the first j characters of each row, from which :func:`_window` gets any window's hash."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1)) * _powers(_BASE, codes.shape[1]), axis=1, out=out[:, 1:])
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]))[:n]


def _window(sums: np.ndarray, start: int, end: int, down: np.uint64) -> np.ndarray:
    """Hash of the characters start to end of each row, wherever they stand."""
    return _mixed((sums[:, end] - sums[:, start]) * down)


#: Words of more characters are worked on one by one, so many characters at once.
LONG_WORD, SLAB = 1_000, 1 << 14


class Vocabulary:
    """Finds pieces inside words by hashes of windows, many words of one length at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({1} | set(map(len, pieces))):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            h = _window(_prefixes(_codes([pieces[i] for i in ids], n)), 0, n, np.uint64(1)) if len(ids) else np.empty(0, np.uint64)
            order = np.argsort(h)
            self.by_length[n] = h[order], ids[order]
        self.longest = max(self.by_length)

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each place j: (length, rows, ids) of the pieces that end there; length 1 is always listed first."""
        sums, down = _prefixes(codes), _powers(_INVERSE, codes.shape[1])
        for j in range(1, codes.shape[1] + 1):
            found = []
            for n, (known, ids) in self.by_length.items():
                if n > j:
                    break
                rows = at = np.empty(0, np.int64)
                if len(known):
                    h = _window(sums, j - n, j, down[j - n])
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rows = np.flatnonzero(known[at] == h)
                if n == 1 or len(rows):
                    found.append((n, rows, ids[at[rows]]))
            yield j, found


@dataclass
class Model:
    """``table[piece]`` holds its probability in each of ``languages``."""

    languages: list[str]
    table: dict[str, tuple[float, ...]]

    def __post_init__(self) -> None:
        self.costs: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.vocabulary = Vocabulary(list(self.table))
        self.p = np.array(list(self.table.values())).reshape(len(self.table), len(self.languages))

    def __reduce__(self):
        return Model, (self.languages, self.table)

    def log_probabilities(self, some: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations of each word, in each language.

        The forward algorithm runs over all words of one length at once, and keeps as many columns
        as the longest piece has characters. Every RESCALE steps they are divided by the last one.
        """
        out = np.zeros((len(some), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(some):
            if len(w) > LONG_WORD:
                out[i] = self._forward_long(w)
            else:
                by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            out[rows] = self._forward(_codes([some[i] for i in rows], n))
        return out

    def _forward_long(self, word: str) -> np.ndarray:
        """The same for one long word. The pieces at all places of a slab are found at once, and each
        place then takes one product of the last places' sums with the probabilities of the pieces that end there."""
        reach, known = self.vocabulary.longest, self.vocabulary.by_length
        sums = np.zeros((SLAB + reach, len(self.languages)))
        sums[reach - 1] = 1.0
        logs, step = np.zeros(len(self.languages)), 0
        for begin in range(0, len(word), SLAB):
            before = min(begin, reach - 1)
            codes = _codes([word[begin - before : begin + SLAB]], min(before + len(word) - begin, before + SLAB))
            prefixes, down = _prefixes(codes)[0], _powers(_INVERSE, codes.shape[1])
            size = codes.shape[1] - before
            p = np.zeros((size, reach, len(self.languages)))
            p[:, -1] = UNKNOWN
            for n, (hashes, ids) in known.items():
                first = max(0, n - 1 - before)  # the first place of the slab where a piece of this length may end
                if len(hashes) and first < size:
                    start = np.arange(first, size) + before + 1 - n
                    h = _mixed((prefixes[start + n] - prefixes[start]) * down[start])
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[at] == h)
                    p[first + hit, reach - n] = self.p[ids[at[hit]]]
            for j in range(size):
                np.einsum("nl,nl->l", sums[j : j + reach], p[j], out=sums[j + reach])
                step += 1
                if step % RESCALE == 0:
                    last = sums[j + reach].copy()
                    logs += np.log(last)
                    sums[j + 1 : j + reach + 1] /= last
            sums[:reach] = sums[size : size + reach].copy()
        return logs + np.log(sums[reach - 1])

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        ahead = [np.ones((len(codes), len(self.languages)))]  # of the last places, the nearest one last
        logs = np.zeros_like(ahead[0])
        for j, found in self.vocabulary.matches(codes):
            (_, rows, ids), *longer = found
            q = np.full_like(logs, UNKNOWN)
            q[rows] = self.p[ids]
            total = ahead[-1] * q
            for n, rows, ids in longer:
                total[rows] += ahead[-n][rows] * self.p[ids]
            ahead.append(total)
            del ahead[: -self.vocabulary.longest]
            if j % RESCALE == 0:
                logs += np.log(total)
                ahead = [a / total for a in ahead]
        return logs + np.log(ahead[-1])

    def _learn_tokens(self, tokens: set[str]) -> dict[str, int]:
        """The costs of tokens: above the best language's, one bit field for each language. Short ones stay in the memo.

        All new tokens are worked on in columns; the fields are cut out of their costs' bytes.
        """
        new = [t for t in tokens if t not in self.costs]
        for t in new:
            if t in self.older:
                self.costs[t] = self.older[t]
        new = [t for t in new if t not in self.costs]
        if not new:
            return {}
        parts = [words(t) for t in new]
        place: dict[str, int] = {}
        every = np.array([place.setdefault(w, len(place)) for p in parts for w in p], np.int64)
        logs = self.log_probabilities(list(place))
        size = np.array([len(p) for p in parts], np.int64)
        total = np.zeros((len(new), len(self.languages)))
        if len(every):
            total[size > 0] = np.add.reduceat(logs[every], (np.cumsum(size) - size)[size > 0])
        costs = ((total.max(axis=1, keepdims=True) - total) * _SCALE).round().astype("<u8")
        fields = costs.view(np.uint8).reshape(len(new), -1, 8)[:, :, : _FIELD // 8].tobytes()
        wide = len(self.languages) * _FIELD // 8
        long = {}
        for i, t in enumerate(new):
            (self.costs if len(t) <= MEMO_CHARS else long)[t] = int.from_bytes(fields[i * wide : (i + 1) * wide], "little")
        return long

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability given the text, all languages being equally likely before)."""
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            tokens = [t.split() for t in texts[at:end]]
            if self.languages:
                if len(self.costs) > MEMO_WORDS:
                    self.older, self.costs = self.costs, {}
                long = self._learn_tokens(set().union(*tokens))
                packed = [sum(map(self.costs.__getitem__, x)) if not long else sum(self.costs[w] if len(w) <= MEMO_CHARS else long[w] for w in x) for x in tokens]
            else:
                packed = [0] * len(tokens)
            out += [self._decide(t, x) for t, x in zip(texts[at:end], packed, strict=True)]
            at = end
        return out

    def _decide(self, text: str, packed: int) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        mask = (1 << _FIELD) - 1
        costs = [(packed >> _FIELD * i & mask) / _SCALE for i in range(len(self.languages))]
        best = min(range(len(costs)), key=costs.__getitem__)
        return self.languages[best], 1 / sum(math.exp(min(0.0, costs[best] - c)) for c in costs)


def _expected(vocabulary: Vocabulary, words_of_a_length: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of the pieces in all segmentations of the words, which have one length.

    The forward pass yields, for every place, the probability of each piece that may end there,
    given that one does. The backward pass spreads a word's count along these, from its end. Sums
    before a place are kept relative to the last one, so words of any length are in range.
    """
    codes = _codes(words_of_a_length, len(words_of_a_length[0]))
    every = np.arange(len(codes))
    ahead = [np.ones(len(codes))]
    ends: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = []
    for _, found in vocabulary.matches(codes):
        (_, rows, ids), *longer = found
        q, one = np.full(len(codes), UNKNOWN), np.full(len(codes), vocabulary.size)  # the last place counts unknown characters
        q[rows], one[rows] = p[ids], ids
        own = [(1, every, one, ahead[-1] * q), *((n, rows, ids, ahead[-n][rows] * p[ids]) for n, rows, ids in longer)]
        total = own[0][3].copy()
        for _, rows, _, x in own[1:]:
            total[rows] += x
        ends.append([(n, rows, ids, x / total[rows]) for n, rows, ids, x in own])
        ahead = [x / total for x in ahead[max(0, len(ahead) + 1 - vocabulary.longest) :]] + [np.ones(len(codes))]
    reach = np.zeros((len(ends) + 1, len(codes)))
    reach[-1] = counts
    uses, pieces = [], []
    for j in range(len(ends), 0, -1):
        for n, rows, ids, share in ends[j - 1]:
            use = share * reach[j, rows]
            reach[j - n, rows] += use
            uses.append(use)
            pieces.append(ids)
    return np.bincount(np.concatenate(pieces), weights=np.concatenate(uses), minlength=vocabulary.size + 1)[:-1]


def fit(samples: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Learn the pieces' probabilities from texts of each language."""
    languages = sorted(samples)
    vocabulary = Vocabulary(pieces)
    columns = []
    for name in languages:
        counts: Counter = Counter()
        for text in samples[name]:
            counts.update(words(text))
        by_length: dict[int, list[str]] = {}
        for w in counts:
            by_length.setdefault(len(w), []).append(w)
        p = np.full(len(pieces), 1 / max(1, len(pieces)))
        for _ in range(rounds):
            use = np.full(len(pieces), PRIOR)
            for some in by_length.values():
                for i in range(0, len(some), FIT_WORDS):
                    part = some[i : i + FIT_WORDS]
                    use += _expected(vocabulary, part, np.array([counts[w] for w in part], float), p)
            p = use / use.sum()
        columns.append(p.tolist())
    return Model(languages, dict(zip(pieces, zip(*columns, strict=True), strict=True)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of the labelled rows that may be learned from."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).filter("lang is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Model([], {})
    picked = F.lit(False)
    for name in names:
        picked = picked | ((F.col("lang") == name) & in_hash_sample(F.col("doc_id"), per_language, sizes[name]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id"))).filter(picked)
    # about 2 * per_language rows of each language; never more than twice that, should many rows share an id
    found = rows.limit(4 * per_language * len(names)).coalesce(1).collect()
    samples = {name: [r["text"] for r in sorted((r for r in found if r["lang"] == name), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["text"]))[:per_language]] for name in names}
    return fit({k: v for k, v in samples.items() if v}, read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = predict(strings(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return run

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), make, f"doc_id {kind}, lang_pred string, score double")
    return out.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
