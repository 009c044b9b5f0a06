"""Groups of spelling variants: words one edit apart, found by pivotal grams.

Words are counted first: each task adds up what it meets, so a word that fills a third of the
corpus leaves a task as one row. All bigrams get one order, rare ones first. A word's prefix is
its three rarest bigrams, its pivots are two of them that do not overlap, chosen by dynamic
programming so that they are as rare as possible together. One edit breaks at most one of two
grams that do not overlap, so of two words one edit apart, the one whose prefix ends first in the
order of bigrams has a pivot in the other's prefix.

Position limits: the edit lies behind the surviving gram, or before it. Behind it, the gram stands
at the same place from the start, and everything up to it is the same; before it, at the same
place from the end, with everything after it the same. So prefixes are indexed by the gram, its place
and the word's length together with what the edit leaves alone, over half of the word in any case,
and pivots look that up for the three lengths possible. A gram that most words share is split by its
surroundings that way. Every pair found is then verified.

Of a gram that ends a prefix and occurs again in the word, five places are indexed: the edit makes
at most two new ones, and the other word's prefix may hold three.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the
hash that plants variants. Rows that repeat are counted again. Words may be of any length, texts
are read in pieces. Ties between forms go to the smallest word in code-point order. An empty table
gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import bound_batches, materialize, own_tables, release_memory, remove

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many pairs of document and word loses a character.
NOISE = 31
#: A form is at least so many times as frequent as its variant.
TIMES = 10
GRAM, EDITS = 2, 1
#: Grams of a prefix, and places of its last gram that are indexed.
PREFIX, PLACES = GRAM * EDITS + 1, GRAM * EDITS + 3
#: Share of a word that a key holds at least.
ENOUGH = 0.6
#: Characters of a text that are read at once, and words that a task counts before it hands them on.
PIECE, MOST_COUNTED = 1 << 20, 200_000
_SPLIT = re.compile(r"[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text, cut where no word is."""
    at = 0
    while at < len(text):
        gap = _SPLIT.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield at, end
        at = end


def noisy_word(word: str, state: int) -> str:
    """``word`` of a document, without one character if its hash says so; ``state`` is the crc32 of what goes before it."""
    h = zlib.crc32(word.encode(), state)
    if h % NOISE:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    bound_batches(docs.sparkSession)
    long_runs = re.compile(RUN + "{%d,}" % least_length)

    def flush(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        release_memory()
        counts: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").encode().lower().decode()  # of bytes, only A-Z have a lower case
                state = zlib.crc32(f"{doc or ''}:".encode())
                for at, end in _pieces(text):
                    for word, n in Counter(long_runs.findall(text, at, end)).items():
                        word = noisy_word(word, state)
                        if len(word) >= least_length:
                            counts[word] = counts.get(word, 0) + n
                    if len(counts) >= MOST_COUNTED:
                        yield flush(counts)
                        counts.clear()
        yield flush(counts)

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(rank, frequency) of each bigram, rare ones first. The alphabet has 90 letters, so there are at most 8,100."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(word[i : i + GRAM] for i in range(len(word) - GRAM + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: (i, r.n) for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(rank, place) of the rarest grams of a word: PREFIX of them, and more places of the last one up to PLACES."""
    ranked = [(order[word[i : i + GRAM]][0], i) for i in range(len(word) - GRAM + 1)]
    first = heapq.nsmallest(PREFIX, ranked)
    last = first[-1][0]
    tied = heapq.nsmallest(PLACES, (x for x in ranked if x[0] == last))
    return [x for x in first if x[0] < last] + tied


def pivots(grams: list[tuple[int, int]], need: int = EDITS + 1) -> list[int]:
    """Places of ``need`` grams that do not overlap, with the least sum of frequencies, of (place, frequency)."""
    grams = sorted(grams)
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * need]  # best[i][j]: j of the first i grams
    for i, (place, cost) in enumerate(grams):
        before = max((k for k in range(i + 1) if k == 0 or grams[k - 1][0] + GRAM <= place), default=0)
        row: list[tuple[int, list[int]] | None] = [(0, [])]
        for j in range(1, need + 1):
            skip, take = best[i][j], best[before][j - 1]
            taken = None if take is None else (take[0] + cost, [*take[1], place])
            row.append(min((x for x in (skip, taken) if x is not None), default=None))
        best.append(row)
    return best[-1][need][1]


def _surroundings(word: str, place: int, n: int) -> Iterator[int]:
    """Keys of the gram at ``place`` of a word with what the edit leaves alone, for a partner of ``n`` characters.

    If the edit lies behind the gram, that is all up to its end. Where this is little of the word, what
    lies behind is halved, and the edit leaves one of the halves alone as well. The same from the other
    end if the edit lies before the gram. Where to halve follows from the partner's length and the
    gram's place in the partner, so both get the same keys.
    """
    own = len(word)
    key = lambda side, at, part: xxhash.xxh3_64_intdigest(part.encode(), n << 32 | at << 3 | side) - (1 << 63)
    end = place + GRAM
    if end <= n:
        if end >= ENOUGH * n or end >= n - 1:
            yield key(0, place, word[:end])
        else:
            half = (end + n) // 2
            yield key(1, place, word[:half])
            yield key(2, place, word[:end] + "\n" + word[own - n + half :])
    begin = place + n - own
    if begin >= 0:
        rest = word[place:]
        if len(rest) >= ENOUGH * n or begin <= 1:
            yield key(3, begin, rest)
        else:
            half = begin // 2
            yield key(4, begin, word[own - n + half :])
            yield key(5, begin, word[:half] + "\n" + rest)


def gram_keys(words: DataFrame, order: dict[str, tuple[int, int]], own: bool) -> DataFrame:
    """(key, last, word, n): the keys under which a word's prefix is indexed, or those its pivots look up."""
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            keys, lasts = [], []
            for word in batch.column(0).to_pylist():
                found, n = prefix(word, order), len(word)
                lasts.append(found[-1][0])
                if own:
                    places, lengths = [i for _, i in found], (n,)
                else:
                    places, lengths = pivots([(i, order[word[i : i + GRAM]][1]) for _, i in found[:PREFIX]]), (n - 1, n, n + 1)
                keys.append([k for i in places for m in lengths for k in _surroundings(word, i, m)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lasts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["word", "n", "last", "keys"])

    out = words.select("word", "n").mapInArrow(run, "word string, n bigint, last int, keys array<bigint>")
    return out.select(F.explode("keys").alias("key"), "last", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words one edit apart, once, in one of its two directions."""
    order = gram_order(words)
    asked = gram_keys(words, order, own=False).withColumnsRenamed({"last": "la", "word": "a", "n": "na"})
    kept = gram_keys(words, order, own=True).withColumnsRenamed({"last": "lb", "word": "b", "n": "nb"})
    found = asked.join(kept, "key").filter("la <= lb and a <> b").filter(F.levenshtein("a", "b", EDITS) == EDITS)
    turned = F.col("a") > F.col("b")
    pair = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("b", "a", "a"), ("nb", "na", "na"), ("a", "b", "b"), ("na", "nb", "nb"))]
    return found.select(*pair).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of (word, form): the last form reached.

    A form is at least TIMES as frequent, so chains are short; each round doubles the steps taken.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    with own_tables() as made:
        result = materialize(_variants(docs, id_col, text_col, times))
        remove(docs.sparkSession, made[:-1])
    return result


def _variants(docs: DataFrame, id_col: str, text_col: str, times: int) -> DataFrame:
    words = materialize(word_counts(docs, id_col, text_col))
    pairs = materialize(near_pairs(words))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")))
    near = links.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
