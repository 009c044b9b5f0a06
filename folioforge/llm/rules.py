"""Quality rules as a ledger of bits: every rule is evaluated once, policies are applied to the ledger.

:func:`ledger` measures each text and stores the measurements with one integer, whose bit i says
that rule i failed. A policy is a version and a mask of the rules that count. Applying one, trying
another one, or asking what each rule does, needs the ledger alone, never the texts:
:func:`ablations` adds up equal bit patterns first, of which there are at most two to the number
of rules, and then counts by bitwise operations on the patterns.

Defined results: a null text is an empty one; a text without words fails ``few_words`` and no rule
about shares. Repeated words are found by hashes of windows and confirmed on the words themselves.
Texts are read in pieces; of a long text only one hash a word is held. Null ids and rows that
repeat are kept as they are. An empty table gives an empty ledger, and ablations with counts of
zero. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import map_batches

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")

#: The rules in the order of their bits; each says when a text fails. New rules go to the end, so that old ledgers keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "n_words > 0 and word_chars > 20 * n_words",
    "symbols": "n_words > 0 and 10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
}
#: Versions and the rules that count in them.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; pieces end at white space."""
    at, n = 0, len(raw)
    while at < n:
        end = at + PIECE
        while end < n and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end].split()
        at = end


def repeated_words(raw: bytes, width: int = WINDOW) -> tuple[int, int]:
    """(words, words in windows of ``width`` that occur twice or more)."""
    parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in _words(raw)]
    h = np.concatenate([np.empty(0, np.int64), *parts]).view(np.uint64)
    n = len(h)
    if n <= width:
        return n, 0
    keys = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        keys = keys * _STEP + h[i : i + len(keys)]
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return n, 0
    found = _confirmed(raw, np.flatnonzero(np.isin(keys, twice)), width)
    covered = np.zeros(n + 1, np.int64)
    covered[found] += 1
    np.subtract.at(covered, found + width, 1)
    return n, int((np.cumsum(covered)[:n] > 0).sum())


def _confirmed(raw: bytes, places: np.ndarray, width: int) -> np.ndarray:
    """Those of the windows that start at ``places`` whose words occur at another of them."""
    wanted, first, good = iter(places.tolist()), {}, set()
    following, window = next(wanted, -1), deque(maxlen=width)
    for i, word in enumerate(w for words in _words(raw) for w in words):
        window.append(word)
        if i - width + 1 == following:
            seen = first.setdefault(tuple(window), following)
            if seen != following:
                good.update((seen, following))
            following = next(wanted, -1)
    return np.array(sorted(good), np.int64)


def _repeated_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them that are equal to an earlier one)."""
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    n, repeated = repeated_words(text.encode())
    lines, equal = _repeated_lines(text)
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), equal, lines, repeated


def failures(rules: Mapping[str, str] = RULES) -> Column:
    """The bits of the rules that fail, over the columns of MEASURES."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """One row per document: its id, MEASURES, and the bits of the rules that fail."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([measure(t or "") for t in batch.column(1).to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["doc_id", *MEASURES])

        return run

    kind = dict(docs.dtypes)[id_col]
    rows = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")), make, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return rows.withColumn("failures", failures(rules)).withColumnRenamed("doc_id", id_col)


def mask(names: Iterable[str], rules: Mapping[str, str] = RULES) -> int:
    """The bits of some rules."""
    order = list(rules)
    return sum(1 << order.index(name) for name in set(names))


def apply_policy(rows: DataFrame, version: str = CURRENT, policies: Mapping[str, Iterable[str]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """The ledger with base_failed and kept: whether none of the policy's rules, and no base rule, fails."""
    bits = F.col("failures")
    base = mask(policies["base"], rules)
    base_failed = bits.bitwiseAND(F.lit(base)) != 0
    return rows.withColumns({"base_failed": base_failed, "kept": bits.bitwiseAND(F.lit(mask(policies[version], rules) | base)) == 0})


def ablations(rows: DataFrame, policies: Mapping[str, Iterable[str]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_only, n_kept, n_kept_without) for each rule of each policy.

    n_failed: documents that fail the rule; n_only: those that fail no other rule of the policy;
    n_kept: documents the policy keeps; n_kept_without: what it would keep without the rule.
    """
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    each = [(v, name, mask(names, rules), mask([name], rules)) for v, names in policies.items() for name in names]
    literal = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("mask"), F.lit(b).cast("bigint").alias("bit")) for v, r, m, b in each])
    none = rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("failures"), F.lit(0).cast("bigint").alias("n"))
    at = patterns.unionByName(none).select("failures", "n", F.inline(literal))
    counted = F.col("failures").bitwiseAND(F.col("mask"))
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return at.groupBy("version", "rule").agg(
        total(counted.bitwiseAND(F.col("bit")) != 0, "n_failed"),
        total(counted == F.col("bit"), "n_only"),
        total(counted == 0, "n_kept"),
        total((counted == 0) | (counted == F.col("bit")), "n_kept_without"),
    )
