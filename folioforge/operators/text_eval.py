"""Fidelity of extracted texts against reference texts, per tool."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioforge.functions.edit_distance import levenshtein
from folioforge.functions.plan import bound_batches
from folioforge.functions.text import trim_all, words
from folioforge.operators.profiles import group_means

METRICS = ("f1", "cer", "ned", "bleu")
EPSILON = 0.1


def token_f1(truth: Column, found: Column) -> Column:
    """F1 of the sets of words, case-sensitive; 0 where a denominator is 0."""
    a, b = F.array_distinct(words(truth)), F.array_distinct(words(found))
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * both / total).otherwise(0.0)


def pair_texts(truth: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, tool, gt, pred): each tool's text with the reference; documents that lack one are left out."""
    return found.join(truth, key)


def _counts(truth: str, found: str, longest: int = 4) -> list[int]:
    """Clipped counts of common 1- to 4-grams, the words of both texts, the distinct words both have, and those of each added up.

    Words get numbers, and so do n-grams, from the number of the gram before and that of the next word; so grams
    are counted exactly, by sorting numbers.
    """
    if truth == found:
        words, distinct = truth.split(), len(set(truth.split()))
        return [*(max(0, len(words) - n) for n in range(longest)), len(words), len(words), distinct, 2 * distinct]
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in text.split()], np.int64) for text in (truth, found))
    a, b = np.bincount(x, minlength=len(ids)), np.bincount(y, minlength=len(ids))
    out, p, q = [int(np.minimum(a, b).sum())], x, y
    for n in range(1, longest):
        p, q = (g[: max(0, len(w) - n)] * len(ids) + w[n:] for g, w in ((p, x), (q, y)))
        names = np.unique(np.concatenate([p, q]), return_inverse=True)[1]
        p, q = names[: len(p)], names[len(p) :]
        out.append(int(np.minimum(*(np.bincount(g, minlength=len(names)) for g in (p, q))).sum()))
    return [*out, len(x), len(y), int(((a > 0) & (b > 0)).sum()), int((a > 0).sum() + (b > 0).sum())]


_HITS = ["m1", "m2", "m3", "m4", "ref", "hyp"]
_COUNTS = [*_HITS, "both", "total"]


@F.pandas_udf(StructType([StructField(n, LongType()) for n in _HITS]))
def gram_hits(truth: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = [_counts(a or "", b or "")[: len(_HITS)] for a, b in zip(truth, found, strict=True)]
    return pd.DataFrame(rows, columns=_HITS)


@F.pandas_udf(StructType([StructField(n, LongType()) for n in [*_COUNTS, "d"]]))
def pair_counts(truth: pd.Series, found: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All that the scores of a pair are made from: counts of words and grams, and the edit distance of the trimmed texts."""
    rows = [[*_counts(x, y), levenshtein(s, t)] for x, y, s, t in zip(truth, found, a, b, strict=True)]
    return pd.DataFrame(rows, columns=[*_COUNTS, "d"])


def bleu_score(hits: str) -> Column:
    """BLEU with one reference, clipped n-gram counts, brevity penalty, and EPSILON for zero counts, from :func:`gram_hits`."""
    h = lambda n: F.col(f"{hits}.{n}")
    logs = None
    for n in range(1, 5):
        share = F.when(h(f"m{n}") > 0, h(f"m{n}").cast("double")).otherwise(EPSILON) / F.greatest(F.lit(1), h("hyp") - n + 1)
        logs = F.log(share) if logs is None else logs + F.log(share)
    penalty = F.when(h("hyp") > h("ref"), 1.0).otherwise(F.exp(1 - h("ref") / h("hyp")))
    return F.when((h("hyp") == 0) | (h("m1") == 0), 0.0).otherwise(penalty * F.exp(logs / 4))


def bleu4(pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "tool")) -> DataFrame:
    """(keys, bleu) of each pair; a pair is counted where it is, nothing is shuffled."""
    bound_batches(pairs.sparkSession)
    return pairs.select(*keys, gram_hits("gt", "pred").alias("hits")).select(*keys, bleu_score("hits").alias("bleu"))


def score_texts(pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "tool")) -> DataFrame:
    """f1, cer, ned and bleu of each pair; its words are split and its distance is computed once."""
    bound_batches(pairs.sparkSession)
    rows = pairs.select(*keys, F.coalesce("gt", F.lit("")).alias("gt"), F.coalesce("pred", F.lit("")).alias("pred"))
    rows = rows.withColumns({"a": trim_all(F.col("gt")), "b": trim_all(F.col("pred"))})
    rows = rows.select(*keys, pair_counts("gt", "pred", "a", "b").alias("c"), F.length("a").alias("n_a"), F.length("b").alias("n_b"))
    f1 = F.when(F.col("c.both") > 0, 2.0 * F.col("c.both") / F.col("c.total")).otherwise(0.0)
    cer = F.when(F.col("n_a") > 0, F.col("c.d") / F.col("n_a"))
    most = F.greatest("n_a", "n_b")
    return rows.select(*keys, f1.alias("f1"), cer.alias("cer"), F.when(most > 0, F.col("c.d") / most).alias("ned"), bleu_score("c").alias("bleu"))


def summarise_tools(scores: DataFrame) -> DataFrame:
    return group_means(scores.select("tool", *METRICS), "tool")


def rank_tools(summary: DataFrame) -> DataFrame:
    """Places by f1, then bleu, then name; the summary has one row per tool."""
    order = Window.orderBy(F.desc("f1"), F.desc("bleu"), "tool")
    return summary.withColumn("rank", F.row_number().over(order))


def metric_series(summary: DataFrame) -> DataFrame:
    """(tool, metric, value): what a bar chart of each metric shows."""
    return summary.unpivot("tool", list(METRICS), "metric", "value")
