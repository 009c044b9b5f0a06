"""Mixing sources to target weights.

Each document gets a hash-random key; within each source the documents are sorted by it, prefix
sums of their sizes say where each one lies, and the source's budget cuts that line exactly: the
document at the cut is taken in part. A budget above the source's size runs through the source
again (at most twice in all).

The sort is distributed: the leading bits of the key split every source into bins of about
``BIN_ROWS`` rows, however large the source is; bins are summed first, then the rows of each bin. Rows
that are alike are counted before that, so a million of them are one row of a bin.

Defined results: null text has size 0; a null source is a source of its own, the last one; rows
that repeat share the same key and are ordered among themselves by size; rows without doc_id get
their key from their text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.util import WORD, materialize

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The sources share this part of all sizes, and no target is above this multiple of its source.
SHARE, EPOCHS = 1.5, 2
#: Rows of one source that share a bin.
BIN_ROWS = 20_000


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows), one row per source.

    Water filling: with cap = epochs * source_size, the targets are min(cap, level * weight), where
    the level makes them add up to share * total. Sources are filled in order of cap / weight. This
    is what resharing any excess by weight until no target is above its cap ends with.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", epochs * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    t = t.withColumn("full", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("budget", share * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.coalesce("full", F.lit(0))) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return t.select("source", "source_size", "rows", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken."""
    return _mixed(docs, id_col, text_col, source_col, weights, share, epochs, seed).drop("text_key")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The rows of :func:`mix` with a hash of their text."""
    own = F.md5(F.concat(F.lit(f"|{seed}"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    key = F.when(F.col(id_col).isNull(), own).otherwise(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("text_key"))
    # rows that are alike, such as those without id and text, are one row with a number of copies
    rows = materialize(rows.groupBy("doc_id", "source", "size", "key", "text_key").agg(F.count(F.lit(1)).alias("copies")))
    weight = F.col("size") * F.col("copies")
    sizes = materialize(rows.groupBy("source").agg(F.sum(weight).alias("source_size"), F.sum("copies").alias("rows")))
    targets = source_targets(sizes, weights, share, epochs)

    total = rows.count()
    digits = 1
    while 16**digits * BIN_ROWS < total and digits < 8:
        digits += 1
    rows = rows.withColumn("bin", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("source", "bin").agg(F.sum(weight).alias("bin_size"))
    bins = bins.withColumn("offset", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    bins = bins.join(targets, same(bins, targets)).drop(targets["source"])
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    r, b = placed.alias("r"), bins.alias("b")
    placed = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    start = F.col("offset") + F.col("inside") + F.col("copy") * F.col("size")
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    return placed.select(
        F.col("doc_id").alias(id_col),
        F.col("r.source").alias(source_col),
        "size",
        "source_size",
        "target",
        (rounds * F.col("size") + part).cast("bigint").alias("taken"),
        "text_key",
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they are.

    Documents stay whole here: the one at the cut of a source is taken once more if at least half
    of it lies before the cut. A row is known by its doc_id, its source and its text; rows that
    repeat in all three are taken alike, as often as the one of them that is taken most often.
    Documents without words are never taken.
    """
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = _mixed(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    taken = mixed.groupBy(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "text_key").agg(F.max(times).alias("times")).filter("times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("from"), F.xxhash64(text_col).alias("own"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("own") == F.col("text_key"))
    return rows.join(taken, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")
