"""The nine-stage cleaning pipeline with counters, and reports about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions.text import CleanerConfig


def clean_text(text: Column, config: CleanerConfig = CleanerConfig(), spark: SparkSession | None = None) -> Column:
    """All stages that are on, as one expression; ``spark`` as in :func:`folioforge.functions.text.nfkc`."""
    for option, _, _, stage in tx.STAGES:
        if getattr(config, option):
            text = stage(tx.nfkc(text, spark)) if option == "unicode" else stage(text)
    return text


def clean(docs: DataFrame, config: CleanerConfig = CleanerConfig(), text: str = "text", keep: str | None = None) -> DataFrame:
    """Replace the text by its clean form and add the struct ``cleaning``: what each stage changed, characters before and after.

    ``keep`` is the name under which the text stays as it was; :func:`report_of` takes it from there.

    Each stage is a projection of its own, so its text is computed once for the counter and the
    next stage; the Python stage (NFKC) runs once, in Arrow batches, and is left out of the plan
    if its option is off.
    """
    out = docs.withColumn("_0", F.col(text))
    if config.unicode:
        out = out.withColumn("_0", tx.nfkc("_0", docs.sparkSession))
    counters: list[Column] = []
    for i, (option, counter, count, stage) in enumerate(tx.STAGES):
        before, after = f"_{i}", f"_{i + 1}"
        on = getattr(config, option)
        out = out.withColumn(after, stage(F.col(before)) if on else F.col(before))
        if not on:
            value = F.lit(0).cast("bigint")
        elif count is None:
            value = tx.same_length_difference(F.col(before), F.col(after))
        else:
            value = F.when(F.col(before) == F.col(after), 0).otherwise(count(F.col(before)))  # what changes nothing counts nothing
        counters.append(F.coalesce(value, F.lit(0)).alias(counter))
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
    last = F.col(f"_{len(tx.STAGES)}")
    counters += [length(F.col(text)).alias("characters_before"), length(last).alias("characters_after")]
    rest = [c for c in docs.columns if c != text]
    before = [F.col(text).alias(keep)] if keep else []
    return out.select(*rest, *before, last.alias(text), F.struct(*counters).alias("cleaning"))


def cleaning_statistics(cleaned: DataFrame) -> DataFrame:
    """Totals of the counters over all documents, how many failed, and the compression ratio."""
    names = [f.name for f in cleaned.schema["cleaning"].dataType.fields]
    sums = [F.coalesce(F.sum(F.col(f"cleaning.{n}")), F.lit(0)).alias(n) for n in names]
    failed = F.count_if(F.col("text").isNull())
    total = cleaned.agg(F.count(F.lit(1)).alias("documents"), (F.count(F.lit(1)) - failed).alias("successful"), failed.alias("failed"), *sums)
    ratio = F.when(F.col("characters_before") > 0, F.round(F.col("characters_after") / F.col("characters_before"), 4)).otherwise(0.0)
    return total.withColumn("compression_ratio", ratio).withColumn("preserved_percent", F.round(100 * ratio, 2))


def _measures(text: str, when: str) -> list[Column]:
    value = F.coalesce(text, F.lit(""))
    return [F.length(value).cast("bigint").alias(f"characters_{when}"), tx.word_count(value).alias(f"words_{when}"), tx.line_count(value).alias(f"lines_{when}")]


def report_of(cleaned: DataFrame, before: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`cleaning_report` of rows that hold both texts, so that nothing is joined."""
    return _compared(cleaned.select(*keys, *_measures(before, "before"), *_measures("text", "after")))


def cleaning_report(raw: DataFrame, cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters, words and lines of each document before and after, what went, and the compression ratio."""
    return _compared(raw.select(key, *_measures("text", "before")).join(cleaned.select(key, *_measures("text", "after")), key))


def _compared(both: DataFrame) -> DataFrame:
    gone = [(F.col(f"{n}_before") - F.col(f"{n}_after")).alias(f"{n}_removed") for n in ("characters", "words", "lines")]
    ratio = F.round(F.col("characters_after") / F.greatest("characters_before", F.lit(1)), 4)
    return both.select("*", *gone, ratio.alias("compression_ratio"))


def missing_cleaned(raw: DataFrame, cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a clean counterpart."""
    return raw.select(key).join(cleaned.select(key), key, "left_anti")


def report_summary(report: DataFrame) -> DataFrame:
    """Totals and means over a report; the mean ratio is that of the rounded ratios, 0 if there is none."""
    mean = lambda c, n: F.coalesce(F.round(F.avg(c), n), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return report.agg(
        F.count(F.lit(1)).alias("documents"),
        total("characters_before").alias("characters_before"),
        total("characters_after").alias("characters_after"),
        total("characters_removed").alias("characters_removed"),
        mean("compression_ratio", 4).alias("mean_compression_ratio"),
        *[mean(f"{n}_removed", 2).alias(f"mean_{n}_removed") for n in ("characters", "words", "lines")],
    )
