"""All charts and facets of the dashboard from one pass over the profiles.

Each profile gives a few (facet, value, amount) rows; they are counted and added up in one shuffle,
combined before it. The result, a row for each value that occurs, is small and is what the charts are
made from: :func:`chart` and the functions below it read it, never the profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import degrees as dg
from folioforge.functions import text as tx
from folioforge.operators import profiles as pr

RESEARCH = {"Journals": "journal_publications", "Conferences": "conference_publications", "Patents": "patents"}


def _one(facet: str, value: Column, amount: Column | None = None) -> Column:
    return F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"), (F.lit(0) if amount is None else amount).cast("bigint").alias("amount"))


def facets(flat: DataFrame) -> DataFrame:
    """(facet, value, profiles, total): how many profiles have each value, and the sum of its amounts.

    Values that are null or blank are left out, but a blank highest degree counts as Other.
    """
    top = F.when(F.trim(F.coalesce("highest_degree", F.lit(""))) != "", F.col("highest_degree")).otherwise("Other")
    single = [
        _one("degree", top),
        _one("designation_class", pr.designation_class()),
        _one("experience", tx.experience_range(F.col("experience_years"))),
        *[_one(f"value:{c}", F.col(c)) for c in ("institution", "designation", "university")],
        *[_one("research", F.lit(label), pr.count_of(name)) for label, name in RESEARCH.items()],
    ]
    several = F.transform(F.array_distinct(F.concat(F.array("highest_degree"), F.coalesce("all_degrees", F.array().cast("array<string>")))), lambda d: _one("any_degree", d))
    rows = flat.select(F.inline(F.concat(F.array(*single), several))).filter("value <> ''")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("profiles"), F.sum("amount").alias("total"))


def chart(table: DataFrame, facet: str, name: str) -> DataFrame:
    """(name, profiles) of one facet."""
    return table.filter(F.col("facet") == facet).select(F.col("value").alias(name), "profiles")


def degree_distribution(table: DataFrame) -> DataFrame:
    return chart(table, "degree", "degree").orderBy(F.desc("profiles"), "degree")


def designation_distribution(table: DataFrame) -> DataFrame:
    return chart(table, "designation_class", "designation")


def experience_histogram(table: DataFrame) -> DataFrame:
    """All buckets of years, empty ones included."""
    one = table.agg(*[F.coalesce(F.sum(F.when((F.col("facet") == "experience") & (F.col("value") == b), F.col("profiles"))), F.lit(0)).alias(b) for b in pr.EXPERIENCE_BUCKETS])
    return one.unpivot([], list(pr.EXPERIENCE_BUCKETS), "bucket", "profiles")


def research_totals(table: DataFrame) -> DataFrame:
    one = table.agg(*[F.coalesce(F.sum(F.when((F.col("facet") == "research") & (F.col("value") == k), F.col("total"))), F.lit(0)).alias(k) for k in RESEARCH])
    return one.unpivot([], list(RESEARCH), "label", "value")


def facet_degrees(table: DataFrame) -> DataFrame:
    some = table.filter("facet = 'any_degree' and value <> 'Other'").select(F.col("value").alias("degree"))
    return some.withColumn("rank", dg.degree_rank(F.col("degree"))).orderBy(F.desc("rank"), "degree")


def facet_values(table: DataFrame, column: str) -> DataFrame:
    return table.filter(F.col("facet") == f"value:{column}").select("value").orderBy("value")


def facet_experience(table: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(b) for b in pr.EXPERIENCE_BUCKETS]), F.col("bucket"))
    return experience_histogram(table).withColumn("place", place.cast("int"))
