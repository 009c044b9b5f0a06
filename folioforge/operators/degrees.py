"""Enrichment of profiles with canonical degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import degrees as dg
from folioforge.functions.plan import computed_once


def enrich_profiles(profiles: DataFrame) -> DataFrame:
    """Add normalized_degree to each education entry, and normalized_highest_degree; raw degrees stay."""
    entries = F.transform("education", lambda e: e.withField("normalized_degree", dg.normalize_degree(e["degree"])))
    named = computed_once(profiles, {"education": entries})
    highest = dg.best_degree(F.transform("education", lambda e: e["normalized_degree"]))
    return computed_once(named, {"normalized_highest_degree": F.when(F.col("education").isNotNull(), highest)})


def enrich_all(datasets: dict[str, DataFrame]) -> DataFrame:
    """Several sets of profiles enriched, as one table with the column ``dataset``."""
    out = None
    for name, profiles in datasets.items():
        part = enrich_profiles(profiles).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset given")
    return out


def dataset_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("dataset").agg(F.count(F.lit(1)).alias("profiles"))
