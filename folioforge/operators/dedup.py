"""Exact deduplication of documents against a growing registry of content hashes.

A registry is a table with a column content_hash, or a :class:`folioforge.sources.registry.Registry`, of
which only the folders are read that may hold some of the documents' hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.sources.registry import Registry


def content_hash(content: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(content, 256)


def with_hash(docs: DataFrame, content: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col(content)))


def _known(registry: DataFrame | Registry, hashed: DataFrame, without: str | None = None) -> DataFrame:
    """The distinct hashes of the registry, as far as they may be among those of ``hashed``."""
    found = registry.candidates(hashed.select("content_hash"), without) if isinstance(registry, Registry) else registry
    return found.select("content_hash").distinct()


def flag_duplicates(docs: DataFrame, registry: DataFrame | Registry | None, content: str = "text") -> DataFrame:
    """Add content_hash and is_duplicate: whether the registry has the hash. No registry: all are new."""
    hashed = with_hash(docs, content)
    if registry is None:
        return hashed.withColumn("is_duplicate", F.lit(False))
    known = _known(registry, hashed).withColumn("_known", F.lit(True))
    return hashed.join(known, "content_hash", "left").withColumn("is_duplicate", F.col("_known").isNotNull()).drop("_known")


def drop_known(docs: DataFrame, registry: DataFrame | Registry | None, content: str = "text", without: str | None = None) -> DataFrame:
    """Documents whose hash is not in the registry, or only in its batch ``without``."""
    hashed = with_hash(docs, content)
    return hashed if registry is None else hashed.join(_known(registry, hashed, without), "content_hash", "left_anti")


def first_of_each(hashed: DataFrame, order: str = "doc_id") -> DataFrame:
    """(content_hash, first): the smallest ``order`` of each hash, combined before the shuffle."""
    return hashed.groupBy("content_hash").agg(F.min(order).alias("first"))


def _firsts(docs: DataFrame, content: Column, order: str) -> DataFrame:
    """The rows of ``docs`` that come first of their content, with content_hash.

    The winners are found on hashes alone. Then the rows are joined with them by two hashes of the
    whole row, so that copies of one content are dealt over tasks and no text is sorted; what
    ``content`` costs is paid once for each row.
    """
    ties = ("_tie", "_tie2")
    keyed = docs.withColumns({t: F.xxhash64(F.lit(i), *docs.columns) for i, t in enumerate(ties)})
    first = F.min(F.struct(F.col(order).alias("_order"), *ties)).alias("first")
    winners = keyed.withColumn("content_hash", content_hash(content)).groupBy("content_hash").agg(first).select("content_hash", *[f"first.{t}" for t in ties])
    return keyed.join(winners.hint("shuffle_hash"), list(ties)).distinct().select(*docs.columns, "content_hash")


def dedup_exact(docs: DataFrame, order: str = "doc_id", content: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The first document, by ``order``, of each content, with content_hash.

    Among rows that tie, the one whose hash of all columns is smallest stays, so reruns agree; a null
    order comes first, and null contents are one content. Rows that are equal in all columns are
    one row.
    """
    return _firsts(docs, F.col(content), order).select(*(keep or docs.columns), "content_hash")


def first_entries(hashed: DataFrame, order: str = "doc_id") -> DataFrame:
    """(doc_id, content_hash): the first document of each hash."""
    return first_of_each(hashed, order).select(F.col("first").alias("doc_id"), "content_hash")


def new_entries(docs: DataFrame, registry: DataFrame | Registry | None, content: str = "text", order: str = "doc_id") -> DataFrame:
    """The (doc_id, content_hash) rows that a batch adds to the registry: new contents, the first document of each."""
    return first_entries(drop_known(docs, registry, content), order)


def dedup_text(docs: DataFrame, clean: Callable[[Column], Column], order: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`dedup_exact` on texts after ``clean``, a function from column to column. Texts that go are cleaned once, others twice."""
    return _firsts(docs, clean(F.col(text)), order).withColumn(text, clean(F.col(text)))
