"""Readers and writers: documents, profiles, the registry, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import unify_line_ends
from folioforge.operators import schema
from folioforge.sources.batches import Batches, content_key
from folioforge.sources.registry import Registry

SUFFIXES = (".pdf", ".docx")


def _stem(column: str = "_metadata.file_name") -> Column:
    return F.regexp_replace(F.col(column), r"\.[^.]*$", "")


def decode_lenient(content: Column) -> Column:
    """Bytes as UTF-8 without the invalid ones, line ends unified. A genuine U+FFFD goes as well."""
    return unify_line_ends(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")))


def read_documents(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt") -> DataFrame:
    """(doc_id, text): one row per text file, named after it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(_stem().alias("doc_id"), decode_lenient(F.col("content")).alias("text"))


def read_profiles(spark: SparkSession, path: str | Sequence[str], kind: str = schema.ENRICHED, glob: str = "*.json") -> DataFrame:
    """(cand_id, profile columns): one JSON record per file; files that are not readable are left out.

    cand_id is the name of the file, unless ``kind`` says that the records have one.
    """
    ddl = f"{kind}, _corrupt string"
    rows = spark.read.schema(ddl).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)
    if "cand_id" not in rows.columns:
        rows = rows.select(_stem().alias("cand_id"), "*")
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def scan_files(spark: SparkSession, path: str | Sequence[str], suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(doc_id, path, length, status, content): files by suffix, whatever its case; others are unsupported and not read."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.[^.]+$", 0))
    good = suffix.isin(*suffixes)
    return files.select(_stem().alias("doc_id"), "path", "length", F.when(good, "ok").otherwise("unsupported").alias("status"), F.when(good, F.col("content")).alias("content"))


def read_registry(spark: SparkSession, path: str, without_batch: str | None = None) -> DataFrame:
    """The registry of content hashes, but for those of one batch; empty if there is none yet."""
    return Registry(spark, path).rows(without_batch)


def append_registry(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows to the registry, in place of an earlier batch of that key; without a key, equal rows are added once."""
    Registry(entries.sparkSession, path).append(entries, batch)


def write_profiles(profiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8 as it is."""
    profiles.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """A report as CSV with a header, or as JSON."""
    writer = report.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    docs.select("doc_id", "text").write.mode(mode).parquet(path)


def write_quarantine(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Responses that are not valid, as the batch ``batch``, in place of an earlier try of it.

    Without a key it follows from the rows, so a job that runs again leaves the same rows.
    """
    spark, kind = rows.sparkSession, rows.schema
    key = batch if batch is not None else lambda to: content_key(spark.read.schema(kind).parquet(to), kind.names)
    Batches(spark, path).publish(key, lambda to: rows.write.parquet(to))


def read_quarantine(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What lies in quarantine; ``kind`` says which columns."""
    return Batches(spark, path).read(kind)


def compact_quarantine(spark: SparkSession, path: str, kind: str, files: int = 1) -> None:
    Batches(spark, path).compact(kind, files)
