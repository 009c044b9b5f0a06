"""Choice between competing extractions of a document, and assembly of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import trim_all

#: Characters that a usable extraction has at least.
MIN_LENGTH = 100
FAILED = "failed"


def choose_extraction(candidates: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text, engine): the first engine by priority whose trimmed text is long enough, else ('', failed)."""
    text = trim_all(F.coalesce("text", F.lit("")))
    good = F.length(text) >= min_length
    best = F.min_by(F.when(good, F.struct(text.alias("text"), "engine")), F.when(good, F.col("priority")))
    chosen = candidates.groupBy("doc_id").agg(best.alias("best"))
    return chosen.select("doc_id", F.coalesce("best.text", F.lit("")).alias("text"), F.coalesce("best.engine", F.lit(FAILED)).alias("engine"))


def assemble_pages(pages: DataFrame, skip_blank: bool = False) -> DataFrame:
    """(doc_id, text): pages in order, one below the other, trimmed; blank pages are kept or left out.

    Every document has a row: one whose pages are all blank has an empty text.
    """
    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    if skip_blank:
        page = F.when(trim_all(F.coalesce("text", F.lit(""))) != "", page)  # null is not collected
    parts = F.array_sort(F.collect_list(page))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return pages.groupBy("doc_id").agg(trim_all(joined).alias("text"))


def assemble_blocks(blocks: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text, engine) from paragraphs and table cells (kind, row_no, cell_no, text).

    Paragraphs come first, then table rows, whose cells are joined by ' | '; blank parts are left out.
    Every document has a row: one without enough text has failed.
    """
    parts = blocks.withColumn("text", trim_all(F.coalesce("text", F.lit(""))))
    cells = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("cell_no", "text"))))
    rows = parts.groupBy("doc_id", "kind", "row_no").agg(F.array_join(F.transform(cells, lambda c: c["text"]), " | ").alias("line"))
    line = F.struct((F.col("kind") != "paragraph").alias("table"), "row_no", "line")
    lines = F.array_sort(F.collect_list(F.when(F.col("line") != "", line)))
    docs = rows.groupBy("doc_id").agg(trim_all(F.array_join(F.transform(lines, lambda c: c["line"]), "\n")).alias("text"))
    good = F.length("text") >= min_length
    return docs.select("doc_id", F.when(good, F.col("text")).otherwise("").alias("text"), F.when(good, "blocks").otherwise(FAILED).alias("engine"))


def extraction_outcome(chosen: DataFrame) -> DataFrame:
    """Counts of all, usable and failed extractions."""
    failed = F.count_if(F.col("engine") == FAILED)
    return chosen.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - failed).alias("success"), failed.alias("failed"))
