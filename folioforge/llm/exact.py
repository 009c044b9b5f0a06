"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. Equal blocks get one integer name
(the distinct blocks are sorted, and their place is their name), then adjacent pairs of names get
a new name, and so on, until one name is left for each document. Two documents of the same height
share that name exactly if their texts are equal: names stand for contents, not for hashes.

Texts go through one shuffle, as distinct blocks. Everything else is joined by 64-bit hashes of the
blocks, after it was made sure that no two different blocks of this corpus share one; blocks that
do are joined by their bytes.

Defined results: null text counts as empty, and all empty texts are equal. Every row counts, also
one that repeats a doc_id and its text; such rows get equal results. A null doc_id counts as the
smallest id. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import ascii_lower, materialize

#: Characters in a block.
BLOCK_CHARS = 8192
_KEYS = ["doc_id", "digest"]


def _cut(text: Column, block_chars: int) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) <= block_chars, F.array(text)).otherwise(pieces)


def _numbered(distinct: DataFrame, key: list[str], odd: int) -> DataFrame:
    """An integer for each row of ``distinct``, which is partitioned by ``key``: sorted place in its partition."""
    return distinct.sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id() * 2 + odd)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, digest, height, at, name) from blocks (doc_id, digest, height, at, block): equal blocks have one name.

    Distinct blocks are numbered in sorted order. Occurrences and names are written tables that are
    joined by the blocks' hashes, so one block may fill any part of the corpus: copies are combined
    before the shuffle of texts, and the join of the small rows can be split.
    """
    hashed = blocks.withColumn("hash", F.xxhash64("block"))
    places = materialize(hashed.drop("block"))
    names = materialize(_numbered(hashed.select("hash", "block").distinct(), ["block"], 0).select("hash", "name"))
    shared = [r[0] for r in names.groupBy("hash").count().filter("count > 1").select("hash").collect()]  # none, short of 1e9 blocks
    keep = [*_KEYS, "height", "at", "name"]
    if not shared:
        return places.join(names, "hash").select(*keep)
    odd = F.col("hash").isin(shared)
    by_bytes = materialize(_numbered(hashed.filter(odd).select("block").distinct(), ["block"], 1))
    return places.filter(~odd).join(names, "hash").select(*keep).unionByName(hashed.filter(odd).join(by_bytes, "block").select(*keep))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, digest, level, name, copies): level and name identify the text of so many equal rows.

    digest is the SHA-256 of the text after lower-casing A-Z; here it only tells apart rows that
    share a doc_id. Rows may appear in several parts.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), _cut(F.col("text"), block_chars).alias("blocks"))
    blocks = rows.select(*_KEYS, F.size("blocks").alias("height"), F.posexplode("blocks").alias("at", "block"))
    named = materialize(_name_blocks(blocks)).withColumn("copies", F.lit(1).cast("bigint"))

    done, level = [], 0
    while True:
        done.append(named.filter("height = 1").select(*_KEYS, F.lit(level).alias("level"), "name", "copies"))
        rest = named.filter("height > 1")
        if rest.isEmpty():
            break
        even = F.col("at") % 2 == 0
        pairs = rest.groupBy(*_KEYS, F.expr("(height + 1) div 2").alias("height"), F.expr("at div 2").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.sum(F.when(even, F.col("copies"))).alias("copies"),
        )
        pairs = materialize(pairs)
        names = materialize(_numbered(pairs.select("left", "right").distinct(), ["left", "right"], 0))
        named = materialize(pairs.join(names, ["left", "right"]).select(*_KEYS, "height", "at", "name", "copies"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id of
    each group stays.
    """
    ids = materialize(identities(docs, id_col, text_col, block_chars))
    groups = materialize(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    rows = ids.join(groups, ["level", "name"])
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return rows.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; columns stay as they are.

    A row is known by its doc_id and its text: another text under the same id stays. Rows that
    repeat the one that stays all stay.
    """
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias("doc_id"), F.unhex("text_sha256").alias("digest")).distinct()
    rows, key = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("own")), gone
    left = rows.join(key, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left_anti")
    return left.select("row.*")
