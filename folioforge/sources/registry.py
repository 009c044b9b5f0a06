"""The registry of content hashes, laid out so that a batch of new documents reads little of it.

A batch of entries is stored by the first digits of its hashes, with a sketch: a Bloom filter, cut
by the leading digits of the hashes into blocks of 32,768 bits. Hashes are SHA-256 in hex, so their
digits are the random bits that the filter needs, and it is built and asked with bitmap functions
alone. To find which of some hashes are known, they are joined with the blocks of all batches; what the
sketches do not rule out names the folders it may be in, and only those are read.

Null hashes are kept with the entries but are equal to nothing.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.batches import Batches, content_key, key_of

ENTRIES = "doc_id string, content_hash string"
_SKETCH = "batch string, digits int, block string, bits binary"
#: Bits of a block, bits set for a hash, hashes in a block at most on average, and entries in a folder, about.
BLOCK_BITS, PROBES, BLOCK_HASHES, FOLDER_ROWS = 32_768, 5, 2_000, 1_000_000
_SKETCHES = "/_sketch"


def _log16(x: float) -> int:
    return max(0, math.ceil(math.log(max(1.0, x), 16)))


def _positions(content_hash: Column) -> Column:
    """The bits of a hash inside its block: digits far behind those that choose the block."""
    return F.array(*[F.conv(F.substring(content_hash, 17 + 4 * i, 4), 16, 10).cast("bigint") % BLOCK_BITS for i in range(PROBES)])


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def sketch(hashes: DataFrame, n: int) -> DataFrame:
    """(block, bits) of the ``n`` rows of ``hashes``."""
    place = hashes.filter("content_hash is not null").select(F.substring("content_hash", 1, _log16(n / BLOCK_HASHES)).alias("block"), F.explode(_positions(F.col("content_hash"))).alias("position"))
    return place.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))


class Registry:
    """The registry at ``path``; nothing is there before the first entries are added."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.batches = spark, Batches(spark, path)

    def rows(self, without: str | None = None) -> DataFrame:
        """(doc_id, content_hash) of all batches, or of all but one."""
        return self.batches.read(ENTRIES, "/entries", without)

    def _write(self, entries: DataFrame, key: str | None, replaces: list[str] | None = None) -> None:
        flat = f"_aside-{uuid.uuid4().hex}"  # what entries come from is costly; they are small
        entries.write.parquet(f"{self.batches.path}/{flat}")
        rows = self.spark.read.schema(ENTRIES).parquet(f"{self.batches.path}/{flat}")
        name = key if key is not None else content_key(rows, rows.columns)
        n = rows.count()
        digits = 1 + _log16(n / 16 / FOLDER_ROWS)

        def write(to: str) -> None:
            prefix = F.coalesce(F.substring("content_hash", 1, digits), F.lit("none"))
            rows.withColumn("prefix", prefix).repartition("prefix").write.partitionBy("prefix").parquet(f"{to}/entries")
            sketch(rows, n).select(F.lit(name).alias("batch"), F.lit(digits).alias("digits"), "block", "bits").write.parquet(f"{to}{_SKETCHES}")

        self.batches.publish(name, write, replaces)
        self.batches.remove([flat])

    def append(self, entries: DataFrame, key: str | None = None) -> None:
        """Add (doc_id, content_hash) rows as the batch ``key``, in place of an earlier one of that key.

        Without a key it follows from the rows, so that the same rows are added once.
        """
        self._write(entries.select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash"), key)

    def folders(self, hashes: DataFrame, without: str | None = None) -> list[str]:
        """The folders that may hold some of ``hashes``, by the sketches."""
        names = {key_of(name): name for name in self.batches.names(without)}
        if not names:
            return []
        sketches = self.batches.read(_SKETCH, _SKETCHES, without)
        depths = sorted(r.n for r in sketches.select(F.length("block").alias("n")).distinct().collect())  # a handful: one for each order of size
        asked = hashes.filter("content_hash is not null").select("content_hash", _positions(F.col("content_hash")).alias("positions"))
        asked = asked.select("*", F.explode(F.array(*[F.substring("content_hash", 1, n) for n in depths]) if depths else F.array().cast("array<string>")).alias("block"))
        maybe = asked.join(sketches, "block").filter(F.forall("positions", lambda p: _has_bit(F.col("bits"), p)))
        found = maybe.select("batch", F.expr("substr(content_hash, 1, digits)").alias("prefix")).distinct().collect()  # folders, not hashes
        return sorted(f"{self.batches.path}/{names[r.batch]}/entries/prefix={r.prefix}" for r in found)

    def candidates(self, hashes: DataFrame, without: str | None = None) -> DataFrame:
        """The content_hash of the entries in the folders that may hold some of ``hashes``."""
        return self.batches.read_folders(ENTRIES, self.folders(hashes, without)).select("content_hash")

    def compact(self) -> None:
        """Merge all batches into one, with folders and a sketch for their common size."""
        old = self.batches.names()
        if len(old) > 1:
            self._write(self.rows(), f"merged-{uuid.uuid4().hex[:8]}", old)
