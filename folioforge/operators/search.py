"""Substring search through an index of trigrams, for searches that should not scan every profile.

The searched text of a profile is cut into its distinct trigrams. A posting holds the sorted ids of one
gram in one segment of the profiles, so the list of a gram that every profile has is many short
ones. Postings lie in folders by the hash of their gram. A search reads the folders of its own grams,
intersects the lists segment by segment, and verifies what is left on the texts, which are stored by
segment next to the postings. Texts are closed by a mark on either side, so that searches of one or
two characters have grams as well: all those that hold them.

Profiles are added in batches; a batch of the same key takes the place of the earlier one.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.profiles import searched_text
from folioforge.sources.batches import Batches

GRAM = 3
#: Profiles in a segment, about, and folders of postings.
SEGMENT_ROWS, FOLDERS = 8_192, 32
_MARK = "\x00"
_POSTINGS = "gram string, segment bigint, ids array<string>, batch string"
_TEXTS = "id string, text string, segment bigint, batch string"


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text and its marks."""
    whole = F.concat(F.lit(_MARK), text, F.lit(_MARK))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - (GRAM - 1)), lambda i: F.substring(whole, i, F.lit(GRAM))))


def _folder(gram: str) -> int:
    return zlib.crc32(gram.encode()) % FOLDERS


class SearchIndex:
    """The index at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.batches = spark, Batches(spark, path)

    def add(self, flat: DataFrame, key: str) -> None:
        """Index flat profiles as the batch ``key``. Rows without an id cannot be found and are left out."""
        rows = flat.filter("id is not null").select("id", F.lower(searched_text()).alias("text"))

        def write(to: str) -> None:
            rows.write.parquet(f"{to}/_rows")
            stored = self.spark.read.schema("id string, text string").parquet(f"{to}/_rows")
            segments = max(1, -(-stored.count() // SEGMENT_ROWS))
            placed = stored.withColumns({"segment": F.pmod(F.xxhash64("id"), F.lit(segments)), "batch": F.lit(key)})
            placed.repartition("segment").sortWithinPartitions("segment", "id").write.parquet(f"{to}/texts")
            pairs = placed.select("id", "segment", "batch", F.explode(grams_of(F.col("text"))).alias("gram"))
            lists = pairs.groupBy("batch", "gram", "segment").agg(F.array_sort(F.collect_set("id")).alias("ids"))
            lists = lists.withColumn("folder", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(FOLDERS)))
            lists.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{to}/postings")
            self.batches.remove([f"{to.rsplit('/', 1)[1]}/_rows"])

        self.batches.publish(key, write)

    def _postings(self, folders: list[int] | None) -> DataFrame:
        inside = [f"/postings/folder={n}" for n in folders] if folders is not None else ["/postings"]
        fs, found = self.batches._fs, []
        for path in (p for part in inside for p in self.batches.paths(part)):
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
                found.append(path)
        return self.batches.read_folders(_POSTINGS, found)

    def candidates(self, search: str) -> DataFrame:
        """(batch, segment, id): profiles that hold every gram of ``search``, which is lower case and not blank."""
        if len(search) < GRAM:
            some = self._postings(None).filter(F.contains("gram", F.lit(search)))
            return some.select("batch", "segment", F.explode("ids").alias("id")).distinct()
        grams = sorted({search[i : i + GRAM] for i in range(len(search) - GRAM + 1)})
        lists = self._postings(sorted({_folder(g) for g in grams})).filter(F.col("gram").isin(grams))
        whole = lists.groupBy("batch", "segment").agg(F.count(F.lit(1)).alias("n"), F.collect_list("ids").alias("lists")).filter(F.col("n") == len(grams))
        both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return whole.select("batch", "segment", F.explode(both).alias("id"))

    def search(self, text: str) -> DataFrame:
        """(id): the profiles whose searched text holds ``text``, case aside; all of them if it is blank."""
        texts = self.batches.read(_TEXTS, "/texts")
        wanted = text.strip().lower()
        if not wanted:
            return texts.select("id")
        found = texts.join(self.candidates(wanted), ["batch", "segment", "id"], "left_semi")
        return found.filter(F.contains("text", F.lit(wanted))).select("id")
