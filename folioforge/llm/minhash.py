"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles. Under each permutation both the minimum and
the maximum are kept, so a signature takes half the hash evaluations; bands of six values put
documents into buckets. With 28 bands a pair at the threshold (Jaccard 0.85) is missed with
probability under 2e-6, a closer one far less often. Lower thresholds take shorter bands
(0.80: 33 bands of five values, about 2e-6).

Links are confirmed on full sets, and no group is compared pair by pair:

1. documents with equal sets are one class, represented by its smallest doc_id;
2. in each bucket all classes are compared with two pivots, the first ones of two fixed random
   orders; the links found this way already join most of what belongs together;
3. what is left are classes that share a bucket but are not yet in one component. Most of those
   cannot be linked at all: if p of a set's n shingles occur in no other candidate, at most n - p
   are shared with any. That bound is exact; the pairs it leaves are compared as well.

Defined results: a text that is null or has no words has an empty set and is linked with nothing;
so is a row whose doc_id is null. doc_id is a key; rows that repeat a document share its result.
An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import shingles as sh
from folioforge.llm.components import components
from folioforge.llm.util import map_batches, materialize, strings

#: Percent: documents are linked if 100 * intersection >= THRESHOLD * union, unless a caller gives another threshold.
THRESHOLD = 85
#: Partners of a pivot that are compared with one copy of its text, about.
PIVOT_SHARE = 256
#: Classes of shingles by which the size of an intersection is bounded.
CLASSES = 64
_ORDERS = (11, 23)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_shingles, print_a, print_b, bands): a hash of the text, the fingerprint of its set and its band keys."""
    shape = sh.bands_for(threshold)

    def make():
        sh.forget_others()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, first, second, bands = [], [], [], []
            for text in strings(batch.column(2)):
                s = sh.shingle_set(text)
                size.append(len(s))
                a, b = sh.fingerprint(s) if len(s) else (0, 0)
                first.append(a)
                second.append(b)
                bands.append(sh.band_keys(sh.signature(s), *shape) if len(s) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "print_a", "print_b", "bands"],
            )

        return run

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col))
    return map_batches(rows, make, "doc_id bigint, text_key bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>")


def _first(seed: int) -> Column:
    """The first document of a bucket in the random order ``seed``."""
    return F.min(F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("rank"), "doc_id"))


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach the threshold.

    The text of ``b`` meets those of its partners; its partners are dealt over several tasks, each
    of which reads one copy of b's text and then one partner after the other.
    """
    pairs = materialize(pairs)
    hot = materialize(pairs.groupBy("b").count().filter(F.col("count") > PIVOT_SHARE).select("b", F.expr(f"count div {PIVOT_SHARE} + 1").alias("parts")))
    dealt = materialize(pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a", F.lit(7)), F.coalesce("parts", F.lit(1))).alias("part")))
    partners = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "text")
    pivots = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "part", F.lit(None).cast("bigint").alias("a"), "text")
    rows = partners.unionByName(pivots).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sh.forget_others()
        pivot, own = None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = sh.shingle_set(text)
                if a is None:
                    pivot, own = b, s
                elif b == pivot:
                    n = sh.shared(own, s)
                    if 100 * n >= threshold * (len(own) + len(s) - n):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return materialize(rows.mapInArrow(run, "a bigint, b bigint"))


def _class_counts(name: str) -> Column:
    return F.array(*[F.count_if(F.pmod("shingle", F.lit(CLASSES)) == k) for k in range(CLASSES)]).alias(name)


def _shareable(texts: DataFrame, sizes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n, counts): how many shingles, by class, a document may share with any other of ``texts``.

    Shingles fall into CLASSES classes by their last bits; those that no other document holds are
    not counted. Documents that cannot be linked are left out; without them the second pass
    bounds better.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [sh.shingle_set(t).view(np.int64) for t in strings(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

        return run

    rows = map_batches(texts, make, "doc_id bigint, shingles array<bigint>").select("doc_id", F.explode("shingles").alias("shingle"))
    total = materialize(rows.groupBy("doc_id").agg(_class_counts("counts")).join(sizes, "doc_id"))
    alive = total
    for _ in range(2):
        once = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).filter("doc_id = other")
        own = once.groupBy("doc_id").agg(_class_counts("own"))
        left = F.when(F.col("own").isNull(), F.col("counts")).otherwise(F.zip_with("counts", "own", lambda x, y: x - y))
        alive = alive.select("doc_id").join(total, "doc_id").join(own, "doc_id", "left").select("doc_id", "n", left.alias("counts"))
        alive = alive.withColumn("most", F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y))
        alive = materialize(alive.filter(100 * F.col("most") >= threshold * F.col("n")))
        rows = rows.join(alive.select("doc_id"), "doc_id", "left_semi")
    return alive


def near_duplicate_links(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between class representatives that join every component; ``signed`` has the same threshold."""
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "print_a", "print_b").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    reps = materialize(classes.select("x.doc_id", F.col("n_shingles").alias("n"), "x.bands"))

    places = reps.select("doc_id", F.explode("bands").alias("key"))
    firsts = [_first(s).alias(f"p{s}") for s in _ORDERS]
    buckets = places.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *firsts).filter("size > 1")
    buckets = materialize(buckets.select("key", *[F.col(f"p{s}.doc_id").alias(f"p{s}") for s in _ORDERS]))
    full = materialize(places.join(buckets, "key"))

    candidates = full.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = materialize(texts.join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    stars = [full.select(F.col("doc_id").alias("a"), F.col(f"p{s}").alias("b")) for s in _ORDERS]
    links = confirm(stars[0].unionByName(stars[1]).filter("a <> b").distinct(), texts, threshold)
    labels = components(links)

    places = full.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    places = materialize(places)
    mixed = materialize(places.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
    places = materialize(places.join(mixed, "key", "left_semi"))
    left = materialize(places.select("doc_id").distinct())
    bound = _shareable(texts.join(left, "doc_id", "left_semi"), reps.select("doc_id", "n").join(left, "doc_id", "left_semi"), threshold)
    side = places.join(bound, "doc_id").join(reps.select("doc_id", "bands"), "doc_id")
    side = materialize(side)
    return links.unionByName(confirm(_open_pairs(side, threshold), texts, threshold))


def _open_pairs(side: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs in one bucket and two components that the bounds leave; each from its first common bucket.

    A pair shares at most the smaller of its two totals, and at most the sum of the smaller counts
    of each class, which also sees most of what the two do not share.
    """
    x, y = side.alias("x"), side.alias("y")
    reach = lambda most: 100 * most >= threshold * (F.col("x.n") + F.col("y.n") - most)
    fits = reach(F.least(F.col("x.most"), F.col("y.most")))
    by_class = F.aggregate(F.zip_with("x.counts", "y.counts", lambda p, q: F.least(p, q)), F.lit(0).cast("bigint"), lambda p, q: p + q)
    here = (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    first = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key")
    return x.join(y, here & fits & first & reach(by_class)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each row of ``docs``."""
    signed = materialize(signatures(docs, id_col, text_col, threshold))
    labels = components(near_duplicate_links(docs, signed, id_col, text_col, threshold))
    key = ["n_shingles", "print_a", "print_b"]
    filled = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"))
    classes = materialize(filled.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component")))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "text_key", *key).join(classes, key, "left")
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return _labelled(docs, id_col, text_col, threshold).drop("text_key").withColumnRenamed("doc_id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component; columns stay as they are.

    Rows without words or without doc_id stay, and rows that repeat the one that stays. doc_id is
    a key: texts that share one count as one document for the links, so they stay or go together
    where both are near copies; a text without near copies stays whatever else has its id, unless
    that is a near copy of a document with a smaller id.
    """
    gone = _labelled(docs, id_col, text_col, threshold).filter("not kept").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("own"))
    left = rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("own") == F.col("text_key")), "left_anti")
    return left.select("row.*")
