"""Incremental ingestion against the registry, as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.dedup import drop_known, first_entries
from folioforge.sources.registry import Registry


def incremental_ingest(spark: SparkSession, source: str, registry: str, checkpoint: str, kind: str = "doc_id bigint, text string", stream_name: str = "stream") -> StreamingQuery:
    """Read new files of ``source``, and add the hashes of contents not seen before to ``registry``.

    A batch reads only the folders of the registry that its hashes may be in. It is added under the
    name of the stream and its number, and does not count what it added before as known: a batch that
    runs again after a failure leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        known, key = Registry(batch.sparkSession, registry), f"{stream_name}-{number}"
        known.append(first_entries(drop_known(batch, known, without=key)), key)

    stream = spark.readStream.schema(kind).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
