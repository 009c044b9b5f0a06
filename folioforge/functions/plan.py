"""Small helpers that shape plans."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch, about.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession | None = None) -> None:
    """Let no Arrow batch of the session (the active one) grow far beyond BATCH_BYTES, however long the texts are."""
    spark = spark or SparkSession.active()
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def release_memory() -> None:
    """Give back what earlier batches of this Python worker freed but the allocators kept."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed once per row.

    The optimizer merges projections, and a long expression that many columns above use would be
    repeated in each of them. It does not merge them through a generator; this one makes exactly
    one row of each row, and filters on the other columns still pass it.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table as it is read, dealt over all cores if they come in fewer parts than there are cores.

    Large tables come in enough parts and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
