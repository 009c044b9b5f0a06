"""Shared helpers of the ten corpus operators: scratch tables, memo tables, row hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.plan import BATCH_BYTES, bound_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder.

    A temporary folder is set only where the session names none and runs on a single machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioforge-"))
    return sc.getCheckpointDir()


#: Folders of scratch tables that this process wrote and did not remove, and the lists of those who asked for theirs.
_written: list[str] = []
_asking: ContextVar[tuple[list[str], ...]] = ContextVar("asking", default=())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: the written table survives the loss of any executor, and branches
    that read it see the same rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    for paths in (_written, *_asking.get()):
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The scratch tables that are still there."""
    return list(_written)


@contextlib.contextmanager
def own_tables() -> Iterator[list[str]]:
    """A list of the scratch tables that this thread writes inside the block, in order, without those removed there."""
    mine: list[str] = []
    token = _asking.set((*_asking.get(), mine))
    try:
        yield mine
    finally:
        _asking.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables from the shared folder. Nothing that is still to be read may depend on them."""
    for path in list(paths):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        for known in (_written, *_asking.get()):
            if path in known:
                known.remove(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only.

    For ASCII texts that is what lower() does, several times as fast as translate().
    """
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def in_hash_sample(key: Column, wanted: int, total: int) -> Column:
    """Whether a row is in a sample of about 2 * ``wanted`` rows of ``total``, chosen by the hash of its key.

    What the driver then collects is bounded by that number, not by the number of partitions, as it
    would be for the first rows of a sort.
    """
    share = min(1.0, 2 * wanted / max(1, total))
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))


class Memo(dict):
    """A memo table of bounded size for ``fn``: two generations, the older one is dropped when
    the newer one is full, so frequent keys stay. Strings of over ``longest`` characters are not kept."""

    _all: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, fn: Callable, limit: int, longest: int = 64) -> None:
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}
        Memo._all.add(self)

    __hash__ = object.__hash__

    @classmethod
    def keep_only(cls, *memos: Memo) -> None:
        """Empty all other memo tables of this Python worker: what an earlier stage left in it."""
        for other in list(cls._all):
            if not any(other is m for m in memos):
                other.clear()
                other.old = {}

    def __missing__(self, key):
        if not isinstance(key, int) and len(key) > self.longest:
            return self.fn(key)
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker freed but the allocators kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that is made once per task."""

    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fn = make()
        release_memory()
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """The values of a string column; null becomes the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]
