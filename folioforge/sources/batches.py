"""Tables that grow by batches: a batch that is written again replaces itself, and many batches become one.

A table is a folder of batches. A batch is written aside and appears by one rename. If it takes the
place of others (an earlier try of the same batch, or those a compaction merged), a file inside
it names them; from the rename on readers leave them out, and then they are removed. So a job that
runs again leaves the same rows, and no reader sees rows twice or misses any.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPLACES = "_replaces"


class Batches:
    """The batches in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._folder("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _replaced_by(self, name: str) -> list[str]:
        file = self._folder(f"{name}/{_REPLACES}")
        if not self._fs.exists(file):
            return []
        stream = self._fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.splitlines()

    def names(self, without: str | None = None) -> list[str]:
        """The folders of the batches that count, in order; ``without`` is the key of one to leave out."""
        if not self._fs.exists(self._folder("")):
            return []
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._folder("")) if s.isDirectory() and s.getPath().getName().startswith("batch="))
        gone = {old for name in found for old in self._replaced_by(name)}
        return [name for name in found if name not in gone and (without is None or key_of(name) != without)]

    def paths(self, inside: str = "", without: str | None = None) -> list[str]:
        return [f"{self.path}/{name}{inside}" for name in self.names(without)]

    def publish(self, key: str | Callable[[str], str], write: Callable[[str], None], replaces: Sequence[str] | None = None) -> None:
        """Let ``write`` fill a folder, and make it the batch ``key`` in place of ``replaces``, or of the batch of that key.

        ``key`` may be a function of the folder that was filled.
        """
        aside = f"_aside-{uuid.uuid4().hex}"
        write(f"{self.path}/{aside}")
        key = key if isinstance(key, str) else key(f"{self.path}/{aside}")
        old = list(replaces) if replaces is not None else [name for name in self.names() if key_of(name) == key]
        if old:
            out = self._fs.create(self._folder(f"{aside}/{_REPLACES}"))
            try:
                out.write(bytearray("\n".join(old).encode()))
            finally:
                out.close()
        name = f"batch={key}+{uuid.uuid4().hex[:12]}"
        if not self._fs.rename(self._folder(aside), self._folder(name)):
            raise OSError(f"{self.path}/{aside} could not be renamed to {name}")
        self.remove(old)

    def remove(self, names: Sequence[str]) -> None:
        for name in names:
            self._fs.delete(self._folder(name), True)

    def read(self, schema: str, inside: str = "", without: str | None = None) -> DataFrame:
        """The rows of all batches that count."""
        return self.read_folders(schema, self.paths(inside, without))

    def read_folders(self, schema: str, paths: Sequence[str]) -> DataFrame:
        """The files in some folders, whose names are not columns."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def compact(self, schema: str, files: int = 1) -> None:
        """Merge all batches into one of ``files`` files. What else reads or adds batches meanwhile is not disturbed."""
        old = self.names()
        if len(old) > 1:
            rows = self.read_folders(schema, [f"{self.path}/{name}" for name in old])
            self.publish(f"merged-{uuid.uuid4().hex[:8]}", lambda to: rows.repartition(files).write.parquet(to), old)


def key_of(name: str) -> str:
    """The key of a batch, from its folder's name."""
    return name.removeprefix("batch=").rsplit("+", 1)[0]


def content_key(rows: DataFrame, columns: Sequence[str]) -> str:
    """A key that follows from the rows alone, in any order: the same job gets the same one."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), *columns)).alias(f"x{seed}") for seed in (1, 2)]).first()
    return f"{facts['n']}-{(facts['x1'] or 0) & (1 << 64) - 1:016x}{(facts['x2'] or 0) & (1 << 64) - 1:016x}"
