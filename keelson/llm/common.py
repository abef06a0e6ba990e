"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Texts reach Python in batches of at most so many rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sizes the batches of this session for long texts, so that workers stay small, and lets workers find this package."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, to be read in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(mod)


_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where its absence is an
    error. In local mode, as in tests, a folder of this process takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="keelson-"))
    return _local[0]


def sampled_ids(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids, the first by hash.

    A hash threshold leaves about twice as many, so what partitions send to be
    sorted stays bounded however many they are.
    """
    ids = df.select(id_col).filter(F.col(id_col).isNotNull())
    share = 2 * most / max(1, ids.count())
    if share < 1:
        ids = ids.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40)) < int(share * (1 << 40)))
    return ids.distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)


class Workspace:
    """Tables written to the shared folder, which cut the lineage.

    ``keep`` writes a DataFrame as Parquet and reads it again with the schema
    it had; ``drop`` removes what is no longer needed, and the rest goes when
    the driver's JVM ends. The rows survive the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        store, path = self._place("")
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(out)
        schema = df.schema
        del df
        self._release_shuffles()
        return self.spark.read.schema(schema).parquet(out)

    def stored_bytes(self, name: str) -> int:
        store, path = self._place(name)
        return store.getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            store, path = self._place(name)
            store.delete(path, True)

    def _release_shuffles(self) -> None:
        """Spark deletes the files of a shuffle once the driver forgets its plan."""
        gc.collect()
        self.spark._jvm.System.gc()


class Cache(dict):
    """A dict that computes what it lacks and starts anew when it is full."""

    def __init__(self, make, size: int = 1 << 18) -> None:
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.make(key)
        return value
