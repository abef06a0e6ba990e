"""The dated archive: partitions that are added once and never changed.

A write stages the partitions that the archive lacks and moves each to its place
as a whole, without overwriting. Whoever comes second finds the place taken and
lets go of its copy, so two writers, a repeated job and a driver that died
between two moves all leave one whole copy of each date.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import require_columns

KEYS = ("source", "as_of")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, path: str, depth: int = len(KEYS)) -> list[str]:
    """The archive's partition folders below ``path``, as source=.../as_of=...; a name for each date."""
    root, store = _files(spark, path)
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "/".join(["*=*"] * depth))) if store.exists(root) else None
    base = store.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    return sorted(str(f.getPath().toUri().getPath()).removeprefix(base) for f in found or ())


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the folder took its place, which nobody may have taken before."""
    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def append_only_sink(df: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> list[str]:
    """Adds the dates of ``df`` that the archive lacks; returns the partitions added.

    Known dates stay as they are, whatever ``df`` says of them. A row without a
    source or date is an error, and then nothing is added.
    """
    spark = df.sparkSession
    require_columns(df, keys, "archive")
    known = partitions(spark, path, len(keys))
    if known:
        # a row for each date of the archive
        values = [tuple(spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(x.partition("=")[2]) for x in p.split("/")) for p in known]
        have = spark.createDataFrame(values, T.StructType([T.StructField(f"_have_{k}", T.StringType()) for k in keys]))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).cast("string") == F.col(f"_have_{k}")
        df = df.join(have, same, "left_anti")
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    place, store = _files(spark, staged)
    try:
        # all of a date in few files, a large one in several
        df.repartition(*keys, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(4))).write.partitionBy(*keys).parquet(staged)
        fresh = partitions(spark, staged, len(keys))
        if any("__HIVE_DEFAULT_PARTITION__" in p for p in fresh):
            raise ValueError(f"rows without {' or '.join(keys)} can't be archived")
        added = []
        for p in fresh:
            target = f"{path.rstrip('/')}/{p}"
            store.mkdirs(_files(spark, target)[0].getParent())
            if _moved(spark, f"{staged}/{p}", target):
                added.append(p)
        return added
    finally:
        store.delete(place, True)


def read_archive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All dates of the archive."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)
