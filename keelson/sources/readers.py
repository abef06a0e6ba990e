"""Readers with explicit schemas, and the dated archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SNAPSHOT, require_columns


def csv_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def override_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Hand-checked mapping with # comments; an absent file is an empty table.

    Families map raw stems, sponsors map families. Missing columns, a key that
    is mapped twice and, for families, an unknown decision or a merge into a
    stem that is itself merged are errors.
    """
    from ..operators.entity import override_faults

    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    as_text = spark.read.option("header", True).option("comment", "#").option("escape", '"')
    read = require_columns(as_text.csv(path), schema.fieldNames(), path).na.fill("").select(*(F.col(f.name).cast(f.dataType) for f in schema))
    family = "firm_id_canonical" in schema.fieldNames()
    faults = override_faults(read, *(("firm_id_raw", "firm_id_canonical") if family else ("firm_id", None)))
    # at most ten rows
    told = sorted({tuple(r) for r in faults.limit(10).collect()})
    if told:
        raise ValueError(f"{path} has faults: {told}")
    return read


def archive_scan(spark: SparkSession, pattern: str, least: int = 2) -> DataFrame:
    """All dated snapshots of an archive, with the file each row came from."""
    df = csv_scan(spark, pattern, SNAPSHOT).withColumn("file", F.col("_metadata.file_name"))
    if df.select("file").distinct().limit(least).count() < least:
        raise ValueError(f"{pattern} has fewer than {least} snapshots")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_latest(spark: SparkSession, working: str, pattern: str) -> str:
    """The working copy if there is one, else the last dated file by name."""
    if exists(spark, working):
        return working
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    paths = sorted(str(f.getPath()) for f in found or [])
    if not paths:
        raise FileNotFoundError(pattern)
    return paths[-1]


def _opened(url: str, timeout: int):
    from urllib.request import Request, urlopen

    return urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout)


def fetch_text(url: str, timeout: int = 60) -> str:
    """A page by HTTP; used before a plan, never in one. Bytes that are no UTF-8 are left out."""
    with _opened(url, timeout) as answer:
        return answer.read().decode("utf-8", "ignore")


def download_once(spark: SparkSession, url: str, target: str, timeout: int = 120) -> bool:
    """Fetches bytes unless the target exists, in any store that Spark reads; never overwrites.

    The bytes are complete before they take the target's name.
    """
    import uuid

    if exists(spark, target):
        return False
    with _opened(url, timeout) as answer:
        data = answer.read()
    path = spark._jvm.org.apache.hadoop.fs.Path
    place, part = path(target), path(f"{target}.{uuid.uuid4().hex}.part")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if exists(spark, target) or not store.rename(part, place):
        store.delete(part, False)
        return False
    return True


def csv_sink(df: DataFrame, path: str) -> None:
    """A result table; it replaces an earlier one."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; it goes when the driver's JVM ends. Only local mode needs no spark.checkpoint.dir."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/keelson-{uuid.uuid4().hex}/{name}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    store.deleteOnExit(path.getParent())
    return path.toString()
