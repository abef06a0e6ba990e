"""Inventory of an archive of files, by content."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import quarter_end
from ..schemas import MANIFEST

#: Bytes of a file that are hashed at a time.
CHUNK = 1 << 20


def file_source(name: Column) -> Column:
    return F.when(F.lower(name).startswith("calpers"), "CalPERS PEP").when(F.lower(name).rlike("^(oregon|operf)"), "Oregon PERS OPERF").otherwise("")


def file_as_of(name: Column) -> Column:
    """From _YYYY-MM-DD.csv, else the quarter end of YYYYQn; '' if neither."""
    dated = F.try_to_date(F.regexp_extract(name, r"_(\d{4}-\d{2}-\d{2})\.csv$", 1), "yyyy-MM-dd")
    year, quarter = F.regexp_extract(name, r"(\d{4})Q([1-4])", 1).try_cast("int"), F.regexp_extract(name, r"(\d{4})Q([1-4])", 2).try_cast("int")
    return F.coalesce(dated.cast("string"), quarter_end(year, quarter).cast("string"), F.lit(""))


def digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``path``, ``sha256`` and ``newlines`` of files (path); a file passes through in pieces, whatever its length."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                state, newlines = hashlib.sha256(), 0
                with store.open_input_stream(inner) as stream:
                    while piece := stream.read(chunk):
                        state.update(piece)
                        newlines += piece.count(b"\n")
                rows.append((path, state.hexdigest(), newlines))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "sha256", "newlines"])

    # files are dealt out one by one, as each may be large
    return files.select("path").repartition("path").mapInArrow(run, "path string, sha256 string, newlines long")


def build(spark: SparkSession, pattern: str, kind: str, old: DataFrame | None = None) -> DataFrame:
    """One row per file; the capture time stays while the bytes do."""
    # content is not read here
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    # named by their place below the pattern's fixed folder, so that folders may hold files of one name
    root = spark._jvm.org.apache.hadoop.fs.Path(re.split(r"[*?\[{]", pattern)[0].rpartition("/")[0]).toUri().getPath()
    file, name = F.substring("path", F.instr("path", f"{root}/") + len(root) + 1, F.length("path")), F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", file.alias("file"), file_source(name).alias("source"), file_as_of(name).alias("as_of"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_utc")).filter(~F.col("file").rlike(r"(^|/)MANIFEST\.csv(/|$)"))
    lines = F.greatest(F.col("newlines") - 1, F.lit(0)).cast("string") if kind == "snapshot" else F.lit("")
    now = listed.join(digests(listed), "path").select(F.lit(kind).alias("kind"), "file", "source", "as_of", "captured_utc", "sha256", lines.alias("rows"))
    if old is None:
        return now
    before = old.select("file", F.col("sha256").alias("_sha"), F.col("captured_utc").alias("_at"))
    return now.join(before, "file", "left").withColumn("captured_utc", F.when(F.col("_sha") == F.col("sha256"), F.col("_at")).otherwise(F.col("captured_utc"))).select(*MANIFEST.fieldNames())


def compare(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(file, state): missing, untracked or changed."""
    a, b = recorded.select("file", F.col("sha256").alias("_a")), present.select("file", F.col("sha256").alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "untracked").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "file", "full").select("file", state.alias("state")).filter("state is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    from .readers import exists

    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("header", True).csv(path).na.fill("")


def archive(spark: SparkSession, snapshots: str, raw: str | None = None, old: DataFrame | None = None) -> DataFrame:
    """The manifest of an archive: its snapshots, and the raw files they were made from."""
    found = build(spark, snapshots, "snapshot", old)
    return found if raw is None else found.unionByName(build(spark, raw, "raw", old))


def write(spark: SparkSession, snapshots: str, path: str, raw: str | None = None) -> DataFrame:
    """Rebuilds and saves the manifest at ``path``; what has not changed keeps its capture time, so a second call changes nothing.

    The new manifest is complete before it takes the old one's place.
    """
    archive(spark, snapshots, raw, read(spark, path)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.new")
    made, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(target, True)
    if not store.rename(made, target):
        raise OSError(f"cannot move the manifest to {path}")
    return read(spark, path)
