"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` are (name, function) pairs; every function takes (spark, docs,
sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of documents.

Columns beyond doc_id and text travel as one struct, so their names can't
clash with those of an operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontam, packing, signatures, substrings, toxicity
from keelson.llm.common import Workspace, small_batches, table

WINDOW = 50


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in the struct _rest."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def _unfolded(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier holds for toxic go.

    Null and empty texts score the model's bias, which is below one half unless
    most labelled texts are toxic; equal texts are judged alike, whatever their
    ids; without toxic labels nothing is learned and nothing goes; an empty
    table stays empty.
    """
    folded = _folded(docs)
    model = toxicity.train(folded, table(spark, sf_dir, "labels"))
    return _unfolded(toxicity.score(folded, model, keep=("text", "_rest")).filter("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by Jaccard similarity 0.8 of five-word shingles, the one with the least doc_id stays.

    Null, empty and wordless texts link with nothing and stay, one for each id.
    Of rows that repeat both id and text one stays, whichever; of different
    texts with one id that are linked, the one with the least MD5; a null id is
    less than any. An empty table stays empty.
    """
    small_batches(spark)
    keyed = _folded(docs).withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("md5")))
    classes = Workspace(spark, "classes").keep(signatures.similar_classes(keyed, shingle_words=5, percent=80, id_col="_key").select("_key", (F.col("_key") == F.col("component_id")).alias("first")), "classes")
    kept = keyed.join(classes.filter("first").select("_key").distinct(), "_key", "left_semi")
    repeated = classes.filter("first").groupBy("_key").count().filter("count > 1").select("_key")
    if not repeated.isEmpty():
        # rows that repeat both id and text
        once = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(repeated, "_key", "left_anti").unionByName(once)
    return _unfolded(kept, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that occur elsewhere are cut out.

    Every copy of a passage goes, those within one text too; null texts stay
    null, short ones whole, and rows stay even if nothing is left of their
    text. n_chars follows the text. An empty table stays empty.
    """
    small_batches(spark)
    cut = substrings.dedup_substrings(_folded(docs), window=WINDOW, keep=("_rest",))
    rows = _unfolded(cut, docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike; an
    empty benchmark drops nothing; an empty table stays empty.
    """
    leaks = decontam.find_leaks(_folded(docs), table(spark, sf_dir, "benchmark"), keep=("text", "_rest"))
    return _unfolded(leaks.filter(F.size("leaks") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in sequences of 4096.

    Null and empty texts are one token, the end mark; equal lengths are packed
    in any order; repeated rows are packed each; an empty table has no piece.
    """
    small_batches(spark)
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Training a classifier, retrieval and tokenizing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            space.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
