"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A profile is the list of a text's most frequent character n-grams (n = 1 to 3)
by falling count. A text is assigned to the language whose profile has the
smallest out-of-place distance to its own. Texts are lower-cased; runs of
anything but letters count as one space.

An n-gram is one 64-bit integer, 21 bits a code point. Profiles are learned
from at most about ``per_language`` ids of each language, picked by a hash, and
one text of each; prediction reads every whole text.

Defined results: null text, or text without a letter, is ``und`` with score
0; with no training text at all every text is ``und``; ties go to the
language that sorts first, ties of n-grams to the lesser; of an id's texts in a
language that with the least hash is trained on, and repeated rows have equal
results; texts of any length are read whole; an empty table gives an empty
table; further columns, also named like those of the result, do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table

BITS = 21
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased letters with one space around and between words; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[raw]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.where(is_letter, raw, 32).astype(np.int64)
    points = np.concatenate([[32], points, [32]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def ngrams(points: np.ndarray) -> np.ndarray:
    two = (points[:-1] << BITS) | points[1:]
    three = (two[:-1] << BITS) | points[2:]
    return np.concatenate([points[points != 32], two, three])


def top_ngrams(points: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, the most frequent first; ties by value."""
    grams, counts = np.unique(ngrams(points), return_counts=True)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))[:size]]


def learn(docs: DataFrame, trainable=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, size: int = 400) -> dict[str, list[int]]:
    """The profile of each language."""
    rows = docs.select(id_col, text_col, lang_col).filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if trainable is not None:
        rows = rows.filter(trainable)
    share = rows.groupBy(F.col(lang_col).alias("_lang")).agg((F.lit(float(per_language)) / F.count("*")).alias("_share"))
    # one row for each language
    drawn = rows.join(F.broadcast(share), F.col(lang_col) == F.col("_lang")).filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    # one text of an id, however often it comes
    drawn = drawn.groupBy("_lang", id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias("_text")).select("_lang", "_text")

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(text)
                if len(points):
                    found.setdefault(lang, []).append(ngrams(points))
            for lang, parts in found.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in total:
                    both = np.concatenate([total[lang][0], grams])
                    weight = np.concatenate([total[lang][1], counts])
                    grams, inverse = np.unique(both, return_inverse=True)
                    counts = np.bincount(inverse, weight).astype(np.int64)
                total[lang] = grams, counts
        for lang, (grams, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    summed = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        points = code_points(text)
        if not len(points) or not self.langs:
            return "und", 0.0
        own = top_ngrams(points, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        place = np.arange(len(own))[:, None]
        distance = np.where(theirs < 0, self.size, np.abs(theirs - place)).sum(0)
        return self.langs[int(distance.argmin())], float(1 - distance.min() / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (1 at distance 0) of each whole text."""
    source = docs.select(id_col, F.col(text_col).alias("_text"))
    schema = T.StructType([source.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        ranker = Ranker(profiles, size)
        for batch in batches:
            found = [ranker.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], [batch.schema.names[0], "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs, trainable=fold("doc_id", 4) != 2)
    return predict(docs, profiles).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
