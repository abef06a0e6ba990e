"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts are the positives; every other training text counts as
unlabelled, whatever its label says. A linear classifier over word and
word-prefix features is fitted in numpy by minimising the class-prior-corrected
risk ``prior * R_p+ + max(0, R_u- - prior * R_p-)`` (Kiryo et al. 2017).

The fit uses every training text, one of each id. A feature counts that is
``min_positive`` times among the positives and significantly commoner there than
among the unlabelled. Texts then matter only by the features they hold: equal
sets are one row with a count, and full-batch steps sum over these rows, on the
driver while they are few and by a Spark job for each step beyond that. The
positives are found by sending their ids to the texts while they are few; what a
text holds is kept as one number for each word, as a word's features follow from
the most special of them.

Defined results: null or empty text scores the model's bias; with no positive
example at all, or none that differs, the model has no feature and scores the
prior; a null id is never used for training and is reported with ``held_out``
false; of an id's texts that with the least hash is trained on, and repeated
rows have equal scores; a score of 0.5 counts as toxic; texts of any length are
read whole; an empty table gives an empty table; further columns, also named
like those of the result, do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, Workspace, fold, table

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Different sets of features that the driver holds at most.
HELD_SETS = 1 << 17
#: Tasks that count features, each of which adds a row for every feature.
TALLIES = 8
#: Ids that go to every task at most; beyond that the texts are shuffled to them.
SENT_IDS = 1 << 20


@dataclass
class ToxicityModel:
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float
    params: dict = field(default_factory=dict)


def word_features(word: str) -> list[str]:
    """The word itself and its first 4, 5 and 6 characters."""
    return ["w" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]


def covered_features(feature: str) -> list[str]:
    """The features of each word that has this one and none more special."""
    return word_features(feature[1:]) if feature[0] == "w" else [f"{n}{feature[1 : n + 1]}" for n in PREFIXES if n <= int(feature[0])]


def text_words(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


class Rows:
    """A matrix of zeros and ones by its ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.shape = row, column, shape

    @classmethod
    def of(cls, found: list[list[int]], width: int) -> Rows:
        return cls(np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([i for f in found for i in f], np.int64), (len(found), width))

    def take(self, rows: np.ndarray) -> Rows:
        """Some rows, each as often as it is named."""
        order = np.argsort(self.row, kind="stable")
        begin = np.searchsorted(self.row[order], np.arange(self.shape[0] + 1))
        n = (begin[1:] - begin[:-1])[rows]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[:-1][rows], n)
        return Rows(np.repeat(np.arange(len(rows)), n), self.column[order][place], (len(rows), self.shape[1]))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], minlength=self.shape[0])

    def sums(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, slope[self.row], minlength=self.shape[1])


def risk_sums(x: Rows, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sums over rows, each counted ``n`` times: the loss as negatives, then its gradient."""
    z = x.dot(theta[:-1]) + theta[-1]
    slope = n / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.concatenate([[n @ np.logaddexp(0, z)], x.sums(slope), [slope.sum()]])


def descend(means, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear nnPU classifier with logistic loss.

    ``means(theta)`` are the ``risk_sums`` a row of the unlabelled and of the
    positives, ``positive`` the mean positive row and a one. Full-batch Adam.
    When the corrected negative risk falls below zero, the step climbs out of
    it instead of fitting the positives away.
    """
    theta = np.zeros(len(positive))
    theta[-1] = math.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        unl, pos = means(theta)
        g = prior * pos[1:] - unl[1:] if unl[0] < prior * pos[0] else unl[1:] - prior * positive
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_nnpu(x: Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: float, n: np.ndarray | None = None, **more) -> tuple[np.ndarray, float]:
    """``descend`` over rows that are held, each counted ``n`` times."""
    n = np.ones(x.shape[0]) if n is None else n
    xu, nu, xp, count_p = x.take(unlabelled), n[unlabelled], x.take(positive), n[positive]
    most = max(count_p.sum(), 1)
    return descend(lambda theta: (risk_sums(xu, nu, theta) / max(nu.sum(), 1), risk_sums(xp, count_p, theta) / most), np.append(xp.sums(count_p), count_p.sum()) / most, prior, **more)


def held_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, Rows, np.ndarray]:
    """Kind, features and count of (kind, found, n) rows."""
    found = batch.column(1)
    return batch.column(0).to_numpy(), Rows(np.repeat(np.arange(len(found)), found.value_lengths().to_numpy()), found.flatten().to_numpy(), (len(found), width)), batch.column(2).to_numpy().astype(float)


def fit_sets(sets: DataFrame, width: int, n_pos: int, n_unl: int, prior: float) -> tuple[np.ndarray, float]:
    """``descend`` over rows (kind, found, n) of any number, a Spark job for each step."""

    def totals(theta: np.ndarray | None) -> np.ndarray:
        def run(batches):
            out = np.zeros((2, width + 2))
            for batch in batches:
                kind, x, n = held_rows(batch, width)
                for k in (0, 1):
                    part = x.take(at := np.flatnonzero(kind == k))
                    out[k] += np.concatenate([[0.0], part.sums(n[at]), [n[at].sum()]]) if theta is None else risk_sums(part, n[at], theta)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["raw"])

        # in one order, whichever task ends first
        return sum(np.frombuffer(raw).reshape(2, -1) for raw in sorted(bytes(r[0]) for r in sets.mapInArrow(run, "raw binary").collect()))

    sizes = np.array([[max(n_unl, 1)], [max(n_pos, 1)]])
    return descend(lambda theta: totals(theta) / sizes, totals(None)[1, 1:] / max(n_pos, 1), prior)


def sent(ids: DataFrame, n: int) -> DataFrame:
    """``n`` ids to be joined, without moving the texts while they are few."""
    return F.broadcast(ids) if n <= SENT_IDS else ids


def train(docs: DataFrame, labels: DataFrame, trainable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_positive: int = 3, prior: float | None = None) -> ToxicityModel:
    """Fits a model; ``trainable`` is a filter on the id that both tables pass.

    ``prior`` (share of toxic texts among the unlabelled) is that of the labels
    where it is not given, whatever it is but 0 and 1. Repeated labels of an id count as toxic if
    one of them says so.
    """
    docs, labels = docs.select(id_col, text_col), labels.select(id_col, label_col)
    docs, labels = docs.filter(F.col(id_col).isNotNull()), labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if trainable is not None:
        docs, labels = docs.filter(trainable), labels.filter(trainable)
    marked = labels.groupBy(id_col).agg((F.max(label_col) > 0).alias("_toxic"))
    total, toxic = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("_toxic").cast("int")), F.lit(0))).first()
    if prior is None:
        # one imagined text keeps it off 0 and 1
        prior = min(max(toxic, 1) / max(toxic + 1, total), total / (total + 1)) if total else 1e-3
    empty = ToxicityModel({}, np.zeros(0), math.log(prior / (1 - prior)), prior)
    if not toxic:
        return empty
    space = Workspace(docs.sparkSession, "toxicity")
    repeated = docs.groupBy(id_col).count().filter("count > 1").select(id_col)
    if n_repeated := repeated.count():
        repeated = sent(repeated, n_repeated)
        once = docs.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col))
        docs = docs.join(repeated, id_col, "left_anti").unionByName(once)
    positives = space.keep(docs.join(sent(marked.filter("_toxic").select(id_col), toxic), id_col, "left_semi").select(text_col), "positives")
    n_pos, n_unl = positives.count(), docs.count()
    if not n_pos:
        return empty

    def count(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for f in {f for w in text_words(text) for f in word_features(w)}:
                    seen[f] = seen.get(f, 0) + 1
            if len(seen) > 1 << 20:
                yield flush(seen)
                seen = {}
        yield flush(seen)

    def flush(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "pos"])

    def telling(pos, unl):
        """Whether a feature is three times as common among the positives, and by more than three standard errors."""
        p, u = pos / n_pos, unl / n_unl
        # the variance of a share p of n is p (1 - p) / n
        spread = np.sqrt((p * (1 - p) + 1 / n_pos) / n_pos + (u * (1 - u) + 1 / n_unl) / n_unl)
        return (p > 3 * u) & (p - u > 3 * spread)

    # positives are among the unlabelled, so what can't tell even if no other text holds it never does
    counted = positives.mapInArrow(count, "feature string, pos long").groupBy("feature").agg(F.sum("pos").alias("pos")).filter(F.col("pos") >= min_positive).orderBy("feature").collect()
    counted = [(r["feature"], r["pos"]) for r in counted if telling(r["pos"], r["pos"])]
    if not counted:
        return empty

    # those that share a prefix are neighbours
    counted.sort(key=lambda c: (c[0][1:], c[0]))
    candidates = {f: i for i, (f, _) in enumerate(counted)}

    def coded(batches):
        """Each word by its most special candidate, the word itself or its longest prefix, from which the others follow."""

        def special(word):
            whole, *prefixes = word_features(word)
            return next((candidates[f] for f in (whole, *reversed(prefixes)) if f in candidates), -1)

        known = Cache(special)
        for batch in batches:
            found = [sorted({*map(known.__getitem__, text_words(t))} - {-1}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["found"])

    found = space.keep(docs.select(text_col).mapInArrow(coded, "found array<int>"), "found")
    # a most special candidate's own features, by kind
    kinds = ["w", *map(str, PREFIXES)]
    covers = np.full((len(kinds), len(counted)), -1)
    for i, (special, _) in enumerate(counted):
        for f in covered_features(special):
            covers[kinds.index(f[0]), i] = candidates.get(f, -1)

    def placed(batch):
        lists = batch.column(0)
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()

    def tally(batches):
        unl = np.zeros(len(counted), np.int64)
        for batch in batches:
            row, code = placed(batch)
            for of in covers:
                feature = of[code]
                r, f = row[feature >= 0], feature[feature >= 0]
                # a text's words that share one are neighbours
                first = np.append(True, (f[1:] != f[:-1]) | (r[1:] != r[:-1]))[: len(f)]
                unl += np.bincount(f[first], minlength=len(unl))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(unl), pa.int64()), pa.array(unl[unl > 0], pa.int64())], ["feature", "unl"])

    unl = np.zeros(len(counted), np.int64)
    for r in found.coalesce(TALLIES).mapInArrow(tally, "feature long, unl long").groupBy("feature").agg(F.sum("unl").alias("unl")).collect():
        unl[r["feature"]] = r["unl"]
    chosen = np.array(sorted(np.flatnonzero(telling(np.array([n for _, n in counted]), unl)), key=lambda i: counted[i][0]), int)
    index = {counted[i][0]: k for k, i in enumerate(chosen)}
    if not index:
        return empty
    number = np.full(len(counted), -1)
    number[chosen] = np.arange(len(chosen))
    narrow = np.where(covers < 0, -1, number[covers])

    def narrowed(batches):
        for batch in batches:
            row, code = placed(batch)
            row, feature = np.divmod(np.unique(np.concatenate([(row * len(index) + of[code])[of[code] >= 0] for of in narrow])), len(index))
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))], ["found"])

    parts = ((0, found.mapInArrow(narrowed, "found array<int>")), (1, positives.mapInArrow(lambda batches: narrowed(coded(batches)), "found array<int>")))
    zero, one = (d.groupBy("found").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "found", "n") for k, d in parts)
    sets = space.keep(zero.unionByName(one), "sets")
    params = {"n_positive": n_pos, "n_unlabelled": n_unl, "n_sets": sets.count()}
    if params["n_sets"] > HELD_SETS:
        return ToxicityModel(index, *fit_sets(sets, len(index), n_pos, n_unl, prior), prior, params)
    kind, x, n = held_rows(sets.orderBy("kind", "found").toArrow().combine_chunks().to_batches()[0], len(index))
    return ToxicityModel(index, *fit_nnpu(x, np.flatnonzero(kind == 1), np.flatnonzero(kind == 0), prior, n), prior, params)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``score`` of each whole text."""
    weights, bias = model.weights, model.bias
    # the model's features travel with the task
    index = model.features
    source = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        known = Cache(lambda w: tuple(index[f] for f in word_features(w) if f in index))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = {i for hit in map(known.__getitem__, text_words(text)) if hit for i in hit}
                z = bias + sum(float(weights[i]) for i in sorted(found))
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, trainable=fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
