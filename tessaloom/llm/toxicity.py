"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. P(grade > j) = sigmoid(w.x - cut_j),
with one weight vector w for both ordered thresholds (proportional odds); the expected
severity is the sum of those probabilities. Labels say toxic or not; the grade of a toxic
training row is 2 where its number of lexicon features (far more frequent in toxic training rows
than in others) lies above the median of toxic rows, else 1, so the severity cut is
learned from the rows themselves. A document is rejected when P(grade > 0) reaches the model's
``reject``: of the values that part the training rows best (a clean row's loss counts
CLEAN_WEIGHT times a toxic one's, by the classes' rates), the middle, but never so low that a text
without any evidence (features of a positive sum) goes. Where nothing parts them, nothing is
rejected.

Features: the presence of distinct words and of word beginnings of PREFIXES characters, as
exact 64-bit hashes of a vocabulary that the training sample gives: those of MIN_DOCS rows at
least whose share of toxic rows is EXCESS standard deviations from chance, the MAX_FEATURES
furthest. They are counted on the executors. The fit uses a bounded sample, MAX_ROWS labelled
rows by hash order of the id (a documented parameter); scoring covers every row and whole texts
of any length.

Null and empty texts have no features and get the base rate's severity; with no usable labels
every row gets severity 0 and nothing is rejected. An empty table gives no rows. Rows are
independent: repeated ids and rows each give their row, and rows of equal texts the same scores.
Labels with a null id or label, or without a document, take no part; of ids that repeat in
labels, the greatest label counts, in documents the least text. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .runtime import arrow_map, cut
from .textops import Words

MAX_ROWS = 6000
MIN_DOCS = 5
MAX_FEATURES = 20_000
PREFIXES = (3, 4, 5, 6)
CLEAN_WEIGHT = 10
LEAST_EVIDENCE = 1e-6
EXCESS, LEXICON = 4.0, 6.0  # standard deviations


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    cuts: np.ndarray  # ascending
    reject: float = 2.0  # least P(grade > 0) of a rejected document

    def exceed(self, features: np.ndarray) -> np.ndarray:
        """P(grade > j) of one text from its feature hashes."""
        if not len(self.cuts):
            return np.zeros(2)
        at = np.searchsorted(self.words, features)
        at[at == len(self.words)] = 0
        total = self.weights[at[self.words[at] == features]].sum() if len(self.words) else 0.0
        return 1 / (1 + np.exp(np.clip(self.cuts - total, -60, 60)))


def features_of(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct feature hashes of each text."""
    words = Words(texts, PREFIXES)
    all_of = np.vstack((words.hashes, *words.prefixes))
    sets = [np.unique(all_of[:, words.offsets[i] : words.offsets[i + 1]]) for i in range(len(words))]
    return [s[1:] if len(s) and s[0] == 0 else s for s in sets]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, size: int, decay: float = 1e-5, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by full-batch Adam on the likelihood of the grades. ``rows`` hold
    feature numbers."""
    owner, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, share = np.zeros(size), [max(1e-3, min(1 - 1e-3, (grades > j).mean())) for j in range(2)]
    cuts = np.array([-np.log(s / (1 - s)) for s in share])
    cuts[1] = max(cuts[1], cuts[0] + 0.1)
    theta = np.concatenate((w, [cuts[0], np.log(cuts[1] - cuts[0])]))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = len(rows)
    for step in range(1, steps + 1):
        w, low, gap = theta[:size], theta[-2], np.exp(theta[-1])
        z = np.bincount(owner, w[feature], n)
        p0, p1 = _sigmoid(z - low), _sigmoid(z - low - gap)
        # d log-likelihood / d (each threshold's logit)
        mid = np.maximum(p0 - p1, 1e-12)
        d0 = np.where(grades == 0, -p0, np.where(grades == 1, p0 * (1 - p0) / mid, 0))
        d1 = np.where(grades == 2, 1 - p1, np.where(grades == 1, -p1 * (1 - p1) / mid, 0))
        gradient = np.concatenate((-np.bincount(feature, (d0 + d1)[owner], size) / n + decay * w, [(d0.sum() + d1.sum()) / n, d1.sum() / n * gap]))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:size], np.array([theta[-2], theta[-2] + np.exp(theta[-1])])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """toxic, words (feature hashes) of a sample of ``max_rows`` labelled ids at most, the first
    by hash of the id; of documents that repeat an id, the least text counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("_toxic"))
    sampled = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(sampled), "_id").groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.min("_text").alias("_text"))
    schema = StructType([StructField("toxic", IntegerType()), StructField("words", BinaryType())])
    return cut(arrow_map(chosen.select("_toxic", "_text"), lambda c: {"toxic": c["_toxic"], "words": [f.tobytes() for f in features_of(c["_text"])]}, schema))


def chosen_features(rows: DataFrame, base: float) -> list[tuple[int, float]]:
    """(hash, excess) of the MAX_FEATURES features at most that lie furthest from chance, counted
    where the rows are. Excess: the standard deviations by which a feature's toxic rows exceed
    those expected."""
    schema = StructType([StructField(n, LongType()) for n in ("feature", "n", "k")])

    def count(c: dict) -> dict:
        sets = [np.frombuffer(w, np.uint64) for w in c["words"]]
        found, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        toxic = np.repeat(np.array(c["toxic"]), [len(s) for s in sets])
        return {"feature": found.view(np.int64), "n": np.bincount(inverse, minlength=len(found)), "k": np.bincount(inverse, toxic, len(found)).astype(np.int64)}

    counts = arrow_map(rows, count, schema).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).filter(F.col("n") >= MIN_DOCS)
    excess = (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)) + 1)
    far = counts.select("feature", excess.alias("excess")).filter(F.abs("excess") >= EXCESS)
    return [(r.feature, r.excess) for r in far.orderBy(F.abs("excess").desc(), "feature").limit(MAX_FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most ``max_rows`` labelled rows. To the driver come the chosen features and,
    of each row, the numbers of those it has: max_rows x MAX_FEATURES at the very most."""
    rows = labelled(docs, labels, max_rows, id_col, text_col)
    of_class = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(of_class) < 2:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    chosen = chosen_features(rows, of_class[1] / sum(of_class.values()))
    words = np.array([f for f, _ in chosen], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, lexicon = words[order], np.array([e for _, e in chosen])[order] >= LEXICON if len(order) else np.zeros(0, bool)

    def numbers(c: dict) -> dict:
        return {"toxic": c["toxic"], "words": [np.flatnonzero(np.isin(words, np.frombuffer(w, np.uint64), assume_unique=True)).astype(np.int32).tobytes() for w in c["words"]]}

    found = sorted((r.words, r.toxic) for r in arrow_map(rows, numbers, rows.schema).collect())  # as rows come in any order
    toxic = np.array([t for _, t in found], np.int64)
    features = [np.frombuffer(f, np.int32).astype(np.int64) for f, _ in found]
    load = np.array([lexicon[f].sum() for f in features])
    grades = np.where(toxic == 0, 0, np.where(load > np.median(load[toxic == 1]), 2, 1))
    weights, cuts = fit_cumulative_link(features, grades, len(words))
    z = np.array([weights[f].sum() for f in features])
    return OrdinalModel(words, weights, cuts, reject_at(max(best_part(z, toxic), LEAST_EVIDENCE), cuts))


def reject_at(z: float, cuts: np.ndarray) -> float:
    return float(_sigmoid(np.array(z) - cuts[0])) if np.isfinite(z) else 2.0


def best_part(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the interval of z that parts the classes best; infinite if none does."""
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order]
    gain = CLEAN_WEIGHT * np.cumsum(toxic == 0) / (toxic == 0).sum() - np.cumsum(toxic == 1) / (toxic == 1).sum()
    gain[:-1][z[1:] == z[:-1]] = -1  # a cut can't part equal values
    i = int(gain.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else np.inf


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), p_toxic, p_severe, rejected."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *(StructField(n, DoubleType()) for n in ("severity", "p_toxic", "p_severe")), StructField("rejected", BooleanType())])

    def run(c: dict) -> dict:
        p = _exceed(model, c["t"])
        return {"doc_id": c["d"], "severity": p.sum(1), "p_toxic": p[:, 0], "p_severe": p[:, 1], "rejected": p[:, 0] >= model.reject}

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)


def _exceed(model: OrdinalModel, texts: list) -> np.ndarray:
    return np.array([model.exceed(f) for f in features_of(texts)]).reshape(-1, 2)


def accepted(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected; all columns as they are."""
    flag = "_p_toxic"
    while flag in docs.columns:
        flag += "_"

    def run(c: dict) -> dict:
        return c | {flag: _exceed(model, c[text_col])[:, 0]}

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField(flag, DoubleType())])).filter(F.col(flag) < model.reject).drop(flag)
