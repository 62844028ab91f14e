"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of the texts.

Both classes are Gaussian over DIM statistics. A class's covariance is shrunk towards the pooled one (POOL) and that towards a
multiple of the identity (RIDGE); the score is the logistic of the difference of the log densities plus the log prior odds. The
Cholesky factors are computed once and travel with the scoring function. Sums of features and of their products are taken per
partition and added up by Spark, so a few hundred numbers reach the driver.

The fit uses FIT_ROWS labelled rows at most, chosen by a hash of doc_id: a documented bound; scores cover every row.

Defined results: a null text is an empty one, and empty texts have features and so a score; rows without a label or with a null
one are not fitted; if a class has under two rows, every score is the share of class 1, (n1 + 1) / (n + 2); repeated rows are
scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ship

FIT_ROWS, POOL, RIDGE, THRESHOLD = 20_000, 0.1, 0.02, 0.7
DIM = 14

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = np.isin(_BYTES, list(b".,;:'\"-()?"))
_SIGN = (_BYTES < 128) & ~_SPACE & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOP
_KINDS = np.stack([_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _SIGN], 1).astype(float)
_SIGN_END = _SIGN | (_BYTES == ord("!"))


def features(text: str | None) -> np.ndarray:
    """The statistics of a text, most of them shares under a square root."""
    out = np.zeros(DIM)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    space, upper, lower, digit, stop, sign = np.bincount(raw, minlength=256) @ _KINDS
    solid = max(len(raw) - space, 1.0)
    gap = _SPACE[raw]
    ends = np.flatnonzero(~gap & np.append(gap[1:], True))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    shares = (
        upper / solid, digit / solid, stop / solid, sign / solid, _SIGN_END[raw[ends]].mean(), _SIGN[raw[ends]].mean() * (ends.size > 1),
        sum(map(operator.eq, words, words[1:])) / n, 1 - distinct / n, 1 - len(set(lines)) / max(len(lines), 1), sum(len(w) <= 2 for w in words) / n,
    )
    out[: len(shares)] = np.sqrt(shares)
    out[10] = np.log1p(n)
    out[11] = np.log(solid / n)
    out[12] = np.log1p(n / (1 + len(lines)))
    out[13] = np.log(distinct) / np.log1p(n)
    return out


class Discriminant:
    """The fitted model: of each class the mean, the inverse Cholesky factor and the log of its density's constant."""

    def __init__(self, n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float = POOL, ridge: float = RIDGE):
        self.share = (n[1] + 1) / (n.sum() + 2)
        self.ready = bool((n >= 2).all())
        if not self.ready:
            return
        mean = total / n[:, None]
        scatter = outer - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        norm = np.outer(self.scale, self.scale)
        self.mean, self.factor, self.constant = mean, [], []
        for c in (0, 1):
            s = ((1 - pool) * scatter[c] / n[c] + pool * pooled) / norm
            s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
            low = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(low).T)
            self.constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), self.share)
        far = [((((x - self.mean[c]) / self.scale) @ self.factor[c]) ** 2).sum(1) for c in (0, 1)]
        odds = 0.5 * (far[0] - far[1]) + self.constant[1] - self.constant[0]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality") -> Discriminant:
    """Learns from labelled rows outside the held-out fold, rows of them at most (in expectation, by hash)."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~F.coalesce(held_out(F.col("id")), F.lit(False)) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    keep = min(1.0, rows / max(n, 1))
    part = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit(11), "id"), 11) < int(keep * (1 << 53)))  # so bounded, and broadcast below
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"]).join(F.broadcast(part), "id").select("label", "text")

    def sums(batches):
        n, total, outer = np.zeros(2), np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
        for b in batches:
            y = np.array(b.column(0).to_pylist(), dtype=int)
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, DIM)
            for c in (0, 1):
                of = x[y == c]
                n[c] += len(of)
                total[c] += of.sum(0)
                outer[c] += of.T @ of
        flat = [np.concatenate([[n[c]], total[c], outer[c].ravel()]).tolist() for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["label", "v"])

    parts = texts.mapInArrow(sums, "label int, v array<double>").select("label", F.posexplode("v").alias("i", "x"))
    flat = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in parts.groupBy("label", "i").agg(F.sum("x").alias("x")).collect():  # 2 (1 + DIM + DIM^2) rows
        flat[r["label"], r["i"]] = r["x"]
    return Discriminant(flat[:, 0], flat[:, 1 : DIM + 1], flat[:, DIM + 1 :].reshape(2, DIM, DIM))


def score_udf(model: Discriminant):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.to_pylist()]).reshape(-1, DIM)
        return pa.array(model.scores(x), pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    score = score_udf(fit(docs, labels))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), score(docs["text"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; the columns stay as they are."""
    score = score_udf(fit(docs, labels))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score(docs["text"]).alias("score"))
    return rows.filter(F.col("score") >= threshold).select("row.*")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
