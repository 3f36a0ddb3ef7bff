"""Operator 7: quality classifier on random-indexing word vectors.

1. *Word vectors.*  A word's index vector is a sparse vector of +1 and -1 drawn from its hash; its
   context vector is the sum of the index vectors of the words up to ``RADIUS`` places away, over
   all occurrences in all documents.  Words share ``BUCKETS`` hashed rows, so the table has one
   size whatever the corpus; every task adds up its own documents and emits the rows it touched,
   and Spark sums them (map-side combined).
2. *Pooling.*  A document is the mean and the spread of its words' unit context vectors, frequent
   words weighing less.
3. *Network.*  Two layers in numpy, fitted on the driver on at most ``max_train`` labelled rows (the
   smallest by a hash of doc_id), then one temperature, chosen on a part kept out of the fit, that
   calibrates the probabilities.

Inputs of a score are the text's words only.  Edge cases: a null or empty text pools to zeros and
gets the network's score for that; a repeated row is scored like any other; labels that are null or
name no document are not used; with no usable label of both kinds every score is the share of label
1 among the labels (0.5 without labels); columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.text import SIGNS, flat, pieces, small_batches, tokens

BUCKETS, DIM, NONZERO, RADIUS = 1 << 15, 32, 2, 2
#: Words pooled at once.
CHUNK = 250_000


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed rows of the tokens of all texts, offsets of the texts): words and runs of signs."""
    hashes, offsets = tokens(*flat(column), SIGNS, lower=False)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), offsets


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the NONZERO places and signs of its index vector."""
    rng = np.random.default_rng(20)
    places = rng.integers(0, DIM, (BUCKETS, NONZERO))
    signs = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
    return places, signs


def _accumulate(table: np.ndarray, counts: np.ndarray, ids: np.ndarray, offsets: np.ndarray,
                places: np.ndarray, signs: np.ndarray) -> None:
    """Add the contexts of the texts' tokens; no context crosses from one text to the next."""
    counts += np.bincount(ids, minlength=BUCKETS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for step in range(1, RADIUS + 1):
        same = text[step:] == text[:-step]
        left, right = ids[:-step][same], ids[step:][same]
        for word, other in ((left, right), (right, left)):
            base = word * DIM
            for k in range(NONZERO):
                table += np.bincount(base + places[other, k], weights=signs[other, k], minlength=BUCKETS * DIM)


def word_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(unit context vectors BUCKETS x DIM, token counts BUCKETS) over all documents."""
    cols = [f"c{i}" for i in range(DIM)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        table, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches, "text"):
            _accumulate(table, counts, *_buckets(batch.column(0)), places, signs)
        rows = np.flatnonzero(counts)
        dense = table.reshape(BUCKETS, DIM)[rows].astype(np.int64)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(counts[rows])] + [pa.array(dense[:, i]) for i in range(DIM)],
                names=["bucket", "n"] + cols)

    schema = "bucket long, n long, " + ", ".join(f"{c} long" for c in cols)
    summed = docs.select("text").mapInArrow(partial, schema).groupBy("bucket").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols])
    got = summed.toPandas()  # BUCKETS rows at most
    vectors, counts = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
    if len(got):
        raw = got[cols].to_numpy(np.float64)
        vectors[got.bucket] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        counts[got.bucket] = got.n
    return vectors, counts


def _pool(column: pa.Array, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean and spread of word vectors, and the log of the number of tokens, per text."""
    ids, offsets = _buckets(column)
    out = np.zeros((len(offsets) - 1, 2 * DIM + 1), np.float32)
    for i, (low, high) in enumerate(zip(offsets, offsets[1:])):
        if low == high:
            continue
        total, squares, mass = np.zeros(DIM), np.zeros(DIM), 0.0
        for start in range(low, high, CHUNK):
            part = ids[start:min(start + CHUNK, high)]
            v, w = vectors[part], weight[part]
            total += w @ v
            squares += w @ (v * v)
            mass += float(w.sum())
        mean = total / mass
        out[i, :DIM] = mean
        out[i, DIM:2 * DIM] = np.sqrt(np.maximum(squares / mass - mean * mean, 0))
        out[i, -1] = np.log1p(high - low)
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60,
                l2: float = 1e-4, seed: int = 7) -> Network:
    """Mini-batch Adam on log loss with classes weighed alike; every fifth row is kept out of the fit
    and chooses the temperature that minimises its log loss, from a fixed grid."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    zt, yt = z[~held], y[~held]
    share = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    weights = np.where(yt > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    params = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
              rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for start in range(0, len(order), 64):
            pick = order[start:start + 64]
            a, target, wt = zt[pick], yt[pick], weights[pick]
            pre = a @ params[0] + params[1]
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3][0], -30, 30)))
            g = (p - target) * wt / len(pick)
            back = np.outer(g, params[2]) * (pre > 0)
            grads = [a.T @ back + l2 * params[0], back.sum(0), act.T @ g + l2 * params[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] = params[k] - 0.005 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(centre, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if held.any():
        logits, yh = net.logits(x[held]), y[held]

        def loss(temperature: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -30, 30))), 1e-9, 1 - 1e-9)
            return -float(np.mean(yh * np.log(p) + (1 - yh) * np.log(1 - p)))

        net.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return net


def _in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = 4000,
                folds: int = 4, fold: int = 2) -> Callable[[Column], Column]:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; rows of fold ``fold`` of
    ``folds`` by crc32 of the doc_id never give a label.  Returns text column -> score column."""
    spark = docs.sparkSession
    vectors, counts = word_table(docs)
    rate = counts / max(counts.sum(), 1.0)
    weight = (1e-3 / (1e-3 + rate)).astype(np.float32)
    shared = spark.sparkContext.broadcast((vectors, weight))  # BUCKETS x (DIM + 1) floats: 4 MB

    @F.arrow_udf("array<float>")
    def pooled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, w = shared.value
        for part in parts:
            x = [row for piece in pieces(part) for row in _pool(piece, table, w)]
            yield pa.array(x, pa.list_(pa.float32()))

    usable = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
              .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~_in_fold(F.col("_id"), folds, fold))
              .groupBy("_id").agg(F.min("_y").alias("_y")))
    known = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where("_doc is not null")
    chosen = usable.join(known.select("_doc").distinct(), F.col("_id") == F.col("_doc"), "left_semi") \
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = known.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(
        F.min("_y").alias("_y"), F.min("_text").alias("_text")).select(
        "_id", "_y", pooled("_text").alias("_x")).toPandas().sort_values("_id")  # max_train rows at most
    y = rows["_y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        constant = float(y.mean()) if len(y) else 0.5
        return lambda text: F.lit(constant)
    net = fit_network(np.stack(rows["_x"].to_numpy()), y)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, w = shared.value
        for part in parts:
            p = [net.probability(_pool(piece, table, w)) for piece in pieces(part)]
            yield pa.array(np.concatenate([np.empty(0), *p]), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    score = fit_quality(docs, labels, **fit)
    folds, fold = fit.get("folds", 4), fit.get("fold", 2)
    return docs.select(
        "doc_id", _in_fold(F.col("doc_id"), folds, fold).alias("held_out"), score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    score = fit_quality(docs, labels, **fit)
    return docs.where(score(F.col("text")) >= threshold)
