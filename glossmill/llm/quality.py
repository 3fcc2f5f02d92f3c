"""Quality: ridge regression on random Fourier features of document statistics, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import written

#: Labelled rows that the model is fitted on at most, chosen by a hash of their doc_id.
MAX_TRAIN = 20_000
#: Fourier features, seed of their frequencies, and folds whose raw scores the calibration sees.
N_FEATURES, SEED, FOLDS = 384, 7, 4
RIDGES = (1e-4, 1e-3, 1e-2)
THRESHOLD = 0.3
_TASKS = 8  # that sum the sample's normal equations
#: Byte classes that are counted, each divided by the number of words.
_CLASSES = (b"#*$%&<>", b"|", b"!?", b".", b",;:", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"()[]{}/\\@_=+", bytes(range(128, 256)))


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each whole text: lengths, byte classes, and how much of it is said once only."""
    words = W.split(texts)
    data, at = W.utf8(texts)
    n, counts, doc = len(at) - 1, words.counts, words.doc_of()
    least = np.maximum(counts, 1)
    columns = [np.log1p(counts), np.log1p(np.diff(at))]
    for chars in _CLASSES:
        is_it = np.zeros(256, np.int64)
        is_it[list(chars)] = 1
        total = np.concatenate([[0], np.cumsum(is_it[data])])
        columns.append(np.minimum(np.diff(total[at]) / least, 20))
    size = words.ends - words.starts
    columns.append(np.bincount(doc, size, n) / least)
    columns.append(np.sqrt(np.bincount(doc, size.astype(float) ** 2, n) / least))
    upper = (data[words.starts] >= 65) & (data[words.starts] <= 90) if len(doc) else np.zeros(0, bool)
    columns.append(np.bincount(doc, upper, n) / least)
    h = W.hashes(words)
    for k in (1, 3, 8):
        places = W.gram_starts(words.offsets, k)
        of = np.searchsorted(words.offsets, places, "right") - 1
        g = W.grams(h, k)[places] if len(places) else np.empty(0, np.uint64)
        mixed = np.unique(W.mix(g + W.mix(of.astype(np.uint64))), return_index=True)[1]
        columns.append(np.bincount(of[mixed], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1))
    return np.column_stack(columns) if n else np.empty((0, len(columns)))


@dataclass
class Model:
    """Standardisation, frequencies, ridge weights, and the points of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        made = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.column_stack([made, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.raw, self.share), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (raw score, share of class 1) of the least-squares fit that never falls, by pooling neighbours."""
    keys, inverse = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for k, w, t in zip(keys, weight, total):
        blocks.append([t, w, k * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


def _solve(a: np.ndarray, b: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """Ridge weights; all zero where no rows are left."""
    n = max(n, 1.0)
    return np.linalg.solve(a + ridge * n * np.eye(len(b)), b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fitted on at most ``max_train`` labelled documents, those with the least hash of their doc_id.

    Tasks sum moments, then normal equations by fold; the driver adds a fixed number of small
    matrices, solves them with each fold left out, picks the ridge with the least error on the folds left out,
    and calibrates on the scores of those. Where one fold has all rows, those scores say nothing and every
    score is the share of class 1. Of several labels of a doc_id the largest counts, of several texts the one with the least xxhash64. Without labels every score is 0.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "sig": batch.column("sig"), "x": pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float64()))})

    rows = rows.withColumn("sig", F.xxhash64("text"))
    sample = rows.mapInArrow(described, "doc_id long, y int, sig long, x array<double>")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("sig", "y", "x")).alias("s")).select("doc_id", "s.y", "s.x")
    sample = written(sample.repartition(_TASKS, "doc_id").sortWithinPartitions("doc_id"))
    rng = np.random.default_rng(SEED)
    p = statistics(pa.array([""], pa.string())).shape[1]
    frequencies, phases = rng.normal(size=(p, N_FEATURES)) * 1.5 / np.sqrt(p), rng.uniform(0, 2 * np.pi, N_FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, p))
        n = 0
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, p)
            total += [x.sum(0), (x * x).sum(0)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    n, total = 0, np.zeros((2, p))
    for r in sorted(sample.mapInArrow(moments, "n long, sums binary").collect()):
        n, total = n + r.n, total + np.frombuffer(r.sums).reshape(2, p)
    if not n:
        return Model(np.zeros(p), np.ones(p), frequencies, phases, np.zeros(N_FEATURES + 1), np.zeros(1), np.zeros(1))
    mean = total[0] / n
    scale = np.sqrt(np.maximum(total[1] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    model = Model(mean, scale, frequencies, phases, np.zeros(N_FEATURES + 1), np.zeros(1), np.zeros(1))
    held, d = docs.sparkSession.sparkContext.broadcast(model), N_FEATURES + 1

    def fold_of(ids: np.ndarray) -> np.ndarray:
        return (W.mix(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(int)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros(FOLDS)
        for batch in batches:
            z = held.value.features(np.array(batch.column("x").to_pylist()).reshape(-1, p))
            y, of = batch.column("y").to_numpy().astype(float), fold_of(batch.column("doc_id").to_numpy())
            for k in range(FOLDS):
                a[k] += z[of == k].T @ z[of == k]
                b[k] += z[of == k].T @ y[of == k]
                n[k] += (of == k).sum()
        yield pa.RecordBatch.from_pydict({"fold": pa.array(range(FOLDS), pa.int32()), "n": pa.array(n), "a": pa.array([m.tobytes() for m in a], pa.binary()), "b": pa.array([v.tobytes() for v in b], pa.binary())})

    a, b, size = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros(FOLDS)
    for r in sample.mapInArrow(equations, "fold int, n double, a binary, b binary").toLocalIterator():
        a[r.fold] += np.frombuffer(r.a).reshape(d, d)
        b[r.fold] += np.frombuffer(r.b)
        size[r.fold] += r.n
    left_out = np.array([[_solve(a.sum(0) - a[k], b.sum(0) - b[k], n - size[k], ridge) for k in range(FOLDS)] for ridge in RIDGES])

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = held.value.features(np.array(batch.column("x").to_pylist()).reshape(-1, p))
            raw = np.einsum("nd,rnd->nr", z, left_out[:, fold_of(batch.column("doc_id").to_numpy())])
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "raw": pa.array(list(raw), pa.list_(pa.float64()))})

    got = sample.mapInArrow(raw_scores, "y int, raw array<double>").toPandas()
    raw, y = np.array(got["raw"].tolist()).reshape(-1, len(RIDGES)), got["y"].to_numpy(float)
    best = int(((raw - y[:, None]) ** 2).mean(0).argmin())
    model.weights = _solve(a.sum(0), b.sum(0), n, RIDGES[best])
    model.raw, model.share = isotonic(raw[:, best], y)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (5, 0), max_train: int = MAX_TRAIN) -> DataFrame:
    """Every whole text scored: ``doc_id, held_out, score, predicted``.

    The model is learnt from labels of documents whose crc32(doc_id as text) mod ``fold[0]`` is not
    ``fold[1]``; the others are ``held_out``. A score uses the text only. ``predicted`` is 1 from
    0.3. A null or empty text has the score of a text of no words; a null doc_id stays null and
    is not held out; repeated rows give repeated rows; labels of unknown documents, null labels
    and further columns are ignored; without any label scores are 0.
    """
    outside = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(fold[0])) == fold[1]
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~outside), label, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(held.value.score(statistics(batch.column("text"))), pa.float64())})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(outside, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
