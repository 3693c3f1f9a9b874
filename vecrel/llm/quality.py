"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its text.  A preference pair is
a document labelled 1 over one labelled 0, and P(i over j) = sigmoid(s_i - s_j), so the
weights come from logistic loss on feature differences.  The cut is the quantile of
the training scores at the share of label 0 among all training labels; scores are
shifted so that this quantile is mapped to ``CUT``.

Learning reads every labelled document.  They are dealt into blocks of ``BLOCK_ROWS``
or more; in a block ``PAIRS`` pairs are drawn (a documented parameter) and each of its
documents stands in at least one more.  Means, spreads and the cut are exact over all of
them.  Scoring reads every byte of every text.

Edge cases: a null text counts as empty; an empty text has all features 0 and gets a
score like any other.  Labels that are null or name no document are ignored; with only
one label to learn from every document scores the share of label 1.  Repeated rows are
scored each on its own, ties score alike, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Rows dealt into one block of pairs; a task holds one or two blocks at a time.
BLOCK_ROWS = 8000
PAIRS = 60_000
STEPS = 40
RIDGE = 1e-3
CUT = 0.3
BINS = 4096
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".",
    "comma": b",",
    "bang": b"!?",
    "mark": b"#$%&*@^~+=<>",
    "bar": b"|\\/_-",
    "quote": b"\"'`()[]{}:;",
    "line": b"\n",
    "wide": range(128, 256),
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each of the texts."""
    n_docs, n = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(n, 1)
    full = n > 0

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n_docs)
        if full.any():
            out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
        return out

    shares = []
    for chars in _CLASSES.values():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        shares.append(total(table[data]) / some)
    named = dict(zip(_CLASSES, shares, strict=True))
    prefix = C.prefix_hash(C.LOWER[data])

    def repeats(mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count, share of distinct ones, largest share of one, mean and spread of length, for the runs of a mask."""
        starts, ends, first = C.runs(mask, offsets)
        count = np.diff(first)
        row = np.repeat(np.arange(n_docs), count)
        keys = (row.astype(np.uint64) << np.uint64(52)) | (C.spans_hash(prefix, starts, ends) >> np.uint64(12))
        unique, times = np.unique(keys, return_counts=True)
        of = (unique >> np.uint64(52)).astype(np.int64)
        distinct = np.bincount(of, minlength=n_docs)
        top = np.zeros(n_docs)
        np.maximum.at(top, of, times)
        length = np.bincount(row, ends - starts, n_docs)
        square = np.bincount(row, (ends - starts).astype(float) ** 2, n_docs)
        c = np.maximum(count, 1)
        return count, distinct / c, top / c, length / c, np.sqrt(np.maximum(square / c - (length / c) ** 2, 0))

    words, kinds, top, mean, spread = repeats(~C.SPACE[data])
    lines, line_kinds, line_top, line_mean, _ = repeats(data != 10)
    letters = np.maximum(named["upper"] + named["lower"], 1e-9)
    columns = [
        *shares, named["upper"] / letters, named["mark"] + named["bang"], np.log1p(n), np.log1p(words), np.log1p(lines),
        kinds, np.log1p(kinds * words) / np.maximum(np.log1p(words), 1e-9), top, mean, np.minimum(spread, 50),
        line_kinds, line_top, np.log1p(line_mean), (n == 0).astype(float), (words < 8).astype(float),
    ]
    return np.nan_to_num(np.stack(columns, axis=1))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    share: float

    def shape(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, np.abs(z)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.size:
            return np.full(len(x), self.share)
        raw = self.shape(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.cut + np.log(CUT / (1 - CUT)), -50, 50)))


def differences(z: np.ndarray, label: np.ndarray, seed: int) -> np.ndarray:
    """Shaped features of label 1 less those of label 0, for drawn pairs and for one more pair of each row."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    better, worse = np.concatenate([better, good, rng.choice(good, len(bad))]), np.concatenate([worse, rng.choice(bad, len(good)), bad])
    return z[better] - z[worse]


def slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and Hessian of their summed loss, in a row."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
    return np.concatenate([[len(d)], d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def descend(size: int, slopes_at: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights of least loss by damped Newton steps."""
    w = np.zeros(size)
    for _ in range(STEPS):
        sums = slopes_at(w)
        n, gradient, hessian = sums[0], sums[1 : size + 1], sums[size + 1 :].reshape(size, size)
        if not n:
            break
        step = np.linalg.solve(hessian / n + (RIDGE + 1e-4) * np.eye(size), gradient / n + RIDGE * w)
        w -= step * min(1.0, 4 / max(np.linalg.norm(step), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, share: float, seed: int = 7) -> Model:
    """The model of rows that fit in one block; ``share``: of label 1 among all labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, share)
    model = Model(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(0), 0.0, share)
    z = model.shape(x)
    d = differences(z, label, seed)
    model.weights = descend(z.shape[1], lambda w: slopes(d, w))
    raw = z @ model.weights
    weight = np.where(label == 1, share / len(good), (1 - share) / len(bad))
    order = np.argsort(raw)
    at = min(np.searchsorted(np.cumsum(weight[order]), 1 - share), len(order) - 1)
    model.cut = float(raw[order[at]])
    return model


def _featured(df: DataFrame) -> DataFrame:
    """(doc_id, x) for rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            rows = [features(part, off) for _, _, part, off in C.groups(data, offsets)]
            x = np.concatenate(rows) if rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), C.list_array(pa.array(x.ravel()), np.full(len(x), x.shape[1]))], ["doc_id", "x"])

    return df.mapInArrow(run, T.StructType([df.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of a batch of (label, x)."""
    label = batch.column(0).to_numpy()
    return label, batch.column(1).flatten().to_numpy().reshape(len(label), -1)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, partners: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of blocks of ``size`` rows or more that hold both labels, ``partners`` in each; the rows left at the end join the last block."""
    held, last = [], []
    for batch in batches:
        if batch.num_rows:
            held.append(_rows(batch))
        if sum(len(x[0]) for x in held) >= size and len({int(y) for x in held + partners for y in (x[0].min(), x[0].max())}) == 2:
            if last:
                yield tuple(np.concatenate(x) for x in zip(*last, *partners, strict=True))
            last, held = held, []
    if last or held:
        label, x = (np.concatenate(x) for x in zip(*last, *held, *partners, strict=True))
        if label.min() < label.max():
            yield label, x


def _summed(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> list[np.ndarray]:
    """What ``of`` yields in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["out"])

    return [np.frombuffer(r.out, np.float64) for r in rows.mapInArrow(run, "out binary").collect()]


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)[1]
                own = np.concatenate([[len(x)], x.mean(0), ((x - x.mean(0)) ** 2).sum(0)])
                total = own if total is None else joined(total, own)
        if total is not None:
            yield total

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, (m, v), (o, u) = a[0] + b[0], np.split(a[1:], 2), np.split(b[1:], 2)
        return np.concatenate([[n], m + (o - m) * (b[0] / n), v + u + (o - m) ** 2 * (a[0] * b[0] / n)])

    total = reduce(joined, _summed(rows, of))
    mean, square = np.split(total[1:], 2)
    return mean, np.maximum(np.sqrt(square / total[0]), 1e-6)


def _cut(raw: DataFrame, weights: dict[int, float], at: float) -> float:
    """The least of (label, raw) up to which the weights of the labels sum to ``at``; ranges are narrowed until one value is left."""
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    before = 0.0
    while low < high:
        place = F.least(F.lit(BINS - 1), F.floor((F.col("raw") - low) / (high - low) * BINS))
        bins = raw.where(F.col("raw").between(low, high)).groupBy(place.alias("bin")).agg(
            F.min("raw").alias("low"), F.max("raw").alias("high"), F.sum("label").alias("ones"), F.count("*").alias("n")
        ).orderBy("bin").collect()
        ones = zeros = 0
        for b in bins:
            upto = before + (ones + b.ones) * weights[1] + (zeros + b.n - b.ones) * weights[0]
            if upto >= at - 1e-12 or b is bins[-1]:
                break
            ones, zeros = ones + b.ones, zeros + b.n - b.ones
        if (b.low, b.high) == (low, high):  # too close to be told apart by bins
            low = high
        else:
            low, high, before = b.low, b.high, before + ones * weights[1] + zeros * weights[0]
    return float(low)


def train(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 7) -> Model:
    """Fit on (doc_id, text) and (doc_id, quality); both already limited to the rows to learn from."""
    C.short_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    count = known.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    share = (count.ones or 0) / max(1, count.n)
    # Texts stay where they are: their features, a tenth of the bytes, go to the labels.
    featured = _featured(docs.select("doc_id", "text")).join(known, "doc_id")
    # Some 32 rows of the rarer label in each part at least, unless they are so few that every block gets them all.
    rare = min(count.ones or 0, count.n - (count.ones or 0))
    parts = max(1, count.n // block_rows if rare <= block_rows else min(count.n // block_rows, rare // 32))
    rows = C.written(featured.repartition(parts, "doc_id", "x").sortWithinPartitions("doc_id", "x").select("label", "x"), "quality-rows")
    found = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        C.free(rows)
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, share)
    model = Model(*_moments(rows), np.zeros(0), 0.0, share)
    scarce, partners, dealt = min(found, key=found.get), [], rows
    if rare <= block_rows and found[scarce] <= block_rows:
        x = np.concatenate(_summed(rows.where(F.col("label") == scarce), lambda batches: (_rows(b)[1].ravel() for b in batches if b.num_rows))).reshape(-1, len(model.mean))
        partners, dealt = [(np.full(len(x), scarce, np.int32), x)], rows.where(F.col("label") != scarce)

    def slopes_at(w: np.ndarray) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            sums = [slopes(differences(model.shape(x), label, seed), w) for label, x in _blocks(batches, block_rows, partners)]
            if sums:
                yield np.sum(sums, axis=0)

        return np.sum([*_summed(dealt, of), np.zeros(1 + len(w) + len(w) ** 2)], axis=0)

    weights = descend(2 * len(model.mean), slopes_at)
    model.weights = weights

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, x = _rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(model.shape(x) @ weights)], ["label", "raw"])

    raw = C.written(rows.mapInArrow(worth, "label int, raw double"), "quality-worth")
    model.cut = _cut(raw, {0: (1 - share) / found[0], 1: share / found[1]}, 1 - share)
    C.free(rows, raw)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text, held_out)."""
    spark = docs.sparkSession
    C.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            rows = [shared.value.scores(features(part, off)) for _, _, part, off in C.groups(data, offsets)]
            s = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, SCHEMA)
