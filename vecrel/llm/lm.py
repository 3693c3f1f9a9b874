"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z in lower
case, then one end token per text.  Counts of all training tokens are exact and cover
the whole corpus.  The neural part predicts one of ``WORDS`` frequent words or of
``CLASSES`` classes of the remaining words (by their last two bytes) from the vectors
of the ``CONTEXT`` units before it; its softmax is normalised exactly, by a matrix
product over the distinct contexts of a batch.  Within a class a word has its smoothed
share of the class's exact counts, unseen words together counting as one more word, so
the whole is a normalised distribution.

The network is fitted to all training texts: in each of ``EPOCHS`` rounds every partition
makes a pass over its own texts from the same start, and the mean of the results, weighted
by tokens, starts the next round.  Bound (documented parameter): the table sent to all
executors holds at most ``TABLE_WORDS`` of the most frequent words.  Words beyond the table
take part exactly, through a join with the full counts.

Edge cases: a null text counts as empty and has the end token alone; with nothing to
train on every token has probability 1 / (classes + words) times a whole share, and the
base score is 0.  Repeated rows are scored each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, CLASSES, CONTEXT, SIZE = 192, 64, 3, 24
TABLE_WORDS = 500_000
#: Units whose order is drawn at once; a partition holds so many at a time.
SHUFFLED = 1 << 20
NOISE, BATCH, EPOCHS, RATE = 64, 1024, 2, 0.05
END = np.uint64(0x5DEECE66D1234567)
#: The suffix code of the end token; no word has it, for words hold no spaces.
END_SUFFIX = 0x2020


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix code of each token, ends included, and the first token of each text."""
    low = C.LOWER[data]
    starts, ends, first = C.runs(~C.SPACE[data], offsets)
    hashes = C.spans_hash(C.prefix_hash(low), starts, ends)
    suffix = low[ends - 1].astype(np.int64) | np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)].astype(np.int64) << 8, 0) if len(starts) else np.zeros(0, np.int64)
    n = len(offsets) - 1
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    out, codes = np.full(len(starts) + n, END), np.full(len(starts) + n, END_SUFFIX, np.int64)
    out[at], codes[at] = hashes, suffix
    return out, codes, first + np.arange(n + 1)


def count_tokens(train: DataFrame) -> DataFrame:
    """(hash, suffix, n) of all tokens of (text)."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        return unique, c[at], np.bincount(back, n, len(unique)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows[0]), 100_000):
                h, c, n = (x[lo : lo + 100_000] for x in rows)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["hash", "suffix", "n"])

        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            for _, _, part, off in C.groups(data, offsets):
                h, c, _ = tokens(part, off)
                held.append(merged([(h, c, np.ones(len(h), np.int64))]))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 600_000:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged(held))

    return train.select("text").mapInArrow(run, "hash long, suffix int, n long").groupBy("hash").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


@dataclass
class Model:
    total: int  # training tokens
    kinds: int  # distinct ones
    hashes: np.ndarray  # of the table, sorted
    counts: np.ndarray
    unit: np.ndarray  # of a table word: its own output, or -1
    classes: np.ndarray  # class of each suffix code
    mass: np.ndarray  # by class: N + 0.1 (V + 1)
    vectors: np.ndarray | None = None  # of units as context
    mixing: np.ndarray | None = None  # by place in the context
    outputs: np.ndarray | None = None
    bias: np.ndarray | None = None
    end: int = 0

    def look_up(self, hashes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether the table has it, its count there, its unit."""
        if len(self.hashes):
            kinds, back = np.unique(hashes, return_inverse=True)  # each kind is looked for once, in order
            at = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
            found = self.hashes[at] == kinds
            found, count, own = found[back], np.where(found, self.counts[at], 0)[back], np.where(found, self.unit[at], -1)[back]
        else:
            found, count, own = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        return found, count, np.where(own >= 0, own, WORDS + self.classes[suffix])

    def contexts(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The CONTEXT units before each token; the end token stands before a text."""
        place = np.arange(len(units)) - np.repeat(first[:-1], np.diff(first))
        out = np.full((len(units), CONTEXT), self.end, np.int64)
        for j in range(1, CONTEXT + 1):
            ok = np.flatnonzero(place >= j)
            out[ok, j - 1] = units[ok - j]
        return out

    def log_probs(self, units: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(unit | context), normalised over all units."""
        code = np.zeros(len(units), np.int64)
        for j in range(CONTEXT):
            code = code * (WORDS + CLASSES) + contexts[:, j]
        out = np.empty(len(units), np.float64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = code[1:] != code[:-1]
        bounds = np.append(np.flatnonzero(fresh), len(code))
        at, back = order[bounds[:-1]], np.cumsum(fresh) - 1  # a row of each context, the context of each row in order
        placed = [self.vectors * self.mixing[j] for j in range(CONTEXT)]  # the vectors as they count in each place
        for lo in range(0, len(at), 512):  # the logits of so many contexts stay in the cache
            hi = min(lo + 512, len(at))
            own = contexts[at[lo:hi]]
            logits = sum(placed[j].take(own[:, j], axis=0) for j in range(CONTEXT)) @ self.outputs.T
            logits += self.bias
            rows = order[bounds[lo] : bounds[hi]]
            of = back[bounds[lo] : bounds[hi]] - lo
            real, top = logits[of, units[rows]], logits.max(axis=1, keepdims=True)
            logits -= top
            norm = np.log(np.exp(logits, out=logits).sum(axis=1)) + top[:, 0]
            out[rows] = real - norm[of]
        return out


def shapes() -> dict[str, tuple[int, ...]]:
    outputs = WORDS + CLASSES
    return {"vectors": (outputs, SIZE), "mixing": (CONTEXT, SIZE), "outputs": (outputs, SIZE), "bias": (outputs,)}


def taken_apart(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of the network that ``flat`` holds one after the other."""
    cuts = np.cumsum([math.prod(x) for x in shapes().values()])[:-1]
    return {k: x.reshape(shape) for (k, shape), x in zip(shapes().items(), np.split(flat, cuts), strict=True)}


def begun(noise: np.ndarray, seed: int) -> np.ndarray:
    """The network before any training and its sums of squared gradients, two rows."""
    rng = np.random.default_rng(seed)
    drawn = {k: rng.normal(0, 0.1, shape) for k, shape in shapes().items()} | {"mixing": np.full(shapes()["mixing"], 1 / CONTEXT), "bias": np.log(noise)}
    flat = np.concatenate([x.ravel() for x in drawn.values()])
    return np.stack([flat, np.full_like(flat, 1e-6)]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; float32 exponents are kept from overflowing."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def added(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values``, taken again from the first where they end, by the output, unit or place and unit in ``rows``, of ``size``."""
    rows = rows.astype(np.uint16)
    n = np.bincount(rows, minlength=size)
    out = np.zeros((size, values.shape[1]), np.float32)
    own = np.flatnonzero(n)
    out[own] = np.add.reduceat(values.take(np.argsort(rows, kind="stable"), axis=0, mode="wrap"), (np.cumsum(n) - n)[own])
    return out


def descend(state: np.ndarray, contexts: np.ndarray, units: np.ndarray, noise: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """A pass of noise-contrastive estimation over ``units`` in a drawn order, noise shared by a minibatch; ``state`` changes."""
    outputs = WORDS + CLASSES
    log_noise = (np.log(noise) + np.log(NOISE)).astype(np.float32)
    parts, sums = taken_apart(state[0]), state[1]
    order, steps = rng.permutation(len(units)), np.cumsum(noise)
    places = np.arange(CONTEXT)[:, None] * outputs
    for lo in range(0, len(order), BATCH):
        at = order[lo : lo + BATCH]
        target, before = units.take(at), contexts.take(at, axis=0).T  # before: one row for each place
        drawn = np.minimum(np.searchsorted(steps, rng.random(NOISE) * steps[-1], "right"), outputs - 1)
        # The vectors as they count in each place: one table to gather from.
        before = (before + places).ravel()
        hidden = (parts["mixing"][:, None] * parts["vectors"]).reshape(-1, SIZE).take(before, axis=0).reshape(CONTEXT, -1, SIZE).sum(0)
        out_real, out_false, bias = parts["outputs"].take(target, axis=0), parts["outputs"].take(drawn, axis=0), parts["bias"] - log_noise
        real = np.einsum("ij,ij->i", hidden, out_real) + bias.take(target)
        false = hidden @ out_false.T
        false += bias[drawn]
        share = np.float32(1 / len(at))
        g_real = _sigmoid(real)
        g_real -= 1
        g_real *= share
        g_false = _sigmoid(false)
        g_false *= share
        g_hidden = g_real[:, None] * out_real + g_false @ out_false
        # By place and unit: the sums serve the vectors and the mixing alike.
        by_place = added(before, g_hidden, CONTEXT * outputs).reshape(CONTEXT, outputs, SIZE)
        grads = {
            "vectors": np.einsum("jk,jik->ik", parts["mixing"], by_place),
            "mixing": np.einsum("ik,jik->jk", parts["vectors"], by_place),
            "outputs": added(np.concatenate([target, drawn]), np.concatenate([g_real[:, None] * hidden, g_false.T @ hidden]), outputs),
            "bias": np.bincount(target, g_real, outputs) + np.bincount(drawn, g_false.sum(0), outputs),
        }
        g = np.concatenate([x.ravel() for x in grads.values()]).astype(np.float32)
        sums += g * g
        state[0] -= np.float32(rate) * g / np.sqrt(sums)


def fit_network(model: Model, texts: DataFrame, noise: np.ndarray, seed: int = 11) -> None:
    """Noise-contrastive estimation over all of ``texts``, in rounds of passes by partition that are averaged."""
    spark = texts.sparkSession
    short = Model(model.total, model.kinds, model.hashes, model.counts, model.unit, model.classes, model.mass, end=model.end)
    shared = spark.sparkContext.broadcast(short)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            for _, _, part, off in C.groups(data, offsets):
                h, s, first = tokens(part, off)
                units = m.look_up(h, s)[2].astype(np.uint16).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([units[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["units"])

    sequences = C.written(texts.select("text").mapInArrow(coded, "units binary"), "lm-units")
    state = begun(noise, seed)
    for epoch in range(EPOCHS):
        start = spark.sparkContext.broadcast(state)

        def passed(batches: Iterator[pa.RecordBatch], start=start, epoch=epoch) -> Iterator[pa.RecordBatch]:
            m, own, seen = shared.value, start.value.copy(), 0
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            held: list[np.ndarray] = []
            size = 0

            def learn() -> int:
                first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                units = np.concatenate(held).astype(np.int64)
                descend(own, m.contexts(units, first), units, noise, RATE / (1 + epoch), rng)
                return len(units)

            for batch in batches:
                for text in batch.column(0):
                    held.append(np.frombuffer(text.as_py(), "<u2"))
                    size += len(held[-1])
                    if size >= SHUFFLED:
                        seen += learn()
                        held, size = [], 0
            if held:
                seen += learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.size)), pa.array(own.ravel().astype(np.float64) * seen), pa.array(np.full(own.size, seen))], ["at", "value", "weight"])

        sums = sequences.mapInArrow(passed, "at long, value double, weight long").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("mean")).orderBy("at").toPandas()
        if len(sums):
            state = sums["mean"].to_numpy(np.float32).reshape(state.shape)
        start.unpersist()
    parts = taken_apart(state[0])
    model.vectors, model.mixing, model.outputs, model.bias = (parts[k] for k in ("vectors", "mixing", "outputs", "bias"))


def train(docs: DataFrame, counts: DataFrame, table_words: int = TABLE_WORDS, sample_docs: int | None = None) -> Model:
    """Model of the training documents (doc_id, text) and their exact token counts; a number of ``sample_docs`` fits the network to so many alone."""
    # The least count in the table: the histogram has one row for each of 4 steps to a doubling.
    histogram = counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, words = 2**62, 0
    for row in histogram:
        words += row.words
        if words > table_words:
            break
        least = row.least
    table = counts.where(F.col("n") >= least).select("hash", "suffix", "n").toPandas()
    hashes, n, suffix = (table[k].to_numpy(np.int64) for k in ("hash", "n", "suffix"))
    by_suffix = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    order = np.lexsort((hashes, -n, hashes != END.astype(np.int64)))[:WORDS]  # the end token first
    unit = np.full(len(n), -1)
    unit[order] = np.arange(len(order))
    mass, kinds = np.zeros(1 << 16), np.zeros(1 << 16)
    mass[by_suffix.suffix], kinds[by_suffix.suffix] = by_suffix.n, by_suffix.v
    total, distinct = int(mass.sum()), int(kinds.sum())
    np.subtract.at(mass, suffix[order], n[order])
    np.subtract.at(kinds, suffix[order], 1)
    classes = np.arange(1 << 16) % (CLASSES // 8) + CLASSES - CLASSES // 8
    classes[np.argsort(-mass, kind="stable")[: CLASSES - CLASSES // 8]] = np.arange(CLASSES - CLASSES // 8)
    by = np.argsort(hashes.view(np.uint64))
    model = Model(total, distinct, hashes.view(np.uint64)[by], n[by], unit[by], classes, np.bincount(classes, mass, CLASSES) + 0.1 * (np.bincount(classes, kinds, CLASSES) + 1))

    by_unit = np.concatenate([np.zeros(WORDS), np.bincount(classes, mass, CLASSES)]) + 0.1
    by_unit[: len(order)] += n[order]
    texts = docs
    if sample_docs is not None:
        ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
        texts = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    fit_network(model, texts, by_unit / by_unit.sum())
    return model


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Token counts and log10 probabilities for every row of (doc_id, text, held_out)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    floor = float(np.log10(model.total + 0.1 * (model.kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_mass = np.log10(m.mass)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            rows = []
            for _, _, part, off in C.groups(data, offsets):
                h, s, first = tokens(part, off)
                found, c, unit = m.look_up(h, s)
                own = np.where(found, np.log10(c + 0.1), 0.0)
                model_part = m.log_probs(unit, m.contexts(unit, first)) / np.log(10) + np.where(unit < WORDS, 0.0, own - log_mass[np.maximum(unit - WORDS, 0)])
                n = np.diff(first)
                of = np.repeat(np.arange(len(n)), n)[~found]
                rest, counted = np.unique(np.stack([of.astype(np.uint64), h[~found]]), axis=1, return_counts=True) if len(of) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                rows.append((n, np.add.reduceat(found, first[:-1], dtype=np.int64), np.add.reduceat(own - floor, first[:-1]), np.add.reduceat(model_part, first[:-1]), np.bincount(rest[0].astype(np.int64), minlength=len(n)), rest[1].view(np.int64), counted))
            if not rows:
                continue
            n, known, base, own, sizes, rest, counted = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(known), pa.array(base), pa.array(own), C.list_array(pa.array(rest), sizes), C.list_array(pa.array(counted), sizes)],
                ["doc_id", "held_out", "row", "n_tokens", "known", "base", "own", "rest", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", F.monotonically_increasing_id().alias("row"))
    scored = C.written(rows.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, own double, rest array<long>, times array<long>"), "lm-scored")
    # Words beyond the table: their exact counts are joined in, and the sums go back to the rows.
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("hash"), F.col("x.times").alias("times"))
    seen = rest.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("add")
    )
    joined = scored.select("doc_id", "held_out", "row", "n_tokens", "known", "base", "own").join(seen, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"), (F.col("own") + add).alias("score"),
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows of (doc_id, text, held_out) that are not held out, and score all rows."""
    C.short_batches(docs.sparkSession)
    learn = docs.where(~F.col("held_out"))
    counts = C.written(count_tokens(learn), "lm-counts")
    return score(docs, counts, train(learn, counts))
