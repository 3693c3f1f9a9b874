"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ``ORDER``.  Its statistics are
frozen after training; the code length of a byte follows method C: a symbol seen in
its context costs -log2(c / (n + d)), an unseen one pays the escape -log2(d / (n + d))
and falls back to the next shorter context, down to a uniform byte.  A text gets the
language with the least exact code length over all of its bytes.

Training reads a bounded sample (a documented parameter): per language the
``sample_docs`` documents of least hash, of any length and read whole; their bytes are
counted where they lie and only the counts are gathered.  Prediction reads every byte of
every text.

Edge cases: rows without doc_id can be learnt from like others. a null text, an empty one or one without a letter gets ``und`` and score 0.
Ties go to the language first in order.  With nothing to learn from, every text is
``und``.  Repeated rows are predicted each on its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
SAMPLE_DOCS = 400
#: The posterior counts at most so many bytes of evidence, so that it does not saturate.
EVIDENCE = 50
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


@dataclass
class Model:
    """``seen[k]``: (grams, code lengths by language, nan where unseen); ``escape[k]``: (contexts, escape lengths)."""

    langs: list[str]
    seen: list[tuple[np.ndarray, np.ndarray]]
    escape: list[tuple[np.ndarray, np.ndarray]]

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths in bits, grams x languages; a gram holds its last byte lowest."""
        out = np.full((len(grams), len(self.langs)), 8.0, np.float32)
        for k in range(ORDER + 1):
            key = grams & np.uint64((1 << (8 * (k + 1))) - 1)
            contexts, cost = self.escape[k]
            out += _at(contexts, cost, key >> np.uint64(8), 0.0)
            known = _at(*self.seen[k], key, np.nan)
            out = np.where(np.isnan(known), out, known)
        return out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], np.float32(default))


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to each position; bytes before a text count as 0."""
    data = C.LOWER[data]
    out = data.astype(np.uint64)
    for j in range(1, ORDER + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[j:] = data[:-j] if len(data) > j else 0
        for t in range(j):
            first = offsets[:-1] + t
            shifted[first[first < offsets[1:]]] = 0
        out |= shifted << np.uint64(8 * j)
    return out


def counted(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, kind, gram, times) over texts of a kind each, a very long text piece by piece."""
    for a in range(0, len(data), C.CHUNK_BYTES):
        b = min(len(data), a + C.CHUNK_BYTES)
        before = max(0, a - ORDER)
        grams = grams_of(data[before:b], np.clip(offsets, before, b) - before)[a - before :]
        own = np.clip(offsets, a, b) - a
        size = np.diff(own)
        place = np.arange(a, b) - np.repeat(offsets[:-1], size)
        of = np.repeat(kind, size).astype(np.uint64) << np.uint64(40)
        for k in range(ORDER + 1):
            full = place >= k
            keys, times = np.unique(of[full] | (grams[full] & np.uint64((1 << (8 * (k + 1))) - 1)), return_counts=True)
            yield k, (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1), times


def fit(texts: list[tuple[str, bytes]]) -> Model:
    """Freeze the context trees of (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64)
    rows = counted(np.frombuffer(b"".join(t for _, t in texts), np.uint8), offsets, np.array([langs.index(x) for x, _ in texts], np.int64))
    return freeze(langs, *(np.concatenate(x) for x in zip(*((np.full(len(g), k), of, g, n) for k, of, g, n in rows), strict=True)))


def freeze(langs: list[str], order: np.ndarray, lang: np.ndarray, gram: np.ndarray, times: np.ndarray) -> Model:
    """The code lengths that counts of grams, by order and place of the language, give; a gram may have several rows."""
    seen, escape = [], []
    for k in range(ORDER + 1):
        at = order == k
        grams, back = np.unique(gram[at], return_inverse=True)
        contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        known = np.full((len(grams), len(langs)), np.nan, np.float32)
        costs = np.zeros((len(contexts), len(langs)), np.float32)
        for j in range(len(langs)):
            own = lang[at] == j
            c = np.bincount(back[own], times[at][own], len(grams))
            n = np.bincount(of, c, len(contexts))
            d = np.bincount(of[c > 0], minlength=len(contexts))
            known[c > 0, j] = np.log2((n + d)[of[c > 0]] / c[c > 0])
            costs[d > 0, j] = np.log2((n + d)[d > 0] / d[d > 0])
        seen.append((grams, known))
        escape.append((contexts, costs))
    return Model(langs, seen, escape)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on the bounded sample of (doc_id, text, lang) rows."""
    fit_for = C.stable(labelled).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.monotonically_increasing_id().alias("row"))
    rows = C.least_hashes(fit_for.select("doc_id", "lang", "row"), "lang", sample_docs, ["doc_id", "row"]).select("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).dictionary_encode()
            data, offsets = C.text_bytes(batch.column(1))
            names, of = kinds.dictionary, np.asarray(kinds.indices)
            for lo, hi, part, off in C.groups(data, offsets):
                for k, own, grams, times in counted(part, off, of[lo:hi]):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(np.full(len(own), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(times)], ["lang", "k", "gram", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).dictionary_encode()
            of = np.asarray(kinds.indices).astype(np.int64) * (ORDER + 1) + np.asarray(batch.column(1))
            order = np.argsort(of, kind="stable")
            groups, first = np.unique(of[order], return_index=True)
            grams, times = (np.split(np.asarray(batch.column(i))[order], first[1:]) for i in (2, 3))
            own = [kinds.dictionary[int(x)].as_py() for x in groups // (ORDER + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array((groups % (ORDER + 1)).astype(np.int32)), *(pa.array([x.tobytes() for x in part][: len(own)], pa.binary()) for part in (grams, times))], ["lang", "k", "grams", "times"])

    sample = fit_for.join(F.broadcast(rows), "row", "left_semi").select("lang", "text")
    counts = sample.mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    # A row holds many grams, so that the driver has no objects for each.
    found = counts.mapInArrow(packed, "lang string, k int, grams binary, times binary").collect()
    langs = sorted({r.lang for r in found})
    sizes = [len(r.grams) // 8 for r in found]
    order, lang = (np.repeat(np.array(x, np.int64), sizes) for x in ([r.k for r in found], [langs.index(r.lang) for r in found]))
    return freeze(langs, order, lang, np.frombuffer(b"".join(r.grams for r in found), np.uint64), np.frombuffer(b"".join(r.times for r in found), np.int64))


class _Scorer:
    """Code lengths of grams through a direct-mapped table that outlives the batch."""

    def __init__(self, model: Model):
        self.model, g = model, max(1, len(model.langs))
        self.bits = max(12, min(21, 24 - g.bit_length()))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros((1 << self.bits, g), np.float32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slot = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        hit = self.keys[slot] == grams
        out = self.values[slot]
        if not hit.all():
            new, back = np.unique(grams[~hit], return_inverse=True)
            lengths = self.model.lengths(new)
            out[~hit] = lengths[back]
            at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
            self.values[at] = lengths
            self.keys[at] = new
        return out


def _totals(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, lengths.shape[1]))
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(lengths, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def _judge(text: pa.Array, letters: pa.Array, model: Model, score_of: _Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior and bits per byte of each text."""
    data, offsets = C.text_bytes(text)
    bits = np.zeros((len(text), max(1, len(model.langs))))
    for lo, hi, part, off in C.groups(data, offsets):
        if model.langs and len(part):
            for a in range(0, len(part), C.CHUNK_BYTES):  # a very long text piece by piece
                b = min(len(part), a + C.CHUNK_BYTES)
                before = max(0, a - ORDER)
                grams = grams_of(part[before:b], np.clip(off, before, b) - before)[a - before :]
                bits[lo:hi] += _totals(score_of(grams), np.clip(off, a, b) - a)
    n = np.diff(offsets)
    known = np.asarray(letters.fill_null(False)) & (len(model.langs) > 0)
    least = bits.min(axis=1)
    rate = (bits - least[:, None]) / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
    score = 1 / np.exp2(-np.minimum(rate, 1000)).sum(axis=1)
    langs = np.array([*model.langs, "und"], object)
    return langs[np.where(known, bits.argmin(axis=1), len(model.langs))], np.where(known, score, 0.0), np.where(known, least / np.maximum(n, 1), 0.0)


def _letters() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row of (doc_id, text, held_out)."""
    spark = df.sparkSession
    C.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _Scorer(shared.value)
        for batch in batches:
            lang, score, bits = _judge(batch.column(1), batch.column(2), shared.value, score_of)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _letters().alias("letters"), "held_out").mapInArrow(run, SCHEMA)


def recognised(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows whose text has a language with a posterior of ``least_score`` or more, whole and with all columns."""
    spark = docs.sparkSession
    C.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _Scorer(shared.value)
        for batch in batches:
            lang, score, _ = _judge(batch.column(at), batch.column(n), shared.value, score_of)
            kept = batch.filter(pa.array((lang != "und") & (score >= least_score)))
            yield pa.RecordBatch.from_arrays(kept.columns[:n], docs_names)

    docs_names = docs.columns
    return docs.select("*", _letters()).mapInArrow(run, docs.schema)
