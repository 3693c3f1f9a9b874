"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case.  A passage of a document becomes a
candidate for an item where they share word ``SEED``-grams on nearby diagonals; it stays
one if a shared seed is among the rarer half of the item's seeds (by the number of
documents that hold them, counted over all documents) or if it shares two seeds.  The
passage and the whole item are then aligned locally (match 2, mismatch -1, gap -1) and
the alignment score is divided by its greatest possible value.  A score of ``THRESHOLD``
or more is a leak.

The benchmark is sent to the executors in blocks of about ``BLOCK_WORDS`` words, so what
is broadcast is bounded whatever its size; each further block reads the documents again.

Edge cases: null or empty texts have no words and no leak, as have items shorter than
``SEED`` words.  Repeated items and documents are each reported.  A document and an item
give one row, with the best alignment; ties go to the earlier passage.  An empty table
on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEED = 3
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, 1, 1
CANDIDATES = "row long, doc_id long, item int, start int, words array<long>, seeds array<int>"
SCHEMA = "row long, doc_id long, item_id long, score double, start int, stop int, n_seeds int"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the first word of each text."""
    low = C.LOWER[data]
    starts, ends, first = C.runs(C.ALNUM[low], offsets)
    return C.spans_hash(C.prefix_hash(low), starts, ends), first


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; shorter by n - 1."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
    return C.mix(out)


class Benchmark:
    """A block of items: word hashes by item, and the sorted seeds with where they occur."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        hashes, first = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids, self.items = ids, [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        own = [grams(x, SEED) for x in self.items]
        gram = np.concatenate([*own, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        place = np.concatenate([*(np.arange(len(x)) for x in own), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(gram))
        self.size = np.array([len(x) for x in self.items])

    def passages(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        """(text, item, first word, past last word, seeds) of the candidate passages."""
        if not len(self.keys) or len(hashes) < SEED:
            return
        g = grams(hashes, SEED)
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == g)
        text = np.searchsorted(first, hit, "right") - 1
        inside = hit + SEED <= first[text + 1]
        hit, text = hit[inside], text[inside]
        if not len(hit):
            return
        key = at[hit]
        times = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key] - np.cumsum(times) + times, times) + np.arange(times.sum())
        hit, text, key = np.repeat(hit, times), np.repeat(text, times), np.repeat(key, times)
        item = self.item[entry]
        slack = self.size[item] // 4 + SEED
        lo = np.maximum(hit - self.place[entry] - slack, first[text])
        hi = np.minimum(hit - self.place[entry] + self.size[item] + slack, first[text + 1])
        order = np.lexsort((lo, item, text))
        text, item, lo, hi, key = (x[order] for x in (text, item, lo, hi, key))
        # Overlapping stretches of the same text and item make one passage.
        group = np.cumsum(np.concatenate([[0], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        top = np.maximum.accumulate(hi + group * (len(hashes) + 1)) - group * (len(hashes) + 1)
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] > top[:-1])])
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], len(text)), strict=True):
            yield int(text[a]), int(item[a]), int(lo[a]), int(top[b - 1]), np.unique(key[a:b])


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of the pairs and where in the passage the best alignment ends."""
    width, depth = max(map(len, passages)), max(map(len, items))
    a, b = np.zeros((len(passages), width), np.uint64), np.ones((len(items), depth), np.uint64)
    real = np.zeros((len(passages), width), bool)
    for i, (x, y) in enumerate(zip(passages, items, strict=True)):
        a[i, : len(x)], b[i, : len(y)], real[i, : len(x)] = x, y, True
    size = np.array([len(y) for y in items])
    ramp = np.arange(width, dtype=np.int32) * GAP
    row = np.zeros((len(passages), width + 1), np.int32)
    best, stop = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    for j in range(depth):
        step = np.where((a == b[:, j : j + 1]) & real, MATCH, -MISMATCH).astype(np.int32)
        cell = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - GAP), 0)
        row[:, 1:] = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        top = np.where(j < size, row[:, 1:].max(axis=1), 0)
        better = top > best
        stop[better] = row[better, 1:].argmax(axis=1) + 1
        best = np.maximum(best, top)
    return best, stop


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, doc_id, item_id, score, start, stop, n_seeds) of every leak; ``row`` tells repeated documents apart."""
    spark = docs.sparkSession
    C.short_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block_words)))
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_words words
        found = _find(docs, Benchmark([r.item_id for r in own], [r.text for r in own]), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _find(docs: DataFrame, block: Benchmark, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(2))
            rows: list[tuple] = []
            for lo, _, part, off in C.groups(data, offsets):
                hashes, first = words(part, off)
                rows += [(lo + t, i, a - int(first[t]), hashes[a:b], s) for t, i, a, b, s in bench.passages(hashes, first)]
            if rows:
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                        C.list_array(pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)), np.array([len(r[3]) for r in rows])),
                        C.list_array(pa.array(np.concatenate([r[4] for r in rows]).astype(np.int32)), np.array([len(r[4]) for r in rows])),
                    ],
                    ["row", "doc_id", "item", "start", "words", "seeds"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    candidates = C.written(rows.mapInArrow(scan, CANDIDATES), "leak-candidates")
    # Documents by seed: at most one row for each seed of the block.
    spread = candidates.select("row", F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count_distinct("row").alias("n")).toPandas()
    count = np.zeros(len(block.keys), np.int64)
    count[spread.seed] = spread.n
    rare = np.zeros(len(block.keys), bool)
    for x in block.items:
        own = np.searchsorted(block.keys, grams(x, SEED))
        if len(own):
            rare[own[count[own] <= np.median(count[own])]] = True
    shared_rare = spark.sparkContext.broadcast(rare)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, rare = shared.value, shared_rare.value
        for batch in batches:
            wo, so = (np.asarray(batch.column(i).offsets).astype(np.int64) for i in (4, 5))
            hashes = np.asarray(batch.column(4).values).view(np.uint64)
            seeds = np.asarray(batch.column(5).values)
            item = np.asarray(batch.column(2))
            keep = [i for i in range(batch.num_rows) if so[i + 1] - so[i] >= 2 or rare[seeds[so[i] : so[i + 1]]].any()]
            keep.sort(key=lambda i: (wo[i + 1] - wo[i], i))
            out = []
            for a in range(0, len(keep), 256):
                own = keep[a : a + 256]
                targets = [bench.items[item[i]] for i in own]
                best, stop = align([hashes[wo[i] : wo[i + 1]] for i in own], targets)
                share = best / (MATCH * np.array([len(t) for t in targets]))
                out += [(i, s, e) for i, s, e in zip(own, share, stop, strict=True) if s >= threshold]
            if out:
                at = pa.array([i for i, _, _ in out])
                start = np.asarray(batch.column(3).take(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array([bench.ids[item[i]] for i, _, _ in out], pa.int64()), pa.array([float(s) for _, s, _ in out]),
                        pa.array(start), pa.array((start + np.array([e for _, _, e in out])).astype(np.int32)), pa.array([int(so[i + 1] - so[i]) for i, _, _ in out], pa.int32()),
                    ],
                    ["row", "doc_id", "item_id", "score", "start", "stop", "n_seeds"],
                )

    order = Window.partitionBy("row", "item_id").orderBy(F.desc("score"), "start")
    judged = candidates.mapInArrow(judge, SCHEMA)
    return judged.withColumn("at", F.row_number().over(order)).where(F.col("at") == 1).drop("at")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a leak, whole and with all columns; rows are told apart by their place in the table."""
    docs = C.stable(docs)
    row = C.fresh(docs, "row")
    leaks = find(docs, benchmark, threshold).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, F.monotonically_increasing_id()).join(leaks, row, "left_anti").select(docs.columns)
