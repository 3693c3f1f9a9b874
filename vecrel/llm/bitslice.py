"""Exact top-k search over a bit-sliced index.

Every component x becomes the integer floor(64 x).  A block of rows holds, for each
dimension and each bit of the (offset) integers, one bitmap over its rows, in order of
vec_id.  A query multiplies by its own components as shifts: each slice enters the sum
once for each set bit of the multiplier, negative multipliers through the complement.
Slices of equal weight are added by carry-save adders, so a whole block is scored with
bitmap arithmetic.  The best rows are chosen from the most significant slice downward;
rows that tie at the boundary are resolved exactly, by smaller vec_id.

A block's bitmaps are built once.  Packed queries go to all blocks and meet a block's
bitmaps, of which there is one copy for ``LANE`` parts of queries; each meeting returns at
most k rows for a query, and the k best of these are the result.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor
do rows without vec_id.  Integers beyond a long count as the nearest long; sums are exact
whatever their width and rank as such, and only the reported score is cut to a long.
Missing components of shorter vectors count as 0.  Rows with the query's own vec_id are
no candidates; repeated rows are candidates each on its own.  Fewer candidates than k are
all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK_ROWS = 1 << 16
BLOCK_QUERIES, LANE = 128, 4
_LOW = (1 << 62) - 1


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, q): integers of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("q")
    )


def matrix(vectors: list, width: int = 0) -> np.ndarray:
    sizes = np.array([len(v) for v in vectors], np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(vectors), width), np.int64)
    if len(vectors) and (sizes == width).all():
        return np.stack(vectors).astype(np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Index:
    """Bitmaps of a block: ``plain[dimension, bit]`` of the integers less ``low``, rows in order of ``ids``."""

    def __init__(self, ids: np.ndarray, low: int, plain: np.ndarray):
        self.ids, self.low, self.plain, self.bits = ids, low, plain, plain.shape[1]
        self.valid = self._packed(np.ones(len(ids), bool), plain.shape[2])
        self.slices = np.stack([plain, ~plain])  # by sign, 1 being the complement

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Index:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order].astype(np.int64)
        low, high = int(values.min(initial=0)), int(values.max(initial=0))
        shifted = values.view(np.uint64) - np.uint64(low % 2**64)  # fits, though the difference need not fit a long
        words = -(-len(ids) // 64)
        plain = np.zeros((values.shape[1], max(1, (high - low).bit_length()), words), np.uint64)
        for d in range(plain.shape[0]):
            for b in range(plain.shape[1]):
                plain[d, b] = cls._packed((shifted[:, d] >> np.uint64(b)) & np.uint64(1), words)
        return cls(ids, low, plain)

    @staticmethod
    def _packed(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8").astype(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the non-negative sums, least first, and the constant to add."""
        query = query[: self.slices.shape[1]].astype(np.int64)
        size = np.abs(query).view(np.uint64)  # right for the least long too
        sign = (query < 0).astype(np.int64)
        constant = self.low * sum(query.tolist()) - sum(size[query < 0].tolist()) * ((1 << self.bits) - 1)
        columns: dict[int, list[np.ndarray]] = {}
        for shift in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero((size >> np.uint64(shift)) & np.uint64(1))
            if len(dims):
                for b in range(self.bits):
                    columns.setdefault(shift + b, []).append(self.slices[sign[dims], dims, b])
        out, weight = [], 0
        while weight <= max(columns, default=-1):
            rows = np.concatenate(columns.pop(weight)) if weight in columns else np.zeros((0, len(self.valid)), np.uint64)
            while len(rows) > 1:  # carry-save: three rows of a weight become one, and one of the next
                if len(rows) == 2:
                    columns.setdefault(weight + 1, []).append((rows[0] & rows[1])[None])
                    rows = (rows[0] ^ rows[1])[None]
                    break
                third = len(rows) // 3
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                half = a ^ b
                columns.setdefault(weight + 1, []).append((a & b) | (c & half))
                rows = np.concatenate([half ^ c, rows[3 * third :]])
            out.append(rows[0] if len(rows) else np.zeros(len(self.valid), np.uint64))
            weight += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, ...]:
        """vec_ids of the k best rows but those of ``own``, and their scores in three parts, of 62 bits from below."""
        slices, constant = self.scores(query)
        tied = self.valid.copy()
        lo, hi = np.searchsorted(self.ids, [own, own + 1])
        for row in range(lo, hi):
            tied[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure, n = np.zeros_like(tied), 0
        for s in reversed(slices):
            high = tied & s
            more = int(np.bitwise_count(high).sum())
            if n + more > k:
                tied = high
            else:
                sure |= high
                n += more
                tied &= ~s
                if n == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.astype("<u8").view(np.uint8), bitorder="little"))
        if n < k:  # all that are left have the same score
            boundary = np.flatnonzero(np.unpackbits(tied.astype("<u8").view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, boundary[: k - n]])
        kind = np.int64 if len(slices) < 62 and abs(constant) < 1 << 62 else object
        total = np.full(len(rows), constant, kind)
        for j, s in enumerate(slices):
            total += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << j
        middle = total >> 62
        return self.ids[rows], (middle >> 62).astype(np.int64), (middle & _LOW).astype(np.int64), (total & _LOW).astype(np.int64)


def _dealt(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt over blocks by a hash; a row's place takes part, so repeated rows spread as well."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")), n


def search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of ``vectors`` (vec_id, embedding) of greatest inner product with each of ``queries``."""
    rows, n_rows = _dealt(usable(C.stable(vectors)), block_rows, "block")
    asked, n_parts = _dealt(usable(C.stable(queries)), block_queries, "part")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index.of(pdf.vec_id.to_numpy(np.int64), matrix(list(pdf.q)))
        return pd.DataFrame({"block": [key[0]], "ids": [index.ids.tobytes()], "low": [index.low], "dims": [index.plain.shape[0]], "bits": [index.bits], "plain": [index.plain.tobytes()]})

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = matrix(list(pdf.q))
        return pd.DataFrame({"part": [key[0]], "ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "dims": [values.shape[1]], "data": [values.tobytes()]})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            index = Index(ids, r.low, np.frombuffer(r.plain, np.uint64).reshape(r.dims, r.bits, -1))
            for own in right.itertuples():
                for query_id, query in zip(np.frombuffer(own.ids, np.int64).tolist(), np.frombuffer(own.data, np.int64).reshape(-1, own.dims), strict=True):
                    found = index.top(query, query_id, k)
                    out.append(np.stack([np.full(len(found[0]), query_id), *found]))
        return pd.DataFrame(np.concatenate([np.zeros((5, 0), np.int64), *out], axis=1).T, columns=["query_id", "vec_id", "high", "middle", "low"])

    lanes = -(-n_parts // LANE)
    index = rows.groupBy("block").applyInPandas(build, "block int, ids binary, low long, dims int, bits int, plain binary").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    parts = asked.groupBy("part").applyInPandas(pack, "part int, ids binary, dims int, data binary")
    parts = parts.withColumn("lane", F.pmod("part", F.lit(lanes))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    found = index.groupBy("block", "lane").cogroup(parts.groupBy("block", "lane")).applyInPandas(meet, "query_id long, vec_id long, high long, middle long, low long")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id")
    fits = ((F.col("high") == 0) & (F.col("middle") < 2)) | ((F.col("high") == -1) & (F.col("middle") >= _LOW - 1))
    score = F.when(fits, F.shiftleft("middle", 62).bitwiseOR(F.col("low"))).when(F.col("high") < 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
