"""Nearest neighbours: exact, batched, hybrid with predicates, two-phase.

Every top-k orders by (distance, id), so results are deterministic.  A single query is a
filter, a projection and ``orderBy().limit()``, which runs as TakeOrderedAndProject: each
task keeps k rows.  Many queries at once are broadcast, in blocks of bounded bytes, against
a scan of the corpus; tasks compare by matrix products, take the few that may be among the k
nearest exactly, and shuffle k rows a query.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantize as qz
from ..functions import vectors as vf

#: Bytes of the queries (as doubles) of one broadcast and scan.
QUERY_BYTES = 64 << 20
#: Pairs of one matrix product, and of one exact comparison.
PAIRS = 4 << 20
EXACT_PAIRS = 1 << 16
#: The first phase keeps this many times k.
EXPANSION = 3


def _k(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def _query(query: list[float] | Column) -> Column:
    return query if isinstance(query, Column) else vf.literal(query)


def top(df: DataFrame, distance: Column, k: int, id_col: str) -> DataFrame:
    k = _k(k)
    return df.withColumn("distance", distance).orderBy("distance", id_col).limit(k)


def knn(df: DataFrame, query: list[float] | Column, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows nearest to ``query``; with ``where``, of the rows that satisfy it (filter first)."""
    rows = df if where is None else df.where(where)
    return top(rows, vf.distance(metric, vector, _query(query)), k, id_col)


def knn_vector_first(df: DataFrame, query: list[float] | Column, k: int, where: Column, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", expansion: int = EXPANSION) -> DataFrame:
    """The predicate over the ``expansion`` * k nearest rows; may return fewer than k."""
    near = top(df, vf.distance(metric, vector, _query(query)), k * expansion, id_col)
    return near.where(where).orderBy("distance", id_col).limit(_k(k))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column without nulls; they must agree in length."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"dimension mismatch: {sizes[0]} and {sizes[-1]}")
    return column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rough(metric: str, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in the order of the distances but for rounding, queries x vectors, and far more than the rounding of each query's."""
    dots, qq, vv = q @ v.T, (q * q).sum(1)[:, None], (v * v).sum(1)
    if metric == "l2":
        return qq + vv - 2 * dots, 1e-10 * (qq + np.nanmax(vv, initial=0.0))
    if metric == "ip":
        return -dots, 1e-10 * np.sqrt(qq * np.nanmax(vv, initial=0.0))
    size = np.sqrt(qq * vv)
    return np.where(size == 0, 1.0, 1 - dots / np.where(size == 0, 1.0, size)), np.full(qq.shape, 1e-10)


def _exact(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distance of each pair, summed in the order of the vectors' elements as ``vectors.distance`` does."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    if metric == "l2":
        return np.sqrt(total((v - q) * (v - q)))
    if metric == "ip":
        return -total(v * q)
    size = np.sqrt(total(v * v)) * np.sqrt(total(q * q))
    return np.where(size == 0, 1.0, 1 - total(v * q) / np.where(size == 0, 1.0, size))


class _Nearest:
    """The k nearest (distance, id) of each query among the vectors seen so far."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.bound = np.full((len(queries), 1), np.inf)  # the k-th distance in the order of _rough, or more
        self.of, self.ids, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(ids) and vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"dimension mismatch: {vectors.shape[1]} and {self.queries.shape[1]}")
        step = max(1, PAIRS // max(1, len(ids)))
        for lo in range(0, len(self.queries) if len(ids) else 0, step):
            own = slice(lo, lo + step)
            rough, margin = _rough(self.metric, self.queries[own], vectors)
            rough = np.where(np.isnan(rough), np.inf, rough)
            margin = np.where(np.isnan(margin), np.inf, margin)
            if len(ids) >= self.k:
                kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                self.bound[own] = np.minimum(self.bound[own], kth + margin)
            at, found = np.nonzero(rough <= self.bound[own] + margin)
            for a in range(0, len(at), EXACT_PAIRS):
                q, v = at[a : a + EXACT_PAIRS] + lo, found[a : a + EXACT_PAIRS]
                self._add(q, ids[v], _exact(self.metric, self.queries[q], vectors[v]))

    def _add(self, of: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        of, ids, distance = (np.concatenate(x) for x in ((self.of, of), (self.ids, ids), (self.distance, distance)))
        order = np.lexsort((ids, distance, of))
        of = of[order]
        kept = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        self.of, self.ids, self.distance = of[kept], ids[order][kept], distance[order][kept]


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of the queries, at most ``most`` bytes of vectors at a time on the driver."""
    names, rows, held = [], [], 0
    for name, q in queries.where("query IS NOT NULL").select("query_id", "query").toLocalIterator():
        if rows and (held + 8 * len(q) > most or len(q) != len(rows[0])):
            yield names, np.array(rows, np.float64)
            names, rows, held = [], [], 0
        names.append(name)
        rows.append([np.nan if x is None else x for x in q])
        held += 8 * len(q)
    if rows:
        yield names, np.array(rows, np.float64)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest corpus rows of each of ``queries`` (query_id, query); null vectors take no part.

    Ids are longs.  One scan of the corpus serves ``query_bytes`` of queries, which are sent to
    all tasks; a task compares batches by matrix products and hands on k rows a query.
    """
    spark, parts = queries.sparkSession, []
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), vector)
    schema = f"query_id long, `{id_col}` long, distance double"
    for names, asked in _blocks(queries, query_bytes) if _k(k) else ():
        shared = spark.sparkContext.broadcast((np.array(names, np.int64), asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            best = _Nearest(asked, k, metric)
            for batch in batches:
                best.see(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(names[best.of]), pa.array(best.ids), pa.array(best.distance)], ["query_id", id_col, "distance"])

        parts.append(rows.mapInArrow(run, schema))
    found = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_two_phase(df: DataFrame, query: list[float] | Column, k: int, params: qz.Params = qz.Params(), id_col: str = "vec_id", vector: str = "embedding", expansion: int = EXPANSION) -> DataFrame:
    """Rank by quantized L2, keep ``expansion`` * k, rank those exactly."""
    query = _query(query)
    # The query is quantized once for each row of the plan's constant, not per row of the table.
    rough = vf.l2(qz.reconstructed(qz.quantize(vector, params), params), qz.reconstructed(qz.quantize(query, params), params))
    kept = df.withColumn("rough", rough).orderBy("rough", id_col).limit(k * expansion)
    return top(kept.drop("rough"), vf.l2(vector, query), k, id_col)


def knn_hamming_rerank(df: DataFrame, query: list[float] | Column, k: int, at: list[float], keep: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rank by Hamming distance of the binary forms, keep ``keep``, rank those exactly."""
    query = _query(query)
    kept = df.withColumn("bits_apart", qz.hamming(qz.binary_words(vector, at), qz.binary_words(query, at))).orderBy("bits_apart", id_col).limit(keep)
    return top(kept, vf.l2(vector, query), k, id_col)


def search(rows: DataFrame, query: list[float], k: int, index=None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to ``query`` with their distance: by the graph ``index``, by one built now where over 100 rows lack it, exactly where they are few."""
    from .hnsw import Index

    n = rows.select(id_col).limit(101).count() if _k(k) else 0
    if not n or (index is None and n <= 100):
        return knn(rows, query, k, id_col=id_col, vector=vector)
    index = Index.build(rows, id_col=id_col, vector=vector) if index is None else index
    asked = rows.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<float>")
    found = index.search(asked, k).select(F.col("id").alias("found_id"), "distance")
    return rows.join(F.broadcast(found), F.col(id_col) == F.col("found_id")).drop("found_id").orderBy("distance", id_col)  # k rows


def recall(truth: DataFrame, hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, recall): share of the true neighbours that were found."""
    found = hits.select("query_id", F.col(id_col).alias("hit")).distinct()
    joined = truth.select("query_id", F.col(id_col).alias("true_id")).join(found, (truth["query_id"] == found["query_id"]) & (F.col("true_id") == found["hit"]), "left").select(truth["query_id"], "true_id", "hit")
    return joined.groupBy("query_id").agg((F.count("hit") / F.count("true_id")).alias("recall"))
