"""Approximate nearest neighbours over hierarchical small-world graphs, one per shard.

Rows are dealt into shards of bounded size by a hash of their id; each shard builds its
own graph in one grouped task and the graph is a table like any other, one row per node.
A search runs in every shard and the shards' answers, k each, are merged by an exact
top-k.  Parameters travel with the table.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_finite

#: Queries that are gathered and sent to the shards at a time.
QUERY_BLOCK = 4096
FORMAT, VERSION = "small-world-graph", 1
NODES = "shard int, node int, id long, level int, neighbors array<array<int>>, vector array<float>"


@dataclass(frozen=True)
class Params:
    m: int = 16
    ef_construction: int = 64
    ef_search: int = 100
    max_level: int = 8
    seed: int = 42
    metric: str = "l2"
    shard_rows: int = 20_000

    def __post_init__(self) -> None:
        if self.m <= 0 or self.ef_construction < self.m or not 0 < self.max_level <= 16:
            raise ValueError("bad graph parameters")

    @classmethod
    def high_recall(cls) -> Params:
        return cls(m=48, ef_construction=200, ef_search=200)

    @classmethod
    def low_memory(cls) -> Params:
        return cls(m=8, ef_construction=50, ef_search=50)


class Graph:
    """One shard's graph, built and searched in memory."""

    def __init__(self, dims: int, params: Params):
        self.params, self.vectors = params, np.zeros((0, dims), np.float32)
        self.links: list[list[list[int]]] = []
        self.entry, self.state = -1, params.seed
        # Of (node, level) with all its links taken: links as (distance, node) ascending, a bit for each, and the bits of those nearer to it than the node.
        self.full: dict[tuple[int, int], tuple[list[tuple[float, int]], list[int], list[int]]] = {}

    @property
    def vectors(self) -> np.ndarray:
        return self._vectors

    @vectors.setter
    def vectors(self, vectors: np.ndarray) -> None:
        self._vectors, self.exact = vectors, vectors.astype(np.float64)

    def distances(self, query: np.ndarray, at: list[int]) -> np.ndarray:
        rows = self.exact[at]
        if self.params.metric == "l2":
            rows -= query
            rows *= rows
            return np.sqrt(np.add.reduce(rows, axis=1))
        dots = rows @ query
        if self.params.metric == "ip":
            return -dots
        size = np.linalg.norm(rows, axis=1) * np.linalg.norm(query)
        return np.where(size > 0, 1 - dots / np.where(size > 0, size, 1), 1.0)

    def draw_level(self) -> int:
        # Fixed values of the level generator: a 64-bit linear congruential step.
        self.state = (self.state * 6364136223846793005 + 1) % 2**64
        u = max((self.state >> 32) / (2**32 - 1), 1e-12)
        return min(int(-math.log(u) / math.log(self.params.m)), self.params.max_level - 1) if self.params.m > 1 else 0

    def beam(self, query: np.ndarray, entries: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on a level, ascending."""
        return self.explore(query, entries, ef, level)[0]

    def explore(self, query: np.ndarray, entries: list[int], ef: int, level: int) -> tuple[list[tuple[float, int]], dict[int, float]]:
        """The ef nearest nodes found on a level, ascending, and the distances of all nodes seen: these and all their links."""
        start = list(dict.fromkeys(entries))
        near = list(zip(self.distances(query, start).tolist(), start, strict=True))
        seen, frontier = {i: d for d, i in near}, list(near)
        heapq.heapify(frontier)
        kept = [(-d, -i) for d, i in near]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while frontier:
            d, node = heapq.heappop(frontier)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = [x for x in self.links[node][level] if x not in seen] if level < len(self.links[node]) else []
            if not fresh:
                continue
            apart = self.distances(query, fresh).tolist()
            seen.update(zip(fresh, apart, strict=True))
            for e, x in zip(apart, fresh, strict=True):
                if len(kept) < ef or e < -kept[0][0]:
                    heapq.heappush(frontier, (e, x))
                    heapq.heappush(kept, (-e, -x))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -i) for d, i in kept), seen

    def select(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Diverse neighbours: a candidate nearer to a chosen one than to the query waits, and fills up the end."""
        if len(found) <= m:
            return [i for _, i in found]
        chosen: list[int] = []
        waiting: list[int] = []
        ids, apart = [i for _, i in found], np.array([d for d, _ in found])
        waits = np.zeros(len(ids), bool)
        for at, i in enumerate(ids):
            if len(chosen) == m:
                break
            if waits[at]:
                waiting.append(i)
            else:
                chosen.append(i)
                waits[at + 1 :] |= self.distances(self.exact[i], ids[at + 1 :]) < apart[at + 1 :]
        return (chosen + waiting)[:m]

    def link(self, other: int, level: int, node: int, seen: dict[int, float], cap: int) -> None:
        """A link back to a new node; beyond ``cap`` links one goes, as ``select`` would have it.

        ``seen`` has the new node's distances to the other one and to its links. Which links are nearer
        to one another than to their node is kept in bits, so a link costs no distances of its own.
        """
        own = self.links[other][level]
        if len(own) < cap:
            own.append(node)
            return
        if (other, level) not in self.full:
            ranked = sorted(zip(self.distances(self.exact[other], own).tolist(), own, strict=True))
            ids, apart = [i for _, i in ranked], np.array([d for d, _ in ranked])
            nearer = np.stack([self.distances(self.exact[i], ids) < apart for i in ids], axis=1)  # of a row: by column
            bits = [1 << x for x in range(cap)]
            self.full[other, level] = ranked, bits, [sum(b for b, near in zip(bits, row, strict=True) if near) for row in nearer.tolist()]
        ranked, bits, nearer = self.full[other, level]
        new, d, mine = ((2 << cap) - 1) & ~sum(bits), seen[other], 0
        for x, (e, i) in enumerate(ranked):
            between = seen[i]
            if between < e:
                nearer[x] |= new
            else:
                nearer[x] &= ~new
            if between < d:
                mine |= bits[x]
        place = bisect(ranked, (d, node))
        ranked.insert(place, (d, node))
        bits.insert(place, new)
        nearer.insert(place, mine)
        chosen, waiting, held = [], [], 0
        for x, (bit, near) in enumerate(zip(bits, nearer, strict=True)):
            if near & held:
                waiting.append(x)
            else:
                chosen.append(x)
                held |= bit
        *order, gone = chosen + waiting
        self.links[other][level] = [ranked[x][1] for x in order]
        del ranked[gone], bits[gone], nearer[gone]

    def build(self, vectors: np.ndarray) -> Graph:
        self.vectors = vectors.astype(np.float32)
        for node in range(len(vectors)):
            query, level = self.exact[node], self.draw_level()
            self.links.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry = node
                continue
            top, entries = len(self.links[self.entry]) - 1, [self.entry]
            for at in range(top, level, -1):
                entries = [self.beam(query, entries, 1, at)[0][1]]
            for at in range(min(level, top), -1, -1):
                found, seen = self.explore(query, entries, self.params.ef_construction, at)
                cap = self.params.m * (1 if at else 2)
                self.links[node][at] = self.select(found, cap)
                for other in self.links[node][at]:
                    self.link(other, at, node, seen, cap)
                entries = [i for _, i in found]
            if level > top:
                self.entry = node
        self.full.clear()
        return self

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0 or not k:
            return []
        query, entries = np.asarray(query, np.float64), [self.entry]
        for at in range(len(self.links[self.entry]) - 1, 0, -1):
            entries = [self.beam(query, entries, 1, at)[0][1]]
        return self.beam(query, entries, max(ef, k), 0)[:k]


def _by_shard(df: DataFrame, shards: int) -> GroupedData:
    """Rows grouped by shard, each shard in a task of its own: by a hash, or in small partitions put together, some tasks would have several."""
    return df.repartitionById(shards, F.col("shard")).groupBy("shard")


class Index:
    """The graphs of all shards as a table, with their parameters."""

    def __init__(self, nodes: DataFrame, params: Params, dims: int, shards: int):
        self.nodes, self.params, self.dims, self.shards = nodes, params, dims, shards

    @classmethod
    def build(cls, df: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector: str = "embedding") -> Index:
        """Validates all vectors before any graph is built."""
        checked = df.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.bool_and(F.coalesce(is_finite(vector), F.lit(False))).alias("fine")).first()
        if checked.n and checked.lo != checked.hi:
            raise ValueError(f"dimension mismatch: {checked.lo} and {checked.hi}")
        if checked.n and not checked.fine:
            raise ValueError("a vector is null or holds NaN or infinite values")
        shards = max(1, -(-checked.n // params.shard_rows))

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            graph = Graph(checked.hi, params).build(np.stack(pdf.vector.to_list()))
            return pd.DataFrame(
                {"shard": key[0], "node": np.arange(len(pdf), dtype=np.int32), "id": pdf.id.to_numpy(), "level": np.array([len(x) - 1 for x in graph.links], np.int32), "neighbors": graph.links, "vector": pdf.vector.to_list()}
            )

        dealt = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        return cls(_by_shard(dealt, shards).applyInPandas(grow, NODES), params, checked.hi or 0, shards)

    def with_ef_search(self, ef: int) -> Index:
        return Index(self.nodes, replace(self.params, ef_search=ef), self.dims, self.shards)

    def search(self, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, id, distance, rank) of a query set (query_id, query), sent to the shards in blocks."""
        if k < 0:
            raise ValueError("k must not be negative")
        params, dims, spark = self.params, self.dims, self.nodes.sparkSession
        rows, shared = queries.select("query_id", "query").toLocalIterator(), []
        while asked := [(r[0], np.asarray(r[1], np.float64)) for r in islice(rows, block)]:
            for _, q in asked:
                if len(q) != dims:
                    raise ValueError(f"dimension mismatch: expected {dims}, got {len(q)}")
                if not np.isfinite(q).all():
                    raise ValueError("a query vector holds NaN or infinite values")
            shared.append(spark.sparkContext.broadcast(asked))

        def look(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            graph = Graph(dims, params)
            graph.vectors = np.stack(pdf.vector.to_list()).astype(np.float32)
            graph.links = [[list(x) for x in own] for own in pdf.neighbors]
            # Levels are drawn in node order, and only a higher level moves the entry.
            graph.entry = int(np.argmax(pdf.level.to_numpy()))
            ids = pdf.id.to_numpy()
            rows = [(name, int(ids[i]), d) for part in shared for name, q in part.value for d, i in graph.search(q, k, params.ef_search)]
            return pd.DataFrame(rows, columns=["query_id", "id", "distance"]).astype({"query_id": "int64", "id": "int64", "distance": "float64"})

        found = _by_shard(self.nodes, self.shards).applyInPandas(look, "query_id long, id long, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def stats(self) -> DataFrame:
        """(level, nodes, avg_degree, max_degree): by each level that a node reaches."""
        levels = self.nodes.select(F.posexplode("neighbors").alias("level", "links"))
        return levels.groupBy("level").agg(F.count("*").alias("nodes"), F.avg(F.size("links")).alias("avg_degree"), F.max(F.size("links")).alias("max_degree"))

    def memory(self) -> DataFrame:
        """(nodes, vector_bytes, link_bytes) at 4 bytes for a coordinate and a link."""
        links = F.aggregate("neighbors", F.lit(0), lambda s, x: s + F.size(x))
        return self.nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).alias("vector_bytes"), F.coalesce(F.sum(links * 4), F.lit(0)).alias("link_bytes"))

    def save(self, path: str) -> None:
        """The node table and, beside it, the format, version, dimension and all parameters."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"format": FORMAT, "version": VERSION, "dims": self.dims, "params": asdict(self.params)})
        self.nodes.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def saved(spark: SparkSession, path: str) -> bool:
        """Whether a whole index is there: its description is written last."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
        return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: int | None = None) -> Index:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if about.get("format") != FORMAT:
            raise ValueError("not a graph index")
        if about["version"] != VERSION:
            raise ValueError(f"unsupported version {about['version']}")
        if dims is not None and about["dims"] != dims:
            raise ValueError(f"dimension mismatch: expected {dims}, got {about['dims']}")
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
        return cls(nodes, Params(**about["params"]), about["dims"], (nodes.agg(F.max("shard")).first()[0] or 0) + 1)


def in_memory(vectors: np.ndarray, params: Params = Params()) -> Graph:
    """A single graph over a small array, for tests and tuning."""
    return Graph(vectors.shape[1], params).build(vectors)


def neighbours(graph: Graph, queries: np.ndarray, k: int) -> Iterator[list[int]]:
    for q in queries:
        yield [i for _, i in graph.search(q, k, graph.params.ef_search)]
