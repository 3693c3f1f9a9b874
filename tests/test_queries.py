"""Every query with an oracle against DuckDB over the same files."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecrel import queries as Q
from vecrel.operators import hnsw
from vecrel.operators import relational as rel

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def rows(df: pd.DataFrame) -> list:
    def one(x):
        if isinstance(x, str | bool):
            return x
        if x is None or pd.isna(x):
            return None
        if isinstance(x, pd.Timestamp):
            return str(x)
        return round(float(x), 6) if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_oracle(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(Q.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["vec_format"])
def test_runs(spark, name):
    found = Q.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    for c in found.columns:
        if c.startswith("same"):
            assert found[c].all()


def test_plans(spark):
    plan = Q.explain(Q.knn_l2_exact(spark, SF))
    assert "TakeOrderedAndProject" in plan
    plan = Q.explain(Q.key_point(spark, SF))
    assert "EqualTo(o_orderkey,777)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "WindowGroupLimit" in Q.explain(Q.knn_batch_join(spark, SF))


def test_conflicts_of_all_events(spark, duck):
    """The whole write set against brute force, with conflicts beyond the first 1,000 events."""
    larger = SF.replace("sf0.001", "sf0.01")  # the smallest table ends before event 1,000
    found = {(r.key, r.winner, r.loser) for r in Q.mvcc_conflicts(spark, larger).collect()}
    by_key = {}
    for event, user in duck.sql(f"SELECT event_id, user_id FROM '{larger}/events.parquet'").fetchall():
        by_key.setdefault(user, []).append(event)
    assert found == {(u, a, b) for u, own in by_key.items() for a in own for b in own if a + 40 < b + 40 and a + 40 > b}
    assert any(a >= 1000 for _, a, _ in found)


def test_searches_ask_every_hundredth_row(spark, duck):
    """Queries are all ids divisible by 100, not the first few; the exact join against numpy."""
    table = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_list()).astype(np.float64)
    asked = {int(i) for i in ids if i % 100 == 0}
    found = {}
    for r in Q.knn_batch_join(spark, SF).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(found) == asked
    for q, own in found.items():
        apart = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        assert [own[k] for k in range(1, 6)] == ids[np.lexsort((ids, apart))[:5]].tolist()
    assert {r.query_id for r in Q.knn_hnsw(spark, SF).collect()} == asked
    assert {r.query_id for r in Q.hnsw_recall(spark, SF).collect()} == asked


def test_graph_search_in_blocks(spark):
    index = hnsw.Index.build(Q.emb(spark, SF))
    queries = Q.emb(spark, SF).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole, cut = (sorted(map(tuple, index.search(queries, 3, **b).collect())) for b in ({}, {"block": 2}))
    assert whole == cut and len(whole) == 3 * queries.count()


def _against_sql(spark, folder, name: str, **tables: pd.DataFrame) -> tuple[list, list]:
    """The rows of a query over tables of the test's own, and those of its SQL."""
    c = duckdb.connect()
    for t, own in tables.items():
        own.to_parquet(f"{folder}/{t}.parquet", index=False)
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return rows(Q.QUERIES[name](spark, str(folder)).toPandas()), rows(c.sql(Q.ORACLES[name]).df())


def test_own_writes_beside_an_event_of_the_same_number(spark, tmp_path):
    """Events of larger tables have the transaction's number, 1,000,000, as their own: begun by others, or the end of what is seen."""
    events = pd.DataFrame({"event_id": [1, 2, 400, 3, 999_999, 1_000_000, 1_000_001], "user_id": [3, 5, 5, 7, 8, 7, 7], "value": [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0]})
    found, expected = _against_sql(spark, tmp_path, "mvcc_read_own_writes", events=events)
    assert found == expected == [(1_000_000, 3, 4.25), (3, 7, 3.0), (400, 5, 2.5)]


@pytest.mark.parametrize("dims,seed", [(3, 240), (4, 144), (8, 1697)])
def test_two_phases_divide_in_float(spark, tmp_path, dims, seed):
    """Tables in which a quotient rounded once, as a double, brings another row among the 30 that are kept."""
    vectors = np.random.default_rng(seed).normal(0, 0.3, (200, dims)).astype(np.float32)
    found, expected = _against_sql(spark, tmp_path, "knn_two_phase", embeddings=pd.DataFrame({"vec_id": np.arange(200), "embedding": list(vectors)}))
    assert found == expected and len(found) == 10


def test_join_on_shared_keys_is_dealt_over_tasks(spark, duck, monkeypatch):
    """All pairs, once, in tasks of bounded pairs and broadcasts of bounded rows; null keys and keys of one side match nothing."""
    expected = rows(duck.sql(Q.ORACLES["join_inner_nonpk"]).df())
    left = spark.sql("SELECT id AS a, CASE WHEN id % 10 < 4 THEN NULL ELSE id % 3 END AS x FROM range(40)")
    right = spark.sql("SELECT id AS b, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 4 END AS y FROM range(300)")
    whole = sorted((p.a, p.x, q.b, q.y) for p in left.collect() for q in right.collect() if p.x is not None and p.x == q.y)
    for a, b, keys, order in ((left, right, "xy", "axby"), (right, left, "yx", "byax")):
        made = rel.many_to_many_join(a, b, *keys, pairs=100, broadcast_rows=15)
        assert made.columns == list(order)
        assert sorted(map(tuple, made.select(*"axby").collect())) == whole
    made = rel.many_to_many_join(left, right, *"xy", pairs=100)
    per_task = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) > 10 and max(per_task) < len(whole) / 5
    # The query takes that way where pairs are many.
    called = []
    monkeypatch.setattr(rel, "many_to_many_join", lambda *a, f=rel.many_to_many_join: called.append(a) or f(*a, pairs=len(expected) // 20 + 1))
    found = Q.join_inner_nonpk(spark, SF)
    assert called and rows(found.toPandas()) == expected
    assert found.rdd.getNumPartitions() >= 10


class _Plain(hnsw.Graph):
    """The graph with each choice of links made anew from all distances."""

    def select(self, found, m):
        chosen, waiting = [], []
        for d, i in found if len(found) > m else ():
            if len(chosen) == m:
                break
            near = chosen and (self.distances(self.vectors[i].astype(np.float64), chosen) < d).any()
            (waiting if near else chosen).append(i)
        return (chosen + waiting)[:m] if len(found) > m else [i for _, i in found]

    def link(self, other, level, node, seen, cap):
        own = self.links[other][level] + [node]
        ranked = sorted(zip(self.distances(self.vectors[other].astype(np.float64), own).tolist(), own, strict=True))
        self.links[other][level] = self.select(ranked, cap) if len(own) > cap else own


@pytest.mark.parametrize("kind", ["vectors", "copies", "grid"])
def test_graph_is_that_of_plain_choices(kind):
    """The same links in the same order from bits kept of earlier distances, in less than half of the calls; also with many equal distances."""
    r = np.random.default_rng(7)
    vectors = {"vectors": r.normal(size=(400, 16)), "copies": np.repeat(r.normal(size=(100, 16)), 4, axis=0)[r.permutation(400)], "grid": r.integers(0, 3, (400, 4))}[kind].astype(np.float32)
    params, calls = hnsw.Params(m=6, ef_construction=24), []

    class Counted(hnsw.Graph):
        def distances(self, query, at):
            calls.append(len(at))
            return super().distances(query, at)

    made, plain = Counted(vectors.shape[1], params).build(vectors), _Plain(vectors.shape[1], params).build(vectors)
    assert made.links == plain.links and made.entry == plain.entry
    assert [made.search(q, 5, 20) for q in vectors[:30]] == [plain.search(q, 5, 20) for q in vectors[:30]]
    assert len(calls) < 100 * len(vectors)


def test_each_shard_has_a_task(spark):
    index = hnsw.Index.build(Q.emb(spark, SF), hnsw.Params(m=4, ef_construction=8, shard_rows=20))
    held = index.nodes.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("shard").alias("n")).collect()
    assert index.shards > 10 and [r.n for r in held] == [1] * index.shards
    assert "shufflepartitionidpassthrough" in Q.explain(index.search(Q._every_hundredth(spark, SF), 3)).lower()
