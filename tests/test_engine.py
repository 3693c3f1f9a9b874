import shutil

import pytest
from pyspark.sql import functions as F

from vecrel.functions import quantize as qz
from vecrel.plans import planner
from vecrel.plans.dialect import rewrite
from vecrel.plans.engine import Deleted, Engine, Inserted, Updated
from vecrel.operators import hnsw, knn
from vecrel.sources.collection import Collection
from vecrel.sources.keyed import Conflict
from vecrel.sources.versions import recovery_stats, replay
from vecrel.streaming import events


def data(found):
    return [tuple(r) for r in found.data.collect()]


def test_statements(spark, tmp_path):
    e = Engine(spark, str(tmp_path), "A")
    e.execute("CREATE TABLE products (id BIGINT PRIMARY KEY, name TEXT, price DOUBLE, embedding VECTOR(3))")
    assert e.execute("INSERT INTO products VALUES (1, 'O''Brien', 9.99, '[1.0, 0.0, 0.0]'), (2, '', 5.0, '[0, 1, 0]')") == Inserted(2)
    assert data(e.execute("SELECT name FROM products WHERE id = 1")) == [("O'Brien",)]
    assert data(e.execute("SELECT id FROM products ORDER BY embedding <=> '[0, 2, 0]' LIMIT 1")) == [(2,)]
    assert data(e.execute("SELECT SUM(id) AS s, COUNT(*) AS n FROM products WHERE id > 10")) == [(0.0, 0)]
    assert e.execute("UPDATE products SET price = 7.5, name = 'SET a, WHERE b' WHERE id = 1") == Updated(1)
    assert data(e.execute("SELECT price, name FROM products WHERE id = $1", [1])) == [(7.5, "SET a, WHERE b")]
    for sql, words in (
        ("UPDATE products SET id = 1 WHERE id = 1", "PRIMARY KEY is immutable"),
        ("UPDATE products SET price = 1.0", "WHERE"),
        ("UPDATE products SET nope = 1 WHERE id = 1", "not found"),
        ("UPDATE products SET price = 'x' WHERE id = 1", "type mismatch"),
        ("UPDATE products SET price = 1.0 WHERE id = 9", "not found"),
        ("DELETE FROM products", "WHERE"),
        ("DELETE FROM products WHERE id = 9", "not found"),
        ("INSERT INTO products VALUES (1, 'x', 1.0, '[1, 2, 3]')", "duplicate"),
        ("INSERT INTO products VALUES (3, 'x', 1.0, '[1, 2]')", "dimension mismatch"),
    ):
        with pytest.raises(Exception, match=words):
            e.execute(sql)
    assert e.execute("DELETE FROM products WHERE id = 1") == Deleted(1)
    assert e.execute("DELETE FROM products WHERE id = 1") == Deleted(0)
    e.execute("INSERT INTO products (id, name) VALUES (1, 'again')")
    assert data(e.execute("SELECT name, price FROM products WHERE id = 1")) == [("again", None)]
    e.execute("BEGIN")
    e.execute("DELETE FROM products WHERE id = 2")
    e.execute("ROLLBACK")
    assert e.catalog.row_count("products") == 2 and e.catalog.primary_key("products") == "id"
    e.execute("DROP TABLE products")
    assert e.catalog.names() == []


def test_writers(spark, tmp_path):
    """A second engine reads what the first committed; of two writers of a key the first to commit wins."""
    a, b = (Engine(spark, str(tmp_path)) for _ in range(2))
    a.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v DOUBLE)")
    a.execute("INSERT INTO t VALUES (1, 1.0), (2, 2.0), (3, 3.0)")
    assert data(b.execute("SELECT id, v FROM t ORDER BY id")) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    for e in (a, b):
        e.execute("BEGIN")
    a.execute("UPDATE t SET v = v + 10 WHERE id = 1")
    b.execute("DELETE FROM t WHERE id = 1")
    b.execute("INSERT INTO t VALUES (4, 4.0)")
    a.execute("COMMIT")
    with pytest.raises(Conflict):
        b.execute("COMMIT")
    for e in (a, b):
        e.execute("BEGIN")
    a.execute("DELETE FROM t WHERE id = 2")
    b.execute("UPDATE t SET v = 30 WHERE id = 3")
    b.execute("INSERT INTO t VALUES (5, 5.0)")
    a.execute("COMMIT")
    b.execute("COMMIT")  # other keys: goes on top
    for e in (a, b, Engine(spark, str(tmp_path))):
        assert data(e.execute("SELECT id, v FROM t ORDER BY id")) == [(1, 11.0), (3, 30.0), (5, 5.0)]
    for i in range(20):  # files are folded on the way
        a.execute(f"UPDATE t SET v = {i}.5 WHERE id = 3")
    assert len(a.catalog._table("t").parts) < 20 and data(b.execute("SELECT v FROM t WHERE id = 3")) == [(19.5,)]
    assert b.execute("DELETE FROM t WHERE id = 2") == Deleted(0)


def test_index_and_plans(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE p (id BIGINT PRIMARY KEY, label INT, v VECTOR(2))")
    spark.range(1200).selectExpr("id", "CAST(id % 10 AS INT) AS label", "array(CAST(id AS FLOAT), 0F) AS v").createOrReplaceTempView("p_rows")
    e.execute("INSERT INTO p SELECT id, label, v FROM p_rows")
    ask = "SELECT id FROM p {} ORDER BY v <-> '[600.2, 0]', id LIMIT 3"
    assert e.execute(ask.format("")).plan == "sql"
    e.execute("CREATE INDEX near ON p USING hnsw (v vector_l2_ops) WITH (m = 8, ef_construction = 32)")
    found = Engine(spark, str(tmp_path)).execute(ask.format(""))
    assert found.plan == "index" and data(found) == [(600,), (601,), (599,)]
    e.execute("INSERT INTO p VALUES (5000, 1, '[600.1, 0]')")  # the index is left behind and rebuilt
    assert data(e.execute(ask.format(""))) == [(5000,), (600,), (601,)]
    assert e.execute("SELECT id FROM p ORDER BY v <=> '[1, 0]' LIMIT 3").plan == "sql"  # no index of that metric
    for where, plan, ids in (("WHERE id = 7", "filter_first", [7]), ("WHERE label <> 0", "vector_first", [5000, 601, 599]), ("WHERE label IN (3)", "filter_first", [603, 593, 613])):
        found = e.execute(ask.format(where))
        assert (found.plan, [i for i, in data(found)]) == (plan, ids)
    for sql, words in (("CREATE INDEX near ON p USING hnsw (v)", "exists"), ("CREATE INDEX x ON p USING hnsw (label)", "vector column"), ("CREATE INDEX x ON p USING hnsw (v) WITH (q = 1)", "unknown options"), ("DROP INDEX nope", "not found")):
        with pytest.raises(ValueError, match=words):
            e.execute(sql)
    shutil.rmtree(e.catalog._table("p").indexes["near"]["path"])  # lost files are built again
    assert e.execute(ask.format("")).plan == "index" and data(e.execute(ask.format(""))) == [(5000,), (600,), (601,)]
    e.execute("DROP INDEX near")
    assert e.execute(ask.format("")).plan == "sql"
    rows = e.catalog.rows("p")
    for few, k, ids in ((rows, 2, [5000, 600]), (rows.where("id < 50"), 2, [49, 48]), (rows, 0, []), (rows.where("id < 0"), 5, [])):
        assert [r.id for r in knn.search(few, [600.1, 0.0], k, id_col="id", vector="v").collect()] == ids


def test_answers(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.answer("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT)")[0] == 200
    assert e.answer("INSERT INTO t VALUES (1, 'a'), (2, NULL)") == (200, {"rows_affected": 2})
    assert e.answer("SELECT id, name FROM t WHERE id >= $1 ORDER BY id", [1]) == (200, {"columns": ["id", "name"], "rows": [[1, "a"], [2, None]]})
    for bad in ("SELECT * FROM nowhere", "SELEC", "", "DELETE FROM t", "INSERT INTO t VALUES (1, 'again')"):
        status, body = e.answer(bad)
        assert status == 400 and list(body) == ["error"] and body["error"], bad


def test_collection_index(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), 2)
    assert c.rebuild_index() is None and c.index() is None
    batch = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "ordinal long, embedding array<float>")
    c.insert_batch(batch)
    asked = spark.createDataFrame([(0, [30.2, 1.0])], "query_id long, query array<float>")

    def near(x):
        return [r.id for r in x.search(asked, 2).orderBy("rank").collect()]

    assert near(c.rebuild_index(hnsw.Params(m=4, ef_construction=20), qz.Params.preset(4))) == [30, 31]
    assert spark.read.parquet(str(tmp_path / "c" / "quantized")).count() == 60
    c.insert([30.3, 1.0])  # left behind: built again with its own parameters
    assert near(c.index()) == [60, 30] and c.index().params.m == 4
    c.save_to(str(tmp_path / "d"))
    d = Collection.load_from(spark, str(tmp_path / "d"), 2)[0]
    assert near(d.index()) == [60, 30]
    shutil.rmtree(tmp_path / "d" / "index")
    assert near(d.index()) == [60, 30] and hnsw.Index.saved(spark, str(tmp_path / "d" / "index"))


def test_stream_of_late_rows(spark, tmp_path):
    """A window that ended 10 minutes before the newest row is final: later rows for it are left out, and nothing comes twice."""

    def arrive(*rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
        events.append_to(events.windowed(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out"))
        return sorted((r.start.hour, r.event_type, r.n, r.total) for r in found.collect())

    arrive(("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 01:30:00", "b", 3.0))
    assert run() == [(0, "a", 2, 3.0)]
    arrive(("2024-01-01 00:50:00", "a", 9.0), ("2024-01-01 01:40:00", "b", 4.0), ("2024-01-01 03:00:00", "c", 5.0))
    assert run() == [(0, "a", 2, 3.0), (1, "b", 2, 7.0)]
    assert run() == [(0, "a", 2, 3.0), (1, "b", 2, 7.0)]


def test_dialect():
    assert rewrite("SELECT '<=>' /* a <-> b */ FROM t WHERE a <=> b").sql == "SELECT '<=>' /* a <-> b */ FROM t WHERE a <=> b"
    assert "zip_with" in rewrite("SELECT a <=> b FROM t", {"a"}).sql
    done = rewrite("CREATE TABLE t (id INT PRIMARY KEY, v VECTOR(4))")
    assert done.key == "id" and done.vectors == {"v": 4} and "ARRAY<FLOAT>" in done.sql
    assert rewrite("SELECT $1").sql == "SELECT :p1"


def test_planner():
    assert planner.use_index(True, 1000) and not planner.use_index(True, 999) and not planner.use_index(False, 5000)
    assert [planner.expansion(k) for k in (10, 50, 200)] == [150, 200, 250]
    assert planner.index_cost(100_000) < planner.scan_cost(100_000) and planner.index_cost(100) < 1 and planner.scan_cost(100) < 1
    assert planner.strategy(0.05)[0] == planner.strategy(0.3)[0] == "filter_first" and planner.strategy(0.9) == ("vector_first", 3)
    with pytest.raises(ValueError):
        planner.Pattern("v", "<->", 0)


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), 2)
    assert c.rows().count() == 0 and c.insert([1.0, 2.0]) == 0
    batch = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "ordinal long, embedding array<float>").repartition(5)
    assert c.insert_batch(batch) == (1, 51)
    assert [(r.vec_id, r.embedding[0]) for r in c.rows().orderBy("vec_id").collect()][1:] == [(i + 1, float(i)) for i in range(50)]
    with pytest.raises(ValueError, match="dimension mismatch"):
        c.insert([1.0])
    with pytest.raises(ValueError, match="NaN"):
        c.insert([float("nan"), 1.0])
    assert c.rows().count() == 51
    c.save_to(str(tmp_path / "d"))
    assert Collection.load_from(spark, str(tmp_path / "d"), 2)[0].rows().count() == 51
    with pytest.raises(FileNotFoundError):
        Collection.load_from(spark, str(tmp_path / "none"), 2)


def test_replay(spark):
    log = spark.createDataFrame(
        [(1, "begin", 1, None, None), (2, "insert", 1, 7, "a"), (3, "commit", 1, None, None), (4, "update", 2, 7, "b"), (5, "insert", 3, 8, "c"), (6, "delete", 3, 8, None), (7, "commit", 3, None, None), (8, "???", 3, 1, None)],
        "seq long, op string, txn_id long, key long, value string",
    )
    assert [tuple(r) for r in replay(log).collect()] == [(7, "a")]
    assert tuple(recovery_stats(log).first()) == (8, 3, 1, 1)
    assert replay(log.where(F.lit(False))).count() == 0
