"""One query for each operator, over the driver's tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import quantize as qz
from .functions import vectors as vf
from .functions.pca import PCA
from .operators import hnsw, knn
from .operators import relational as rel
from .plans import planner
from .plans.dialect import rewrite
from .plans.engine import Engine
from .sources import versions as vs
from .sources.paths import scratch
from .streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def asked(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """A query vector: the stored vector of an id."""
    row = emb(spark, sf).where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def engine(spark: SparkSession, sf: str, *tables: str) -> Engine:
    """An engine over a new folder; the named tables are there as views ``<name>_rows``."""
    for name in tables:
        table(spark, sf, name).createOrReplaceTempView(f"{name}_rows")
    return Engine(spark, scratch(spark, "engine"))


def vector_text(v: list[float]) -> str:
    return "'[" + ", ".join(repr(float(x)) for x in v) + "]'"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"


def _cos(a: str, b: str) -> str:
    return f"(1 - {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _knn_sql(distance: str, k: int = 10, where: str = "true", source: str = "embeddings e") -> str:
    return f"SELECT e.vec_id, round({distance}, 6) AS distance FROM {source} WHERE {where} ORDER BY {distance}, e.vec_id LIMIT {k}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", r6(F.col("distance")).alias("distance"))


# Scans, lookups, sources


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_full(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777")
def key_point(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 777").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = -5")
def key_point_missing(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = -5").select("o_orderkey", "o_totalprice")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def vector_by_ordinal(spark, sf):
    return emb(spark, sf).where("vec_id = 7").select("vec_id", "label")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 400 AND 600 ORDER BY o_orderkey")
def key_range_inclusive(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderkey").between(400, 600)).select("o_orderkey", "o_custkey").orderBy("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 400 AND 600")
def key_count_range(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderkey").between(400, 600)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 600 AND 400")
def key_count_range_reversed(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderkey").between(600, 400)).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def key_range_half_open(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey >= 100 AND o_orderkey < 200").select("o_orderkey")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS value FROM nation UNION ALL SELECT * FROM (VALUES (1000::BIGINT, 'O''Brien'), (1001, ''), (1002, NULL)) t(id, value)")
def insert_values(spark, sf):
    e = engine(spark, sf, "nation")
    e.execute("CREATE TABLE names (id BIGINT PRIMARY KEY, value TEXT)")
    e.execute("INSERT INTO names SELECT n_nationkey, n_name FROM nation_rows")
    e.execute("INSERT INTO names VALUES (1000, 'O''Brien'), (1001, ''), (1002, NULL)")
    return e.execute("SELECT id, value FROM names").data


@query("""SELECT c_custkey::BIGINT AS id, CASE c_custkey WHEN 3 THEN 'changed' ELSE c_name END AS name, CASE c_custkey WHEN 3 THEN c_acctbal + 1 WHEN 8 THEN 0.5 ELSE c_acctbal END AS balance
    FROM customer WHERE c_custkey NOT IN (5, 7) UNION ALL SELECT 7::BIGINT, 'again', NULL""")
def engine_changes(spark, sf):
    """UPDATE, DELETE, INSERT after DELETE, and a transaction that is rolled back, read by a second engine over the same folder."""
    e = engine(spark, sf, "customer")
    e.execute("CREATE TABLE accounts (id BIGINT PRIMARY KEY, name TEXT, balance DOUBLE)")
    e.execute("INSERT INTO accounts SELECT c_custkey, c_name, c_acctbal FROM customer_rows")
    e.execute("UPDATE accounts SET name = 'changed', balance = balance + 1 WHERE id = 3")
    e.execute("DELETE FROM accounts WHERE id = 5")
    e.execute("DELETE FROM accounts WHERE id = 7")
    e.execute("BEGIN")
    e.execute("DELETE FROM accounts WHERE id = 9")
    e.execute("ROLLBACK")
    e.execute("BEGIN")
    e.execute("INSERT INTO accounts (id, name) VALUES (7, 'again')")
    e.execute("UPDATE accounts SET balance = $1 WHERE id = 8", [0.5])
    e.execute("COMMIT")
    return Engine(spark, e.catalog.root).execute("SELECT id, name, balance FROM accounts").data


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def parameters_positional(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_for_parameters")
    sql = rewrite("SELECT o_orderkey, o_totalprice FROM orders_for_parameters WHERE o_totalprice > $1 AND o_orderstatus = $2").sql
    return spark.sql(sql, {"p1": 100000, "p2": "O"})


@query("SELECT vec_id, (8 + 4 * len(embedding))::INTEGER AS n_bytes, true AS same FROM embeddings")
def vector_binary_round_trip(spark, sf):
    return emb(spark, sf).select("vec_id", vf.to_binary("embedding").alias("b"), "embedding").select("vec_id", F.length("b").alias("n_bytes"), (vf.from_binary("b") == F.col("embedding")).alias("same"))


@query("SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def wal_replay(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.lit(1).alias("txn_id"), F.col("user_id").alias("key"), "value")
    commit = log.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("commit").alias("op"), F.lit(1).alias("txn_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"))
    return vs.replay(log.unionByName(commit))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS applied, count(*) FILTER (WHERE event_type = 'error') AS failed, 0::BIGINT AS corrupted FROM events")
def wal_recovery_stats(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit("update").alias("op"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("txn_id"), F.col("user_id").alias("key"), "value")
    one = log.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("commit").alias("op"), F.lit(1).alias("txn_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"))
    stats = vs.recovery_stats(log.unionByName(one))
    return stats.select((F.col("total") - 1).alias("total"), "applied", "failed", "corrupted")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1")
def wal_checkpoint_compaction(spark, sf):
    return vs.latest(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.lit(False)).select("user_id", "event_id", "value")


# DML and transactions as queries


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 5 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_as_select(spark, sf):
    return rel.update_as_select(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5, {"o_totalprice": F.lit(1.5)})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <> 5")
def delete_as_select(spark, sf):
    return rel.delete_as_select(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <> 5 UNION ALL SELECT 5::BIGINT, 9.5::DOUBLE")
def delete_then_insert(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey"), "o_totalprice", F.lit(0).alias("seq"), F.lit(False).alias("gone"))
    log = spark.createDataFrame([(5, None, 1, True), (5, 9.5, 2, False)], orders.schema)
    return vs.latest(orders.unionByName(log), "o_orderkey", "seq", F.col("gone")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3)")
def duplicate_keys_of_insert(spark, sf):
    new = spark.range(-3, 4).withColumnRenamed("id", "o_orderkey").where("o_orderkey <> 0")
    return new.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


def _versions(spark, sf):
    e = table(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("begin_ts"), F.lead("event_id").over(order).alias("end_ts"), "value")


_VERSIONS = "WITH v AS (SELECT user_id AS key, event_id AS begin_ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS end_ts, value FROM events) "


@query(_VERSIONS + "SELECT key, begin_ts, value FROM v WHERE begin_ts <= 500 AND begin_ts NOT IN (17, 18) AND (end_ts IS NULL OR NOT (end_ts <= 500 AND end_ts NOT IN (17, 18)))")
def mvcc_snapshot_read(spark, sf):
    return vs.visible(_versions(spark, sf), txn=-1, snapshot=500, active=[17, 18]).select("key", "begin_ts", "value")


@query(_VERSIONS + """, s AS (SELECT key, begin_ts, value FROM v WHERE begin_ts <= 500 AND (end_ts IS NULL OR end_ts > 500))
    SELECT key, begin_ts, value FROM s WHERE key <> 3 UNION ALL SELECT 3::BIGINT, 1000000::BIGINT, 4.25::DOUBLE""")
def mvcc_read_own_writes(spark, sf):
    own = spark.createDataFrame([(3, 1_000_000, None, 4.25, True)], "key long, begin_ts long, end_ts long, value double, own boolean")
    versions = _versions(spark, sf).withColumn("own", F.lit(False)).unionByName(own)  # an event may have the number of the transaction
    return vs.visible(versions, txn=1_000_000, snapshot=500, began=F.col("own"), ended=F.lit(False)).select("key", "begin_ts", "value")


@query("""WITH w AS (SELECT event_id AS txn_id, user_id AS key, event_id AS start_ts, event_id + 40 AS commit_ts FROM events)
    SELECT DISTINCT a.key, a.txn_id AS winner, b.txn_id AS loser FROM w a JOIN w b ON a.key = b.key AND a.commit_ts < b.commit_ts AND a.commit_ts > b.start_ts""")
def mvcc_conflicts(spark, sf):
    e = table(spark, sf, "events")
    return vs.conflicts(e.select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("key"), F.col("event_id").alias("start_ts"), (F.col("event_id") + 40).alias("commit_ts")))


@query(_VERSIONS + "SELECT key, begin_ts, end_ts, value FROM v WHERE end_ts IS NULL OR begin_ts >= 700 OR end_ts >= 700")
def mvcc_gc(spark, sf):
    return vs.collect_garbage(_versions(spark, sf), 700)


# Projection and filters


@query("SELECT c_custkey, c_name FROM customer")
def project_columns(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name")


@query("SELECT customer.c_name AS c_name FROM customer")
def project_qualified(spark, sf):
    return table(spark, sf, "customer").alias("customer").select(F.col("customer.c_name").alias("c_name"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def project_alias_arithmetic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("revenue"))


@query("SELECT r_name, 1 AS one, 'text' AS word, 'O''Brien' AS name, ('' IS NULL) AS empty_is_null FROM region")
def select_literals(spark, sf):
    return engine(spark, sf, "region").execute("SELECT r_name, 1 AS one, 'text' AS word, 'O''Brien' AS name, '' IS NULL AS empty_is_null FROM region_rows").data


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'")
def filter_equal_text(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand") == "Brand#11").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 1000 AND p_retailprice <= 1500")
def filter_ranges_and(spark, sf):
    return table(spark, sf, "part").where("p_size >= 10 AND p_size < 20 AND p_retailprice > 1000 AND p_retailprice <= 1500").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_retailprice > 1800")
def filter_or(spark, sf):
    return table(spark, sf, "part").where((F.col("p_size") < 5) | (F.col("p_retailprice") > 1800)).select("p_partkey")


# Joins


@query("SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return rel.unqualified_join(c.select("c_custkey", "c_name"), o.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("c_custkey") == F.col("o_custkey"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_inner_nonpk(spark, sf):
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return rel.many_to_many_join(s, c, "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_custkey < 0")
def join_no_match(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_custkey") < 0)).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey")
def join_left(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 150000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return table(spark, sf, "nation").select("n_name").crossJoin(table(spark, sf, "region").select("r_name"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_mktsegment")
def join_groupby(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
def join_where(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).where("o_totalprice > 100000").select("c_name", "o_totalprice")


# Aggregation


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_linenumber) AS least, max(l_extendedprice) AS most FROM lineitem")
def agg_global(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), r6(F.avg("l_discount")).alias("mean"), F.min("l_linenumber").alias("least"), F.max("l_extendedprice").alias("most")
    )


@query("SELECT coalesce(sum(l_linenumber::DOUBLE), 0.0) AS total FROM lineitem")
def agg_sum_engine_a(spark, sf):
    return table(spark, sf, "lineitem").agg(rel.sum_a("l_linenumber").alias("total"))


@query("SELECT sum(l_linenumber)::BIGINT AS total FROM lineitem")
def agg_sum_engine_b(spark, sf):
    return table(spark, sf, "lineitem").agg(F.sum("l_linenumber").alias("total"))


@query("SELECT count(*) AS n, coalesce(sum(l_linenumber::DOUBLE), 0.0) AS total, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_orderkey < 0")
def agg_empty(spark, sf):
    return table(spark, sf, "lineitem").where("l_orderkey < 0").agg(
        F.count("*").alias("n"), rel.sum_a("l_linenumber").alias("total"), F.avg("l_quantity").alias("mean"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")
    )


@query("SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS known, round(avg(nullif(l_linenumber, 1)), 6) AS mean FROM lineitem")
def agg_nulls(spark, sf):
    x = F.nullif(F.col("l_linenumber"), F.lit(1))
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count(x).alias("known"), r6(F.avg(x)).alias("mean"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def groupby_one(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def groupby_many(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_count(spark, sf):
    return rel.having(table(spark, sf, "orders"), ["o_custkey"], [F.count("*").alias("n")], F.col("n") > 12)


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000 AND avg(o_totalprice) > 90000 AND count(*) > 5")
def having_sum_and(spark, sf):
    kept = rel.having(
        table(spark, sf, "orders"), ["o_custkey"], [F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"), F.count("*").alias("n")], (F.col("s") > 1000000) & (F.col("a") > 90000) & (F.col("n") > 5)
    )
    return kept.select("o_custkey", F.round("s", 2).alias("total"), "n")


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 1000000000")
def having_no_group(spark, sf):
    return rel.having(table(spark, sf, "orders"), [], [F.count("*").alias("n")], F.col("n") > 1000000000)


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct(spark, sf):
    return table(spark, sf, "orders").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def agg_key_filter(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderkey").between(100, 900)).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY o_custkey ORDER BY revenue DESC, o_custkey LIMIT 10")
def order_by_agg(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_custkey").limit(10)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, sf):
    return rel.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r6(F.col("r")).alias("r"))


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark, sf):
    return rel.latency_percentiles(table(spark, sf, "events"), "value", accuracy=None)


# Vector functions


@query(f"SELECT vec_id, round({_l2('embedding', Q0)}, 6) AS d FROM embeddings")
def vec_l2(spark, sf):
    return emb(spark, sf).select("vec_id", r6(vf.l2("embedding", vf.literal(asked(spark, sf)))).alias("d"))


@query(f"SELECT vec_id, round({_dot('embedding', Q0)}, 6) AS ip, round(-{_dot('embedding', Q0)}, 6) AS negative FROM embeddings")
def vec_inner_product(spark, sf):
    q = vf.literal(asked(spark, sf))
    return emb(spark, sf).select("vec_id", r6(vf.inner_product("embedding", q)).alias("ip"), r6(vf.negative_inner_product("embedding", q)).alias("negative"))


@query(f"SELECT vec_id, round({_cos('embedding', Q0)}, 6) AS d FROM embeddings WHERE vec_id <> 0")
def vec_cosine(spark, sf):
    return emb(spark, sf).where("vec_id <> 0").select("vec_id", r6(vf.cosine("embedding", vf.literal(asked(spark, sf)))).alias("d"))


@query(f"SELECT vec_id, round(sqrt({_dot('embedding', 'embedding')}), 6) AS n, len(embedding)::INTEGER AS dims FROM embeddings")
def vec_norm(spark, sf):
    return emb(spark, sf).select("vec_id", r6(vf.norm("embedding")).alias("n"), vf.dimensions("embedding").alias("dims"))


@query("""SELECT vec_id, round(list_sum(list_transform(u, lambda x: x)), 5) AS total FROM (SELECT vec_id, list_transform(s, lambda x: (x / sqrt(list_sum(list_transform(s, lambda y: y * y))))) AS u
    FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::double) AS s FROM embeddings))""")
def vec_normalize(spark, sf):
    u = vf.normalize(F.transform("embedding", lambda x: (3 * x.cast("double"))))
    return emb(spark, sf).select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, true AS same FROM embeddings")
def vec_parse(spark, sf):
    v = vf.parse("s")
    parsed = emb(spark, sf).select("vec_id", "embedding", vf.format_vector("embedding").alias("s")).select("vec_id", "embedding", v.alias("v"))
    return parsed.select("vec_id", F.size("v").alias("dims"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), (F.col("v") == F.col("embedding")).alias("same"))


@query()
def vec_format(spark, sf):
    return emb(spark, sf).select("vec_id", vf.format_vector("embedding").alias("s"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS fine FROM embeddings")
def vec_is_finite(spark, sf):
    return emb(spark, sf).select("vec_id", vf.is_finite("embedding").alias("fine"))


@query("SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def vec_dimension_check(spark, sf):
    return emb(spark, sf).where(F.size(vf.with_dimensions("embedding", 64)) == 64).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS kinds, sum(n)::BIGINT AS n FROM (SELECT embedding, count(*) AS n FROM embeddings GROUP BY embedding)")
def vec_distinct(spark, sf):
    return emb(spark, sf).groupBy("embedding").agg(F.count("*").alias("c")).agg(F.count("*").alias("kinds"), F.sum("c").alias("n"))


# Nearest neighbours


@query(_knn_sql(_l2("e.embedding", Q0)))
def knn_l2_exact(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10))


@query(_knn_sql(_cos("e.embedding", Q0), where="vec_id <> 0"))
def knn_cosine_exact(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, "cosine", where=F.col("vec_id") != 0))


@query(_knn_sql("-" + _dot("e.embedding", Q0)))
def knn_mip_exact(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, "ip"))


@query(_knn_sql(_l2("e.embedding", Q0), k=0))
def knn_k_zero(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 0))


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_l2('e.embedding', 'q.embedding')} AS d FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank FROM d) SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def knn_batch_join(spark, sf):
    return knn.knn_join(_every_hundredth(spark, sf), emb(spark, sf), 5).select("query_id", "vec_id", r6(F.col("distance")).alias("distance"), "rank")


def _every_hundredth(spark, sf):
    return emb(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _parts(spark, sf):
    return emb(spark, sf).join(table(spark, sf, "part"), F.col("vec_id") == F.col("p_partkey"))


PARTS = "embeddings e JOIN part p ON e.vec_id = p.p_partkey"


@query(_knn_sql(_l2("e.embedding", Q0), where="vec_id = 5"))
def hybrid_pk_eq(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, where=F.col("vec_id") == 5))


@query(_knn_sql(_cos("e.embedding", Q0), where="label = 3 AND vec_id <> 0"))
def hybrid_label_eq(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, "cosine", where=(F.col("label") == 3) & (F.col("vec_id") != 0)))


@query(_knn_sql(_l2("e.embedding", Q0), where="p_retailprice >= 1000 AND p_retailprice < 1500", source=PARTS))
def hybrid_range(spark, sf):
    return _hits(knn.knn(_parts(spark, sf), asked(spark, sf), 10, where=(F.col("p_retailprice") >= 1000) & (F.col("p_retailprice") < 1500)))


@query(_knn_sql(_l2("e.embedding", Q0), where="label = 2 AND p_size > 10", source=PARTS))
def hybrid_and(spark, sf):
    return _hits(knn.knn(_parts(spark, sf), asked(spark, sf), 10, where=(F.col("label") == 2) & (F.col("p_size") > 10)))


@query(_knn_sql(_l2("e.embedding", Q0), where="label = 2 OR label = 4"))
def hybrid_or(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, where=(F.col("label") == 2) | (F.col("label") == 4)))


@query(_knn_sql(_l2("e.embedding", Q0), where="label > 1000"))
def hybrid_empty(spark, sf):
    return _hits(knn.knn(emb(spark, sf), asked(spark, sf), 10, where=F.col("label") > 1000))


@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, label, {_l2('e.embedding', Q0)} AS d FROM embeddings e ORDER BY d, vec_id LIMIT 30) WHERE label < 5 ORDER BY d, vec_id LIMIT 10")
def hybrid_vector_first(spark, sf):
    return _hits(knn.knn_vector_first(emb(spark, sf), asked(spark, sf), 10, F.col("label") < 5))


@query()
def knn_hnsw(spark, sf):
    index = hnsw.Index.build(emb(spark, sf))
    return index.search(_every_hundredth(spark, sf), 10).select("query_id", F.col("id").alias("vec_id"), r6(F.col("distance")).alias("distance"), "rank")


@query()
def hnsw_recall(spark, sf):
    queries = _every_hundredth(spark, sf)
    hits = hnsw.Index.build(emb(spark, sf)).search(queries, 10).withColumnRenamed("id", "vec_id")
    return knn.recall(knn.knn_join(queries, emb(spark, sf), 10), hits)


@query()
def hnsw_stats(spark, sf):
    return hnsw.Index.build(emb(spark, sf)).stats()


@query(f"""WITH t AS (SELECT vec_id FROM embeddings e ORDER BY {_l2('e.embedding', Q0)}, vec_id LIMIT 10), h AS (SELECT vec_id FROM embeddings e WHERE label < 8 ORDER BY {_l2('e.embedding', Q0)}, vec_id LIMIT 10)
    SELECT 0::BIGINT AS query_id, round(count(h.vec_id) / count(t.vec_id), 6) AS recall FROM t LEFT JOIN h ON t.vec_id = h.vec_id""")
def recall_at_k(spark, sf):
    q = asked(spark, sf)
    truth = knn.knn(emb(spark, sf), q, 10).select(F.lit(0).cast("long").alias("query_id"), "vec_id")
    hits = knn.knn(emb(spark, sf), q, 10, where=F.col("label") < 8).select(F.lit(0).cast("long").alias("query_id"), "vec_id")
    return knn.recall(truth, hits).select("query_id", r6(F.col("recall")).alias("recall"))


# Quantization


def _levels_sql(scale: float, bits: int, v: str = "embedding") -> str:
    top = 2**bits - 1
    return f"list_transform({v}, lambda x: least(greatest(round(x * {scale}::FLOAT * {top}::FLOAT), 0), {top})::INTEGER)"


def _quant_levels(bits: int):
    def run(spark, sf):
        q = qz.levels("embedding", 1.0, 2**bits)
        return emb(spark, sf).select("vec_id", F.posexplode(q).alias("pos", "level"))

    run.__name__ = f"quant_levels_{bits}"
    return query(f"SELECT vec_id, (unnest(range(len(q))))::INTEGER AS pos, unnest(q) AS level FROM (SELECT vec_id, {_levels_sql(1.0, bits)} AS q FROM embeddings)")(run)


for _bits in (2, 4, 8):
    _quant_levels(_bits)


@query(f"SELECT vec_id, round(list_sum(list_transform({_levels_sql(1.0, 4)}, lambda x: x::DOUBLE / 15)), 4) AS total FROM embeddings")
def quant_reconstruct(spark, sf):
    v = qz.reconstruct(qz.levels("embedding", 1.0, 16), 1.0, 16)
    return emb(spark, sf).select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"""WITH g AS (SELECT i, (0.5 + 1.5 * i / 11.0)::FLOAT AS s FROM range(12) t(i)),
    e AS (SELECT vec_id, i, s, list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - (least(greatest(round(x * s * 15::FLOAT), 0), 15)::FLOAT / 15::FLOAT / s)::DOUBLE, 2))) AS error FROM embeddings, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, i) AS nth FROM e)
    SELECT vec_id, s AS scale, 4::TINYINT AS bits, 64::INTEGER AS dimensions, 64::INTEGER AS n_levels FROM r WHERE nth = 1""")
def quantize_best_scale(spark, sf):
    q = qz.quantize("embedding", qz.Params.preset(4))
    return emb(spark, sf).select("vec_id", q.alias("q")).select("vec_id", "q.scale", "q.bits", "q.dimensions", F.size("q.levels").alias("n_levels"))


@query(f"""WITH q AS (SELECT vec_id, list_transform({_levels_sql(1.0, 4)}, lambda x: (x::FLOAT / 15::FLOAT)::FLOAT) AS r FROM embeddings)
    SELECT a.vec_id, round({_l2('a.r', 'b.r')}, 4) AS distance FROM q a JOIN q b ON b.vec_id = 0""")
def quant_l2(spark, sf):
    rec = qz.reconstruct(qz.levels("embedding", 1.0, 16), 1.0, 16)
    one = emb(spark, sf).where("vec_id = 0").select(rec.alias("b"))
    return emb(spark, sf).select("vec_id", rec.alias("a")).crossJoin(F.broadcast(one)).select("vec_id", F.round(vf.l2("a", "b"), 4).alias("distance"))


_RECONSTRUCTED = f"SELECT vec_id, list_transform({_levels_sql(1.25, 4)}, lambda x: (x::FLOAT / 15::FLOAT / 1.25::FLOAT)::FLOAT) AS r FROM embeddings"


@query(f"""WITH q AS ({_RECONSTRUCTED}) SELECT a.vec_id, round({_l2('a.r', 'b.r')}, 4) AS l2, round({_cos('a.r', 'b.r')}, 4) AS cosine, round(-{_dot('a.r', 'b.r')}, 4) AS ip
    FROM q a JOIN q b ON b.vec_id = 0""")
def quant_distances(spark, sf):
    """All distances of the reconstructions to that of vector 0, a constant of the plan."""
    params = qz.Params(4, 1)  # one scale, 1.25
    own, one = qz.quantize("embedding", params), qz.quantize(vf.literal(asked(spark, sf)), params)
    q = emb(spark, sf).select("vec_id", own.alias("q"))
    return q.select("vec_id", *(F.round(qz.quantized_distance(m, "q", one, params), 4).alias(m) for m in ("l2", "cosine", "ip")))


@query(f"""WITH q AS (SELECT vec_id, {_levels_sql(1.0, 4)} AS r FROM embeddings) SELECT a.vec_id, round({_l2('a.r', 'b.r')}, 6) AS distance FROM q a JOIN q b ON b.vec_id = 0""")
def quant_approximate(spark, sf):
    q = F.struct(qz.levels("embedding", 1.0, 16).alias("levels"))
    one = emb(spark, sf).where("vec_id = 0").select(q.alias("b"))
    return emb(spark, sf).select("vec_id", q.alias("a")).crossJoin(F.broadcast(one)).select("vec_id", r6(qz.level_distance("a", "b")).alias("distance"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {_levels_sql(1.0, 4)}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE / 15) * (z[1]::DOUBLE - z[2]::DOUBLE / 15))), 5) AS error FROM embeddings")
def quant_error(spark, sf):
    q = qz.levels("embedding", 1.0, 16)
    return emb(spark, sf).select("vec_id", F.round(qz.squared_error("embedding", q, 1.0, 16), 5).alias("error"))


@query("SELECT vec_id, 16::INTEGER AS bytes_2, 32::INTEGER AS bytes_4, 64::INTEGER AS bytes_8, true AS same_2, true AS same_4, true AS same_8 FROM embeddings")
def quant_pack_round_trip(spark, sf):
    q = emb(spark, sf).select("vec_id", *(qz.levels("embedding", 1.0, 2**b).alias(f"q{b}") for b in (2, 4, 8)))
    packed = q.select("*", *(vf.pack_levels(f"q{b}", b).alias(f"p{b}") for b in (2, 4, 8)))
    return packed.select("vec_id", *(F.length(f"p{b}").alias(f"bytes_{b}") for b in (2, 4, 8)), *((vf.unpack_levels(f"p{b}", b, 64) == F.col(f"q{b}")).alias(f"same_{b}") for b in (2, 4, 8)))


@query("SELECT n_name, round(0.5 + 1.5 * n_nationkey / 24.0, 6)::DOUBLE AS scale FROM nation")
def quant_scale_grid(spark, sf):
    grid = F.array(*[F.lit(x) for x in qz.scale_grid(0.5, 2.0, 25)])
    return table(spark, sf, "nation").select("n_name", r6(F.get(grid, F.col("n_nationkey"))).alias("scale"))


@query("SELECT vec_id, round(64 * 4 / (CASE b WHEN 2 THEN 16 WHEN 4 THEN 32 ELSE 64 END + 5), 6) AS ratio, b AS bits, (CASE b WHEN 2 THEN 16 WHEN 4 THEN 32 ELSE 64 END)::INTEGER AS n_bytes FROM embeddings, (VALUES (2), (4), (8)) t(b)")
def quant_compression(spark, sf):
    e = emb(spark, sf).select("vec_id", F.size("embedding").alias("n"))
    parts = [e.select("vec_id", r6(qz.compression_ratio(F.col("n"), b)).alias("ratio"), F.lit(b).alias("bits"), qz.packed_bytes(F.col("n"), b).alias("n_bytes")) for b in (2, 4, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH g AS (SELECT i, (0.5 + 1.5 * i / 11.0)::FLOAT AS s FROM range(12) t(i)),
    e AS (SELECT vec_id, i, s, list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - (least(greatest(round(x * s * 15::FLOAT), 0), 15)::FLOAT / 15::FLOAT / s)::DOUBLE, 2))) AS error FROM embeddings, g),
    r AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY error, i) AS nth FROM e),
    b AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: (least(greatest(round(x * s * 15::FLOAT), 0), 15)::FLOAT / 15::FLOAT / s)::FLOAT) AS rec FROM r JOIN embeddings USING (vec_id) WHERE nth = 1),
    c AS (SELECT b.vec_id, b.embedding, q.embedding AS near FROM b JOIN b q ON q.vec_id = 0 ORDER BY {_l2('b.rec', 'q.rec')}, b.vec_id LIMIT 30)
    SELECT vec_id, round({_l2('embedding', 'near')}, 6) AS distance FROM c ORDER BY {_l2('embedding', 'near')}, vec_id LIMIT 10""")
def knn_two_phase(spark, sf):
    return _hits(knn.knn_two_phase(emb(spark, sf), asked(spark, sf), 10, qz.Params.preset(4)))


@query("SELECT (i - 1)::INTEGER AS pos, round(median(embedding[i]::DOUBLE), 6) AS threshold FROM embeddings, range(1, 65) t(i) GROUP BY i")
def binary_thresholds(spark, sf):
    return qz.thresholds(emb(spark, sf)).select("pos", r6(F.col("threshold")).alias("threshold"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x >= 0))::INTEGER AS ones FROM embeddings")
def binary_bits(spark, sf):
    return emb(spark, sf).select("vec_id", F.size(F.filter(qz.binary("embedding", [0.0] * 64), lambda b: b)).alias("ones"))


_HAMMING = "len(list_filter(list_zip(e.embedding, q.embedding), lambda z: (z[1] >= 0) <> (z[2] >= 0)))"


@query(f"SELECT e.vec_id, {_HAMMING}::INTEGER AS apart FROM embeddings e JOIN embeddings q ON q.vec_id = 0")
def hamming(spark, sf):
    at = [0.0] * 64
    return emb(spark, sf).select("vec_id", qz.hamming(qz.binary_words("embedding", at), qz.binary_words(vf.literal(asked(spark, sf)), at)).alias("apart"))


@query(f"""WITH c AS (SELECT e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e JOIN embeddings q ON q.vec_id = 0 ORDER BY {_HAMMING}, e.vec_id LIMIT 50)
    SELECT vec_id, round({_l2('a', 'b')}, 6) AS distance FROM c ORDER BY {_l2('a', 'b')}, vec_id LIMIT 10""")
def hamming_topn_rerank(spark, sf):
    return _hits(knn.knn_hamming_rerank(emb(spark, sf), asked(spark, sf), 10, [0.0] * 64))


@query("SELECT round(sum(v), 6) AS variance, round(sum(v), 6) AS along FROM (SELECT var_samp(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY i)")
def pca_variance(spark, sf):
    """All components together hold the variance of all dimensions, also when measured on the projections."""
    e = emb(spark, sf)
    found = PCA.train(e, 64)
    along = e.select(F.posexplode(found.project("embedding")).alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("v"))
    return along.agg(F.round(F.lit(found.total), 6).alias("variance"), r6(F.sum("v")).alias("along"))


@query()
def pca_project(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", F.transform(PCA.train(e, 8).project("embedding"), r6).alias("projected"))


@query("SELECT count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def memory_stats(spark, sf):
    return emb(spark, sf).agg(F.count("*").alias("vectors"), F.sum(F.size("embedding") * 4).alias("bytes"))


# Plans, dialect, streams


_PLANNED = (("pk =", "vec_id = 5", "filter_first"), ("label range", "label >= 2 AND label < 6", "filter_first"), ("most rows", "label <> 3", "vector_first"), ("none", "", "sql"))


@query(" UNION ALL ".join(
    f"(SELECT '{name}' AS predicate, '{plan}' AS strategy, e.vec_id, e.label FROM embeddings e WHERE {where or 'true'} ORDER BY {_l2('e.embedding', Q0)}, e.vec_id LIMIT 10)" for name, where, plan in _PLANNED
))
def plan_strategies(spark, sf):
    """Nearest-neighbour statements that the engine plans and runs: the way it went and what it found."""
    e = engine(spark, sf, "embeddings")
    e.execute("CREATE TABLE items (vec_id BIGINT PRIMARY KEY, label INT, embedding VECTOR(64))")
    e.execute("INSERT INTO items SELECT vec_id, label, embedding FROM embeddings_rows")
    near, out = vector_text(asked(spark, sf)), None
    for name, where, _ in _PLANNED:
        done = e.execute(f"SELECT vec_id, label FROM items {'WHERE ' + where if where else ''} ORDER BY embedding <-> {near}, vec_id LIMIT 10")
        own = spark.createDataFrame(done.data.collect(), done.data.schema).select(F.lit(name).alias("predicate"), F.lit(done.plan).alias("strategy"), "vec_id", "label")  # at most ten rows
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT c_nationkey, count(*) AS k, (CASE WHEN count(*) <= 10 THEN 150 WHEN count(*) <= 100 THEN 200 ELSE 250 END)::INTEGER AS expansion FROM customer GROUP BY c_nationkey")
def plan_expansion(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k")).select("c_nationkey", "k", planner.expansion(F.col("k")).alias("expansion"))


@query(f"SELECT vec_id FROM embeddings e WHERE label = 1 ORDER BY {_l2('e.embedding', Q0)}, vec_id LIMIT 5")
def dialect_distance_operator(spark, sf):
    near = "[" + ", ".join(repr(float(x)) for x in asked(spark, sf)) + "]"
    own = rewrite(f"SELECT vec_id FROM embeddings_for_dialect WHERE label = $1 ORDER BY embedding <-> '{near}', vec_id LIMIT 5", {"embedding"})
    vf.register_sql(spark)
    emb(spark, sf).createOrReplaceTempView("embeddings_for_dialect")
    return spark.sql(own.sql, {"p1": 1})


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf):
    found = ev.windowed(table(spark, sf, "events"))
    return found.select(F.col("start").cast("timestamp").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def events_streamed(spark, sf):
    """The windows that are final, from a stream over the file run to its end into a table."""
    source = table(spark, sf, "events")
    path = scratch(spark, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*")
    ev.append_to(ev.windowed(stream), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    found = spark.read.schema(ev.windowed(source).schema).parquet(f"{path}/table")
    return found.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def explain(df: DataFrame) -> str:
    """The formatted physical plan, for tests."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
