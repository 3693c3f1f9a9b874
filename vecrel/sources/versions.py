"""Keyed tables as queries over a version log: snapshots, conflicts, clean-up, replay.

A version is (key, begin_ts, end_ts, value).  It is visible to transaction t with snapshot
s and active set A if it began by t itself or committed by s, and did not end so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _happened(ts: str, own: Column, snapshot: int, active: list[int]) -> Column:
    c = F.col(ts)
    return own | ((c <= snapshot) & (~c.isin(active) if active else F.lit(True)))


def visible(versions: DataFrame, txn: int, snapshot: int, active: list[int] = (), began: Column | None = None, ended: Column | None = None) -> DataFrame:
    """The latest visible version of each key.

    ``began`` and ``ended`` tell whether the transaction itself began or ended a version, for
    where its number may also be a timestamp of others; without them the number decides.
    """
    active = list(active)
    began, ended = F.col("begin_ts") == txn if began is None else began, F.col("end_ts") == txn if ended is None else ended
    seen = versions.where(_happened("begin_ts", began, snapshot, active) & ~F.coalesce(_happened("end_ts", ended, snapshot, active), F.lit(False)))
    order = Window.partitionBy("key").orderBy(F.desc(began), F.desc("begin_ts"))
    return seen.withColumn("at", F.row_number().over(order)).where(F.col("at") == 1).drop("at")


def conflicts(writes: DataFrame) -> DataFrame:
    """Of (txn_id, key, start_ts, commit_ts): pairs where the second wrote a key that the first committed meanwhile; the first committer wins."""
    a, b = writes.alias("a"), writes.alias("b")
    overlap = (F.col("a.key") == F.col("b.key")) & (F.col("a.commit_ts") < F.col("b.commit_ts")) & (F.col("a.commit_ts") > F.col("b.start_ts"))
    return a.join(b, overlap).select(F.col("a.key").alias("key"), F.col("a.txn_id").alias("winner"), F.col("b.txn_id").alias("loser")).distinct()


def collect_garbage(versions: DataFrame, watermark: int) -> DataFrame:
    """The versions that a transaction may still see: live ones, and those that began or ended at the watermark or later."""
    return versions.where(F.col("end_ts").isNull() | (F.col("begin_ts") >= watermark) | (F.col("end_ts") >= watermark))


def replay(log: DataFrame) -> DataFrame:
    """Of (seq, op, txn_id, key, value): the state after all operations of committed transactions, the last of each key."""
    committed = log.where("op = 'commit'").select("txn_id").distinct()
    writes = log.where(F.col("op").isin("insert", "update", "delete")).join(committed, "txn_id", "left_semi")
    last = writes.groupBy("key").agg(F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"))
    return last.where("op <> 'delete'").select("key", "value")


def recovery_stats(log: DataFrame) -> DataFrame:
    """(total, applied, failed, corrupted): failed are writes of transactions that did not commit, corrupted lack a known operation or key."""
    known = F.col("op").isin("begin", "commit", "rollback", "insert", "update", "delete")
    write = F.col("op").isin("insert", "update", "delete")
    committed = log.where("op = 'commit'").select("txn_id").distinct().withColumn("done", F.lit(True))
    joined = log.join(committed, "txn_id", "left")
    broken = ~F.coalesce(known, F.lit(False)) | (write & F.col("key").isNull())
    return joined.agg(
        F.count("*").alias("total"), F.count_if(write & F.col("done") & ~broken).alias("applied"), F.count_if(write & F.col("done").isNull() & ~broken).alias("failed"), F.count_if(broken).alias("corrupted")
    )


def latest(log: DataFrame, key: str, order: str, deleted: Column) -> DataFrame:
    """The newest row of each key, without keys whose newest row is a delete marker."""
    newest = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("x")).select("x.*")
    return newest.where(~F.coalesce(deleted, F.lit(False)))
