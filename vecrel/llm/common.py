"""Shared pieces of the training-data operators: input, shared storage, vectorised bytes.

Python stages receive Arrow batches.  A batch is cut into groups of whole
documents of about ``CHUNK_BYTES`` each, so that the numpy work arrays stay small
whatever the batch holds; only a single document longer than that makes a larger
group.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 4096
#: Rows of one Arrow batch: documents run to hundreds of kilobytes, so batches stay short.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python stages that read whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of our own only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vecrel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    trim(spark)
    return out


def trim(spark: SparkSession) -> None:
    """Let the driver's JVM give free native memory back.

    Its many threads and compilations leave free blocks in the C library's arenas, which
    never shrink by themselves.  Where the JVM has no such command, nothing happens.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    with contextlib.suppress(Py4JJavaError):  # by the interface: the server's own class is not open to reflection
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        asked = new(jvm.java.lang.Object, 4)
        asked[0], asked[1] = name, "systemTrimNativeHeap"
        call.invoke(beans, asked)


def free(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


#: Keys with more than this share of all rows are too hot for one task of a join; there are at most so many.
HOT_KEYS = 4000


def having(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose ``on`` is among ``keys`` (on, n), n being the number of rows that have it and ``total`` that of all.

    Keys of more than total / HOT_KEYS rows are at most HOT_KEYS, so those are sent to
    all tasks; the others are joined, and none of them makes a large task.
    """
    hot = F.col("n") > total / HOT_KEYS
    few = F.broadcast(keys.where(hot).select(*on))
    return rows.join(few, on, "left_semi").unionByName(rows.join(few, on, "left_anti").join(keys.where(~hot).select(*on), on, "left_semi"))


#: Hashes of ids fall into 2 ** RANGE_BITS ranges.
RANGE_BITS = 10


def least_hashes(rows: DataFrame, group: str, most: int, ties: list[str]) -> DataFrame:
    """The ``most`` rows of each ``group`` (not null; few values) whose doc_id has the least hash, then the least ``ties``.

    A histogram of the hashes tells in which range the last of them lies; rows of later
    ranges are never ranked, so no group's rows gather in one task.
    """
    hashed = rows.withColumn("hash_", F.xxhash64("doc_id")).withColumn("range_", F.shiftright("hash_", 64 - RANGE_BITS))
    sizes = hashed.groupBy(group, "range_").agg(F.count("*").alias("size_"))
    up_to = Window.partitionBy(group).orderBy("range_")
    last = sizes.withColumn("before_", F.sum("size_").over(up_to) - F.col("size_")).where(F.col("before_") < most).groupBy(group).agg(F.max("range_").alias("last_"))
    near = hashed.join(F.broadcast(last), group).where(F.col("range_") <= F.col("last_"))
    ranked = near.withColumn("at_", F.row_number().over(Window.partitionBy(group).orderBy("hash_", *ties)))
    return ranked.where(F.col("at_") <= most).select(rows.columns)


def stable(docs: DataFrame) -> DataFrame:
    """``docs``, written first unless it is a plain scan.

    Row numbers (monotonically_increasing_id) name the same row in every reading of a
    scan, but not above a shuffle, where each reading may place rows anew.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+-]*(\w+)", line)[1] for line in plan.splitlines() if re.match(r"[\s:+-]*\w", line)}
    return docs if nodes <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD"} else written(docs, "stable")


def held_out(modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of runs of whole rows of about ``size`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + CHUNK_DOCS, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# Vectorised polynomial hashing modulo 2**64 over random byte values, finished by a mixer.
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of BYTE[data[t]] * BASE**t over i <= t < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(BYTE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends)."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII and every byte of a longer UTF-8 character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay within a row, and the first run of each row (one entry more than rows)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    edge = offsets[:-1][offsets[:-1] < len(mask)]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
