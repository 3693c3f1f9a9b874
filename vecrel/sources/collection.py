"""A vector collection on Parquet: validated inserts, scans, save and load.

Ids are insertion ordinals.  A batch is checked as a whole before anything is written.
Files are sorted by id within each, so point and range lookups skip row groups.  The graph
index lies beside the vectors and is rebuilt from them where it is missing or behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quantize as qz
from ..functions.vectors import is_finite
from ..operators import hnsw

SCHEMA = "vec_id long, embedding array<float>"


class Collection:
    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/vectors")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path))

    def rows(self) -> DataFrame:
        """Full scan."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/vectors") if self.exists() else self.spark.createDataFrame([], SCHEMA)

    def get(self, vec_id: int) -> DataFrame:
        return self.rows().where(F.col("vec_id") == vec_id)

    def next_id(self) -> int:
        last = self.rows().agg(F.max("vec_id")).first()[0]
        return 0 if last is None else last + 1

    def insert(self, vector: list[float]) -> int:
        """One vector; its id."""
        return self.insert_batch(self.spark.createDataFrame([(0, vector)], "ordinal long, embedding array<float>"))[0]

    def insert_batch(self, batch: DataFrame) -> tuple[int, int]:
        """Append (ordinal, embedding) in order of ``ordinal``, all or nothing; the range [first, past last) of ids.

        Ranks come from sorted partitions and their sizes, so no task sees the whole batch.
        """
        bad = batch.agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce(F.size("embedding") != self.dims, F.lit(True))).alias("dims"),
            F.count_if(~F.coalesce(is_finite("embedding"), F.lit(False))).alias("values"),
        ).first()
        if bad["dims"]:
            raise ValueError(f"dimension mismatch: {bad['dims']} vectors are not of {self.dims}")
        if bad["values"]:
            raise ValueError("a vector holds NaN or infinite values")
        first = self.next_id()
        if not bad.n:
            return first, first
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        batch.select("ordinal", "embedding").repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("*", F.spark_partition_id().alias("part")).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        before, offsets = first, []
        for r in held.groupBy("part").agg(F.count("*").alias("n"), F.min("ordinal").alias("o")).orderBy("o").collect():
            offsets.append((r.part, before))
            before += r.n
        order = Window.partitionBy("part").orderBy("ordinal")
        base = self.spark.createDataFrame(offsets, "part int, base long")
        numbered = held.join(F.broadcast(base), "part").withColumn("vec_id", F.col("base") + F.row_number().over(order) - 1)
        numbered.sortWithinPartitions("vec_id").select("vec_id", "embedding").write.mode("append").parquet(f"{self.path}/vectors")
        fs, _ = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        return first, before

    def rebuild_index(self, params: hnsw.Params = hnsw.Params(), quantizer: qz.Params | None = None) -> hnsw.Index | None:
        """Build the graph anew from the stored vectors and, with ``quantizer``, their quantized form; None while there are no vectors."""
        rows = self.rows()
        if not rows.limit(1).count():
            return None
        hnsw.Index.build(rows, params).save(f"{self.path}/index")
        if quantizer:
            self._quantize(self.path, quantizer)
        return hnsw.Index.load(self.spark, f"{self.path}/index", self.dims)

    def index(self) -> hnsw.Index | None:
        """The stored index; rebuilt where it is missing, or, with its own parameters, where vectors were added since."""
        if not hnsw.Index.saved(self.spark, f"{self.path}/index"):
            return self.rebuild_index()
        held = hnsw.Index.load(self.spark, f"{self.path}/index", self.dims)
        return held if held.nodes.count() == self.rows().count() else self.rebuild_index(held.params)

    def _quantize(self, path: str, params: qz.Params) -> None:
        self.rows().select("vec_id", qz.quantize("embedding", params).alias("q")).write.mode("overwrite").parquet(f"{path}/quantized")

    def save_to(self, path: str, params: qz.Params | None = None) -> None:
        """Vectors and their index if there is one, with ``params`` also their quantized form, and a note of dimension and parameters."""
        rows = self.rows()
        rows.write.mode("overwrite").parquet(f"{path}/vectors")
        if params:
            self._quantize(path, params)
        if hnsw.Index.saved(self.spark, f"{self.path}/index"):
            self.index().save(f"{path}/index")
        about = {"dims": self.dims, "quantizer": vars(params) if params else None}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load_from(cls, spark: SparkSession, path: str, dims: int) -> tuple[Collection, qz.Params | None]:
        out = cls(spark, path, dims)
        if not out.exists():
            raise FileNotFoundError(f"no vectors in {path}")
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if about["dims"] != dims:
            raise ValueError(f"dimension mismatch: expected {dims}, got {about['dims']}")
        return out, qz.Params(**about["quantizer"]) if about["quantizer"] else None

    def memory(self) -> DataFrame:
        """(vectors, bytes) at 4 bytes for a coordinate."""
        return self.rows().agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).alias("bytes"))
