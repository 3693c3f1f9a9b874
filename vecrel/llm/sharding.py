"""Sharding by size-tiered compaction, with DataFrame operations and file metadata only.

Arrivals are appended as small immutable Parquet shards.  Shards fall into tiers by size;
whenever a tier holds ``fanout`` of them, its shards are merged, similar sizes together,
into files ``fanout`` times as large, up to the target size.  A merge is one scan whose
splits Spark packs from whole shards up to the wanted size, each written as one file:
no shuffle, no driver loop over rows, one task per new shard.

The manifest is a table with one row per shard.  Every change writes a new manifest
beside the old ones and then publishes it by renaming a small file to the next version
number, which fails if that version exists; readers see the old or the new state.
Files of a failed or lost attempt are never named by a manifest.  Old versions stay
readable until ``vacuum``.

Edge cases: an empty arrival publishes nothing new; rows are kept whole with all their
columns, nulls, empty and very long texts and repeated rows included; columns may have
any names, for no column is added.  An arrival with other columns than the store is
refused.  An empty store reads as None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TARGET_BYTES = 128 << 20
FANOUT = 4
TIERS = 4
MANIFEST = "path string, bytes long, rows long, arrival long"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, compression: str = "zstd"):
        self.spark, self.root, self.target, self.fanout, self.compression = spark, root.rstrip("/"), target_bytes, fanout, compression
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The latest published version; 0 before the first."""
        at = self._path(f"{self.root}/versions")
        fs = self._fs(self.root)
        if not fs.exists(at):
            return 0
        return max([0, *(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit())])

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row for each shard of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.root}/versions/{version:010d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def publish(self, manifest: DataFrame, base: int) -> int:
        """Commit a manifest made from version ``base``; fails if another writer was first."""
        name = uuid.uuid4().hex
        manifest.select("path", "bytes", "rows", "arrival").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        fs = self._fs(self.root)
        fs.mkdirs(self._path(f"{self.root}/versions"))
        draft = self._path(f"{self.root}/versions/draft-{name}")
        out = fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
        none[0] = getattr(options, "Rename").NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, self._path(f"{self.root}/versions/{base + 1:010d}"), none)
        return base + 1

    def _shards(self, path: str, arrival: int) -> DataFrame:
        """Manifest rows of the files under a folder; a file without rows is none."""
        found = self.spark.read.parquet(path)
        return found.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).withColumn("arrival", F.lit(arrival).cast("long"))

    def _columns(self) -> list | None:
        first = self.manifest().select("path").first()
        return self.spark.read.parquet(first.path).dtypes if first else None

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as small shards and publish them."""
        base = self.version()
        if base and (known := self._columns()) and known != arrival.dtypes:
            raise ValueError(f"an arrival has columns {arrival.dtypes}, the store {known}")
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", self.compression).parquet(path)
        new = self._shards(path, base + 1)
        return self.publish(self.manifest(base).unionByName(new), base) if new.first() else base

    def _tiered(self, manifest: DataFrame) -> DataFrame:
        """With the tier: 0 for the smallest, TIERS for shards of half the target size or more."""
        least = self.target / self.fanout**TIERS
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / least) / F.log(F.lit(float(self.fanout)))))
        return manifest.withColumn("tier", F.when(F.col("bytes") >= self.target // 2, TIERS).otherwise(F.least(tier, F.lit(TIERS - 1))).cast("int"))

    def compact(self) -> int:
        """Merge tiers that hold ``fanout`` shards or more until none does, but those whose sizes do not pack; the version reached."""
        stuck: set[int] = set()
        while True:
            base = self.version()
            tiers = self._tiered(self.manifest(base))
            full = tiers.where((F.col("tier") < TIERS) & ~F.col("tier").isin(*stuck)).groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if full is None:
                return base
            old = tiers.where(F.col("tier") == full.tier)
            size = min(self.target, int(self.target / self.fanout ** (TIERS - full.tier - 2)))
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            self._merge([r.path for r in old.select("path").collect()], path, size)
            new = self._shards(path, base + 1)
            if new.count() >= full.n:  # nothing gained
                stuck.add(full.tier)
                self._fs(path).delete(self._path(path), True)
                continue
            self.publish(tiers.where(F.col("tier") != full.tier).drop("tier").unionByName(new), base)

    def _merge(self, paths: list[str], path: str, size: int) -> None:
        """Pack whole shards up to ``size`` bytes into one file each."""
        wanted = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        held = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            self.spark.read.parquet(*paths).write.option("compression", self.compression).parquet(path)
        finally:
            for k, v in held.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def vacuum(self, versions: int = 2) -> None:
        """Delete shards and manifests that none of the latest ``versions`` names, so that readers of those go on."""
        fs, latest = self._fs(self.root), self.version()
        if not latest:
            return
        known = [v for v in range(max(1, latest - versions + 1), latest + 1) if fs.exists(self._path(f"{self.root}/versions/{v:010d}"))]
        paths = {r.path for v in known for r in self.manifest(v).select("path").collect()}
        kept = {x.rsplit("/", 1)[-1] for x in paths}
        folders = {x.rsplit("/", 2)[-2] for x in paths}
        names = {self.spark.read.text(f"{self.root}/versions/{v:010d}").first()[0] for v in known}
        for folder in fs.listStatus(self._path(f"{self.root}/data")):
            at = folder.getPath()
            if at.getName() not in folders:
                fs.delete(at, True)
                continue
            for file in fs.listStatus(at):
                if file.getPath().getName().endswith(".parquet") and file.getPath().getName() not in kept:
                    fs.delete(file.getPath(), False)
        for folder, keep in (("manifests", names), ("versions", {f"{v:010d}" for v in known})):
            for x in fs.listStatus(self._path(f"{self.root}/{folder}")):
                if x.getPath().getName() not in keep:
                    fs.delete(x.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        return self.spark.read.parquet(*paths) if paths else None


def load(store: ShardStore, table: DataFrame, arrivals: int = 4) -> None:
    """Append the rows of a table in as many arrivals, compacting and clearing up after each.

    A bare scan of enough files arrives file by file; any other table is dealt by row.
    """
    plan = table._jdf.queryExecution().optimizedPlan()
    files = sorted(table.inputFiles()) if plan.nodeName().startswith("LogicalRelation") or plan.toString().startswith("Relation") else []
    whole = None if len(files) >= arrivals else C.stable(table)
    for k in range(arrivals):
        if whole is None:
            store.append(store.spark.read.schema(table.schema).parquet(*files[k::arrivals]))
        else:
            store.append(whole.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(1)  # nobody else reads while the table is loaded
