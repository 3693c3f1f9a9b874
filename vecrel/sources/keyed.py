"""Tables with a primary key: a durable catalog, guarded UPDATE and DELETE, transactions.

A table is a list of immutable row files and of tombstones, each with a sequence number; a
row is there if no tombstone of its key is younger.  A change adds files and never rewrites
the table; many small ones are folded together now and then.  The catalog's state is a
small file for each version, published by a rename that fails where the version exists, so
every process that opens the folder sees the old or the new state, and of two writers the
first to commit wins: the other is refused if both wrote a key, and goes on top otherwise.
Deleted keys are remembered, so that deleting again is told apart from deleting what
never was.
"""

from __future__ import annotations

import json
import uuid
from copy import deepcopy
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files of a table beyond which they are folded into one.
FILES = 16


class Conflict(ValueError):
    """Another writer committed a change of the same key first."""


@dataclass
class Table:
    schema: T.StructType
    key: str | None
    vectors: dict[str, int] = field(default_factory=dict)
    seq: int = 0
    parts: list[list] = field(default_factory=list)  # [seq, path] of row files
    tombs: list[list] = field(default_factory=list)  # [seq, path] of files of (key, deleted)
    indexes: dict[str, dict] = field(default_factory=dict)
    born: str = ""  # tells tables of one name apart

    def to_json(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "schema"} | {"schema": json.loads(self.schema.json())}

    @classmethod
    def from_json(cls, about: dict) -> Table:
        return cls(**(about | {"schema": T.StructType.fromJson(about["schema"])}))


class Catalog:
    """Named keyed tables under a folder; changes are staged while a transaction is open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: tuple[int, dict[str, Table]] = (0, {})
        self.staged: dict[str, Table] | None = None
        self.base: tuple[int, dict[str, Table]] = (0, {})

    # The state and its versions

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        fs, at = self._fs(f"{self.root}/versions")
        return max([0, *(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit())]) if fs.exists(at) else 0

    def _latest(self) -> tuple[int, dict[str, Table]]:
        version = self.version()
        if version != self.seen[0]:
            fs, at = self._fs(f"{self.root}/versions/{version:010d}")
            stream = fs.open(at)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self.seen = version, {name: Table.from_json(x) for name, x in json.loads(text).items()}
        return self.seen

    def _publish(self, tables: dict[str, Table], base: int) -> None:
        name = uuid.uuid4().hex
        fs, draft = self._fs(f"{self.root}/versions/draft-{name}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({k: t.to_json() for k, t in tables.items()}).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        none[0] = jvm.Options.Rename.NONE
        try:
            _, at = self._fs(f"{self.root}/versions/{base + 1:010d}")
            jvm.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, at, none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            raise Conflict("another writer committed first") from e
        self.seen = base + 1, tables

    def _all(self) -> dict[str, Table]:
        return self._latest()[1] if self.staged is None else self.staged

    def _change(self, tables: dict[str, Table], base: int) -> None:
        """Make a changed copy of the state current: at once, or with the transaction."""
        if self.staged is None:
            self._publish(tables, base)
        else:
            self.staged = tables

    def _copy(self) -> tuple[int, dict[str, Table]]:
        version, tables = self._latest() if self.staged is None else (0, self.staged)
        return version, deepcopy(tables)

    # Tables

    def _table(self, name: str) -> Table:
        tables = self._all()
        if name not in tables:
            raise ValueError(f"table not found: {name}")
        return tables[name]

    def names(self) -> list[str]:
        return sorted(self._all())

    def exists(self, name: str) -> bool:
        return name in self._all()

    def primary_key(self, name: str) -> str | None:
        return self._table(name).key

    def _tombs(self, table: Table) -> DataFrame | None:
        """(key, seq, deleted): the youngest tombstone of each key."""
        schema = T.StructType([T.StructField("key", table.schema[table.key].dataType), T.StructField("deleted", T.BooleanType())]) if table.key else None
        out = None
        for seq, path in table.tombs:
            own = self.spark.read.schema(schema).parquet(path).select("key", F.lit(seq).alias("seq"), "deleted")
            out = own if out is None else out.unionByName(own)
        return out if out is None else out.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("deleted", "seq").alias("deleted"))

    def _rows(self, table: Table) -> DataFrame:
        if not table.parts:
            return self.spark.createDataFrame([], table.schema)
        oldest = max((seq for seq, _ in table.tombs), default=-1)
        fresh = [path for seq, path in table.parts if seq > oldest]
        out = self.spark.read.schema(table.schema).parquet(*fresh) if fresh else None
        aged = [(seq, path) for seq, path in table.parts if seq <= oldest]
        if aged:
            held = None
            for seq, path in aged:
                own = self.spark.read.schema(table.schema).parquet(path).withColumn("part_seq", F.lit(seq))
                held = own if held is None else held.unionByName(own)
            tombs = self._tombs(table).select(F.col("key").alias("tomb_key"), F.col("seq").alias("tomb_seq"))
            live = held.join(tombs, (F.col(table.key) == F.col("tomb_key")) & (F.col("part_seq") < F.col("tomb_seq")), "left_anti").drop("part_seq")
            out = live if out is None else live.unionByName(out)
        return out

    def rows(self, name: str) -> DataFrame:
        return self._rows(self._table(name))

    def row_count(self, name: str) -> int:
        return self.rows(name).count()

    def create(self, name: str, schema: T.StructType, key: str | None = None, vectors: dict[str, int] | None = None) -> None:
        if self.exists(name):
            raise ValueError(f"table exists: {name}")
        base, tables = self._copy()
        tables[name] = Table(schema, key, vectors or {}, born=uuid.uuid4().hex)
        self._change(tables, base)

    def drop(self, name: str) -> None:
        self._table(name)
        base, tables = self._copy()
        del tables[name]
        self._change(tables, base)

    def set_index(self, name: str, index: str, about: dict | None) -> None:
        """Note an index of a table, or with None forget it."""
        self._table(name)
        base, tables = self._copy()
        if about is None:
            if tables[name].indexes.pop(index, None) is None:
                raise ValueError(f"index not found: {index}")
        else:
            tables[name].indexes[index] = about
        self._change(tables, base)

    # Transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise ValueError("a transaction is open")
        self.base = self._latest()
        self.staged = deepcopy(self.base[1])

    def rollback(self) -> None:
        if self.staged is None:
            raise ValueError("no transaction is open")
        self.staged = None

    def commit(self) -> None:
        """Publish the staged changes, on top of what others committed meanwhile; Conflict if both wrote a key."""
        if self.staged is None:
            raise ValueError("no transaction is open")
        staged, self.staged = self.staged, None
        version, now = self._latest()
        if version != self.base[0]:
            staged = self._rebased(staged, now)
        self._publish(staged, version)

    def _rebased(self, staged: dict[str, Table], now: dict[str, Table]) -> dict[str, Table]:
        out = deepcopy(now)
        for name in {*staged, *self.base[1]}:
            mine, was, theirs = staged.get(name), self.base[1].get(name), now.get(name)
            if mine == was:
                continue  # not touched here
            if theirs == was:
                out.pop(name, None)
                if mine:
                    out[name] = mine
                continue
            if not (mine and was and theirs) or not mine.born == was.born == theirs.born:
                raise Conflict(f"table {name} was created, dropped or replaced by another writer")
            (a, a_whole), (b, b_whole) = (self._keys(x, was) for x in (mine, theirs))
            if a_whole or b_whole or (mine.key and a is not None and b is not None and a.join(b, "key", "left_semi").limit(1).count()):
                raise Conflict(f"another writer changed the same rows of {name} first")
            shift = theirs.seq - was.seq
            out[name].parts += [[seq + shift, path] for seq, path in mine.parts if seq > was.seq]
            out[name].tombs += [[seq + shift, path] for seq, path in mine.tombs if seq > was.seq]
            out[name].seq += mine.seq - was.seq
            out[name].indexes |= mine.indexes
        return out

    def _keys(self, table: Table, was: Table) -> tuple[DataFrame | None, bool]:
        """Keys that ``table`` wrote since ``was``, and whether its older files were folded meanwhile."""
        out = None
        if table.key:
            for kind, column in (("parts", table.key), ("tombs", "key")):
                for path in [path for seq, path in getattr(table, kind) if seq > was.seq]:
                    own = self.spark.read.parquet(path).select(F.col(column).alias("key"))
                    out = own if out is None else out.unionByName(own)
        return out, any(x not in table.parts for x in was.parts)

    # Changes of rows

    def _add(self, name: str, rows: DataFrame | None, tombs: DataFrame | None = None) -> None:
        """Add tombstones and, younger than these, rows."""
        base, tables = self._copy()
        table = tables[name]
        for kind, df in (("tombs", tombs), ("parts", rows)):
            if df is not None:
                path = f"{self.root}/{name}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                table.seq += 1
                getattr(table, kind).append([table.seq, path])
        if len(table.parts) + len(table.tombs) > FILES and self.staged is None:
            self._fold(name, table)
        self._change(tables, base)

    def _fold(self, name: str, table: Table) -> None:
        """One file of the deleted keys and one of the rows in place of all; the old files stay for those who read them."""
        rows, tombs = self._rows(table), self._tombs(table) if table.tombs else None
        at = f"{self.root}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        if tombs is not None:
            tombs.where("deleted").select("key", "deleted").write.parquet(f"{at}-gone")
            table.tombs = [[table.seq + 1, f"{at}-gone"]]
        table.parts, table.seq = [[table.seq + 2, at]], table.seq + 2

    def insert(self, name: str, new: DataFrame) -> int:
        """Append rows; keys must be new and given once."""
        table = self._table(name)
        new = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema))
        for column, dims in table.vectors.items():
            if new.where(F.size(column) != dims).limit(1).count():
                raise ValueError(f"dimension mismatch: {column} takes {dims}")
        if table.key:
            if new.where(F.col(table.key).isNull()).limit(1).count():
                raise ValueError(f"PRIMARY KEY {table.key} must not be null")
            twice = new.groupBy(table.key).count().where("count > 1").limit(1).count()
            if twice or new.join(self._rows(table), table.key, "left_semi").limit(1).count():
                raise ValueError(f"duplicate PRIMARY KEY in {name}")
        n = new.count()
        self._add(name, new)
        return n

    def _key_value(self, table: Table, where: tuple[str, object] | None) -> object:
        if where is None:
            raise ValueError("a WHERE clause is required")
        if where[0] not in table.schema.names:
            raise ValueError(f"column not found: {where[0]}")
        if where[0] != table.key:
            raise ValueError("WHERE must name the PRIMARY KEY")
        return where[1]

    def update(self, name: str, changes: dict[str, object], where: tuple[str, object] | None) -> int:
        """Rows updated: 1, also if nothing differs; a key that is not there is an error."""
        table = self._table(name)
        value = self._key_value(table, where)
        kinds = {f.name: f.dataType for f in table.schema}
        for column, to in changes.items():
            if column not in kinds:
                raise ValueError(f"column not found: {column}")
            if column == table.key:
                raise ValueError("PRIMARY KEY is immutable")
            number = isinstance(kinds[column], T.NumericType)
            if to is not None and not isinstance(to, Column) and (isinstance(kinds[column], T.StringType) != isinstance(to, str) or number != (isinstance(to, (int, float)) and not isinstance(to, bool))):
                raise ValueError(f"type mismatch for column {column}")
        row = self._rows(table).where(F.col(table.key) == value)
        if not row.limit(1).count():
            raise ValueError(f"key not found: {value}")
        new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]) for c, v in changes.items()}
        self._add(name, row.select(*(new.get(c, F.col(c)).alias(c) for c in table.schema.names)), row.select(F.col(table.key).alias("key"), F.lit(False).alias("deleted")))
        return 1

    def delete(self, name: str, where: tuple[str, object] | None) -> int:
        """Rows deleted: 1, or 0 for a key deleted before; a key that never was is an error."""
        table = self._table(name)
        value = self._key_value(table, where)
        row = self._rows(table).where(F.col(table.key) == value)
        if not row.limit(1).count():
            if table.tombs and self._tombs(table).where((F.col("key") == value) & F.col("deleted")).limit(1).count():
                return 0
            raise ValueError(f"key not found: {value}")
        self._add(name, None, row.select(F.col(table.key).alias("key"), F.lit(True).alias("deleted")))
        return 1
