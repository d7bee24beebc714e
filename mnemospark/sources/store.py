"""A durable experience table: Parquet parts in a folder, and a pointer that lists the current ones.

An append writes a part of its own and then a new pointer, which lists it beside the parts before; a rebuild
writes a pointer to one new part.  A pointer is a numbered file that is renamed into place and never changed,
so that there always is one, a write takes effect whole or not at all, together with the notes that go with
it, and of two writers that start from the same pointer one fails.  What a failed write leaves behind is
listed nowhere.  All paths go through Hadoop's FileSystem, so a store can lie wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..operators.log import flag_events, with_flags
from .experience import SCHEMA, validated, with_dense_ids

FLAGS = "id long, flag int"
#: Pointers are kept for readers that have just looked; older ones go.
KEPT_POINTERS = 3


class Store:
    def __init__(self, spark: SparkSession, path: str, config: MemoryConfig | None = None, index_options: dict | None = None):
        """Open a store, or create one for config; an existing store must have the same dimensions."""
        self.spark, self.path = spark, path.rstrip("/")
        found = self._read_pointer()
        if found is None:
            if config is None:
                raise ValueError(f"no store at {path}")
            found = {"dim": config.dim, "action_dim": config.action_dim, "index": index_options or {}, "parts": []}
            self.number = 0
            self._write_pointer(found)
        elif config is not None and (config.dim, config.action_dim) != (found["dim"], found["action_dim"]):
            raise ValueError(f"the store at {path} has dim {found['dim']} and action_dim {found['action_dim']}")
        self.meta = found

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        found = self._fs().globStatus(self._path("current-*.json")) or []
        return sorted(int(f.getPath().getName()[8:-5]) for f in found)

    def _read_pointer(self) -> dict | None:
        numbers = self._pointers()
        if not numbers:
            return None
        self.number = numbers[-1]
        return json.loads(self.spark.read.text(f"{self.path}/current-{self.number:012d}.json", wholetext=True).first()[0])

    def _write_pointer(self, meta: dict) -> None:
        """Make meta the current pointer, or fail if another writer was first."""
        fs, part, to = self._fs(), self._path(f".{uuid.uuid4().hex}"), self._path(f"current-{self.number + 1:012d}.json")
        out = fs.create(part)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(part, to):
            fs.delete(part, False)
            raise RuntimeError(f"the store at {self.path} was written by someone else")
        self.number, self.meta = self.number + 1, meta
        for old in self._pointers()[:-KEPT_POINTERS]:
            fs.delete(self._path(f"current-{old:012d}.json"), False)

    def read(self) -> DataFrame:
        """The rows, with the flags that were set on them since."""
        parts, flags = ([f"{self.path}/{p}" for p in self.meta.get(k, [])] for k in ("parts", "flags"))
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return with_flags(rows, self.spark.read.schema(FLAGS).parquet(*flags)) if flags else rows

    def flag(self, ids: DataFrame, flag: int) -> None:
        """Set a flag on rows, as facts beside them; no row is rewritten until the table is."""
        part = "f-" + uuid.uuid4().hex
        flag_events(ids, flag).write.parquet(f"{self.path}/{part}")
        self._write_pointer(self.meta | {"flags": [*self.meta.get("flags", []), part]})

    def scan(self, start_id: int = 0) -> DataFrame:
        """Rows from start_id on in id order; files and row groups below it are skipped by their statistics."""
        return self.read().where(F.col("id") >= start_id).orderBy("id")

    def count(self) -> int:
        return self.read().count()

    def append(self, rows: DataFrame, max_rows_per_file: int = 100_000, notes: dict | None = None) -> None:
        """Append rows that have ids; notes become part of the pointer with them, or not at all."""
        out = validated(rows, self.meta["dim"], self.meta["action_dim"]).select(*SCHEMA.names)
        part = "p-" + uuid.uuid4().hex
        out.sortWithinPartitions("id").write.option("maxRecordsPerFile", max_rows_per_file).parquet(f"{self.path}/{part}")
        self._write_pointer(self.meta | {"parts": [*self.meta["parts"], part]} | (notes or {}))

    def append_new(self, rows: DataFrame, order: list[str], notes: dict | None = None) -> int:
        """Append rows without ids, in the given order; the first id that they got."""
        mine = self.read()
        first = mine.agg(F.max("id")).first()[0]
        first = 0 if first is None else first + 1
        sizes = mine.groupBy("episode_id").agg(F.count("*").alias("size"))
        self.append(with_dense_ids(rows, first, order, sizes), notes=notes)
        return first

    def replace(self, rows: DataFrame) -> None:
        """Make these rows the table, as one part; readers of the old parts aren't disturbed."""
        part = "p-" + uuid.uuid4().hex
        rows.select(*SCHEMA.names).sortWithinPartitions("id").write.parquet(f"{self.path}/{part}")
        self._write_pointer(self.meta | {"parts": [part], "flags": []})
