"""Tables in the shared folder, and small helpers that every text operator uses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. A session of one machine may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (folder or LOCAL_SHARED).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_stored(df: DataFrame, path: str, batch_rows: int = 2000) -> None:
    """Write df as Parquet.  The shuffle files of the write go as soon as it has ended.
    batch_rows: rows of an Arrow batch, which bounds what a Python worker and its JVM hold of large rows.
    The two settings are the session's while the write runs."""
    spark = df.sparkSession
    settings = {_CLEAN: "true", _BATCH: str(batch_rows)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, label: str, batch_rows: int = 2000) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage, and a lost
    executor takes nothing with it."""
    path = new_folder(df.sparkSession, label)
    write_stored(df, path, batch_rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by stored() that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", max_chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds at most about max_chars characters (one row at least)."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        lo = total = 0
        for i, n in enumerate(sizes):
            if i > lo and total + n > max_chars:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        if lo < len(sizes):
            yield batch.slice(lo)
