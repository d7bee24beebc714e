"""Connected components by least labels, with lineage cut in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. A session of one machine may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written in the folder of spark.checkpoint.dir and read back, which cuts its lineage.

    Unlike checkpoint(), this leaves the constraints behind that the optimiser has inferred for df; carried
    from round to round of an iteration, they make planning take longer than the work.  The files go when
    the driver's JVM ends."""
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable over undirected edges (a, b); only ids that have an edge.

    A round takes the least label among the neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        far = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = checkpointed(step.join(far, step.label == far.via, "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels
