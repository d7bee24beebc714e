"""The experience table: schema, the driver's tables as experience, appending with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from ..operators.components import shared_folder

FLAG_DELETED, FLAG_PINNED = 1, 2

SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("episode_id", T.LongType(), False),
    T.StructField("seq_no", T.LongType(), False),
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("pred_err", T.DoubleType(), False),
    T.StructField("flags", T.IntegerType(), False),
    T.StructField("z", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("action", T.ArrayType(T.DoubleType(), False), True),
])

def by_episode():
    return Window.partitionBy("episode_id").orderBy("seq_no")


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as experiences: label is the episode, the last four elements stand in for the action, the
    event of the same number gives the time, the prediction error is the distance to the next latent."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = e.join(v, e.vec_id == v.event_id, "left").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("episode_id"), (F.coalesce("us", F.lit(0)) * 1000).alias("timestamp_ns"),
        F.transform("embedding", lambda x: x.cast("double")).alias("z"), F.transform(F.slice("embedding", 61, 4), lambda x: x.cast("double")).alias("action"),
    )
    w = Window.partitionBy("episode_id").orderBy("id")
    rows = rows.withColumn("seq_no", (F.row_number().over(w) - 1).cast("long"))
    error = F.coalesce(F.sqrt(vec.squared_distance(F.lead("z").over(w), F.col("z"))), F.lit(0.0))
    return rows.select("id", "episode_id", "seq_no", "timestamp_ns", error.alias("pred_err"), F.lit(0).alias("flags"), "z", "action")


def validated(rows: DataFrame, dim: int, action_dim: int | None) -> DataFrame:
    """rows with checked vectors: z of dim elements; an action of action_dim on every row, or on none."""
    out = rows.withColumn("z", vec.checked_length(F.col("z"), dim, "z"))
    if action_dim is None:
        wrong = F.raise_error(F.lit("this table has no actions")).cast("array<double>")
        return out.withColumn("action", F.when(F.col("action").isNull(), F.col("action")).otherwise(wrong))
    missing = F.raise_error(F.lit("this table needs an action on every row")).cast("array<double>")
    return out.withColumn("action", F.when(F.col("action").isNull(), missing).otherwise(vec.checked_length(F.col("action"), action_dim, "action")))


def with_dense_ids(new: DataFrame, first_id: int, order: list[str], episode_sizes: DataFrame | None = None) -> DataFrame:
    """new with ids from first_id on in the given order, and seq_no counting on within each episode.

    Ids come from per-partition offsets of a range-sorted frame: no task sees more than its own range.
    episode_sizes: (episode_id, size) of the rows that the table has."""
    spark = new.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()).checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_in").alias("lo"))  # a row per partition
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "lo", (F.coalesce(F.sum("n").over(w), F.lit(0)) + first_id).alias("start"))
    ids = ranged.join(F.broadcast(starts), "_part").withColumn("id", F.col("start") + F.col("_in") - F.col("lo")).drop("_part", "_in", "lo", "start")
    seq = F.row_number().over(Window.partitionBy("episode_id").orderBy("id")) - 1
    if episode_sizes is None:
        return ids.withColumn("seq_no", seq.cast("long"))
    return ids.join(episode_sizes, "episode_id", "left").withColumn("seq_no", (seq + F.coalesce("size", F.lit(0))).cast("long")).drop("size")
