"""The append-only log: point and range reads, flags as facts, navigation within episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.experience import FLAG_DELETED, FLAG_PINNED, by_episode


def point_lookup(log: DataFrame, id: int) -> DataFrame:
    """The row of an id; an error if the table has no such row."""
    found = log.where(F.col("id") == id)
    if found.isEmpty():
        raise ValueError(f"no row {id}")
    return found


def range_scan(log: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows with start <= id < end in id order, tombstoned ones too; the bounds reach the Parquet scan."""
    rows = log.where(F.col("id") >= start)
    return (rows if end is None else rows.where(F.col("id") < end)).orderBy("id")


def flag_events(ids: DataFrame, flag: int) -> DataFrame:
    """(id, flag) facts that set a flag; no row is rewritten."""
    return ids.select(F.col("id").cast("long").alias("id"), F.lit(flag).alias("flag"))


def with_flags(log: DataFrame, events: DataFrame) -> DataFrame:
    """log with the flags that events set on top of its own."""
    merged = events.groupBy("id").agg(F.bit_or("flag").cast("int").alias("_set"))
    return log.join(merged, "id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_set", F.lit(0)))).drop("_set").select(*log.columns)


def live(flags="flags"):
    return F.col(flags).bitwiseAND(FLAG_DELETED) == 0


def pinned(flags="flags"):
    return F.col(flags).bitwiseAND(FLAG_PINNED) != 0


def neighbours(log: DataFrame) -> DataFrame:
    """(id, prev_id, next_id): the rows before and after each row in its episode, null at the ends."""
    return log.select("id", F.lag("id").over(by_episode()).alias("prev_id"), F.lead("id").over(by_episode()).alias("next_id"))


def with_outcome(log: DataFrame) -> DataFrame:
    """log with z_next, the latent of the next row of the episode, null at its end."""
    return log.withColumn("z_next", F.lead("z").over(by_episode()))


def episode(log: DataFrame, episode_id: int) -> DataFrame:
    rows = log.where(F.col("episode_id") == episode_id)
    if rows.isEmpty():
        raise ValueError(f"no episode {episode_id}")
    return rows.orderBy("seq_no")


def episode_ids(log: DataFrame) -> DataFrame:
    """Episodes in the order in which they first appear."""
    return log.groupBy("episode_id").agg(F.min("id").alias("first_id")).orderBy("first_id")


def episode_lengths(log: DataFrame) -> DataFrame:
    return log.groupBy("episode_id").agg(F.count("*").alias("length"))


def walk_forward(log: DataFrame, n: int) -> DataFrame:
    """(id, walk): up to n following ids of the episode, nearest first."""
    return log.select("id", F.collect_list("id").over(by_episode().rowsBetween(1, n)).alias("walk")) if n > 0 else log.select("id", F.expr("CAST(array() AS array<bigint>)").alias("walk"))


def walk_back(log: DataFrame, n: int) -> DataFrame:
    """(id, walk): up to n preceding ids of the episode, nearest first."""
    back = Window.partitionBy("episode_id").orderBy(F.col("seq_no").desc())
    return log.select("id", F.collect_list("id").over(back.rowsBetween(1, n)).alias("walk")) if n > 0 else log.select("id", F.expr("CAST(array() AS array<bigint>)").alias("walk"))
