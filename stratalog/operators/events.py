"""The event log: scans, filters, cursors, snapshots, state and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from .order import number_rows


def last_seq(events: DataFrame) -> DataFrame:
    """One row ``last_seq``; 0 for an empty log."""
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("last_seq"))


def read_all(events: DataFrame) -> DataFrame:
    return events.orderBy("seq")


def as_of(events: DataFrame, seq: int | Column) -> DataFrame:
    """Events up to and including ``seq``; the comparison reaches the Parquet scan."""
    return events.where(F.col("seq") <= seq)


def matching(events: DataFrame, layers: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """Events of the layers and kinds; an empty side takes all."""
    if layers:
        events = events.where(F.col("layer").isin(*layers))
    if kinds:
        events = events.where(F.col("kind").isin(*kinds))
    return events


def subject() -> Column:
    """The subject of an event as a struct; null unless there is a layer."""
    return F.when(F.col("subject_layer").isNotNull(), F.struct(F.col("subject_layer").alias("layer"), F.col("subject_kind").alias("kind"), F.col("subject_id").alias("id")))


def append(events: DataFrame, after: int, order: Sequence[str], now: Column | None = None) -> DataFrame:
    """New events with seq after + 1, after + 2, ... along ``order`` (total), a missing ts set to now, a missing tx to ''."""
    e = number_rows(events.drop("seq"), order, "seq", after)
    return e.withColumns({"ts": F.coalesce("ts", now if now is not None else F.current_timestamp()), "tx": F.coalesce("tx", F.lit(""))})


def write_cursors(writes: DataFrame, order: str) -> DataFrame:
    """The cursor of each subscriber: the last write along ``order``, which may go backwards. Ties: the greater seq."""
    return writes.groupBy("subscriber_id").agg(F.max_by("last_processed_seq", F.struct(order, "last_processed_seq")).alias("last_processed_seq"))


def read_cursors(subscribers: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each of ``subscribers`` with its cursor, 0 if it has none or a null one."""
    return subscribers.join(cursors, "subscriber_id", "left").select("subscriber_id", F.coalesce("last_processed_seq", F.lit(0)).cast("long").alias("last_processed_seq"))


def state_as_of(events: DataFrame, seq: int, keys: Sequence[str], value: str) -> DataFrame:
    """The last ``value`` of each key at ``seq``, and when it was set. Rows without a key have no state; ties: the greater value."""
    e = as_of(events, seq).dropna(subset=list(keys))
    return e.groupBy(*keys).agg(F.max_by(value, F.struct("seq", value)).alias(value), F.max("seq").alias("last_seq"))


def retain(events: DataFrame, most: int, since: Column) -> DataFrame:
    """Events to keep: of each layer the last ``most`` by seq, and any since ``since``.

    The least seq kept is found in two stages, the last ``most`` per layer and salt and of these the last per layer, so that no task
    sees a whole layer.
    """
    w = W.orderBy(F.desc("seq"))
    e = events.select("layer", "seq").distinct().withColumn("s", F.pmod(F.xxhash64("seq"), F.lit(64)))
    some = e.withColumn("n", F.row_number().over(w.partitionBy("layer", "s"))).where(F.col("n") <= most)
    floor = some.withColumn("n", F.row_number().over(w.partitionBy("layer"))).where(F.col("n") <= most).groupBy("layer").agg(F.min("seq").alias("__floor"))
    return events.join(floor, "layer", "left").where((F.col("seq") >= F.col("__floor")) | (F.col("ts") >= since)).select(*events.columns)


def snapshot(events: DataFrame, seq: int, layer: str = "") -> DataFrame:
    """The events of a snapshot: up to ``seq``, of one layer or, with '', of all."""
    e = as_of(events, seq)
    return e.where(F.col("layer") == layer) if layer else e


def snapshot_digest(events: DataFrame, seq: int, layer: str = "") -> DataFrame:
    """One row: the snapshot's id, made of the hashes of its events. Independent of their order, so that no task needs all of them."""
    e = snapshot(events, seq, layer).select(F.xxhash64(F.to_json(F.struct("*"))).alias("h"))
    d = e.agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.count(F.lit(1)).alias("n_events"))
    return d.select(ids.snapshot_id(F.lit(layer), F.lit(seq), F.concat_ws(":", F.hex("x"), "n_events")).alias("id"), F.lit(layer).alias("layer"), F.lit(seq).cast("long").alias("seq"), "n_events")


def create_snapshot(events: DataFrame, folder: str, seq: int, layer: str = "") -> str:
    """Write a snapshot under its id; the same snapshot again overwrites itself. Returns the id."""
    name = snapshot_digest(events, seq, layer).first()["id"]
    snapshot(events, seq, layer).write.mode("overwrite").parquet(f"{folder}/id={name}")
    return name


def load_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The events of a snapshot in order; an unknown id is an error."""
    return spark.read.parquet(f"{folder}/id={name}").orderBy("seq")


def lineage(events: DataFrame) -> DataFrame:
    """Each event and each of its causes that is in the log: seq, kind, cause, cause_kind."""
    e = events.select("seq", "kind", "causes").dropDuplicates(["seq"])
    return e.select("seq", "kind", F.explode("causes").alias("cause")).join(e.select(F.col("seq").alias("cause"), F.col("kind").alias("cause_kind")), "cause").select("seq", "kind", "cause", "cause_kind")
