"""The event log as a stream: one writer that numbers events, any number of readers that follow.

Readers are file streams with a checkpoint: they lose nothing when slow, and after a restart go on where they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import append, last_seq, matching
from ..schemas import EVENTS
from ..session import exists

#: Name and type of each column.
FIELDS = [tuple(f.split(" ", 1)) for f in EVENTS.split(", ")]


#: Folder within a log's folder, hidden from its readers, with one row per batch: the last number it gave.
LAST = "_last"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log in ``folder``; empty if nothing was written."""
    if not exists(spark, f"{folder}/{LAST}"):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).option("basePath", folder).parquet(f"{folder}/batch=*").select(*[n for n, _ in FIELDS])


def last_before(spark: SparkSession, folder: str, batch_id: int) -> int:
    """The last number that batches before this one gave; 0 if there is none. Reads one row per batch, whatever the log's length."""
    if not exists(spark, f"{folder}/{LAST}"):
        return 0
    told = spark.read.schema("seq long, batch long").parquet(f"{folder}/{LAST}")
    return last_seq(told.where(F.col("batch") < batch_id)).first()[0]


def sequence(stream: DataFrame, folder: str, checkpoint: str, order: Sequence[str], available_now: bool = True) -> StreamingQuery:
    """Number the events of ``stream`` along ``order`` (total within a batch), behind all earlier ones, and append them to ``folder``.

    A batch that is written again after a failure gets the same numbers, as it counts on from earlier batches only, and
    replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        after = last_before(spark, folder, batch_id)
        full = batch.withColumns({n: F.lit(None).cast(t) for n, t in FIELDS if n not in batch.columns})
        append(full, after, order).select(*[F.col(n).cast(t) for n, t in FIELDS]).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        # an empty batch gives no number
        mine = spark.read.schema(EVENTS).parquet(f"{folder}/batch={batch_id}").agg(F.coalesce(F.max("seq"), F.lit(after)).alias("seq"))
        mine.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LAST}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def subscribe(spark: SparkSession, path: str, layers: Sequence[str] = (), kinds: Sequence[str] = (), files_per_trigger: int = 64) -> DataFrame:
    """The events under ``path`` (a folder or a pattern) as a stream, of the given layers and kinds; an empty side takes all."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return matching(s, layers, kinds)


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there of a stream to ``folder`` and stop; a later call with the same checkpoint goes on from there."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
