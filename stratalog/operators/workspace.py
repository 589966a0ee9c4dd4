"""What a workspace says about itself: status, layers, and the test of a selector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import last_seq
from .overlay import resolve


def status(events: DataFrame, entities: DataFrame, selectors: DataFrame, flows: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: the last seq, and how many events (by seq), entities (by id), selectors, flows and pending proposals there are."""
    counts = {
        "events": events.agg(F.count_distinct("seq").alias("n")),
        "entities": entities.agg(F.count_distinct("id").alias("n")),
        "selectors": selectors.agg(F.count_distinct("name").alias("n")),
        "flows": flows.agg(F.count_distinct("name").alias("n")),
        "pending": proposals.where("state = 'pending_review'").agg(F.count_distinct("id").alias("n")),
    }
    return last_seq(events).select("last_seq", *[c.scalar().alias(n) for n, c in counts.items()])


def layers(catalogue: DataFrame, events: DataFrame) -> DataFrame:
    """Each installed layer with what it depends on, and the events and last seq it has in the log; layers without events have 0 and null."""
    n = events.select("layer", "seq").distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"))
    c = catalogue.select("name", "version", F.array_join("depends_on", ",").alias("depends_on"))
    return c.join(n.withColumnRenamed("layer", "name"), "name", "left").select("name", "version", "depends_on", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "last_seq")


def check_selectors(selectors: DataFrame, entities: DataFrame, seq: int) -> DataFrame:
    """One row per selector, whether its test passes: bound, and if it must be unique, by a name that only one entity has."""
    r = resolve(selectors, entities, seq)
    same = entities.where(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.count_distinct("id").alias("n_entities"))
    n = F.coalesce("n_entities", F.lit(0)).cast("long")
    ok = (F.col("outcome") == "bound") & (~F.coalesce("unique", F.lit(False)) | (n == 1))
    return r.join(same, "qualified_name", "left").select("name", "outcome", "qualified_name", n.alias("n_entities"), ok.alias("passed"), "resolved_at")
