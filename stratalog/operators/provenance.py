"""Folding the provenance of several facts into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blocking_risk

#: Facts of a key that may stand in one row.
MOST_NESTED = 10_000


def fold(facts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key: the least confidence, the freshness of the greatest risk (of equals the first along ``order``), the greatest
    produced_seq and the number of constituents. Combined before the shuffle."""
    return facts.groupBy(*keys).agg(
        F.min("confidence").alias("confidence"),
        F.max_by("freshness", F.struct(blocking_risk("freshness"), -F.col(order))).alias("freshness"),
        F.max("produced_seq").alias("produced_seq"),
        F.count(F.lit(1)).alias("n_constituents"),
    )


def fold_members(facts: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """The union of an array column per key, as one row for each distinct member: a key may have any number of them."""
    return facts.select(*keys, F.explode(member).alias(member)).distinct()


def fold_nested(facts: DataFrame, keys: Sequence[str], order: str, most: int = MOST_NESTED) -> DataFrame:
    """As fold(), with the sorted unions of source_class and inputs and the constituents as arrays, in one row per key. A key with more than
    ``most`` facts is an error, raised before any of them is collected: fold() and fold_members() are for keys of any size. An empty table gives an
    empty one; empty_fold() is the value of no facts."""
    over = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).first()
    if over:
        raise ValueError(f"{over['n']} facts of {tuple(over)[:-1]}, more than {most}: take fold() and fold_members()")
    one = F.struct(order, "confidence", "freshness", "source_class", "inputs", "produced_seq")
    return facts.groupBy(*keys).agg(
        F.min("confidence").alias("confidence"),
        F.max_by("freshness", F.struct(blocking_risk("freshness"), -F.col(order))).alias("freshness"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_class")))).alias("source_class"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("inputs")))).alias("inputs"),
        F.max("produced_seq").alias("produced_seq"),
        F.array_sort(F.collect_list(one)).alias("constituents"),
    )


def empty_fold() -> dict:
    return {"confidence": 0.0, "freshness": "", "source_class": [], "inputs": [], "produced_seq": 0, "constituents": []}


def disagreement(facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys for which there is more than one distinct ``value``: their number and the least and greatest. Nulls are no value."""
    v = facts.dropna(subset=[*keys, value]).select(*keys, value).distinct()
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return g.where("n_values > 1")
