"""Joins of patterns with texts by what is literal in the patterns, instead of every pattern with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns without any literal at their ends that are held against all texts, at most.
MOST_OPEN = 1000


def literal_join(patterns: DataFrame, begins: Column, ends: Column, texts: DataFrame, text: str, most_open: int = MOST_OPEN) -> DataFrame:
    """Candidates: each row of ``patterns`` with each row of ``texts`` whose column ``text`` begins and ends with what the pattern begins and ends
    with literally (``begins`` and ``ends``, over ``patterns``; '' where it does not). The pattern itself is for the caller to test.

    The longer of the two ends is the key of an equi-join: a text gives one key for each length of such an end that occurs among the
    patterns. Patterns with neither end go to all texts by broadcast; more than ``most_open`` of them are an error. Null
    texts match nothing. Columns of the two sides must have different names.
    """
    p = patterns.withColumns({"__a": F.coalesce(begins, F.lit("")), "__z": F.coalesce(ends, F.lit(""))})
    first = F.length("__a") >= F.length("__z")
    p = p.withColumns({"__side": first, "__key": F.when(first, F.col("__a")).otherwise(F.col("__z"))}).withColumn("__n", F.length("__key"))
    open_ones = p.where("__n = 0").drop("__a", "__z", "__side", "__key", "__n")
    shapes = p.where("__n > 0").select("__side", "__n").distinct()
    # as many as there are lengths, twice
    listed = shapes.agg(F.collect_list(F.struct("__side", "__n"))).scalar()
    t = texts.where(F.col(text).isNotNull()).withColumn("__s", F.explode(listed)).where(F.length(text) >= F.col("__s.__n"))
    key = F.when(F.col("__s.__side"), F.substring(text, F.lit(1), F.col("__s.__n"))).otherwise(F.right(text, F.col("__s.__n")))
    keyed = t.select(*texts.columns, F.col("__s.__side").alias("__side"), F.col("__s.__n").alias("__n"), key.alias("__key"))
    found = p.where("__n > 0").join(keyed, ["__side", "__n", "__key"]).where(F.col(text).startswith(F.col("__a")) & F.col(text).endswith(F.col("__z")))
    found = found.select(*patterns.columns, *texts.columns)
    n = open_ones.limit(most_open + 1).count()
    if n > most_open:
        raise ValueError(f"more than {most_open} patterns begin and end with a wildcard")
    if not n:
        return found
    return found.unionByName(texts.where(F.col(text).isNotNull()).join(F.broadcast(open_ones), F.lit(True)).select(*patterns.columns, *texts.columns))
