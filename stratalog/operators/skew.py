"""Per-key results where a few keys hold most rows: aggregation in two salted stages.

1. The heavy keys, those with about 1/HEAVY of the rows or more, are read off a sketch of frequent items: each task sends one sketch, and
   no key is counted for it. The sketch overrates a key by at most 1/HEAVY_ERROR of the rows and misses none that
   is heavier, so there are at most about HEAVY such keys whatever the input (they may be broadcast), and any other key
   holds less than that share. A key in or out of the set by mistake changes how rows are spread, never a result.
2. Rows of a heavy key get a salt below the number of fair shares of a task that it holds: a third of all rows under one key is spread over
   a third of the tasks. The salt is the hash of the value that is counted distinct (or of the whole row), not a random
   number, so that a task that is run again after a loss yields the same rows.
3. Partial results are made per (key, salt) and merged per key. Distinct counts add up, as each value has one salt.

Where distinct values are counted, rows of heavy keys are shuffled under a number instead of the key, and a light key's rows go to
one task, where all its distinct counts are made at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, parts

#: Keys with 1/HEAVY of the rows are heavy; the sketch follows TRACKED times as many.
HEAVY, TRACKED = 1000, 16


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy: int = HEAVY) -> DataFrame:
    """The keys that hold at least about 1/heavy of the rows: the key, ``n_rows`` (the sketch's estimate) and ``of`` (rows with a key).
    Null keys are none; keys of types that JSON does not carry exactly, as timestamps, are never heavy. The few rows are written out, so that all
    uses of them agree."""
    rows = df.select(*keys).dropna()
    top = F.call_function("approx_top_k", F.to_json(F.struct(*keys)), F.lit(2 * heavy), F.lit(TRACKED * heavy))
    found = rows.agg(top.alias("top"), F.count(F.lit(1)).alias("of")).select("of", F.explode("top").alias("t"))
    key = F.from_json("t.item", rows.schema)
    return cut(found.where(F.col("t.count") * heavy >= F.col("of")).select(key.alias("k"), F.col("t.count").alias("n_rows"), "of").select("k.*", "n_rows", "of"))


def salted(df: DataFrame, keys: Sequence[str], heavy: int = HEAVY, salts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``__h`` (a number for a heavy key, null for others) and ``__salts`` (how many salts it gets), and the heavy keys with
    ``__h``. salts: for all rows together; as many as tasks, unless given."""
    salts = salts or parts(df)
    # keys whose numbers clash count as light
    h = heavy_keys(df, keys, heavy).withColumn("__h", F.xxhash64(*keys))
    h = h.join(F.broadcast(h.groupBy("__h").agg(F.count(F.lit(1)).alias("__same")).where("__same = 1")), "__h", "left_semi")
    h = h.select(*keys, "__h", F.ceil(F.col("n_rows") * salts / F.col("of")).cast("int").alias("__salts"))
    return df.join(F.broadcast(h), list(keys), "left"), h.drop("__salts")


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    distinct: Sequence[str] = (),
    heavy: int = HEAVY,
    salts: int | None = None,
) -> DataFrame:
    """Per-key results of two stages: ``partial`` (aggregates over rows) per salt, ``merge`` (aggregates over the names in
    ``partial``, which give one value back as it is and pass over nulls, as sum, min and max do) per key. distinct: columns whose
    distinct non-null values are counted, each as ``n_`` and its name. Rows with a null key have no result. An empty table gives an empty one.
    """
    rows = df.dropna(subset=list(keys))
    marked, h = salted(rows, keys, heavy, salts)
    salt_of = lambda *on: F.pmod(F.xxhash64(*on), F.col("__salts"))
    first = [c.alias(n) for n, c in partial.items()]
    second = [c.alias(n) for n, c in merge.items()]
    if not distinct:
        stage = marked.withColumn("__salt", F.coalesce(salt_of(*rows.columns), F.lit(0))).groupBy(*keys, "__salt").agg(*first)
        return stage.groupBy(*keys).agg(*second)
    counted = [f"n_{c}" for c in distinct]
    light = marked.where(F.col("__h").isNull()).repartition(*keys)
    for j, c in enumerate(distinct):
        # the first row of each value; all of a key's rows are in one task already, so this sorts and shuffles nothing
        nth = F.row_number().over(W.partitionBy(*keys, c).orderBy(F.lit(0)))
        light = light.withColumn(f"__f{j}", (F.col(c).isNotNull() & (nth == 1)).cast("long"))
    light = light.groupBy(*keys).agg(*first, *[F.sum(f"__f{j}").alias(n) for j, n in enumerate(counted)])
    # a row of a heavy key becomes one for each column of which values are counted; the other results hang on the first of them
    kinds = [F.struct(F.lit(i).alias("__k"), salt_of(c).alias("__salt"), *[F.col(x).alias(f"__v{j}") if j == i else F.lit(None).cast(df.schema[x].dataType).alias(f"__v{j}") for j, x in enumerate(distinct)]) for i, c in enumerate(distinct)]
    values = [f"__v{j}" for j in range(len(distinct))]
    spread = marked.where(F.col("__h").isNotNull()).withColumn("__x", F.explode(F.array(*kinds))).select("__h", *rows.columns, "__x.*")
    per_value = spread.groupBy("__h", "__k", "__salt", *values).agg(*first).withColumns({n: F.when(F.col("__k") == 0, F.col(n)) for n in partial})
    per_salt = per_value.groupBy("__h", "__k", "__salt").agg(*second, *[F.count(v).alias(n) for v, n in zip(values, counted)])
    merged = per_salt.groupBy("__h").agg(*second, *[F.sum(n).alias(n) for n in counted])
    names = [*merge, *counted]
    return light.select(*keys, *names).unionByName(merged.join(F.broadcast(h), "__h").select(*keys, *names))


def hot_join(rows: DataFrame, side: DataFrame, on: Sequence[str], weight: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key, no nulls) by ``how`` (inner or left_semi) without a hot task.

    weight: a column of ``side`` with the number of rows each key holds. Keys with at least 1/heavy of the sum of all weights are
    joined by broadcast; there are at most ``heavy`` of them. Each other key holds less than that share, and goes by a
    shuffle. The weight is not part of the result. ``side`` is read several times, so it should be a written table.
    """
    is_hot = (F.col(weight) > 0) & (F.col(weight) * heavy >= side.agg(F.sum(weight)).scalar())
    top, rest = side.where(is_hot).drop(weight), side.where(~is_hot).drop(weight)
    marked = rows.join(F.broadcast(top.select(*on, F.lit(True).alias("__hot"))), list(on), "left")
    hot = marked.where("__hot").drop("__hot").join(F.broadcast(top), list(on), how)
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(rest, list(on), how)
    return hot.unionByName(cold)
