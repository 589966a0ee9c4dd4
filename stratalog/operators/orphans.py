"""References to records that do not exist.

References are composite keys of which some columns may be null. Rows are grouped by their null mask;
each mask is anti-joined with the targets on its non-null columns only, under a declared match rule:

``simple``   a key with any null refers to nothing and is never an orphan;
``partial``  null columns match anything, an all-null key refers to nothing;
``full``     an all-null key refers to nothing, a partly null key is always an orphan.

References may also be held against the time they were made: a target counts only if it was there at the
referring row's own order (``target_order <= ref_order``).

Shape of the plan for each mask. The references are reduced to one row per key (count and least order, combined
before the shuffle, so a key that holds a third of all rows costs one row per task), joined with the targets reduced
to their first order, and only the keys with some orphan ("suspects") are kept. Suspects go back to the rows in two
ways: those that hold at least 1/HEAVY of the suspects' rows, of which there can be no more than HEAVY, by broadcast; the
others, each with less than that share, by a shuffle join.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Most keys that are sent by broadcast; any other key holds less than 1/HEAVY of the rows that are joined.
HEAVY = 1000
LEAST = -(1 << 63)


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    on: list[tuple[str, str]],
    match: str = "simple",
    ref_order: str | None = None,
    target_order: str | None = None,
    heavy: int = HEAVY,
    first: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` without a target, with all their columns.

    first: the name of a further column with the order at which a target came later, null if there never was one.

    on: pairs (column of refs, column of targets). A null ``ref_order`` is before every target, a null
    ``target_order`` is never reached, so both yield orphans. Repeated rows of ``refs`` are kept. Empty ``refs`` give an
    empty result, empty ``targets`` make every reference an orphan (but for keys that refer to nothing). Columns of
    ``targets`` that clash with those of ``refs`` do no harm: only the key and order columns are read, under own names.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match rule: {match}")
    if (ref_order is None) != (target_order is None):
        raise ValueError("ref_order and target_order go together")
    k = len(on)
    # the masks that occur, of 2^k at most
    there = {tuple(r[0]) for r in refs.select(F.array(*[F.col(r).isNotNull() for r, _ in on])).distinct().collect()} if k > 1 else {(True,)}
    out = [refs.where(F.lit(False)).withColumns({first: F.lit(None).cast("long")} if first else {})]
    for present in product((True, False), repeat=k):
        if present not in there:
            continue
        if not any(present) or (match == "simple" and not all(present)):
            continue
        here = reduce(lambda a, b: a & b, (F.col(r).isNotNull() if p else F.col(r).isNull() for p, (r, _) in zip(present, on)))
        rows = refs.where(here)
        if match == "full" and not all(present):
            out.append(rows.withColumn(first, F.lit(None).cast("long")) if first else rows)
            continue
        pairs = [p for have, p in zip(present, on) if have]
        out.append(_anti(rows, targets, pairs, ref_order, target_order, heavy, first))
    return reduce(DataFrame.unionByName, out)


def _anti(rows, targets, pairs, ref_order, target_order, heavy, first_name):
    keys = [f"__k{i}" for i in range(len(pairs))]
    at = F.coalesce(F.col(ref_order).cast("long"), F.lit(LEAST)) if ref_order else F.lit(0)
    first = F.min(F.col(target_order).cast("long")) if target_order else F.min(F.lit(0))
    keyed = rows.withColumns({n: F.col(r) for n, (r, _) in zip(keys, pairs)} | {"__at": at})
    need = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__least"))
    have = targets.select(*[F.col(t).alias(n) for n, (_, t) in zip(keys, pairs)], *([F.col(target_order)] if target_order else []))
    have = have.dropna(subset=keys).groupBy(*keys).agg(first.alias("__first"))
    suspects = cut(need.join(have, keys, "left").where(F.col("__first").isNull() | (F.col("__least") < F.col("__first"))).select(*keys, "__n", "__first"))
    # of counts that are at least 1/heavy of their sum there are at most ``heavy``
    is_hot = F.col("__n") * heavy >= suspects.agg(F.sum("__n")).scalar()
    top, rest = (suspects.where(c).select(*keys, "__first") for c in (is_hot, ~is_hot))
    flagged = keyed.join(F.broadcast(top.withColumn("__hit", F.lit(True)).withColumnRenamed("__first", "__f")), keys, "left")
    late = lambda c: F.col(c).isNull() | (F.col("__at") < F.col(c))
    out = lambda c: [*rows.columns, *([F.col(c).alias(first_name)] if first_name else [])]
    by_broadcast = flagged.where(F.col("__hit") & late("__f")).select(*out("__f"))
    by_shuffle = flagged.where(F.col("__hit").isNull()).drop("__hit", "__f").join(rest, keys, "inner").where(late("__first")).select(*out("__first"))
    return by_broadcast.unionByName(by_shuffle)


def orphan_report(refs: DataFrame, orphans: DataFrame, by: list[str]) -> DataFrame:
    """References and orphans per group of ``by``; groups without orphans are kept with 0. Repeated rows count once."""
    n = refs.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    o = orphans.select(*refs.columns).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    cond = reduce(lambda a, b: a & b, (n[c].eqNullSafe(o[c]) for c in by))
    return n.join(o, cond, "left").select(*[n[c] for c in by], "n_refs", F.coalesce("n_orphans", F.lit(0).cast("long")).alias("n_orphans"))
