"""Applying a feed of inserts, updates and deletes in commit order.

Each change has a *place* in the one order of the log. A change may be delivered any number of times, in any order, and
may be sent again later under a new sequence number that names the place it stands for. The operator

1. assembles transactions and finds where each one commits (its last place);
2. holds back what lies behind a gap: the *watermark* is the last place up to which every place is known or declared
   closed, and a transaction is visible only if it commits at or before the watermark;
3. folds the visible changes of every key on its own, all keys in parallel.

The fold needs no sorting and no list per key. With I, U, D the last visible places at which a key was inserted, updated
and deleted, the key is there exactly if I exists and no delete lies behind it, since updates and deletes of what is not
there have no effect; the last change with an effect is then the greater of I and U. Three maxima are combined before the
shuffle, so a key that holds a third of all changes costs one row per task, and repeated changes change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .order import number_rows, with_previous

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def change_place(seq: Column, payload: Column, field: str = "replay_of") -> Column:
    """The place of a change: what ``payload`` (JSON) names as the place it stands for, as number or text, else ``seq``.
    A payload that is null, empty or no JSON names nothing."""
    named = F.get_json_object(payload, f"$.{field}")
    return F.coalesce(F.trim(named).try_cast("bigint"), seq)


def watermark(places: DataFrame, place: str = "place", start: int = 1, closed: DataFrame | None = None, closed_ranges: DataFrame | None = None) -> DataFrame:
    """One row ``watermark``: the last place w so that start..w are all in ``places`` or in ``closed`` (a table with the
    same column of places known to be lost). ``start - 1`` if the first one is missing, null places do not count.
    closed_ranges: ranges of lost places as ``gaps`` gives them; none of them may hold a known place.

    Every place with no successor ends a run; the watermark is the first such end at or after ``start``. Found by one
    anti-join on the place, so no task ever sees the whole order.
    """
    p = places.select(F.col(place).cast("long").alias("__p")).where(F.col("__p") >= start)
    if closed is not None:
        p = p.unionByName(closed.select(F.col(place).cast("long").alias("__p")).where(F.col("__p") >= start))
    p = p.distinct()
    # start - 1 stands for the state before the first change
    base = places.sparkSession.range(start - 1, start).select(F.col("id").alias("__p"))
    p = p.unionByName(base).withColumn("__from", F.col("__p"))
    if closed_ranges is not None:
        p = p.unionByName(closed_ranges.where(F.col("gap_to") >= start).select(F.col("gap_to").alias("__p"), F.greatest("gap_from", F.lit(start)).alias("__from")))
    ends = p.join(p.select((F.col("__from") - 1).alias("__p")), "__p", "left_anti")
    return ends.agg(F.min("__p").alias("watermark"))


def gaps(places: DataFrame, place: str = "place") -> DataFrame:
    """The missing ranges between the known places: ``gap_from``, ``gap_to``, inclusive. Null places do not count."""
    p = with_previous(places.select(F.col(place).cast("long").alias("__p")).dropna().distinct(), ["__p"], "__p", "__was")
    return p.where(F.col("__p") > F.col("__was") + 1).select((F.col("__was") + 1).alias("gap_from"), (F.col("__p") - 1).alias("gap_to"))


def held_watermark(places: DataFrame, hold: int, place: str = "place") -> DataFrame:
    """One row ``watermark`` of a log that grows, as an extension: a gap is waited for until ``hold`` places lie behind it, then it is
    closed. The last place before the first gap that is still waited for, or the last place; null for an empty log. What comes later
    than ``hold`` places is missing from the state there; ``watermark`` waits for every place."""
    last = places.agg(F.max(F.col(place).cast("long")).alias("last"))
    open_gaps = gaps(places, place).where(F.col("gap_to") > last.scalar() - hold)
    return open_gaps.agg(F.min("gap_from").alias("g")).select(F.coalesce(F.col("g") - 1, last.scalar()).alias("watermark"))


def transactions(changes: DataFrame, place: str = "place", tx: str = "tx") -> DataFrame:
    """``tx``, ``first_place``, ``commit_place``, ``n_changes`` (distinct places). A change with a null or empty tx is a
    transaction of its own and has no row here."""
    t = changes.where(F.col(tx).isNotNull() & (F.col(tx) != "")).select(F.col(tx).alias("tx"), F.col(place).alias("__p"))
    return t.distinct().groupBy("tx").agg(F.min("__p").alias("first_place"), F.max("__p").alias("commit_place"), F.count(F.lit(1)).alias("n_changes"))


def judged_transactions(log: DataFrame, upto: Column, place: str = "place", tx: str = "tx") -> DataFrame:
    """transactions() of all rows of a log, with ``complete`` (each place from the first to the last is in the log) and ``visible`` (it ends
    at or before ``upto``). Places are numbered once, so that between two of them the missing ones are counted without a range join."""
    nth = number_rows(log.select(F.col(place).alias("__p")).dropna().distinct(), ["__p"], "__rank")
    t = transactions(log.dropna(subset=[place]), place, tx)
    t = t.join(nth.select(F.col("__p").alias("first_place"), F.col("__rank").alias("__a")), "first_place").join(nth.select(F.col("__p").alias("commit_place"), F.col("__rank").alias("__z")), "commit_place")
    whole = F.col("__z") - F.col("__a") == F.col("commit_place") - F.col("first_place")
    return t.select("tx", "first_place", "commit_place", "n_changes", whole.alias("complete"), (F.col("commit_place") <= upto).alias("visible"))


def visible(changes: DataFrame, upto: Column, place: str = "place", tx: str = "tx", log: DataFrame | None = None) -> DataFrame:
    """The changes whose whole transaction lies at or before ``upto``. Only transactions that reach over ``upto`` are joined
    back; they are the open ones. log: all rows of the log, with place and tx, if ``changes`` are only some of them."""
    open_tx = transactions(changes if log is None else log, place, tx).where((F.col("commit_place") > upto) & (F.col("first_place") <= upto)).select(F.col("tx").alias(tx))
    before = changes.where(F.col(place) <= upto)
    # changes without a transaction, often the most, take no part in the join
    in_tx = F.coalesce(F.col(tx), F.lit("")) != ""
    return before.where(~in_tx).unionByName(before.where(in_tx).join(open_tx, tx, "left_anti").select(*changes.columns))


def fold_changes(changes: DataFrame, keys: list[str], place: str = "place", op: str = "op") -> DataFrame:
    """The keys that exist after all of ``changes``: key columns and ``last_place``. Rows with a null key, place or operation
    are no change. See the module's head for why three maxima are enough."""
    at = lambda kind: F.max(F.when(F.col(op) == kind, F.col(place)))
    s = changes.dropna(subset=[*keys, place, op]).groupBy(*keys).agg(at(INSERT).alias("__i"), at(UPDATE).alias("__u"), at(DELETE).alias("__d"))
    alive = F.col("__i").isNotNull() & (F.col("__d").isNull() | (F.col("__d") < F.col("__i")))
    return s.where(alive).select(*keys, F.greatest("__i", "__u").alias("last_place"))


def replay(changes: DataFrame, keys: list[str], closed_log: bool = False, place: str = "place", op: str = "op", tx: str = "tx", start: int = 1, closed: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """State of the table behind a feed of changes: the keys that exist, with ``last_place``.

    closed_log: the feed has ended, so what is missing never comes: it begins at its first place and each of its gaps is declared
    closed. Its watermark comes out as the last place, and no transaction reaches beyond it. Otherwise the state is the one at the contiguous watermark. Empty feeds
    give an empty table. log: all rows of the log, with place and tx, if ``changes`` are only some of them; gaps and ends of
    transactions are those of the log.
    """
    log = changes if log is None else log
    lost = None
    if closed_log:
        first = log.agg(F.min(F.col(place).cast("long"))).first()[0]
        start, closed, lost = 1 if first is None else first, None, cut(gaps(log, place))
    # one number, found once, so that the scan of the changes is held against a literal
    upto = F.lit(watermark(log, place, start, closed, lost).first()[0]).cast("long")
    return fold_changes(visible(changes, upto, place, tx, log), keys, place, op)
