"""Joining totals back to rows whose keys may be hot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], count: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row per key, nulls equal) whose ``count`` is the key's rows.

    A key with more than one in ``hot_keys`` of all rows is joined by broadcast: there are fewer than
    ``hot_keys`` such keys whatever the data.  The others are shuffled, and none of them is hot.
    ``totals`` must be stored, since it is read three times.
    """
    everything = totals.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * hot_keys > F.lit(everything)
    named = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    small = F.broadcast(named.where(hot).select(*[f"_{k}" for k in keys]))  # fewer than hot_keys rows
    away = [f"_{k}" for k in keys]
    common = rows.join(small, match, "left_anti").join(named.where(~hot), match)
    return rows.join(F.broadcast(named.where(hot)), match).drop(*away).union(common.drop(*away))
