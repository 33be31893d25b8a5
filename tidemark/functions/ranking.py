"""Running totals over a ranking that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _slots(df: DataFrame, score: str, slots: int) -> DataFrame:
    """``__slot`` 0.. from the highest scores down, by approximate quantiles; their number is fixed."""
    bounds = sorted(set(df.approxQuantile(score, [i / slots for i in range(1, slots)], 0.001)), reverse=True)
    above = F.lit(0)
    for i, b in enumerate(bounds, 1):
        above = F.when(F.col(score) < F.lit(b), F.lit(i)).otherwise(above)
    return df.withColumn("__slot", above)


def running_totals(df: DataFrame, score: str, tie: str, sums: dict[str, str], slots: int = 64) -> DataFrame:
    """Totals of ``sums`` (new name -> column) down the ranking by score, ties by ``tie``.

    Each slot is summed on its own; the totals of the slots before it, one row a slot, are broadcast.
    """
    df = _slots(df, score, slots)
    here = Window.partitionBy("__slot").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    whole = df.groupBy("__slot").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("__slot", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = df.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}).join(F.broadcast(offsets), "__slot")
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])


def running_max_from_below(df: DataFrame, score: str, tie: str, value: str, name: str) -> DataFrame:
    """The largest ``value`` at or below each place of the ranking; ``df`` comes from ``running_totals``."""
    here = Window.partitionBy("__slot").orderBy(F.desc(score), tie).rowsBetween(0, Window.unboundedFollowing)
    whole = df.groupBy("__slot").agg(F.max(value).alias("__top"))
    below = Window.orderBy("__slot").rowsBetween(1, Window.unboundedFollowing)
    later = whole.select("__slot", F.max("__top").over(below).alias("__later"))
    return df.withColumn(name, F.max(value).over(here)).join(F.broadcast(later), "__slot").withColumn(name, F.greatest(name, "__later")).drop("__later")
