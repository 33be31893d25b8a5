"""The archive as a stream: cleaning, reception and positions while reports arrive. Batch and stream agree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ais import MAX_PLAUSIBLE_SPEED_MS
from tidemark.operators.spatial import cell
from tidemark.staging import Staged


def clean_stream(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports (with ``ts``) that pass the row-wise rules, each (mmsi, ts) once within the watermark.

    Of duplicates *a* row is kept, not provably the first: that is all a watermark can promise.
    """
    known = reports.where("mmsi is not null and ts is not null and x is not null and y is not null")
    if "speed_ms" in reports.columns:
        known = known.where(F.col("speed_ms").isNull() | (F.col("speed_ms") <= MAX_PLAUSIBLE_SPEED_MS))
    return known.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])


LEG = "mmsi string, gap_s double, mid_x double, mid_y double"


def legs_stream(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Usable gaps between consecutive reports of a vessel; the state is its last report.

    Within a micro-batch a vessel's reports are sorted; a report older than the last one seen is left out, so
    the stream equals the batch if each vessel's reports arrive in order over micro-batches.
    """
    state = "t_us long, x double, y double"

    def run(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last = held.get if held.exists else None
        rows = pd.concat(list(frames)).sort_values(["t_us", "ord"])
        out = []
        for r in rows.itertuples():
            if last is not None:
                if r.t_us < last[0]:
                    continue
                gap = (r.t_us - last[0]) / 1e6
                way = ((r.x - last[1]) ** 2 + (r.y - last[2]) ** 2) ** 0.5
                if gap > 0 and way / gap <= MAX_PLAUSIBLE_SPEED_MS:
                    out.append((key[0], gap, (r.x + last[1]) / 2, (r.y + last[2]) / 2))
            last = (int(r.t_us), float(r.x), float(r.y))
        if last is not None:
            held.update(last)
        yield pd.DataFrame(out, columns=["mmsi", "gap_s", "mid_x", "mid_y"])

    needed = reports.select("mmsi", "t_us", "ord", "x", "y")
    return needed.groupBy("mmsi").applyInPandasWithState(run, LEG, state, "append", "NoTimeout")


class CellTotals:
    """Sums per cell that micro-batches add to; sums are associative, so any split of the stream gives the same model."""

    def __init__(self, max_gap_s: float, cell_m: float):
        self.max_gap_s, self.cell_m = max_gap_s, cell_m
        self.now: Staged | None = None
        self.seen = -1

    def __call__(self, legs: DataFrame, batch: int) -> None:
        """For ``foreachBatch``; a batch that is handed over again changes nothing."""
        if batch <= self.seen:
            return
        covered = F.least(F.col("gap_s"), F.lit(2.0 * self.max_gap_s))
        own = legs.select(cell(F.col("mid_x"), self.cell_m).alias("ix"), cell(F.col("mid_y"), self.cell_m).alias("iy"), covered.alias("covered_s"), F.col("gap_s").alias("total_s"), F.lit(1.0).alias("intervals"))
        both = own if self.now is None else own.unionByName(self.now.df)
        merged = Staged(both.groupBy("ix", "iy").agg(*[F.sum(c).alias(c) for c in ("covered_s", "total_s", "intervals")]), "cell-totals")
        if self.now is not None:
            self.now.drop()
        self.now, self.seen = merged, batch

    def cells(self) -> DataFrame:
        """The model's cells: each total lent to the nine cells around it."""
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        spread = self.now.df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
        spread = spread.withColumns({"ix": F.col("ix") + F.col("dx"), "iy": F.col("iy") + F.col("dy")})
        return spread.groupBy("ix", "iy").agg(*[F.sum(c).alias(c) for c in ("covered_s", "total_s", "intervals")])


def latest_stream(reports: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The last report of each vessel in each event-time window, once the watermark has passed it."""
    last = F.max_by(F.struct("t_us", "x", "y", "length_m"), F.struct("t_us", "ord")).alias("last")
    return reports.withWatermark("ts", late).groupBy(F.window("ts", window), "mmsi").agg(last)
