"""Where every vessel was at an acquisition's instant, and where the radar drew it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import radar_shift
from tidemark.schemas import DECLARED, ordered

INTERPOLATED, NEAREST = "interpolated", "nearest"
DAY_US = 86_400_000_000


def _report() -> Column:
    return F.struct("t_us", "x", "y", "length_m")


def track_ends(ais: DataFrame) -> DataFrame:
    """Per vessel: first and last report, velocity over its last two reports, first ``ord`` and the number of reports.

    The top two by time are pruned map-side before the shuffle; no list of a vessel's reports is built.
    """
    seen = ais.where("mmsi is not null and t_us is not null")
    late = F.row_number().over(Window.partitionBy("mmsi").orderBy(F.desc("t_us"), F.desc("ord")))
    two = seen.withColumn("__late", late).where("__late <= 2")
    two = two.groupBy("mmsi").agg(
        F.max(F.when(F.col("__late") == 1, _report())).alias("last"), F.max(F.when(F.col("__late") == 2, _report())).alias("prior")
    )
    passed = (F.col("last.t_us") - F.col("prior.t_us")) / F.lit(1e6)
    speed = lambda c: F.when(passed > 0, (F.col(f"last.{c}") - F.col(f"prior.{c}")) / passed)
    two = two.select("mmsi", "last", speed("x").alias("tail_east"), speed("y").alias("tail_north"))
    start = seen.groupBy("mmsi").agg(F.min_by(_report(), F.struct("t_us", "ord")).alias("first"), F.min("ord").alias("first_ord"), F.count("*").alias("reports"))
    return start.join(two, "mmsi")


def positions_at(ais: DataFrame, scenes: DataFrame, max_gap_s: float, many: bool = False) -> DataFrame:
    """One declared position per scene and vessel that is bracketed, or whose nearest end is at most ``max_gap_s`` off.

    A report at the instant counts as before it. A bracket is interpolated however wide it is; otherwise the
    track's nearer end stands, with the velocity of its last two reports. The length is the last report's.

    The default is for a few scenes: it broadcasts them and aggregates every report once per scene. ``many``
    instead cuts each track into the stretches between reports and finds the scenes in each by an equality join
    on days, so the archive is shuffled once however many scenes there are; Spark sizes that join itself.
    """
    ends = track_ends(ais)
    seen = ais.where("mmsi is not null and t_us is not null")
    brackets = _brackets_by_stretch(seen, scenes) if many else _brackets_by_scene(seen, scenes)
    instants = scenes.select("scene", F.col("t_us").alias("at"))
    if many:
        near = F.when(F.col("at") < F.col("first.t_us"), F.col("first.t_us") - F.col("at")).when(F.col("at") >= F.col("last.t_us"), F.col("at") - F.col("last.t_us"))
        gap_us = int(max_gap_s * 1e6)
        reach = [(F.col("first.t_us") - gap_us, F.col("first.t_us")), (F.col("last.t_us"), F.col("last.t_us") + gap_us)]
        days = F.array_union(*[F.sequence(F.floor(a / F.lit(DAY_US)), F.floor(b / F.lit(DAY_US))) for a, b in reach])
        dated = instants.withColumn("__day", F.floor(F.col("at") / F.lit(DAY_US)))
        alone = ends.withColumn("__day", F.explode(days)).join(dated, "__day").where(near <= F.lit(gap_us)).withColumns({"left": F.lit(None).cast(brackets.schema["left"].dataType), "right": F.lit(None).cast(brackets.schema["left"].dataType)})
        held = brackets.join(ends, "mmsi").join(instants, "scene")
        cols = ["scene", "mmsi", "at", "left", "right", "first", "last", "tail_east", "tail_north", "first_ord"]
        both = held.select(*cols).unionByName(alone.select(*cols))
    else:
        both = brackets.join(ends, "mmsi").join(instants, "scene")
    held = F.col("left").isNotNull() & F.col("right").isNotNull()
    nearest = F.when(F.col("last.t_us") <= F.col("at"), F.col("last")).otherwise(F.col("first"))
    both = both.withColumns({"__held": held, "__near": nearest})
    age = F.abs(F.col("at") - F.col("__near.t_us")) / F.lit(1e6)
    span = (F.col("right.t_us") - F.col("left.t_us")) / F.lit(1e6)
    part = ((F.col("at") - F.col("left.t_us")) / F.lit(1e6)) / span
    place = lambda c: F.when(F.col("__held"), F.col(f"left.{c}") + part * (F.col(f"right.{c}") - F.col(f"left.{c}"))).otherwise(F.col(f"__near.{c}"))
    speed = lambda c, tail: F.when(F.col("__held"), (F.col(f"right.{c}") - F.col(f"left.{c}")) / span).otherwise(F.col(tail))
    placed = both.where(F.col("__held") | (age <= max_gap_s))
    out = placed.select(
        "scene",
        "mmsi",
        F.col("last.length_m").alias("length_m"),
        F.when(F.col("__held"), F.lit(INTERPOLATED)).otherwise(F.lit(NEAREST)).alias("position_basis"),
        F.when(F.col("__held"), F.lit(0.0)).otherwise(age).alias("position_age_s"),
        F.when(F.col("__held"), span).alias("position_span_s"),
        speed("x", "tail_east").alias("velocity_east_ms"),
        speed("y", "tail_north").alias("velocity_north_ms"),
        place("x").alias("x"),
        place("y").alias("y"),
        "first_ord",
    )
    return ordered(out, DECLARED)


def _brackets_by_scene(seen: DataFrame, scenes: DataFrame) -> DataFrame:
    instants = F.broadcast(scenes.select("scene", F.col("t_us").alias("__at")))
    order = F.struct("t_us", "ord")
    before = F.col("t_us") <= F.col("__at")
    left = F.max_by(F.when(before, _report()), F.when(before, order)).alias("left")
    right = F.min_by(F.when(~before, _report()), F.when(~before, order)).alias("right")
    return seen.crossJoin(instants).groupBy("scene", "mmsi").agg(left, right)


def _brackets_by_stretch(seen: DataFrame, scenes: DataFrame) -> DataFrame:
    order = Window.partitionBy("mmsi").orderBy("t_us", "ord")
    legs = seen.select("mmsi", _report().alias("left"), F.lead(_report()).over(order).alias("right")).where("right is not null and right.t_us > left.t_us")
    day = lambda c: F.floor(F.col(c) / F.lit(DAY_US))
    legs = legs.withColumn("__day", F.explode(F.sequence(day("left.t_us"), day("right.t_us"))))
    instants = scenes.select("scene", F.col("t_us").alias("__at"), day("t_us").alias("__day"))
    return legs.join(instants, "__day").where("left.t_us <= __at and __at < right.t_us").select("scene", "mmsi", "left", "right")


def drawn_by_radar(declared: DataFrame, scenes: DataFrame | None) -> DataFrame:
    """Declared positions where the radar draws them, with azimuth_shift_m; without geometry they stay, shift NULL.

    ``scenes`` brings heading_deg, incidence_deg and shift_per_mps. Unknown velocity is not rest: such a
    vessel stays put and its shift is NULL.
    """
    if scenes is None:
        return declared.withColumn("azimuth_shift_m", F.lit(None).cast("double"))
    known = scenes.select("scene", "heading_deg", "incidence_deg", "shift_per_mps")
    east, north = radar_shift(F.col("velocity_east_ms"), F.col("velocity_north_ms"), F.col("heading_deg"), F.col("incidence_deg"), F.col("shift_per_mps"))
    moved = declared.join(known, "scene", "left").withColumns({"__e": east, "__n": north})
    shift = F.sqrt(F.col("__e") * F.col("__e") + F.col("__n") * F.col("__n"))
    moved = moved.withColumns({"azimuth_shift_m": shift, "x": F.col("x") + F.coalesce("__e", F.lit(0.0)), "y": F.col("y") + F.coalesce("__n", F.lit(0.0))})
    return moved.select(*declared.columns, "azimuth_shift_m")
