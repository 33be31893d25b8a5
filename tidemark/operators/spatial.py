"""Distance joins over grid cells: within a tolerance, and nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import distance
from tidemark.staging import stage


def cell(coordinate: Column, size: float) -> Column:
    """Index of the grid cell; floor, so it holds for negative coordinates."""
    return F.floor(coordinate / F.lit(float(size))).cast("long")


def _around(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    df = df.withColumn("__cx", F.explode(F.transform(steps, lambda i: cell(F.col(x), size) + i)))
    return df.withColumn("__cy", F.explode(F.transform(steps, lambda i: cell(F.col(y), size) + i)))


def within_distance(left: DataFrame, right: DataFrame, tolerance_m: float, on: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Pairs at most ``tolerance_m`` apart, 0 included, with ``distance_m``; both sides bring x and y.

    Cells are as wide as the tolerance: the right side is put into the nine cells around each of its points
    and meets the left side by equality, so the plan is a hash or sort-merge join, never a nested loop. Other
    column names must differ; the right side's x and y come back as x_right and y_right.
    """
    size = max(float(tolerance_m), 1e-3)
    here = left.withColumns({"__cx": cell(F.col("x"), size), "__cy": cell(F.col("y"), size)})
    there = _around(right.withColumnsRenamed({"x": "x_right", "y": "y_right"}), size, "x_right", "y_right")
    met = here.join(there, [*on, "__cx", "__cy"]).drop("__cx", "__cy")
    met = met.withColumn("distance_m", distance(F.col("x"), F.col("y"), F.col("x_right"), F.col("y_right")))
    return met.where(F.col("distance_m") <= float(tolerance_m))


def nearest(left: DataFrame, right: DataFrame, keys: tuple[str, ...], on: tuple[str, ...] = ("scene",), reach_m: float = 5000.0) -> DataFrame:
    """``keys`` of the left side and nearest_m: the distance to the closest right point of equal ``on``, else NULL.

    Points search the grid out to twice the mean spacing of the right side, ``reach_m`` at most; those that find nothing
    search again four times as far, until all have found theirs, so no point is compared with points far beyond its
    nearest. Points without a place find none.
    """
    place = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    places, own = right.where(place).select(*on, "x", "y"), left.select(*dict.fromkeys([*on, *keys]), "x", "y")
    far = own.where(place)
    far = far.join(places.select(*on).distinct(), list(on), "left_semi") if on else far
    found, reach = None, min(float(reach_m), 2 * _spacing(places, on))
    while True:
        got = stage(within_distance(far, places, reach, on).groupBy(*keys).agg(F.min("distance_m").alias("nearest_m")), "nearest")
        found = got if found is None else found.unionByName(got)
        far = stage(far.join(got.select(*keys), list(keys), "left_anti"), "without-nearest")
        if not far.limit(1).count() or not on and not places.limit(1).count():
            return own.select(*keys).join(found, list(keys), "left")
        reach *= 4


def _spacing(places: DataFrame, on: tuple[str, ...]) -> float:
    """Side of the square that one of the places has on average, at least 1 m; the boxes around those of equal ``on`` count."""
    span = lambda c: F.max(c) - F.min(c)
    boxes = places.groupBy(*on).agg((span("x") * span("y")).alias("area"), F.count("*").alias("n"))
    share = boxes.agg(F.try_divide(F.sum("area"), F.sum("n"))).first()[0]
    return max(share or 0.0, 1.0) ** 0.5


def anywhere_within(points: DataFrame, register: DataFrame, tolerance_m: float, key: tuple[str, ...]) -> DataFrame:
    """The distinct ``key`` of points that lie within ``tolerance_m`` of any registered x, y."""
    met = within_distance(points.select(*key, "x", "y"), register.select("x", "y"), tolerance_m, on=())
    return met.select(*key).distinct()
