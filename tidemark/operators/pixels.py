"""Image operators over pixel rows (image, r, c, v): for catalogued products that live in tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import components
from tidemark.sources.scenes import TILES


def tiling(height: int, width: int, tile_px: int, overlap_px: int, spark) -> DataFrame:
    """Tiles with windows row0..col1 and cores that partition the image exactly."""
    if overlap_px * 2 >= tile_px:
        raise ValueError("overlap_px must be less than half of tile_px")
    step = tile_px - 2 * overlap_px
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step)))
    cores = spark.range(1).select(starts(height).alias("core_row0")).withColumn("core_col0", starts(width))
    cores = cores.withColumns({"core_row1": F.least(F.col("core_row0") + step, F.lit(height)), "core_col1": F.least(F.col("core_col0") + step, F.lit(width))})
    return cores.select(
        F.greatest(F.col("core_row0") - overlap_px, F.lit(0)).alias("row0"),
        F.greatest(F.col("core_col0") - overlap_px, F.lit(0)).alias("col0"),
        F.least(F.col("core_row1") + overlap_px, F.lit(height)).alias("row1"),
        F.least(F.col("core_col1") + overlap_px, F.lit(width)).alias("col1"),
        "core_row0", "core_col0", "core_row1", "core_col1",
    )


def tiles_of(pixels: DataFrame, scenes: DataFrame, tile_px: int, overlap_px: int) -> DataFrame:
    """Pixel rows (scene, r, c, v) of scenes as the tiles that ``detect`` takes; pixels without a row read as 0.

    Each pixel goes to the tiles whose window holds it, so one shuffle gives a tile all of its pixels. Tiles
    without any pixel are left out: nothing is to be found in them.
    """
    if overlap_px * 2 >= tile_px:
        raise ValueError("overlap_px must be less than half of tile_px")
    step = tile_px - 2 * overlap_px
    at = lambda place: F.floor(place / F.lit(step)).cast("int")
    held = lambda c, n: F.explode(F.sequence(F.greatest(at(F.col(c) - overlap_px), F.lit(0)), F.least(at(F.col(c) + overlap_px), at(F.col(n) - 1))))
    placed = pixels.join(scenes.select("scene", "height", "width", F.array(*"abcdef").alias("frame")), "scene").where("r between 0 and height - 1 and c between 0 and width - 1")
    dealt = placed.withColumn("i", held("r", "height")).withColumn("j", held("c", "width"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        core = [int(one.i) * step, int(one.j) * step]
        ends = [min(core[0] + step, int(one.height)), min(core[1] + step, int(one.width))]
        low = [max(p - overlap_px, 0) for p in core]
        high = [min(p + overlap_px, int(n)) for p, n in zip(ends, (one.height, one.width))]
        window = np.zeros((high[0] - low[0], high[1] - low[1]))
        window[group["r"].to_numpy() - low[0], group["c"].to_numpy() - low[1]] = group["v"].fillna(0.0).to_numpy()
        row = (one.scene, *low, *high, *core, *ends, window.dtype.str, window.tobytes(), *map(float, one.frame))
        return pd.DataFrame([row], columns=[f.split()[0] for f in TILES.split(", ")])

    return dealt.groupBy("scene", "i", "j").applyInPandas(build, TILES)


def owns(row: Column, col: Column) -> Column:
    """Half-open on both axes, so every place has one owner."""
    return (row >= F.col("core_row0")) & (row < F.col("core_row1")) & (col >= F.col("core_col0")) & (col < F.col("core_col1"))


def cleaned(v: Column, nodata: float | None = None) -> Column:
    """No-data and non-finite values as 0, what every detector takes for outside the swath."""
    bad = F.isnan(v) | v.isNull() | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad if nodata is None else bad | (v == F.lit(float(nodata))), F.lit(0.0)).otherwise(v)


def box_sums(pixels: DataFrame, sizes: dict[str, int], columns: list[str]) -> DataFrame:
    """``pixels`` with ``<name>_<column>``: sums over centred boxes, zero beyond the edge.

    Rows first, columns second: two shuffles by image line, whatever the box.
    """
    across = lambda n: Window.partitionBy("image", "r").orderBy("c").rangeBetween(-(n // 2), n // 2)
    down = lambda n: Window.partitionBy("image", "c").orderBy("r").rangeBetween(-(n // 2), n // 2)
    half = pixels.withColumns({f"__{k}_{c}": F.sum(c).over(across(n)) for k, n in sizes.items() for c in columns})
    whole = half.withColumns({f"{k}_{c}": F.sum(f"__{k}_{c}").over(down(n)) for k, n in sizes.items() for c in columns})
    return whole.drop(*[f"__{k}_{c}" for k in sizes for c in columns])


def cfar_statistic(pixels: DataFrame, target: int = 3, guard: int = 41, background: int = 81) -> DataFrame:
    """(image, r, c, z): target mean over clutter in clutter deviations."""
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != 0)
    base = pixels.select("image", "r", "c", F.when(valid, F.col("v")).otherwise(F.lit(0.0)).alias("s"), valid.cast("double").alias("n")).withColumn("q", F.col("s") * F.col("s"))
    sums = box_sums(base, {"t": target, "g": guard, "b": background}, ["s", "n", "q"])
    ring = lambda c: F.col(f"b_{c}") - F.col(f"g_{c}")
    seen = F.greatest(ring("n"), F.lit(1.0))
    mean = ring("s") / seen
    spread = F.sqrt(F.greatest(ring("q") / seen - mean * mean, F.lit(0.0))) + F.lit(1e-3)
    here = F.col("t_s") / F.greatest("t_n", F.lit(1.0))
    enough = ring("n") >= F.lit(0.25 * (background**2 - guard**2))
    return sums.select("image", "r", "c", F.when((F.col("n") > 0) & enough, (here - mean) / spread).otherwise(F.lit(0.0)).alias("z"))


def regions(bright: DataFrame, width: int) -> DataFrame:
    """(image, r, c, region) for the pixels given: 4-connected regions, named by their first pixel in reading order.

    ``width`` is at least the widest image's; images must be numbered.
    """
    number = F.col("image") * F.lit(1 << 40) + F.col("r") * F.lit(width) + F.col("c")
    here = bright.select("image", "r", "c", number.alias("node"))
    beside = here.select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("node").alias("b"))
    steps = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    to = here.withColumn("s", steps).select("image", F.col("node").alias("a"), (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"))
    labels = components(to.join(beside, ["image", "r2", "c2"]).select("a", "b")).withColumnRenamed("node", "__node")
    return here.join(labels, F.col("node") == F.col("__node"), "left").select("image", "r", "c", F.coalesce("label", "node").alias("region"))


def bright_blobs(pixels: DataFrame, threshold: float, width: int) -> DataFrame:
    """(image, region, row, col, size): one detection at the mean of each bright region."""
    found = regions(pixels.where(F.col("v") >= threshold), width)
    return found.groupBy("image", "region").agg(F.avg("r").alias("row"), F.avg("c").alias("col"), F.count("*").alias("size"))


def cfar_blobs(z: DataFrame, floor: float, width: int, min_pixels: int = 2) -> DataFrame:
    """(image, region, row, col, score, size): centroids weighted by the excess over the floor."""
    above = z.where(F.col("z") >= floor)
    of = regions(above, width)
    weight = F.greatest(F.col("z") - F.lit(float(floor)), F.lit(0.0)) + F.lit(1e-6)
    rows = above.join(of, ["image", "r", "c"]).withColumn("w", weight)
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    found = rows.groupBy("image", "region").agg(mean("r").alias("row"), mean("c").alias("col"), F.max("z").alias("score"), F.count("*").alias("size"))
    return found.where(F.col("size") >= min_pixels)


def local_maxima(pixels: DataFrame, floor: float, radius: int = 2) -> DataFrame:
    """(image, r, c, v) of pixels at or above the floor that equal the maximum around them."""
    across = Window.partitionBy("image", "r").orderBy("c").rangeBetween(-radius, radius)
    down = Window.partitionBy("image", "c").orderBy("r").rangeBetween(-radius, radius)
    top = pixels.withColumn("__a", F.max("v").over(across)).withColumn("__m", F.max("__a").over(down))
    return top.where((F.col("v") == F.col("__m")) & (F.col("v") >= floor) & (F.col("v") != 0)).select("image", "r", "c", "v")


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """(image, r, c, grey): percentiles to 0..255, or the range where those coincide, or 0."""
    real = F.when(~F.isnan("v"), F.col("v"))
    per = pixels.groupBy("image").agg(F.percentile(real, F.array(F.lit(low), F.lit(high))).alias("p"), F.min(real).alias("lo"), F.max(real).alias("hi"))
    flat = F.col("p")[1] <= F.col("p")[0]
    per = per.select("image", F.when(flat, F.col("lo")).otherwise(F.col("p")[0]).alias("lo"), F.when(flat, F.col("hi")).otherwise(F.col("p")[1]).alias("hi"))
    scaled = (F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    grey = F.when(F.col("hi") > F.col("lo"), F.bround(scaled * 255)).otherwise(F.lit(0.0))
    return pixels.join(per, "image").select("image", "r", "c", grey.cast("int").alias("grey"))


def robust_z(pixels: DataFrame) -> DataFrame:
    """(image, r, c, z, valid): deviations from the image's median in robust units, clipped and over 10."""
    ok = (F.col("v") != 0) & ~F.isnan("v")
    own = F.when(ok, F.col("v"))
    middle = pixels.groupBy("image").agg(F.median(own).alias("med"), F.count(own).alias("n"), F.stddev_pop(own).alias("sd"))
    with_middle = pixels.join(middle, "image")
    mad = with_middle.groupBy("image").agg(F.median(F.abs(F.when(ok, F.col("v")) - F.col("med"))).alias("mad"))
    rows = with_middle.join(mad, "image")
    robust = F.lit(1.4826) * F.col("mad")
    spread = F.when(robust > 1e-6, robust).otherwise(F.col("sd") + F.lit(1e-6))
    z = F.least(F.greatest((F.col("v") - F.col("med")) / spread, F.lit(-4.0)), F.lit(40.0)) / F.lit(10.0)
    return rows.select("image", "r", "c", F.when(ok & (F.col("n") >= 16), z).otherwise(F.lit(0.0)).alias("z"), F.coalesce(ok, F.lit(False)).alias("valid"))


def heatmap(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """(image, r, c, heat) of the pixels that boxes (image, x0, y0, x1, y1) warm: Gaussian bumps with peak 1."""
    mid = boxes.select(
        "image",
        F.floor((F.col("y0") + F.col("y1")) / 2).cast("int").alias("mr"),
        F.floor((F.col("x0") + F.col("x1")) / 2).cast("int").alias("mc"),
        F.least(F.greatest(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(6.0), F.lit(1.0)), F.lit(4.0)).alias("sigma"),
    ).where(F.col("mr").between(0, height - 1) & F.col("mc").between(0, width - 1))
    mid = mid.withColumn("reach", F.floor(3 * F.col("sigma")).cast("int") + 1)
    span = lambda m, n: F.explode(F.sequence(F.greatest(F.col(m) - F.col("reach"), F.lit(0)), F.least(F.col(m) + F.col("reach"), F.lit(n - 1))))
    rows = mid.withColumn("r", span("mr", height)).withColumn("c", span("mc", width))
    d2 = (F.col("r") - F.col("mr")) * (F.col("r") - F.col("mr")) + (F.col("c") - F.col("mc")) * (F.col("c") - F.col("mc"))
    bump = F.exp(-d2 / (2 * F.col("sigma") * F.col("sigma")))
    return rows.groupBy("image", "r", "c").agg(F.max(bump).alias("heat"))
