"""Hygiene of labelled boxes, and audits of the splits they come in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import stage

VALIDATION_SCENES = ("05", "10")
SUSPICIOUS_PX, NEAR_IOU, NODATA_SHARE = 300, 0.7, 0.5
#: The audit's rules, in the order in which they run.
SWAPPED, CLIPPED, TINY, REPEATED, TWICE, LONG = (
    "box corners swapped (fixed)", "box past the image edge (clipped)", "box under one pixel (dropped)", "exact duplicate box (dropped)",
    "same ship boxed twice, IoU > 0.7 (merged)", "box longer than 300 px (kept)",
)
BOX_RULES = (SWAPPED, CLIPPED, TINY, REPEATED, TWICE, LONG)


def iou(a, b) -> float:
    across = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return across / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - across)


def mark_boxes(boxes: DataFrame, size: int = 800, iou_above: float = NEAR_IOU) -> DataFrame:
    """boxes (image, box_id, x0, y0, x1, y1) repaired, with ``rules`` they met and ``dropped``: the rule that drops them.

    Greedy removal of boxes that overlap an earlier kept one depends on their order by box_id, so it runs image by
    image, on the boxes that overlap any other so far; those are found by a join, and all others stay in the JVM.
    """
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    fixed = boxes.withColumn("__swap", (F.col("x0") > F.col("x1")) | (F.col("y0") > F.col("y1")))
    fixed = fixed.select("image", "box_id", "__swap", *[f(a, b).alias(n) for f, a, b, n in ((lo, "x0", "x1", "x0"), (lo, "y0", "y1", "y0"), (hi, "x0", "x1", "x1"), (hi, "y0", "y1", "y1"))])
    corners = ("x0", "y0", "x1", "y1")
    cut = {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(size))) for c in corners}
    fixed = fixed.withColumn("__cut", F.greatest(*[(cut[c] != F.col(c)).cast("int") for c in corners]) > 0).withColumns(cut)
    fixed = fixed.withColumn("__tiny", (F.col("x1") - F.col("x0") < 1) | (F.col("y1") - F.col("y0") < 1))
    same = Window.partitionBy("image", "__tiny", *[F.bround(c, 1) for c in corners]).orderBy("box_id")
    fixed = fixed.withColumn("__again", ~F.col("__tiny") & (F.row_number().over(same) > 1))
    fixed = fixed.withColumn("__many", F.count(F.when(~F.col("__tiny") & ~F.col("__again"), 1)).over(Window.partitionBy("image")) > 1)

    def overlaps(group: pd.DataFrame) -> pd.DataFrame:
        kept, twice = [], []
        for box in group.sort_values("box_id").itertuples():
            corner = (box.x0, box.y0, box.x1, box.y1)
            if all(iou(corner, k) <= iou_above for k in kept):
                kept.append(corner)
            else:
                twice.append(box.box_id)
        return pd.DataFrame({"image": group["image"].iloc[0], "box_id": pd.array(twice, "int64")})

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    crowded = stage(fixed.where("__many and not __tiny and not __again").select("image", "box_id", *corners), "boxes")
    other = crowded.select(*[F.col(c).alias(f"__{c}") for c in ("image", "box_id", *corners)])
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(f"{b}1", f"__{b}1") - F.greatest(f"{a}0", f"__{a}0"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    shared = side("x", "x") * side("y", "y")
    clash = (F.col("image") == F.col("__image")) & (F.col("box_id") < F.col("__box_id")) & (shared > F.lit(float(iou_above)) * (area("") + area("__") - shared) * (1 - 1e-9))
    clashing = crowded.join(other, clash).select("image", F.explode(F.array("box_id", "__box_id")).alias("box_id")).distinct()
    twice = crowded.join(clashing, ["image", "box_id"], "left_semi").groupBy("image").applyInPandas(overlaps, f"image {kinds['image']}, box_id long").withColumn("__twice", F.lit(True))
    out = fixed.join(twice, ["image", "box_id"], "left").withColumn("__twice", F.coalesce("__twice", F.lit(False)))
    dropped = F.when(F.col("__tiny"), F.lit(TINY)).when(F.col("__again"), F.lit(REPEATED)).when(F.col("__twice"), F.lit(TWICE))
    too_long = dropped.isNull() & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > SUSPICIOUS_PX)
    rules = F.filter(
        F.array(F.when(F.col("__swap"), F.lit(SWAPPED)), F.when(F.col("__cut"), F.lit(CLIPPED)), dropped, F.when(too_long, F.lit(LONG))), lambda r: r.isNotNull()
    )
    return out.select("image", "box_id", *corners, rules.alias("rules"), dropped.alias("dropped"))


def clean_boxes(marked: DataFrame) -> DataFrame:
    return marked.where("dropped is null").select("image", "box_id", "x0", "y0", "x1", "y1")


def audit(marked: DataFrame) -> DataFrame:
    """(rule, n, examples): how often each rule was met, and its first five images."""
    each = marked.select("image", F.explode("rules").alias("rule"))
    counts = each.groupBy("rule").agg(F.count("*").alias("n"))
    first = each.distinct().withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("image"))).where("k <= 5")
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list("image")).alias("examples"))
    order = F.array_position(F.array(*[F.lit(r) for r in BOX_RULES]), F.col("rule"))
    return counts.join(shown, "rule").select(order.alias("ordinal"), "rule", "n", "examples")


def audit_line(row) -> str:
    shown = ", ".join(map(str, row["examples"]))
    return f"  {row['rule']}: {row['n']}" + (f"  (e.g. {shown})" if shown else "")


def scene_of(name: str = "image"):
    return F.split_part(F.col(name), F.lit("_"), F.lit(1))


def centres(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"row": (F.col("y0") + F.col("y1")) / 2, "col": (F.col("x0") + F.col("x1")) / 2})


def split_train(listed: DataFrame, validation: tuple[str, ...] = VALIDATION_SCENES) -> DataFrame:
    """Official training names (image) as train and val, carved out by scene."""
    return listed.withColumn("split", F.when(scene_of().isin(*validation), F.lit("val")).otherwise(F.lit("train")))


def audit_splits(train: DataFrame, test: DataFrame, inshore: DataFrame, offshore: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(ordinal, rule, n) for each defect that spans splits; every input is (image)."""
    scenes = lambda df: df.select(scene_of().alias("image")).distinct()
    both = inshore.select("image").union(offshore.select("image")).distinct()
    t = test.select("image").distinct()
    found = [
        ("sub-image in both train and test", train.select("image").intersect(t)),
        ("scene in both train and test", scenes(train).intersect(scenes(test))),
        ("inshore + offshore does not equal test", both.subtract(t).union(t.subtract(both))),
        ("image on disk in no split", on_disk.select("image").distinct().subtract(train.select("image").union(t))),
    ]
    out = None
    for i, (rule, rows) in enumerate(found, 1):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(i).alias("ordinal"), F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def nodata_share(pixels: DataFrame) -> DataFrame:
    """(image, nodata, mostly_outside) of pixel rows (image, v)."""
    share = F.avg((F.col("v") == 0).cast("double"))
    return pixels.groupBy("image").agg(share.alias("nodata")).withColumn("mostly_outside", F.col("nodata") >= NODATA_SHARE)
