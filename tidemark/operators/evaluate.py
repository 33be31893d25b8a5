"""Detector scores against labelled boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import running_max_from_below, running_totals
from tidemark.staging import stage

MARGIN_PX = 3.0


def most_hits(points: list[int], boxes_of: dict[int, list[int]]) -> set[int]:
    """The points that get a box of their own: as many as possible, the earlier in the list the better.

    Adding points in order of score and augmenting never drops one that already has a box, and whether one
    can be added does not depend on how the earlier ones were paired; so this is the best set at every cut.
    """
    holder: dict[int, int] = {}

    def place(point: int, tried: set[int]) -> bool:
        path = [(point, iter(boxes_of.get(point, ())))]
        via: list[int] = []
        while path:
            box = next((b for b in path[-1][1] if b not in tried), None)
            if box is None:
                path.pop()
                if via:
                    via.pop()
                continue
            tried.add(box)
            via.append(box)
            if box not in holder:
                for (p, _), b in zip(path, via):
                    holder[b] = p
                return True
            path.append((holder[box], iter(boxes_of.get(holder[box], ()))))
        return False

    return {p for p in points if place(p, set())}


def match_points(points: DataFrame, boxes: DataFrame, margin: float = MARGIN_PX) -> DataFrame:
    """points (image, id, row, col, score) with ``hit``: whether each is paired with a ship of its image.

    A point reaches a box (image, box_id, x0, y0, x1, y1) if it lies in it or within the margin of it. Images
    are solved one by one from the reaching pairs alone.
    """
    near = (
        F.col("col").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("row").between(F.col("y0") - margin, F.col("y1") + margin)
    )
    reach = points.join(boxes, "image").where(near).select("image", "id", "score", "box_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        boxes_of = group.sort_values("box_id").groupby("id")["box_id"].agg(list).to_dict()
        order = group.drop_duplicates("id").sort_values(["score", "id"], ascending=[False, True])["id"].tolist()
        return pd.DataFrame({"image": group["image"].iloc[0], "id": sorted(most_hits(order, boxes_of))})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    hits = reach.groupBy("image").applyInPandas(run, f"image {kinds['image']}, id {kinds['id']}").withColumn("hit", F.lit(True))
    return points.join(hits, ["image", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ratios(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision and recall, 1 without a denominator, and F1, 0 where both are 0."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _scores(row: DataFrame, ships: int) -> DataFrame:
    counted = row.select("threshold", F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), (F.lit(ships) - F.col("tp")).alias("false_negatives"))
    p, r, f = ratios(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives"))
    return counted.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(f, 4)})


def at_threshold(scored: DataFrame, ships: int, threshold: float) -> DataFrame:
    """One row of scores for points (score, hit) at or above the threshold."""
    kept = scored.where(F.col("score") >= threshold)
    return _scores(kept.agg(F.lit(float(threshold)).alias("threshold"), F.count(F.when(F.col("hit"), 1)).alias("tp"), F.count(F.when(~F.col("hit"), 1)).alias("fp")), ships)


def ranked(scored: DataFrame) -> DataFrame:
    """points (id, score, hit) with tp and fp down to each place; ties by id."""
    return running_totals(scored.withColumns({"__h": F.col("hit").cast("long"), "__m": (~F.col("hit")).cast("long")}), "score", "id", {"tp": "__h", "fp": "__m"}).drop("__h", "__m")


def best_f1(scored: DataFrame, ships: int) -> DataFrame:
    """One row of scores at the place of the ranking with the highest F1, the first of equals."""
    f1 = F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.lit(ships))
    top = ranked(scored).orderBy(F.desc(f1), F.desc("score"), "id").limit(1)
    return _scores(top.select(F.col("score").alias("threshold"), "tp", "fp"), ships)


def average_precision(scored: DataFrame, ships: int) -> DataFrame:
    """One row: the area under the precision-recall curve, each precision raised to the best at or below it."""
    rows = ranked(scored).withColumn("__p", F.col("tp") / (F.col("tp") + F.col("fp")))
    rows = running_max_from_below(rows, "score", "id", "__p", "__env")
    total = F.coalesce(F.sum(F.when(F.col("hit"), F.col("__env"))), F.lit(0.0))
    return rows.agg((total / F.lit(float(ships)) if ships else F.lit(0.0)).alias("average_precision"))


def benchmark(points: DataFrame, boxes: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per split of its scores at the threshold that is best on ``val``, with its average precision.

    ``splits`` is (image, split) with val, test, test_inshore; the other test images are test_offshore.
    """
    scored = stage(match_points(points, boxes), "scored")
    names = splits.where("split in ('val', 'test')").unionByName(
        splits.where("split = 'test'").join(splits.where("split = 'test_inshore'").select("image"), "image", "left_semi").withColumn("split", F.lit("test_inshore"))
    )
    offshore = splits.where("split = 'test'").join(splits.where("split = 'test_inshore'").select("image"), "image", "left_anti")
    names = names.unionByName(offshore.withColumn("split", F.lit("test_offshore")))
    part = lambda df, s: df.join(names.where(F.col("split") == s).select("image"), "image", "left_semi")
    threshold, out = None, None
    for split in ("val", "test", "test_inshore", "test_offshore"):
        ships = part(boxes, split).count()
        rows = part(scored, split)
        if threshold is None:
            best = best_f1(rows, ships).first()
            threshold = best["threshold"] if best else float("inf")
        row = at_threshold(rows, ships, threshold).crossJoin(average_precision(rows, ships)).withColumn("split", F.lit(split))
        out = row if out is None else out.unionByName(row)
    return out
