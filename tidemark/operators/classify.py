"""Which detections a declaration explains, and which declarations a detection explains."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.assign import assign
from tidemark.operators.spatial import within_distance
from tidemark.schemas import MATCH, absent
from tidemark.staging import stage

MATCHED, DARK, UNSEARCHED = "matched", "dark", "unsearched"
STRUCTURE, SHADOWED = "structure", "shadowed"
STATUSES = (MATCHED, DARK, SHADOWED, STRUCTURE, UNSEARCHED)
CARRIED = ["length_m", "position_basis", "position_age_s", "position_span_s", "azimuth_shift_m"]


class Match(NamedTuple):
    """Both sides of one assignment."""

    detections: DataFrame
    declared: DataFrame


def candidates(detections: DataFrame, declared: DataFrame, tolerance_m: float) -> DataFrame:
    """(scene, det_id, mmsi, distance_m) of all pairs within the tolerance."""
    return within_distance(detections.select("scene", "det_id", "x", "y"), declared.select("scene", "mmsi", "x", "y"), tolerance_m).select(
        "scene", "det_id", "mmsi", "distance_m"
    )


def classify(detections: DataFrame, declared: DataFrame | None, tolerance_m: float, scenes: DataFrame | None = None) -> Match:
    """Detections (scene, det_id, x, y, ...) with status and evidence, declarations with what they explain.

    ``declared`` of None means no archive was searched: everything is ``unsearched``. An empty one was
    searched in vain: ``dark``, with no declarations searched.
    """
    base = detections.drop(*[n for n in MATCH.names if n in detections.columns])
    if scenes is not None:
        base = base.join(scenes.select("scene", F.col("t_us").alias("acquired_at")), "scene", "left")
    if declared is None:
        empty = absent(base.withColumn("status", F.lit(UNSEARCHED)), MATCH)
        none = detections.sparkSession.createDataFrame([], "scene string, mmsi string, length_m double, position_basis string, position_age_s double, position_span_s double, velocity_east_ms double, velocity_north_ms double, x double, y double, azimuth_shift_m double")
        return Match(_in_order(empty, detections), _explaining(none, None))
    pairs = stage(assign(candidates(base, declared, tolerance_m)), "pairs")  # both sides need them
    source = pairs.join(declared.select("scene", "mmsi", *CARRIED), ["scene", "mmsi"])
    searched = declared.groupBy("scene").agg(F.count("*").cast("double").alias("declarations_searched"))
    out = base.join(source.withColumnRenamed("distance_m", "match_distance_m"), ["scene", "det_id"], "left").join(searched, "scene", "left")
    out = out.withColumns(
        {
            "status": F.when(F.col("mmsi").isNotNull(), F.lit(MATCHED)).otherwise(F.lit(DARK)),
            "tolerance_m": F.lit(float(tolerance_m)),
            "declarations_searched": F.coalesce("declarations_searched", F.lit(0.0)),
        }
    )
    return Match(_in_order(absent(out, MATCH), detections), _explaining(declared, pairs))


def _in_order(out: DataFrame, detections: DataFrame) -> DataFrame:
    return out.select(*[c for c in detections.columns if c not in MATCH.names], *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH])


def _explaining(declared: DataFrame, pairs: DataFrame | None) -> DataFrame:
    if pairs is None:
        return declared.withColumns({"detection": F.lit(None).cast("long"), "match_distance_m": F.lit(None).cast("double")})
    found = pairs.select("scene", "mmsi", F.col("det_id").alias("detection"), F.col("distance_m").alias("match_distance_m"))
    return declared.join(found, ["scene", "mmsi"], "left")


def status_counts(rows: DataFrame, statuses: tuple[str, ...] = STATUSES, by: tuple[str, ...] = ()) -> DataFrame:
    """total and one count per status, zero where none."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses])
