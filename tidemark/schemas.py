"""Column sets that operators end in, so a column's presence never depends on which stage ran."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _schema(columns: str) -> T.StructType:
    """From ``name type, ...``; unlike Spark's own parser this needs no session."""
    out = T.StructType()
    for column in columns.split(","):
        out = out.add(*column.split())
    return out


#: One row per report; ``ord`` is the order of ingestion.
AIS = _schema("mmsi string, t_us long, ord long, x double, y double, length_m double, speed_ms double")
SCENES = _schema(
    "scene string, t_us long, a double, b double, c double, d double, e double, f double, width long, height long, "
    "crs string, heading_deg double, incidence_deg double, shift_per_mps double"
)
FOUND = _schema("scene string, det_id long, row double, col double")
DECLARED = _schema(
    "scene string, mmsi string, length_m double, position_basis string, position_age_s double, position_span_s double, "
    "velocity_east_ms double, velocity_north_ms double, x double, y double"
)
#: What classification adds to detections, in order.
MATCH = _schema(
    "status string, mmsi string, length_m double, match_distance_m double, tolerance_m double, declarations_searched double, "
    "position_basis string, position_age_s double, position_span_s double, azimuth_shift_m double, acquired_at long"
)
RECEPTION = _schema("reception_p double, reception_basis string, reception_intervals double")
CONTEXT = _schema("distance_to_shore_m double, depth_m double, fishing_hours double, eez string")
#: Declarations after review: these first, then the rest.
REVIEWED = _schema(
    "mmsi string, status string, length_m double, detection long, match_distance_m double, nearest_detection_m double, "
    "position_basis string, position_age_s double, position_span_s double, azimuth_shift_m double, tolerance_m double, "
    "smallest_detectable_m double"
)
CELLS = _schema("x0 double, y0 double, x1 double, y1 double, reception_p double, intervals double, observed_s double")


def absent(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every column of ``schema`` that it lacks, as NULL of the declared type."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def ordered(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` first and cast, then the rest in their order."""
    first = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*first, *[c for c in df.columns if c not in schema.names])
