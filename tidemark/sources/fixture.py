"""The synthetic scene: seven targets, ten vessels, forty-one reports, one story each."""

from __future__ import annotations

from datetime import datetime, timezone
from math import cos, radians, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.geo import radar_shift_of
from tidemark.schemas import AIS, SCENES
from tidemark.sources.scenes import micros, write_scene

# The scene.
SCENE = dict(
    scene="synthetic-scene-1", t_us=micros(datetime(2026, 8, 9, 5, 31, 24, tzinfo=timezone.utc)), a=5.0, b=0.0, c=499900.0, d=0.0, e=-5.0, f=6101100.0,
    width=320, height=320, crs="EPSG:25832", heading_deg=350.0, incidence_deg=35.0, shift_per_mps=113.0,
)
# Name, x, y and brightness of each target.
TARGETS = {
    "stationary_match": (500180.0, 6100870.0, 0.9),
    "interpolated_match": (500420.0, 6100120.0, 0.75),
    "azimuth_corrected_match": (500980.0, 6100640.0, 0.65),
    "simple_match": (500760.0, 6099800.0, 0.85),
    "dark_vessel": (500935.0, 6099900.0, 0.6),
    "faint_trawler": (501290.0, 6100950.0, 0.35),
    "faint_dark": (500245.0, 6099700.0, 0.4),
}


def image() -> np.ndarray:
    out = np.zeros((SCENE["height"], SCENE["width"]), np.float32)
    for x, y, v in TARGETS.values():
        r, c = int((SCENE["f"] - y) / 5), int((x - SCENE["c"]) / 5)
        out[r : r + 2, c : c + 2] = v
    return out


def reports() -> list[tuple]:
    """(mmsi, minutes from the acquisition, length, x, y) in archive order."""
    fe, fn = sin(radians(SCENE["heading_deg"])), cos(radians(SCENE["heading_deg"]))
    at = lambda name, dx=0.0, dy=0.0: (TARGETS[name][0] + dx, TARGETS[name][1] + dy)
    east, north = radar_shift_of(8.0, 0.0, SCENE["heading_deg"], SCENE["incidence_deg"])
    moving = at("azimuth_corrected_match", -east, -north)
    lane = lambda x, y, speed, minutes: (x + speed * minutes * 60 * fe, y + speed * minutes * 60 * fn)
    rows = [
        ("219000001", 0, 50.0, at("stationary_match", 110, -85)),
        ("219000002", -5, 80.0, at("interpolated_match", -900 * fe, -900 * fn)),
        ("219000002", 5, 80.0, at("interpolated_match", 900 * fe, 900 * fn)),
        ("219000003", -10, 140.0, (moving[0] - 4800.0, moving[1])),
        ("219000003", 0, 140.0, moving),
        ("219000004", 0, 60.0, at("simple_match", 70 * sin(radians(60)), 70 * cos(radians(60)))),
        *[("219100001", m, 90.0, lane(501180.0, 6099900.0, 0.5, m)) for m in range(-20, 21, 2)],
        *[("219100002", m, 30.0, lane(500520.0, 6099700.0, 0.005, m)) for m in range(-270, 271, 60)],
        ("219100003", 0, 12.0, (500500.0, 6100500.0)),
        ("219100004", 0, 60.0, (501800.0, 6100300.0)),
        ("219000005", -14, 24.0, at("faint_trawler", -36, -48)),
        ("219000006", -25, 110.0, at("dark_vessel", 192, -256)),
    ]
    return [(m, t, n, *xy) for m, t, n, xy in rows]


def ais(spark: SparkSession) -> DataFrame:
    rows = [(m, SCENE["t_us"] + t * 60_000_000, i, x, y, n, None) for i, (m, t, n, x, y) in enumerate(reports())]
    return spark.createDataFrame(rows, AIS).drop("speed_ms")


def scenes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(SCENE[n] for n in SCENES.names)], SCENES)


def write(folder: str) -> str:
    """The scene's folder for the tile source; the archive goes where the caller wants it."""
    write_scene(folder, SCENE, image())
    return folder
