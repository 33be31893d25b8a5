"""Run configurations from YAML, with the defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from tidemark.operators.detect import Detector, Tiling, tiling_for
from tidemark.plans.fusion import Params


@dataclass(frozen=True)
class Geometry:
    heading_deg: float
    incidence_deg: float
    shift_per_mps: float = 113.0


@dataclass(frozen=True)
class RunConfig:
    scene_dir: str
    tolerance_m: float
    ais_path: str | None = None
    max_gap_minutes: float = 10.0
    tile_px: int | None = None
    overlap_px: int | None = None
    detector: str = "stub"
    detector_threshold: float | None = None
    detector_weights: str | None = None
    output_path: str = "outputs/detections"
    geometry: Geometry | None = None
    reception_cell_m: float = 1000.0
    reception_floor: float = 0.0
    reception_min_intervals: int = 5
    smallest_detectable_m: float | None = 20.0
    land_path: str | None = None
    land_buffer_m: float = 0.0

    def tiling(self, detector: Detector) -> Tiling:
        return tiling_for(detector, self.tile_px, self.overlap_px)

    def params(self) -> Params:
        return Params(
            tolerance_m=self.tolerance_m,
            max_gap_s=self.max_gap_minutes * 60,
            apply_azimuth=self.geometry is not None,
            reception_cell_m=self.reception_cell_m,
            reception_min_intervals=self.reception_min_intervals,
            reception_floor=self.reception_floor,
            smallest_detectable_m=self.smallest_detectable_m,
            land_buffer_m=self.land_buffer_m,
        )


def parse(raw: dict) -> RunConfig:
    """A missing entry takes its default; an explicit null turns ``smallest_detectable_m`` off and means missing elsewhere."""
    known = {f.name: f for f in fields(RunConfig)}
    given = {k: x for k, x in raw.items() if k in known and (x is not None or k == "smallest_detectable_m")}
    if given.get("geometry"):
        given["geometry"] = Geometry(**{f.name: float(given["geometry"][f.name]) for f in fields(Geometry) if f.name in given["geometry"]})
    for name in ("tolerance_m", "max_gap_minutes", "detector_threshold", "reception_cell_m", "reception_floor", "land_buffer_m", "smallest_detectable_m"):
        if given.get(name) is not None:
            given[name] = float(given[name])
    if given.get("detector", "stub") == "stub":
        given.setdefault("detector_threshold", 0.5)
    return RunConfig(**given)


def load(path: str | Path) -> RunConfig:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text()))
