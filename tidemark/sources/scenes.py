"""Scenes on disk: ``scene.json`` beside ``image.npy`` or a GeoTIFF, read as metadata or as tiles.

Tiles come from a data source with one partition per tile, so a task reads its own window only. The folders
must be on a file system that every executor mounts.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.schemas import SCENES
from tidemark.sources.geotiff import GeoTiff

TILES = (
    "scene string, row0 int, col0 int, row1 int, col1 int, core_row0 int, core_col0 int, core_row1 int, core_col1 int, dtype string, data binary, "
    "a double, b double, c double, d double, e double, f double"
)


def open_image(folder: str | Path, meta: dict):
    path = Path(folder) / meta.get("image", "image.npy")
    return GeoTiff(path, meta.get("band", 1)) if path.suffix.lower() in (".tif", ".tiff") else np.load(path, mmap_mode="r")


def scene_row(folder: str | Path, shift_per_mps: float = 113.0) -> tuple[dict, object]:
    """The scene's row and its image; a GeoTIFF's own georeference stands where ``scene.json`` gives none."""
    meta = json.loads((Path(folder) / "scene.json").read_text())
    image = open_image(folder, meta)
    transform = meta.get("transform") or getattr(image, "transform", None)
    crs = meta.get("crs") or getattr(image, "crs", None)
    if transform is None or crs is None:
        raise ValueError(f"{folder}: neither scene.json nor the image says where the pixels are")
    at = datetime.fromisoformat(meta["acquired_at"])
    if at.tzinfo is None:
        raise ValueError(f"{folder}: acquired_at needs a time zone")
    row = dict(zip("abcdef", map(float, transform))) | {
        "scene": meta["id"],
        "t_us": micros(at),
        "height": int(image.shape[0]),
        "width": int(image.shape[1]),
        "crs": crs,
        "heading_deg": float(meta["heading_deg"]),
        "incidence_deg": float(meta["incidence_deg"]),
        "shift_per_mps": float(shift_per_mps),
    }
    return row, image


def micros(at: datetime) -> int:
    gone = at.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gone.days * 86400 + gone.seconds) * 1_000_000 + gone.microseconds


def read_scenes(spark: SparkSession, folders: list[str], shift_per_mps: float = 113.0) -> DataFrame:
    """The scenes table; one small row each, from the driver."""
    rows = [scene_row(f, shift_per_mps)[0] for f in folders]
    return spark.createDataFrame([tuple(r[n] for n in SCENES.names) for r in rows], SCENES)


def write_scene(folder: str | Path, row: dict, image: np.ndarray) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    np.save(folder / "image.npy", np.asarray(image))
    at = datetime.fromtimestamp(row["t_us"] / 1e6, timezone.utc)
    meta = {"id": row["scene"], "transform": [row[k] for k in "abcdef"], "crs": row["crs"], "acquired_at": at.isoformat(), "heading_deg": row["heading_deg"], "incidence_deg": row["incidence_deg"]}
    (folder / "scene.json").write_text(json.dumps(meta, indent=2))


class TilePartition(InputPartition):
    def __init__(self, folder, window):
        self.folder, self.window = folder, window


class TileReader(DataSourceReader):
    def __init__(self, options):
        self.folders = [f for f in options["path"].split(",") if f]
        self.tile, self.overlap = int(options.get("tile_px", 128)), int(options.get("overlap_px", 32))
        if self.tile and self.overlap * 2 >= self.tile:
            raise ValueError("overlap_px must be less than half of tile_px")

    def partitions(self):
        out = []
        for folder in self.folders:
            row, _ = scene_row(folder)
            height, width = row["height"], row["width"]
            if not self.tile:
                out.append(TilePartition(folder, (0, 0, height, width, 0, 0, height, width)))
                continue
            step = self.tile - 2 * self.overlap
            for r in range(0, height, step):
                for c in range(0, width, step):
                    r1, c1 = min(r + step, height), min(c + step, width)
                    window = (max(r - self.overlap, 0), max(c - self.overlap, 0), min(r1 + self.overlap, height), min(c1 + self.overlap, width))
                    out.append(TilePartition(folder, (*window, r, c, r1, c1)))
        return out

    def read(self, partition):
        row, image = scene_row(partition.folder)
        r0, c0, r1, c1 = partition.window[:4]
        data = np.ascontiguousarray(np.asarray(image[r0:r1, c0:c1]))
        yield (row["scene"], *partition.window, data.dtype.str, data.tobytes(), *(row[k] for k in "abcdef"))


class SceneTiles(DataSource):
    """``spark.read.format("scene_tiles").option("tile_px", 128).load(folders, comma-separated)``; tile_px 0 is whole images."""

    @classmethod
    def name(cls):
        return "scene_tiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return TileReader(self.options)


def read_tiles(spark: SparkSession, folders: list[str], tile_px: int = 128, overlap_px: int = 32) -> DataFrame:
    spark.dataSource.register(SceneTiles)
    return spark.read.format("scene_tiles").option("tile_px", tile_px).option("overlap_px", overlap_px).load(",".join(folders))
