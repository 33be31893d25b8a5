"""AIS archives and vector layers: daily CSV exports, Parquet, GeoPackage and GeoJSON."""

from __future__ import annotations

import json
import sqlite3
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.geo import KNOT_MS, TransverseMercator
from tidemark.schemas import AIS, absent

#: The export's headers and ours.
DMA_COLUMNS = {"# Timestamp": "timestamp", "MMSI": "mmsi", "Latitude": "latitude", "Longitude": "longitude", "Length": "length_m", "SOG": "speed_knots"}
#: Tried in turn; the real export is day-first.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "dd/MM/yyyy HH:mm:ss")


def read_dma_csv(spark: SparkSession, path: str, crs: str, formats: tuple[str, ...] = TIME_FORMATS) -> DataFrame:
    """Reports of a daily export in the given UTM zone: mmsi, t_us, ord, x, y, and length_m, speed_ms if present.

    ``ord`` is the order of rows in files as Spark reads them. Times are UTC; a time that no format reads is NULL,
    and the cleaning counts it.
    """
    raw = spark.read.csv(path, header=True).withColumnsRenamed(DMA_COLUMNS)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    at = F.coalesce(*[F.try_to_timestamp("timestamp", F.lit(f)) for f in formats])
    x, y = TransverseMercator.of(crs).forward(number("longitude"), number("latitude"))
    columns = [F.col("mmsi"), F.unix_micros(at).alias("t_us"), F.monotonically_increasing_id().alias("ord"), x.alias("x"), y.alias("y")]
    if "length_m" in raw.columns:
        columns.append(number("length_m").alias("length_m"))
    if "speed_knots" in raw.columns:
        columns.append((number("speed_knots") * F.lit(KNOT_MS)).alias("speed_ms"))
    return raw.select(*columns)


def unread_times(spark: SparkSession, path: str, formats: tuple[str, ...] = TIME_FORMATS) -> DataFrame:
    """How many times of an export no format reads."""
    raw = spark.read.csv(path, header=True).withColumnsRenamed(DMA_COLUMNS)
    at = F.coalesce(*[F.try_to_timestamp("timestamp", F.lit(f)) for f in formats])
    return raw.agg(F.count(F.when(at.isNull() & F.col("timestamp").isNotNull(), 1)).alias("unread"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """An archive in this engine's columns; ``timestamp`` columns must carry a zone."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if "t_us" not in kinds:
        if kinds.get("timestamp") == "timestamp_ntz":
            raise TypeError("the archive's timestamps have no time zone; state one before reading it")
        df = df.withColumn("t_us", F.unix_micros("timestamp"))
    if "ord" not in kinds:
        df = df.withColumn("ord", F.monotonically_increasing_id())
    wanted = [n for n in AIS.names if n != "speed_ms" or "speed_ms" in df.columns]
    return absent(df, AIS).select(*wanted)


def wkb_points(wkb: bytes) -> list:
    """Polygons as [rings of (x, y)], or a point as (x, y)."""
    at = 0

    def take(form):
        nonlocal at
        out = struct.unpack_from(order + form, wkb, at)
        at += struct.calcsize(order + form)
        return out

    def geometry():
        nonlocal at, order
        order = "<" if wkb[at] else ">"
        at += 1
        (kind,) = take("I")
        wide = 2 + (kind & 0x80000000 > 0 or kind % 10000 // 1000 in (1, 3)) + (kind & 0x40000000 > 0 or kind % 10000 // 1000 in (2, 3))
        kind = (kind & 0xFFFF) % 1000
        point = lambda: take(f"{wide}d")[:2]
        if kind == 1:
            return point()
        if kind == 3:
            return [[[point() for _ in range(take("I")[0])] for _ in range(take("I")[0])]]
        if kind == 6:
            return [p for _ in range(take("I")[0]) for p in geometry()]
        raise ValueError(f"geometry type {kind} is not supported")

    order = "<"
    return geometry()


def gpkg_wkb(blob: bytes) -> bytes:
    """The WKB of a GeoPackage geometry, behind its header and envelope."""
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return blob[8 + envelope :]


def gpkg_layer(path: str, layer: str | None) -> tuple[str, str, str]:
    """(table, geometry column, crs) of a layer, the first if none is named."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        rows = con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchall()
        row = next(r for r in rows if layer in (None, r[0]))
        org = con.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (row[2],)).fetchone()
    return row[0], row[1], f"{org[0].upper()}:{org[1]}" if org else ""


class Slice(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class GeoPackageReader(DataSourceReader):
    """Point layers by slices of row id, one partition each."""

    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 200_000))
        self.table, self.geometry, self.crs = gpkg_layer(self.path, options.get("layer"))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            top = con.execute(f'select max(rowid) from "{self.table}"').fetchone()[0] or 0
        return [Slice(i, i + self.rows) for i in range(0, top + 1, self.rows)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            names = [r[1] for r in con.execute(f'pragma table_info("{self.table}")')]
            con.row_factory = sqlite3.Row
            for row in con.execute(f'select rowid as __rowid, * from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high)):
                place = wkb_points(gpkg_wkb(row[self.geometry])) if row[self.geometry] else (None, None)
                get = lambda n: row[n] if n in names else None  # noqa: B023, E731
                real = lambda n: None if get(n) is None else float(get(n))  # noqa: B023, E731
                yield (None if get("mmsi") is None else str(get("mmsi")), get("timestamp"), row["__rowid"], *place, real("length_m"), real("speed_ms"))


class GeoPackage(DataSource):
    @classmethod
    def name(cls):
        return "ais_geopackage"

    def schema(self):
        return "mmsi string, timestamp string, ord long, x double, y double, length_m double, speed_ms double"

    def reader(self, schema):
        return GeoPackageReader(self.options)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """An archive from a point layer with mmsi, timestamp, length_m and perhaps speed_ms."""
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("ais_geopackage")
    raw = (reader.option("layer", layer) if layer else reader).load(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[1] for r in con.execute(f'pragma table_info("{gpkg_layer(path, layer)[0]}")')]
    out = raw.withColumn("t_us", F.unix_micros(F.expr("try_cast(timestamp as timestamp)")))
    return out.select(*[n for n in AIS.names if n != "speed_ms" or "speed_ms" in names])


def write_geopackage(path: str, layer: str, rows: list[dict], crs_code: int = 25832) -> None:
    """A point layer of collected rows with x and y; for reports and fixtures, not for archives."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as con:
        con.executescript(
            "create table if not exists gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text);"
            "create table if not exists gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer);"
            "create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);"
            "pragma application_id = 0x47504B47;"
        )
        con.execute("insert or replace into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, '', '')", (f"EPSG:{crs_code}", crs_code, crs_code))
        con.execute("insert or replace into gpkg_contents values (?, 'features', ?, ?)", (layer, layer, crs_code))
        con.execute("insert or replace into gpkg_geometry_columns values (?, 'geom', 'POINT', ?, 0, 0)", (layer, crs_code))
        names = [n for n in (rows[0] if rows else {}) if n not in ("x", "y")]
        con.execute(f'drop table if exists "{layer}"')
        con.execute(f'create table "{layer}" (fid integer primary key, geom blob' + "".join(f', "{n}"' for n in names) + ")")
        for r in rows:
            blob = None if r["x"] is None else b"GP\0\1" + struct.pack("<i", crs_code) + struct.pack("<BIdd", 1, 1, r["x"], r["y"])
            con.execute(f'insert into "{layer}" values (null, ?' + ", ?" * len(names) + ")", (blob, *[r[n] for n in names]))


def read_land(path: str, crs: str, box: tuple[float, float, float, float] | None = None, buffer_m: float = 0.0) -> list:
    """Land polygons near ``box`` (in ``crs``) from GeoJSON in degrees or in ``crs``, or from a GeoPackage layer.

    Only polygons whose bounds come within the buffer and a metre of the box are kept: the rest cannot reach it.
    """
    if str(path).lower().endswith(".gpkg"):
        table, column, own = gpkg_layer(path, None)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            polygons = [p for (g,) in con.execute(f'select "{column}" from "{table}"') if g for p in wkb_points(gpkg_wkb(g))]
    else:
        data = json.loads(Path(path).read_text())
        own = (data.get("crs") or {}).get("properties", {}).get("name", "EPSG:4326").replace("urn:ogc:def:crs:", "").replace("::", ":")
        own = "EPSG:4326" if own.endswith("CRS84") else own
        shapes = [f["geometry"] for f in data["features"]] if data["type"] == "FeatureCollection" else [data.get("geometry", data)]
        polygons = [p for s in shapes if s for p in ([s["coordinates"]] if s["type"] == "Polygon" else s["coordinates"])]
    if not own:
        raise ValueError(f"{path} has no CRS; the land cannot be placed on the scene")
    if own == "EPSG:4326":
        to = TransverseMercator.of(crs)
        polygons = [[[to.forward_of(p[0], p[1]) for p in ring] for ring in rings] for rings in polygons]
    elif own.upper() != crs.upper():
        raise ValueError(f"{path} is in {own}; only degrees and the scenes' own {crs} are read")
    if box is None:
        return polygons
    reach = max(buffer_m, 0.0) + 1.0

    def near(rings):
        xs, ys = zip(*[(p[0], p[1]) for r in rings for p in r])
        return min(xs) <= box[2] + reach and max(xs) >= box[0] - reach and min(ys) <= box[3] + reach and max(ys) >= box[1] - reach

    return [p for p in polygons if p and p[0] and near(p)]
