"""Sources, sinks, the payload, the bundle, the commands and the stream."""

import base64
import json
import struct
import threading
import urllib.error
import urllib.request
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import raster
from tidemark.operators import boxes, reception
from tidemark.operators.detect import BrightPixels, Cfar, crops, detect
from tidemark.plans import bundle, commands, payload
from tidemark.plans.fusion import Params
from tidemark.plans.payload import Request, Viewer
from tidemark.sources import archives, config, fixture, labels
from tidemark.sources.geotiff import GeoTiff, joined_planes, unpack_bits, unpack_lzw, unpack_zstd
from tidemark.sources.scenes import read_scenes, read_tiles, scene_row, write_scene


def tiff(path, image, tile=None, compress=False, nodata=None, bands=1):
    """A little-endian GeoTIFF for tests: strips of 7 rows or square tiles, one or more interleaved bands."""
    height, width = image.shape
    data = np.repeat(image[..., None], bands, axis=2) * np.arange(1, bands + 1, dtype=image.dtype)
    blocks = []
    if tile:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                b = np.zeros((tile, tile, bands), image.dtype)
                part = data[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b.tobytes())
    else:
        blocks = [data[r : r + 7].tobytes() for r in range(0, height, 7)]
    blocks = [zlib.compress(b) if compress else b for b in blocks]
    kind = {"f": 3, "u": 1, "i": 2}[image.dtype.kind]
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [image.dtype.itemsize * 8]), 259: ("H", [8 if compress else 1]), 277: ("H", [bands]), 339: ("H", [kind])}
    names = (324, 325) if tile else (273, 279)
    tags |= {322: ("I", [tile]), 323: ("I", [tile])} if tile else {278: ("I", [7])}
    tags |= {33550: ("d", [10.0, 10.0, 0.0]), 33922: ("d", [0.0, 0, 0, 500000, 6100000, 0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 25832])}
    if nodata is not None:
        tags[42113] = ("s", [str(nodata).encode() + b"\0"])
    offset, offsets = 8, []
    for b in blocks:
        offsets.append(offset)
        offset += len(b)
    tags |= {names[0]: ("I", offsets), names[1]: ("I", [len(b) for b in blocks])}
    extra, entries = b"", b""
    start = offset + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        form, values = tags[tag]
        raw = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        count = len(raw) if form == "s" else len(values)
        entries += struct.pack("<HHI", tag, {"I": 4, "H": 3, "d": 12, "s": 2}[form], count)
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", start + len(extra))
            extra += raw
    path.write_bytes(b"II*\0" + struct.pack("<I", offset) + b"".join(blocks) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra)


def pack_lzw(data: bytes) -> bytes:
    """The plain encoder: greedy longest known word, table emptied before codes get wider than 12 bits."""
    bits, known, width, word = "", {bytes([i]): i for i in range(256)}, 9, b""
    bits += format(256, "09b")
    free = 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in known:
            word = longer
            continue
        bits += format(known[word], f"0{width}b")
        known[longer], free, word = free, free + 1, bytes([byte])
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free == 4094:
            bits += format(known[word], f"0{width}b") + format(256, f"0{width}b")
            known, free, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if word:
        bits += format(known[word], f"0{width}b")
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_codecs_and_predictors_of_geotiff(tmp_path):
    R = np.random.default_rng(5)
    for n in (0, 1, 300, 5000, 40000):
        for data in (R.integers(0, 256, n, np.uint8).tobytes(), R.integers(0, 3, n, np.uint8).tobytes(), b"a" * n):
            assert unpack_lzw(pack_lzw(data)) == data
    with pytest.raises(ValueError):
        unpack_lzw(int("100000000" + "001100001" + "111111111" + "00000", 2).to_bytes(4, "big"))
    zstandard = pytest.importorskip("zstandard")
    assert unpack_zstd(zstandard.compress(b"abc" * 99)) == b"abc" * 99
    image = (R.random((6, 11, 2)) * 1000 - 300).astype("<f4")
    planes = image.astype(">f4").reshape(6, -1).view(np.uint8).reshape(6, -1, 4).transpose(0, 2, 1).reshape(6, -1, 2)
    steps = np.diff(planes.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
    assert joined_planes(steps.reshape(-1), 6, 2, image.dtype) == image.tobytes()


@pytest.mark.parametrize("tile,compress,dtype,bands", [(None, False, "<f4", 1), (16, True, "<f4", 1), (None, True, "<u2", 3), (16, False, "<u1", 2)])
def test_geotiff_windows(tmp_path, tile, compress, dtype, bands):
    image = (np.random.default_rng(1).random((45, 38)) * 50).astype(dtype)
    image[3, 4] = 7
    if image.dtype.kind == "f":
        image[5, 6] = np.nan
    tiff(tmp_path / "a.tif", image, tile, compress, 7, bands)
    want = np.nan_to_num(np.where(image * bands == 7, 0, image * bands)).astype(image.dtype)
    source = GeoTiff(tmp_path / "a.tif", bands)
    assert source.shape == (45, 38) and source.transform == (10.0, 0.0, 500000.0, 0.0, -10.0, 6100000.0) and source.crs == "EPSG:25832"
    for window in ((0, 45, 0, 38), (3, 20, 5, 37), (14, 17, 15, 17), (9, 9, 0, 3)):
        assert (source[window[0] : window[1], window[2] : window[3]] == want[window[0] : window[1], window[2] : window[3]]).all()
    with pytest.raises(ValueError):
        source[::2, :]
    with pytest.raises(ValueError):
        GeoTiff(tmp_path / "a.tif", bands + 1)
    assert unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])


def test_scene_from_geotiff_and_tiles(spark, tmp_path):
    image = np.zeros((150, 130), np.float32)
    image[60:62, 63:65] = 0.9
    tiff(tmp_path / "s.tif", image, 16, True)
    (tmp_path / "scene.json").write_text(json.dumps({"id": "T", "image": "s.tif", "acquired_at": "2026-01-01T00:00:00Z", "heading_deg": 0, "incidence_deg": 30}))
    row, _ = scene_row(tmp_path)
    assert (row["crs"], row["a"], row["width"]) == ("EPSG:25832", 10.0, 130)
    tiles = read_tiles(spark, [str(tmp_path)], 64, 16)
    assert tiles.count() == 25
    found = detect(tiles, BrightPixels(0.5)).collect()
    assert [(r.row, r.col) for r in found] == [(60.5, 63.5)]
    write_scene(tmp_path / "copy", row, image)
    assert scene_row(tmp_path / "copy")[0] == row


def test_tiled_cfar_equals_the_whole_and_crops(spark, tmp_path):
    rng = np.random.default_rng(2)
    sea = (0.01 + rng.gamma(4, 0.05, (300, 280))).astype(np.float32)
    for r, c in ((20, 30), (140, 141), (290, 270)):
        sea[r : r + 3, c : c + 3] += 8
    write_scene(tmp_path, fixture.SCENE | {"height": 300, "width": 280}, sea)
    cfar = Cfar(6.0)
    whole = sorted((round(float(r), 3), round(float(c), 3)) for r, c, _ in cfar.scored(sea))
    tiled = detect(read_tiles(spark, [str(tmp_path)], 256, 64), cfar)
    assert sorted((round(r.row, 3), round(r.col, 3)) for r in tiled.collect()) == whole and len(whole) >= 3
    one = read_tiles(spark, [str(tmp_path)], 0)
    for r in crops(one, tiled, 16, 4).join(tiled, "det_id").collect():
        assert (np.frombuffer(r.crop, "<f4").reshape(r.side, r.side) == raster.crop(sea, r.row, r.col, 16, 4)).all()
    corner = raster.crop(sea, 0, 0, 4, 2)
    assert corner.shape == (8, 8) and (corner[:4] == 0).all() and (corner[4:, 4:] == sea[:4, :4]).all()


def test_masked_pixels_are_not_searched(spark, tmp_path):
    folder = fixture.write(str(tmp_path / "scene"))
    land = [[[(500100, 6100800), (500300, 6100800), (500300, 6100950), (500100, 6100950)]]]
    n = lambda land, b=0.0: detect(read_tiles(spark, [folder]), BrightPixels(0.5), land, b).count()
    assert (n(None), n(land), n([[[(0, 0), (10**7, 0), (10**7, 10**7), (0, 10**7)]]])) == (5, 4, 0)


def test_dma_csv(spark, tmp_path):
    (tmp_path / "day.csv").write_text("# Timestamp,MMSI,Latitude,Longitude,Length,SOG\n2026-08-09 05:31:24,219000001,0.0,9.0,50,10\n09/08/2026 05:31:25,219000002,55.0,9.0,,\nnonsense,219000003,55.0,10.0,x,1\n")
    rows = archives.read_dma_csv(spark, str(tmp_path / "day.csv"), "EPSG:25832").orderBy("mmsi").collect()
    assert rows[0].t_us == fixture.SCENE["t_us"] and rows[1].t_us == rows[0].t_us + 1_000_000 and rows[2].t_us is None
    assert rows[0].x == pytest.approx(500000) and rows[0].speed_ms == pytest.approx(5.14444) and rows[1].length_m is None and rows[2].length_m is None
    assert archives.unread_times(spark, str(tmp_path / "day.csv")).first()[0] == 1
    (tmp_path / "bare.csv").write_text("# Timestamp,MMSI,Latitude,Longitude\n2026-08-09 05:31:24,1,0.0,9.0\n")
    assert archives.read_dma_csv(spark, str(tmp_path / "bare.csv"), "EPSG:25832").columns == ["mmsi", "t_us", "ord", "x", "y"]


def test_geopackage_and_parquet(spark, tmp_path):
    rows = [{"mmsi": str(i), "timestamp": f"2026-08-09T05:31:{i:02d}Z", "length_m": None if i % 2 else 10.0 * i, "x": None if i == 3 else 500000.0 + i, "y": 6100000.0} for i in range(20)]
    archives.write_geopackage(str(tmp_path / "ais.gpkg"), "ais", rows)
    df = archives.read_geopackage(spark, str(tmp_path / "ais.gpkg"))
    got = sorted(df.collect(), key=lambda r: int(r.mmsi))
    assert df.columns == ["mmsi", "t_us", "ord", "x", "y", "length_m"] and len(got) == 20
    assert [r.x for r in got] == [r["x"] for r in rows] and [r.length_m for r in got] == [r["length_m"] for r in rows] and got[0].t_us % 60_000_000 == 0
    naive = spark.sql("select '1' as mmsi, timestamp_ntz'2026-01-01 00:00:00' as timestamp, 0d as x, 0d as y, 1d as length_m")
    naive.write.parquet(str(tmp_path / "naive"))
    with pytest.raises(TypeError):
        archives.read_parquet(spark, str(tmp_path / "naive"))


def test_land_files(tmp_path):
    square = [[[8.99, 55.0], [9.01, 55.0], [9.01, 55.01], [8.99, 55.01], [8.99, 55.0]]]
    far = [[[20.0, 55.0], [20.1, 55.0], [20.1, 55.1], [20.0, 55.0]]]
    shape = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": square}}, {"geometry": {"type": "MultiPolygon", "coordinates": [far]}}]}
    (tmp_path / "land.json").write_text(json.dumps(shape))
    land = archives.read_land(str(tmp_path / "land.json"), "EPSG:25832", (499000, 6094000, 501000, 6097000))
    assert len(land) == 1 and len(archives.read_land(str(tmp_path / "land.json"), "EPSG:25832")) == 2
    assert land[0][0][0] == pytest.approx((499360.4, 6094791.5), abs=1.0)
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert archives.wkb_points(wkb) == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]


def test_config():
    base = {"scene_dir": "s", "tolerance_m": 200}
    cfg = config.parse(base)
    assert (cfg.detector_threshold, cfg.smallest_detectable_m, cfg.max_gap_minutes, cfg.tile_px) == (0.5, 20.0, 10.0, None)
    assert config.parse(base | {"smallest_detectable_m": None}).smallest_detectable_m is None
    assert config.parse(base | {"detector": "cfar", "reception_floor": None}).detector_threshold is None
    full = config.parse(base | {"geometry": {"heading_deg": 350, "incidence_deg": 35}, "tile_px": 256})
    assert full.geometry.shift_per_mps == 113.0 and full.params().apply_azimuth and full.tiling(Cfar()).overlap_px == 64
    assert not cfg.params().apply_azimuth and cfg.params().max_gap_s == 600
    with pytest.raises(TypeError):
        config.parse({"scene_dir": "s"})


def corpus(root, size=800):
    (root / "ImageSets/Main").mkdir(parents=True)
    (root / "JPEGImages_sub").mkdir()
    (root / "Annotations_sub").mkdir()
    rng = np.random.default_rng(3)
    names = {"train": ["01_1", "05_1"], "test": ["11_1", "11_2"], "test_inshore": ["11_1"], "test_offshore": ["11_2"]}
    for split, listed in names.items():
        (root / f"ImageSets/Main/{split}.txt").write_text("\n".join([*listed, "", "  "]))
    for name in ("01_1", "05_1", "11_1", "11_2", "12_9"):
        image = (rng.gamma(4, 4, (size, size))).clip(1, 60).astype(np.uint8)
        found = ""
        for k in range(2):
            r, c = int(rng.integers(100, 700)), int(rng.integers(100, 700))
            image[r : r + 4, c : c + 6] = 250
            found += f"<object><name> Ship </name><bndbox><xmin>{c}</xmin><ymin>{r}</ymin><xmax>{c + 6}</xmax><ymax>{r + 4}</ymax></bndbox></object>"
        (root / f"JPEGImages_sub/{name}.png").write_bytes(raster.png(image))
        (root / f"Annotations_sub/{name}.xml").write_text(f"<annotation>{found}<object><name>buoy</name></object><object><name>ship</name><bndbox><xmin>a</xmin></bndbox></object></annotation>")
    return root


def test_label_corpus(spark, tmp_path):
    root = str(corpus(tmp_path))
    found, audit = labels.read_boxes(spark, f"{root}/Annotations_sub")
    assert found.count() == 10 and {r.rule: r.n for r in audit.collect()} == {"object not labelled 'ship' (kept)": 5, "object without a box (dropped)": 5, "box with non-numeric corners (dropped)": 5}
    chips = labels.read_chips(spark, f"{root}/JPEGImages_sub").persist()
    assert chips.count() == 5 and 0 < np.frombuffer(chips.first().pixels, "<f4").max() <= 1
    listed = spark.createDataFrame([("01_1",), ("77_7",)], "image string")
    rules = {(r.image, r.rule) for r in labels.audit_chips(listed, chips, found).collect()}
    assert rules == {("77_7", "image missing (dropped)"), ("77_7", "label file missing (kept as no ships)")}
    lines = []
    commands.audit_data(spark, root, lines.append)
    assert lines == ["splits", "  image on disk in no split: 1"]
    report = {r["split"]: r for r in commands.evaluate_detector(spark, root, "cfar", str(tmp_path / "out.json"), log=lines.append)}
    assert report["val"]["f1"] == 1.0 and report["test"]["recall"] >= 0.5 and report["test_inshore"]["true_positives"] >= 1 and report["test"]["average_precision"] == pytest.approx(1.0)
    assert {r.split for r in boxes.split_train(labels.read_list(spark, f"{root}/ImageSets/Main/train.txt")).collect()} == {"train", "val"}


@pytest.fixture(scope="module")
def viewer(spark, tmp_path_factory):
    folder = fixture.write(str(tmp_path_factory.mktemp("viewer") / "scene"))
    find = lambda t, tile, overlap: detect(read_tiles(spark, [folder], tile, overlap), BrightPixels(t))
    return Viewer(read_scenes(spark, [folder]), fixture.image(), fixture.ais(spark), find, Params(reception_cell_m=200.0))


def test_payload(viewer):
    run = viewer.run(Request(reception_floor=0.5, register=((500940.0, 6099895.0),)))
    assert run["counts"] == {"total": 5, "matched": 4, "dark": 0, "shadowed": 0, "structure": 1, "unsearched": 0}
    assert run["declaration_counts"] == {"total": 8, "explained": 4, "undetected": 2, "below_detectable": 1, "outside_scene": 1, "masked": 0}
    assert run["ais"]["vessels"] == 10 and run["ais"]["rows_kept"] == 41 and run["reception"]["report"]["cells"] == 53
    first = run["detections"][0]
    assert (first["index"], first["px"], first["py"]) == (0, 57.0, 47.0) and base64.b64decode(first["crop"].split(",")[1])[:4] == b"\x89PNG"
    by = {d["mmsi"]: d for d in run["declarations"]}
    assert [d["mmsi"] for d in run["declarations"]][:3] == ["219000001", "219000002", "219000003"]
    assert by["219000003"]["speed_kn"] == pytest.approx(8 * 3600 / 1852) and by["219000003"]["course_deg"] == pytest.approx(90)
    assert by["219000003"]["matched_index"] == 1 and by["219000001"]["course_deg"] is None
    assert run["register"][0]["px"] == pytest.approx(208.0)
    assert "crop" not in json.loads(payload.export_json({"detections": [{"crop": 1, "a": 2}]}))["detections"][0]


def test_exports_and_urls(spark, viewer, tmp_path):
    fusion = viewer.fusion(Request())
    rows = payload.detections_for_csv(fusion.detections).orderBy("detection").collect()
    text = payload.csv_text(payload.DETECTION_CSV, rows)
    assert text.splitlines()[0] == ",".join(payload.DETECTION_CSV) and len(text.splitlines()) == 6 and "2026-08-09T05:31:24Z" in text
    assert payload.csv_text(["a"], [{"a": 'say "x", y'}]) == 'a\n"say ""x"", y"\n'
    payload.write_sides(fusion, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/declarations")).count() == 8
    asked = Request(tolerance_m=350.0, apply_azimuth=False, register=((1.0, 2.5),))
    from urllib.parse import parse_qs, urlencode

    assert payload.from_query(parse_qs(urlencode(payload.to_query(asked)))) == asked and payload.to_query(Request()) == []
    for bad in ({"tolerance_m": ["0"]}, {"register": ["1"]}, {"register": ["a,b"]}, {"reception_floor": ["2"]}):
        with pytest.raises(ValueError):
            payload.from_query(bad)


def test_bundle_equals_live_runs(viewer, tmp_path):
    manifest = bundle.bake(viewer, Request(), str(tmp_path), thresholds=[0.45, 0.5, 0.7], gaps=[10.0, 11.0], tolerances=[200.0])
    assert len(manifest["runs"]) == 3 * 2 * 2 and manifest["distinct_runs"] == len(list((tmp_path / "runs").iterdir())) == 8
    run = bundle.run_at(manifest, detector_threshold=0.7, max_gap_minutes=10.0, apply_azimuth=True, tolerance_m=200.0)
    live = viewer.run(Request(detector_threshold=0.7))
    baked = json.loads((tmp_path / f"runs/{run}.json").read_text())
    assert baked["counts"] == live["counts"] and baked["declaration_counts"] == live["declaration_counts"] and len(manifest["reception"]) == 2


def test_server_and_commands(spark, viewer, tmp_path, capsys):
    http = commands.server(viewer, Request(), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{p}").read()
    assert json.loads(get("/api/health"))["scene"] == "synthetic-scene-1" and get("/api/scene.png")[:4] == b"\x89PNG"
    assert json.loads(get("/api/run?tolerance_m=100"))["counts"]["matched"] == 3
    for path, code in (("/api/run?tolerance_m=0", 400), ("/nothing", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    http.shutdown()
    fixture.write(str(tmp_path / "scene"))
    fixture.ais(spark).write.parquet(str(tmp_path / "ais.parquet"))
    (tmp_path / "run.yaml").write_text(
        f"scene_dir: {tmp_path}/scene\nais_path: {tmp_path}/ais.parquet\ntolerance_m: 200\noutput_path: {tmp_path}/out\nreception_cell_m: 200\nreception_floor: 0.5\ngeometry: {{heading_deg: 350.0, incidence_deg: 35.0}}\n"
    )
    lines: list[str] = []
    commands.run(spark, str(tmp_path / "run.yaml"), lines.append)
    told = {tuple(x.split()) for x in lines if x.startswith("  ")}
    assert {("matched", "4"), ("dark", "1"), ("shadowed", "0"), ("structure", "0"), ("undetected", "2"), ("below_detectable", "1"), ("outside_scene", "1")} <= told
    assert lines[0] == "detections: 5" and "matched within 200 m; coordinates in" in "\n".join(lines)
    assert lines[-1].strip() == "40 report intervals in, 9 dropped (not_a_pair: 9, no_elapsed_time: 0, implausible_speed: 0), 31 attributed to 53 cells at a max gap of 10 min"


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import incremental

    ais = fixture.ais(spark).withColumn("ts", F.timestamp_micros("t_us"))
    folder = str(tmp_path / "in")
    for i, low in enumerate((-300, -60, 0, 60)):
        at = fixture.SCENE["t_us"] + low * 60_000_000
        high = fixture.SCENE["t_us"] + (-60, 0, 60, 400)[i] * 60_000_000
        ais.where((F.col("t_us") >= at) & (F.col("t_us") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(ais.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    totals = incremental.CellTotals(600.0, 200.0)
    query = incremental.legs_stream(stream()).writeStream.foreachBatch(totals).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    row = lambda r: (r.ix, r.iy, round(r.covered_s, 6), round(r.total_s, 6), r.intervals)
    batch = reception.estimate(ais, 600.0, 200.0).cells
    assert sorted(map(row, totals.cells().collect())) == sorted(map(row, batch.collect())) and batch.count() == 53
    before = totals.now
    totals(spark.createDataFrame([("1", 1.0, 0.0, 0.0)], incremental.LEG), totals.seen)
    assert totals.now is before
    for name, df in (("clean", incremental.clean_stream(stream().union(stream()))), ("latest", incremental.latest_stream(stream(), "30 days"))):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append" if name == "clean" else "append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("clean").count() == 41
    assert replace(Request(), tile_px=64).tile_px == 64
