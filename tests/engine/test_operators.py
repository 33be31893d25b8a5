"""Operators on small cases: known answers, boundaries, brute force and independence of order."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, raster, rings
from tidemark.operators import ais as cleaning
from tidemark.operators import boxes, evaluate, pixels, reception, spatial, structures, sweep
from tidemark.operators.assign import assign, least_cost, solve
from tidemark.operators.components import components
from tidemark.operators.spatial import nearest
from tidemark.operators.detect import BrightPixels, Cfar, Tiling, context_warning, make_detector, tiling_for
from tidemark.operators.instant import positions_at

AIS = "mmsi string, t_us long, ord long, x double, y double, length_m double"


def track(rows, mmsi="1"):
    return [(mmsi, int(t * 1e6), i, float(x), float(y), 50.0) for i, (t, x, y) in enumerate(rows)]


def at(spark, rows, t, gap=600.0, many=False):
    scenes = spark.createDataFrame([("S", int(t * 1e6))], "scene string, t_us long")
    return positions_at(spark.createDataFrame(rows, AIS), scenes, gap, many).collect()


@pytest.mark.parametrize("many", [False, True])
def test_positions(spark, many):
    (r,) = at(spark, track([(0, 0, 0), (600, 100, 0)]), 240, many=many)
    assert (r.x, r.position_basis, r.position_age_s, r.position_span_s) == (40.0, "interpolated", 0.0, 600.0)
    assert r.velocity_east_ms == pytest.approx(1 / 6)
    (r,) = at(spark, track([(0, 0, 0), (600, 100, 0), (1200, 0, 0)]), 600, many=many)  # a report at the instant with a later one
    assert (r.x, r.position_basis, r.position_span_s) == (100.0, "interpolated", 600.0)
    (r,) = at(spark, track([(0, 0, 0), (600, 100, 0)]), 600, many=many)  # the last report, at the instant
    assert (r.x, r.position_basis, r.position_age_s) == (100.0, "nearest", 0.0)
    assert at(spark, track([(0, 0, 0)]), 600, many=many)[0].position_age_s == 600.0  # inclusive
    assert at(spark, track([(0, 0, 0)]), 601, many=many) == []
    (r,) = at(spark, track([(0, 0, 0), (90000, 90, 0)]), 45000, 1.0, many=many)  # a bracket is not bounded by the gap
    assert r.x == 45.0
    (r,) = at(spark, track([(100, 0, 0), (200, 50, 0)]), 0, many=many)  # before the track: its first report, its last velocity
    assert (r.x, r.velocity_east_ms, r.position_age_s) == (0.0, 0.5, 100.0)
    (r,) = at(spark, track([(0, 5, 0), (0, 9, 0)]), 0, many=many)  # no elapsed time: no velocity; the later row stands
    assert (r.x, r.velocity_east_ms) == (9.0, None)
    last = track([(0, 0, 0), (600, 100, 0)])
    last[1] = (*last[1][:5], None)
    assert at(spark, last, 240, many=many)[0].length_m is None


def test_cleaning_order_and_boundaries(spark):
    rows = [("1", 1, 0, 0.0, 0.0, 1.0), ("1", 1, 1, 9.0, 0.0, 1.0), (None, 1, 2, 0.0, 0.0, 1.0), ("2", None, 3, 0.0, 0.0, 1.0), ("2", 1, 4, None, 0.0, 1.0), ("2", 1, 5, 0.0, 0.0, 25.7), ("3", 1, 6, 0.0, 0.0, 25.8), ("4", 1, 7, 10.0, 10.0, None), ("5", 1, 8, 10.1, 10.0, 1.0), ("1", 1, 9, 99.0, 0.0, 99.0)]
    raw = spark.createDataFrame(rows, "mmsi string, t_us long, ord long, x double, y double, speed_ms double")
    for parts in (1, 7):
        kept, report = cleaning.clean(raw.repartition(parts), cleaning.StudyArea(0, 0, 10, 10))
        assert sorted(r.ord for r in kept.collect()) == [0, 5, 7]
        assert [r.removed for r in report.orderBy("ordinal").collect()] == [3, 2, 1, 1]
    assert [r.rule for r in cleaning.clean(raw.drop("speed_ms")).report.orderBy("ordinal").collect()] == cleaning.RULES[:2]
    assert cleaning.report_line(10, report.collect()) == "10 rows in, 7 removed (missing_identity_time_or_position: 3, duplicate_mmsi_timestamp: 2, implausible_speed: 1, outside_study_area: 1), 3 kept"


def test_distance_joins_equal_brute_force(spark):
    R = random.Random(3)
    pts = lambda n: [(s, i, R.uniform(-900, 900), R.uniform(-900, 900)) for i in range(n) for s in ("A", "B")]
    left, right = pts(40), pts(30)
    left.append(("A", 99, *right[0][2:]))
    a, b = spark.createDataFrame(left, "scene string, i long, x double, y double"), spark.createDataFrame(right, "scene string, j long, x double, y double")
    want = {(s, i, j): math.dist((x, y), (u, v)) for s, i, x, y in left for t, j, u, v in right if s == t}
    got = {(r.scene, r.i, r.j): r.distance_m for r in spatial.within_distance(a, b, 120.0).collect()}
    assert got.keys() == {k for k, d in want.items() if d <= 120} and got[("A", 99, right[0][1])] == 0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for reach in (50.0, 5000.0):
        near = {(r.scene, r.i): r.nearest_m for r in spatial.nearest(a, b, ("scene", "i"), reach_m=reach).collect()}
        assert all(abs(near[(s, i)] - min(d for (t, k, _), d in want.items() if (t, k) == (s, i))) < 1e-9 for s, i, *_ in left)
    assert spatial.nearest(a, b.where("false"), ("scene", "i")).where("nearest_m is not null").count() == 0
    exact = spark.createDataFrame([("A", 1, 0.0, 0.0)], "scene string, i long, x double, y double")
    assert spatial.within_distance(exact, spark.createDataFrame([("A", 1, 120.0, 0.0)], "scene string, j long, x double, y double"), 120.0).count() == 1


def brute_assignment(edges):
    best = (0, 0.0)
    for k in range(min(len(edges), 5), 0, -1):
        for some in itertools.combinations(edges, k):
            if len({a for a, _, _ in some}) == len({b for _, b, _ in some}) == k:
                best = max(best, (k, -sum(d for *_, d in some)))
        if best[0]:
            break
    return best[0], -best[1]


def test_assignment_equals_brute_force():
    R = random.Random(4)
    for _ in range(60):
        edges = list({(R.randrange(5), R.randrange(5)): R.uniform(0, 100) for _ in range(R.randrange(1, 12))}.items())
        edges = [(a, b, d) for (a, b), d in edges]
        picked = solve(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), np.array([e[2] for e in edges]))
        n, total = brute_assignment(edges)
        assert len(picked) == n and sum(edges[i][2] for i in picked) == pytest.approx(total)
        assert len({edges[i][0] for i in picked}) == len({edges[i][1] for i in picked}) == n
    cost = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert sum(cost[i, j] for i, j in enumerate(least_cost(cost))) == 5


def test_assignment_takes_more_pairs_before_shorter_ones(spark):
    greedy = [("S", 1, "a", 90.0), ("S", 1, "b", 95.0), ("S", 2, "a", 98.0), ("T", 1, "a", 5.0)]
    got = {(r.scene, r.det_id, r.mmsi) for r in assign(spark.createDataFrame(greedy, "scene string, det_id long, mmsi string, distance_m double")).collect()}
    assert got == {("S", 1, "b"), ("S", 2, "a"), ("T", 1, "a")}
    square = [("S", 1, "a", 1.0), ("S", 1, "b", 9.0), ("S", 2, "a", 9.0), ("S", 2, "b", 1.0)]
    assert sum(r.distance_m for r in assign(spark.createDataFrame(square, "scene string, det_id long, mmsi string, distance_m double")).collect()) == 2.0


def test_one_large_connected_part_needs_memory_for_its_edges_only():
    """3,000 by 30,000 in one part: as a matrix 1.4 GB, as edges 36,000."""
    import tracemalloc

    rng = np.random.default_rng(7)
    n, fan = 3000, 12
    left = np.repeat(np.arange(n), fan)
    right = (left * 10 + np.tile(np.arange(fan), n)) % (10 * n)  # neighbours share two
    metres = rng.uniform(0, 600, len(left))
    tracemalloc.start()
    picked = solve(left, right, metres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(picked) == n == len(set(right[picked])) and peak < 100e6
    # No assignment is cheaper than every left side's nearest; only those that share it can pay more.
    assert metres[picked].sum() >= metres.reshape(n, fan).min(1).sum()
    few = left < 40
    dense = np.full((40, 402), 1e6)
    dense[left[few], right[few]] = metres[few]
    best = sum(dense[i, j] for i, j in enumerate(least_cost(dense)))
    assert sum(metres[few][i] for i in solve(left[few], right[few], metres[few])) == pytest.approx(best)


@pytest.mark.parametrize("dets, ships", [(40, 30), (30, 40)])
def test_assignment_looks_beyond_the_nearest_candidates(spark, dets, ships):
    """All pairs in reach of each other, at nearly equal places and with ties: the nearest 16 are not enough."""
    R = random.Random(dets)
    rows = [("S", d, f"m{m}", float(R.randrange(1, 40))) for d in range(dets) for m in range(ships)]
    rows += [("S", 500 + d, f"far{d % 2}", 5.0) for d in range(3)]
    got = assign(spark.createDataFrame(rows, "scene string, det_id long, mmsi string, distance_m double")).collect()
    cost = np.zeros((dets, ships))
    for _, d, m, metres in rows[: dets * ships]:
        cost[d, int(m[1:])] = metres
    cost = cost if dets <= ships else cost.T
    best = sum(cost[i, j] for i, j in enumerate(least_cost(cost)))
    assert len(got) == 30 + 2 == len({r.det_id for r in got}) == len({r.mmsi for r in got})
    assert sum(r.distance_m for r in got) == best + 10.0


def test_a_large_scene_is_solved_in_parts(spark, monkeypatch):
    """One connected scene of many harbours: no task gets it whole, and what harbours lack is found next door."""
    from tidemark.operators import assign as module

    R, rows = random.Random(21), []
    ships = [(f"m{h}-{i}", 300.0 * h + R.uniform(0, 40)) for h in range(24) for i in range(12)]
    dets = [(100 * h + i, 300.0 * h + R.uniform(0, 40)) for h in range(24) for i in range(6 if h % 8 == 3 else 20)]
    dets += [(d + 50, x) for d, x in dets if d % 3 == 0]  # seen twice at the same place
    rows = [("S", d, m, abs(x - y)) for d, x in dets for m, y in ships if abs(x - y) <= 600]
    whole = solve(*[np.array(c) for c in zip(*[(m, d, metres) for _, d, m, metres in rows])])
    told = module._solved

    def watched(table):
        if len(table) > 2500:
            raise ValueError(f"{len(table)} pairs in one task")
        return told(table)

    monkeypatch.setattr(module, "PART", 300, raising=False)
    monkeypatch.setattr(module, "_solved", watched)
    got = assign(spark.createDataFrame(rows, "scene string, det_id long, mmsi string, distance_m double")).collect()
    assert len(got) == len(whole) == len({r.det_id for r in got}) == len({r.mmsi for r in got})
    assert sum(r.distance_m for r in got) == pytest.approx(sum(rows[i][3] for i in whole), abs=1e-6)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 209)}


@pytest.mark.parametrize("gap,window,p", [(60, 600, 1.0), (3600, 600, 1 / 3), (3600, 1800, 1.0)])
def test_reception(spark, gap, window, p):
    rows = track([(i * gap, 500.0, 500.0) for i in range(10)])
    model = reception.estimate(spark.createDataFrame(rows, AIS), window, 1000.0)
    dets = spark.createDataFrame([("S", i, 500.0 + 1000 * i, 500.0, "dark") for i in (0, 1, 2)], "scene string, det_id long, x double, y double, status string")
    got = sorted(reception.mark(dets, model, floor=p).collect(), key=lambda r: r.det_id)
    assert [r.reception_intervals for r in got] == [9, 9, 0] and got[0].reception_p == pytest.approx(p)
    assert [r.status for r in got] == ["dark"] * 3  # the floor itself is enough, and the unmeasured stay
    assert {r.status for r in reception.mark(dets, model, floor=p + 0.01).collect() if r.det_id < 2} == {"shadowed"}
    assert reception.estimate(None, 600) is None and set(reception.mark(dets, None).columns) > {"reception_p"}


def test_reception_drops_by_cause(spark):
    rows = track([(0, 0, 0), (10, 100000, 0), (10, 100000, 0), (70, 100000, 0)]) + track([(0, 0, 0)], "2")
    report = reception.estimate(spark.createDataFrame(rows, AIS), 600).report.first()
    assert (report.intervals, report.used, report.not_a_pair, report.no_elapsed_time, report.implausible_speed) == (4, 1, 1, 1, 1)


def test_structures_do_not_depend_on_order(spark):
    line = [("a", 0.0), ("b", 90.0), ("c", 180.0)]
    for order in itertools.permutations(range(3)):
        rows = [(i, line[k][0], line[k][1], 0.0) for i, k in enumerate(order)]
        found = structures.standing(spark.createDataFrame(rows, "id long, scene string, x double, y double"))
        (r,) = found.positions.collect()
        assert (r.acquisitions, r.crops, r.x) == (3, 3, 90.0)
    rows = [(0, "a", 0.0, 0.0), (1, "a", 5.0, 0.0), (2, "b", 500.0, 0.0), (3, "c", 505.0, 0.0)]
    found = structures.standing(spark.createDataFrame(rows, "id long, scene string, x double, y double"))
    assert [(r.x, r.acquisitions) for r in structures.register(found).collect()] == [(502.5, 2)]
    assert {r.id: r.position for r in structures.dense_ids(found).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    known = spark.createDataFrame([(500.0, 0.0), (0.0, 0.0)], "x double, y double")
    r = structures.verify(structures.register(found), known, 10.0).first()
    assert (r.known, r.registered, r.found, r.unpublished, r.median_m) == (2, 1, 1, 0, 2.5)
    assert structures.verify(known.where("false"), known, 10.0).first().median_m == float("inf")
    with pytest.raises(ValueError):
        structures.verify(known, known.where("false"), 10.0)


def test_projection_inverts(spark):
    tm = geo.TransverseMercator.of("EPSG:25832")
    rows = [(9.0, 0.0), (9.0, 55.0), (6.1, 54.3), (12.9, 57.9), (11.0, -33.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = tm.forward(F.col("lon"), F.col("lat"))
    back = df.withColumns({"x": x, "y": y})
    lon, lat = tm.inverse(F.col("x"), F.col("y"))
    for r in back.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9)
        assert tm.forward_of(r.lon, r.lat) == pytest.approx((r.x, r.y), abs=1e-6)
        if r.lon == 9.0:
            assert r.x == pytest.approx(500000, abs=1e-6)
    assert tm.forward_of(9.0, 55.0)[1] == pytest.approx(6094791.4186, abs=0.01)  # meridian arc times 0.9996


def test_radar_shift(spark):
    assert geo.radar_shift_of(0, 0, 350, 35) == (0, 0)
    e, n = geo.radar_shift_of(8, 0, 350, 35)
    assert math.hypot(e, n) == pytest.approx(510.636, abs=1e-3) and math.degrees(math.atan2(e, n)) % 360 == pytest.approx(350)
    along = geo.radar_shift_of(5 * math.sin(math.radians(350)), 5 * math.cos(math.radians(350)), 350, 35)
    assert math.hypot(*along) == pytest.approx(0, abs=1e-9)


def test_tiles_partition_and_detectors_agree_with_the_whole(spark):
    with pytest.raises(ValueError):
        pixels.tiling(10, 10, 64, 32, spark)
    seen = np.zeros((300, 420), int)
    for t in pixels.tiling(300, 420, 128, 32, spark).collect():
        seen[t.core_row0 : t.core_row1, t.core_col0 : t.core_col1] += 1
        assert t.row0 <= t.core_row0 < t.core_row1 <= t.row1
    assert (seen == 1).all()
    assert tiling_for(Cfar(), 256) == Tiling(256, 64) and tiling_for(BrightPixels()) == Tiling(128, 32)
    assert "40 px" in context_warning(Cfar(), Tiling(128, 32), "cfar") and context_warning(Cfar(), Cfar().preferred_tiling, "cfar") is None
    with pytest.raises(ValueError):
        make_detector("radar")


def test_label_and_box_sums_and_cfar():
    rng = np.random.default_rng(5)
    mask = rng.random((40, 50)) < 0.45
    region, n = raster.label(mask)
    flood, k = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not flood[r, c]:
            k += 1
            todo = [(r, c)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < 40 and 0 <= j < 50 and mask[i, j] and not flood[i, j]:
                    flood[i, j] = k
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert n == k and (region == flood).all()
    image = rng.random((30, 20))
    padded = np.pad(image, 3)
    assert np.allclose(raster.box_sum(image, 7), [[padded[i : i + 7, j : j + 7].sum() for j in range(20)] for i in range(30)])
    sea = 0.01 + rng.gamma(4, 0.05, (260, 260)).astype(np.float32)
    sea[100:103, 120:124] += 6
    sea[200:204, 60:62] += 6
    points = Cfar().scored(sea)
    bright = sorted((float(r), float(c)) for r, c, s in points if s > 10)
    assert np.allclose(bright, [(101, 121.5), (201.5, 60.5)], atol=1.0)
    z, half = Cfar().statistic(sea), 48
    part = Cfar().statistic(sea[100 - half : 160 + half, 80 - half : 140 + half])
    assert np.allclose(part[half:-half, half:-half], z[100:160, 80:140], atol=1e-5)


def test_pixel_rows_equal_arrays(spark):
    rng = np.random.default_rng(6)
    image = np.where(rng.random((40, 40)) < 0.05, 3.0, 0.2 + 0.1 * rng.random((40, 40)))
    image[:3, :4] = 0
    rows = spark.createDataFrame([(0, r, c, float(image[r, c])) for r in range(40) for c in range(40)], "image long, r long, c long, v double")
    grid = lambda df, v: np.array([x[v] for x in df.orderBy("r", "c").collect()], float).reshape(40, 40)
    assert np.allclose(grid(pixels.cfar_statistic(rows, 3, 9, 17), "z"), raster.cfar_statistic(image, 3, 9, 17), atol=1e-4)
    assert np.allclose(grid(pixels.robust_z(rows), "z"), raster.robust_z(image)[0], atol=1e-4)
    assert (grid(pixels.stretch(rows), "grey") == raster.stretch(image)).all()
    blobs = sorted((r.row, r.col) for r in pixels.bright_blobs(rows, 1.0, 40).collect())
    assert np.allclose(blobs, sorted((r, c) for r, c, _ in BrightPixels(1.0).scored(image)))
    tops = {(r.r, r.c) for r in pixels.local_maxima(rows, 0.1).collect()}
    assert tops == {(int(r), int(c)) for r, c, _ in raster.local_maxima(image, image != 0, 0.1)}


def test_ranking(spark):
    rows = [(i, s, h) for i, (s, h) in enumerate(zip((0.9, 0.8, 0.7, 0.6), (True, True, False, True)))]
    scored = spark.createDataFrame(rows, "id long, score double, hit boolean")
    r = evaluate.best_f1(scored, 4).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.threshold) == (3, 1, 1, 0.6)
    assert evaluate.average_precision(scored, 4).first()[0] == pytest.approx(0.6875)
    assert evaluate.at_threshold(scored, 4, 0.75).first().true_positives == 2
    none = evaluate.at_threshold(scored, 0, 2.0).first()
    assert (none.precision, none.recall, none.f1) == (1.0, 1.0, 1.0)
    R = random.Random(7)
    many = [(i, R.choice([0.1 * k for k in range(30)]), R.random() < 0.4) for i in range(500)]
    ranked = sorted(many, key=lambda p: (-p[1], p[0]))
    tp = np.cumsum([h for *_, h in ranked])
    precision = tp / np.arange(1, 501)
    want = sum(max(precision[i:]) for i, p in enumerate(ranked) if p[2]) / 300
    assert evaluate.average_precision(spark.createDataFrame(many, "id long, score double, hit boolean"), 300).first()[0] == pytest.approx(want)


def test_box_stealing_and_pairing(spark):
    points = [(0, 0, 10.0, 10.0, 0.9), (0, 1, 10.0, 14.0, 0.8), (0, 2, 50.0, 50.0, 0.7), (1, 0, 10.0, 10.0, 0.6)]
    found = [(0, 0, 8.0, 8.0, 12.0, 12.0), (0, 1, 9.0, 9.0, 20.0, 12.0), (1, 0, 13.0, 7.0, 20.0, 13.0)]
    got = evaluate.match_points(spark.createDataFrame(points, "image long, id long, row double, col double, score double"), spark.createDataFrame(found, "image long, box_id long, x0 double, y0 double, x1 double, y1 double"))
    assert {(r.image, r.id): r.hit for r in got.collect()} == {(0, 0): True, (0, 1): True, (0, 2): False, (1, 0): True}
    R = random.Random(8)
    for _ in range(40):
        reach = {p: R.sample(range(5), R.randrange(0, 4)) for p in range(6)}
        hits = evaluate.most_hits(list(range(6)), reach)
        best = max(sum(1 for p, b in zip(range(6), pick) if b is not None) for pick in itertools.product(*[[None, *reach[p]] for p in range(6)]) if len({b for b in pick if b is not None}) == sum(b is not None for b in pick))
        assert len(hits) == best


def test_box_hygiene_equals_a_sequential_version(spark):
    R = random.Random(9)
    rows = [(i % 4, i, *[R.choice([R.uniform(-20, 830), R.randrange(0, 30)]) for _ in range(4)]) for i in range(120)]
    rows += [(9, 500, 10.0, 10.0, 30.0, 30.0), (9, 501, 30.0, 30.0, 10.0, 10.0), (9, 502, 11.0, 10.0, 30.0, 30.0), (9, 503, 5.0, 5.0, 5.5, 40.0), (9, 504, 0.0, 0.0, 900.0, 20.0)]
    raw = spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], "image long, box_id long, x0 double, y0 double, x1 double, y1 double")
    marked = {r.box_id: r for r in boxes.mark_boxes(raw).collect()}
    kept: dict = {}
    for image, box, x0, y0, x1, y1 in rows:
        b = [min(max(v, 0), 800) for v in (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))]
        key = tuple(round(v, 1) for v in b)
        mine = kept.setdefault(image, [])
        if b[2] - b[0] < 1 or b[3] - b[1] < 1:
            want = boxes.TINY
        elif key in kept.setdefault(("seen", image), set()):
            want = boxes.REPEATED
        else:
            kept[("seen", image)].add(key)
            want = boxes.TWICE if any(boxes.iou(b, k) > 0.7 for k in mine) else None
            if want is None:
                mine.append(b)
        assert marked[box].dropped == want
    assert boxes.SWAPPED in marked[501].rules and boxes.CLIPPED in marked[504].rules and boxes.LONG in marked[504].rules
    assert marked[501].dropped == boxes.REPEATED and marked[502].dropped == boxes.TWICE


def test_rings():
    hole = [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]]
    x, y = np.array([5.0, 1, 0, 4, 11, 12]), np.array([5.0, 1, 5, 5, 5, 5])
    assert rings.on_land(x, y, hole).tolist() == [False, True, True, True, False, False]
    assert rings.on_land(x, y, hole, 1.0).tolist() == [True, True, True, True, True, False]
    mask = rings.mask_of(hole, (1, 0, 0, 0, -1, 10), 0, 0, (10, 12))
    assert mask.sum() == 96 and not mask[:, 10:].any()
    assert rings.land_share(hole, (1, 0, 0, 0, -1, 10), 10, 20) == pytest.approx(0.48)


def test_sweep_rows_equal_single_runs(spark):
    from tidemark.plans import views as v

    sf, dets = "/root/testdata/sf0.001", None
    dets, ais, scenes = v.detections(spark, sf), v.ais(spark, sf), v.scenes(spark)
    plan = spark.createDataFrame([(0, 360.0, True, 600.0), (1, 360.0, False, 900.0), (2, 60.0, False, 2000.0), (3, 1e5, False, 2000.0)], "run long, max_gap_minutes double, apply_azimuth boolean, tolerance_m double")
    got = {r.run: (r.matched, round(r.total_m, 6)) for r in sweep.outcomes(dets, ais, scenes, plan).collect()}
    from tidemark.operators.classify import candidates
    from tidemark.operators.instant import drawn_by_radar

    for r in plan.collect():
        placed = drawn_by_radar(positions_at(ais, scenes, r.max_gap_minutes * 60), scenes if r.apply_azimuth else None)
        pairs = assign(candidates(dets, placed, r.tolerance_m)).collect()
        assert got[r.run] == (len(pairs), round(sum(p.distance_m for p in pairs), 6))


def test_sweep_writes_and_ranks_pairs_once_for_all_gaps(spark, monkeypatch):
    from tidemark import staging
    from tidemark.operators import assign as module
    from tidemark.plans import views as v

    class Counted(staging.Staged):
        rows: dict[str, int] = {}

        def __init__(self, df, tag, *how):
            super().__init__(df, tag, *how)
            self.rows[tag] = self.df.count()

    monkeypatch.setattr(module, "Staged", Counted)
    monkeypatch.setattr(sweep, "stage", lambda df, tag: Counted(df, tag).df)
    sf = "/root/testdata/sf0.001"
    plan = [(i, *x) for i, x in enumerate(itertools.product((60.0, 360.0, 1e4, 2e4, 1e5), (True, False), (900.0, 2000.0)))]
    plan = spark.createDataFrame(plan, "run long, max_gap_minutes double, apply_azimuth boolean, tolerance_m double")
    out = sweep.outcomes(v.detections(spark, sf), v.ais(spark, sf), v.scenes(spark), plan).collect()
    assert len({r.matched for r in out}) > 2
    assert 0 < Counted.rows["candidates"] <= Counted.rows["sweep-pairs"]


@pytest.mark.parametrize("dets, ships", [(8, 20), (20, 8)])
def test_lines_of_a_family_equal_assignments_of_their_own(spark, monkeypatch, dets, ships):
    from tidemark.operators import assign as module

    for name, value in (("NEAREST", 1), ("HELD", 4), ("BLOCK", 2)):
        monkeypatch.setattr(module, name, value)
    R = random.Random(dets)
    age = {(s, m): R.choice([0.0, 60.0, 120.0, 300.0]) for s in "ab" for m in range(ships)}
    pairs = {(s, R.randrange(dets), R.randrange(ships)): R.choice([5.0, R.uniform(0, 50)]) for _ in range(150) for s in "ab"}
    rows = [(f, f"{f}|{s}", d, f"m{m}", x, age[s, m]) for (s, d, m), x in pairs.items() for f in (0, 1) if not f or d % 3]
    lines = [(0, 0, 0.0, [10.0, 20.0, 50.0]), (1, 0, 60.0, [50.0]), (2, 0, 300.0, [0.5, 5.0, 25.0, 30.0, 50.0]), (3, 1, 120.0, [30.0, 40.0])]
    given = spark.createDataFrame(rows, "family int, scene string, det_id long, mmsi string, distance_m double, age double")
    got = {(r.line, r.tolerance_m): (r.matched, round(r.total_m, 6)) for r in module.assign_within(given, lines).collect()}
    for line, family, most_age, cuts in lines:
        for cut in cuts:
            n = total = 0
            for scene in ("a", "b"):
                own = [r for r in rows if r[:2] == (family, f"{family}|{scene}") and r[5] <= most_age and r[4] <= cut]
                chosen = module.solve(*(np.array([r[k] for r in own]) for k in (2, 3, 4))) if own else []
                n, total = n + len(chosen), total + sum(own[i][4] for i in chosen)
            assert got.get((line, cut), (0, 0.0)) == (n, round(total, 6))


def test_sweep_keys_added_up_from_steps_equal_those_of_each_inputs_pairs(spark):
    R = random.Random(9)
    met = [("S", R.randrange(9), f"m{R.randrange(9)}", R.choice([25.0, R.uniform(0, 90)]), R.choice([0.0, 60.0, R.uniform(0, 200)]), R.random() < 0.5, R.random()) for _ in range(120)]
    met = spark.createDataFrame(met, "scene string, det_id long, mmsi string, distance_m double, age double, az boolean, score double")
    inputs = [(float(t), float(g), az, float(tol)) for t in (0, 0.5) for g in (1, 2) for az in (True, False) for tol in (10, 25, 80)]
    inputs = spark.createDataFrame([(*x, i) for i, x in enumerate(inputs)], "thr double, max_gap_minutes double, apply_azimuth boolean, tol double, first long")
    kept = met.join(inputs, (F.col("az") == F.col("apply_azimuth")) & (F.col("distance_m") <= F.col("tol")) & (F.col("age") <= F.col("max_gap_minutes") * 60) & (F.col("score") >= F.col("thr")))
    plain = sweep.digest(kept, ["first"], ["scene", "det_id", "mmsi", "distance_m"])
    assert sorted(map(tuple, sweep._keys(met, inputs).collect())) == sorted(map(tuple, plain.collect()))


def test_nearest_starts_at_the_spacing_of_dense_places(spark, monkeypatch):
    reaches, plain = [], spatial.within_distance
    monkeypatch.setattr(spatial, "within_distance", lambda left, right, reach, on: reaches.append(reach) or plain(left, right, reach, on))
    near = spark.createDataFrame([("s", float(10 * i), float(10 * j)) for i in range(21) for j in range(21)], "scene string, x double, y double")
    far = spark.createDataFrame([("s", 1, 3.0, 0.0), ("s", 2, 5000.0, 0.0)], "scene string, n long, x double, y double")
    assert {r.n: r.nearest_m for r in nearest(far, near, ("n",)).collect()} == {1: 3.0, 2: 4800.0}
    assert 18 < reaches[0] < 20


def test_nearest_searches_as_far_as_it_must(spark):
    rng = random.Random(12)
    far = [(f"s{i % 3}", i, rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)) for i in range(40)] + [("s0", 90, None, 1.0), ("none", 91, 0.0, 0.0)]
    near = [(f"s{i % 3}", rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(9)]
    left, right = spark.createDataFrame(far, "scene string, n long, x double, y double"), spark.createDataFrame(near, "scene string, x double, y double")
    for on in (("scene",), ()):
        got = {r.n: r.nearest_m for r in nearest(left, right, ("n",), on, reach_m=10.0).collect()}
        for scene, n, x, y in far:
            own = [((x - u) ** 2 + (y - w) ** 2) ** 0.5 for s, u, w in near if not on or s == scene] if x is not None else []
            assert got[n] is None if not own else abs(got[n] - min(own)) < 1e-6
        assert [r.nearest_m for r in nearest(left, right.limit(0), ("n",), on).collect()] == [None] * len(far)


def test_links_connect_what_all_pairs_connect_with_few_edges(spark):
    R = random.Random(4)
    rows = [(i, f"s{i % 9}", R.uniform(-900, 900), R.uniform(-900, 900)) for i in range(300)]
    rows += [(1000 + i, "t", 5000 + R.gauss(0, 12), 5000 + R.gauss(0, 12)) for i in range(400)]
    rows += [(2000 + i, "u", 100.0 * i, -3000.0) for i in range(20)]  # each exactly the tolerance from the next
    sightings = spark.createDataFrame(rows, "id long, scene string, x double, y double")
    top = {r[0]: r[0] for r in rows}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for i, (a, _, x, y) in enumerate(rows):
        for b, _, x2, y2 in rows[:i]:
            if (x - x2) ** 2 + (y - y2) ** 2 <= 100.0**2:
                one, two = root(a), root(b)
                top[max(one, two)] = min(one, two)
    assert {r.id: r.position_id for r in structures.standing(sightings, 100.0).members.collect()} == {n: root(n) for n in top}
    assert structures._links(sightings.where("id between 1000 and 1999"), 100.0).count() < 2 * 400
