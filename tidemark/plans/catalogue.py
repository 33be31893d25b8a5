"""Registered queries over the driver's tables and their DuckDB counterparts.

Every query reads its tables whole. Derived doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo
from tidemark.operators import ais as cleaning
from tidemark.operators import boxes, declarations, evaluate, pixels, reception, structures, sweep
from tidemark.operators import classify as match
from tidemark.operators.components import components
from tidemark.operators.detect import attach_embedding
from tidemark.operators.instant import drawn_by_radar, positions_at
from tidemark.operators.spatial import nearest
from tidemark.plans import bundle, payload
from tidemark.plans import views as v
from tidemark.plans.views import AIS, CAND, DET, DRAWN, GRID, PAIRS, POSITIONS, SCENE, SCORE, SIGHT, with_
from tidemark.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREA = cleaning.StudyArea(505000.0, 6105000.0, 535000.0, 6135000.0)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero as zero."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 as {n.split('.')[-1]}" for n in names)


def _declared(spark, sf_dir):
    return positions_at(v.ais(spark, sf_dir), v.scenes(spark), v.MAX_GAP_S)


def _drawn(spark, sf_dir):
    return drawn_by_radar(_declared(spark, sf_dir), v.scenes(spark))


def _match(spark, sf_dir):
    return match.classify(v.detections(spark, sf_dir), stage(_drawn(spark, sf_dir), "declared"), v.TOLERANCE_M, v.scenes(spark))


def _coverage(spark, sf_dir):
    return reception.estimate(v.ais(spark, sf_dir), v.MAX_GAP_S, v.CELL_M)


def _image(spark):
    return v.grid(spark).withColumn("image", F.lit(0).cast("long"))


# -- archives ---------------------------------------------------------------------------------------------------

RULED = f"""ranked as (select *, mmsi is not null and t_us is not null and x is not null and y is not null as known,
    row_number() over (partition by mmsi, t_us, mmsi is not null and t_us is not null and x is not null and y is not null order by ord) as k from ais),
ruled as (select *, case when not known then 1 when k > 1 then 2 when speed_ms > {cleaning.MAX_PLAUSIBLE_SPEED_MS} then 3
    when not (x between {AREA.min_x} and {AREA.max_x} and y between {AREA.min_y} and {AREA.max_y}) then 4 end as failed from ranked)"""


@query(with_(AIS, RULED, select=f"select mmsi, t_us, ord, x, y, length_m, {r6('speed_ms')} from ruled where failed is null"))
def ais_clean(spark, sf_dir):
    return rounded(cleaning.clean(v.ais(spark, sf_dir), AREA).rows)


@query(with_(AIS, RULED, select="select o as ordinal, n as rule, (select count(*) from ruled where failed = o) as removed from (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(cleaning.RULES, 1)) + ") as t(o, n)"))
def ais_clean_report(spark, sf_dir):
    return cleaning.clean(v.ais(spark, sf_dir), AREA).report


@query(with_(AIS, select="select count(*) as rows, count(distinct mmsi) as vessels from ais"))
def archive_counts(spark, sf_dir):
    return cleaning.archive_counts(v.ais(spark, sf_dir))


# -- positions --------------------------------------------------------------------------------------------------


@query(with_(AIS, POSITIONS, select=f"select scene, mmsi, length_m, position_basis, {r6('position_age_s', 'position_span_s', 'x', 'y')} from pos"))
def positions(spark, sf_dir):
    return rounded(_declared(spark, sf_dir).select("scene", "mmsi", "length_m", "position_basis", "position_age_s", "position_span_s", "x", "y"))


QUERIES["positions_at"], ORACLES["positions_at"] = QUERIES.pop("positions"), ORACLES.pop("positions")


@query(ORACLES["positions_at"])
def positions_at_many_scenes(spark, sf_dir):
    placed = positions_at(v.ais(spark, sf_dir), v.scenes(spark), v.MAX_GAP_S, many=True)
    return rounded(placed.select("scene", "mmsi", "length_m", "position_basis", "position_age_s", "position_span_s", "x", "y"))


@query(with_(AIS, POSITIONS, select=f"select mmsi, {r6('velocity_east_ms', 'velocity_north_ms')} from pos"))
def positions_velocity(spark, sf_dir):
    return rounded(_declared(spark, sf_dir).select("mmsi", "velocity_east_ms", "velocity_north_ms"))


@query(with_(AIS, POSITIONS, DRAWN, select=f"select mmsi, {r6('x', 'y', 'azimuth_shift_m')} from drawn"))
def azimuth_shift(spark, sf_dir):
    return rounded(_drawn(spark, sf_dir).select("mmsi", "x", "y", "azimuth_shift_m"))


@query(
    with_(AIS, POSITIONS, "s as (select mmsi, velocity_east_ms as e, velocity_north_ms as n, sqrt(velocity_east_ms * velocity_east_ms + velocity_north_ms * velocity_north_ms) as sp from pos)",
    select=f"select mmsi, round(case when sp > 0 then case when degrees(atan2(e, n)) < 0 then degrees(atan2(e, n)) + 360 else degrees(atan2(e, n)) end end, 6) + 0 as course_deg, round(sp * {geo.MS_TO_KNOTS!r}::double, 6) + 0 as speed_kn from s")
)
def course_speed(spark, sf_dir):
    e, n = F.col("velocity_east_ms"), F.col("velocity_north_ms")
    return rounded(_declared(spark, sf_dir).select("mmsi", geo.course_deg(e, n).alias("course_deg"), geo.speed_kn(e, n).alias("speed_kn")))


# -- matching ---------------------------------------------------------------------------------------------------

MATCHING = (AIS, POSITIONS, DRAWN, DET, CAND)


@query(with_(*MATCHING, select=f"select det_id, mmsi, {r6('distance_m')} from cand"))
def candidate_pairs(spark, sf_dir):
    return rounded(match.candidates(v.detections(spark, sf_dir), _drawn(spark, sf_dir), v.TOLERANCE_M).drop("scene"))


PARTS = """arcs as (select det_id * 2 as a, cast(mmsi as bigint) * 2 + 1 as b from cand union select cast(mmsi as bigint) * 2 + 1, det_id * 2 from cand),
reach(a, b) as (select a, a from arcs union select r.a, x.b from reach r join arcs x on r.b = x.a)"""


@query(with_(*MATCHING, PARTS, select="select a as node, min(b) as label from reach group by a"))
def pair_components(spark, sf_dir):
    pairs = match.candidates(v.detections(spark, sf_dir), _drawn(spark, sf_dir), v.TOLERANCE_M)
    return components(pairs.select((F.col("det_id") * 2).alias("a"), (F.col("mmsi").cast("long") * 2 + 1).alias("b")))


@query(with_(*MATCHING, PAIRS, select=f"select det_id, mmsi, {r6('distance_m')} from pairs"))
def assignment(spark, sf_dir):
    return rounded(match.assign(match.candidates(v.detections(spark, sf_dir), _drawn(spark, sf_dir), v.TOLERANCE_M)).drop("scene"))


CLASSED = f"""classed as (select d.scene, d.det_id, d.x, d.y, case when p.mmsi is null then 'dark' else 'matched' end as status, p.mmsi, w.length_m, p.distance_m as match_distance_m,
    cast({v.TOLERANCE_M} as double) as tolerance_m, cast((select count(*) from drawn) as double) as declarations_searched, w.position_basis, w.position_age_s, w.position_span_s, w.azimuth_shift_m,
    cast({v.INSTANT_US} as bigint) as acquired_at
  from det d left join pairs p on d.det_id = p.det_id left join drawn w on w.mmsi = p.mmsi)"""
CLASSIFIED = (*MATCHING, PAIRS, CLASSED)


@query(with_(*CLASSIFIED, select=f"select scene, det_id, x, y, status, mmsi, length_m, {r6('match_distance_m')}, tolerance_m, declarations_searched, position_basis, {r6('position_age_s', 'position_span_s', 'azimuth_shift_m')}, acquired_at from classed"))
def classify(spark, sf_dir):
    return rounded(_match(spark, sf_dir).detections)


@query(with_(*CLASSIFIED, select="select count(*) as total, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in match.STATUSES) + " from classed"))
def status_counts(spark, sf_dir):
    return match.status_counts(_match(spark, sf_dir).detections)


@query(with_(AIS, POSITIONS, DRAWN, DET, select="select p.mmsi, round(min(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y))), 6) + 0 as nearest_m from drawn p, det d group by p.mmsi"))
def nearest_detection(spark, sf_dir):
    return rounded(nearest(_drawn(spark, sf_dir), v.detections(spark, sf_dir), ("mmsi",), reach_m=1000.0))


# -- reception --------------------------------------------------------------------------------------------------

LEGS = f"""legs as (select mmsi, t_us, x, y, lead(t_us) over w as t2, lead(x) over w as x2, lead(y) over w as y2 from ais window w as (partition by mmsi order by t_us, ord)),
gaps as (select mmsi, (t2 - t_us) / cast(1e6 as double) as gap_s, (x + x2) / 2 as mid_x, (y + y2) / 2 as mid_y, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) as way from legs where t2 is not null),
ints as (select mmsi, gap_s, mid_x, mid_y, case when gap_s <= 0 then 'no_elapsed_time' when way / gap_s > {cleaning.MAX_PLAUSIBLE_SPEED_MS} then 'implausible_speed' end as cause from gaps)"""
OWN = f"""own as (select cast(floor(mid_x / {v.CELL_M}) as bigint) as ix, cast(floor(mid_y / {v.CELL_M}) as bigint) as iy, sum(least(gap_s, {2 * v.MAX_GAP_S})) as c, sum(gap_s) as t, count(*) as n
  from ints where cause is null group by 1, 2),
cells as (select ix + dx as ix, iy + dy as iy, sum(c) as c, sum(t) as t, cast(sum(n) as double) as n from own, (values (-1), (0), (1)) as a(dx), (values (-1), (0), (1)) as b(dy) group by 1, 2),
model as (select ix, iy, case when n >= 5 and t <> 0 then c / t end as p, n, t from cells)"""


@query(with_(AIS, LEGS, select=f"select mmsi, cause, {r6('gap_s', 'mid_x', 'mid_y')} from ints"))
def reception_intervals(spark, sf_dir):
    return rounded(reception.intervals(v.ais(spark, sf_dir)))


@query(
    with_(AIS, LEGS, select="select count(*) + (select greatest(count(distinct mmsi) - 1, 0) from ais) as intervals, count(*) filter (where cause is null) as used, (select greatest(count(distinct mmsi) - 1, 0) from ais) as not_a_pair, "
    "count(*) filter (where cause = 'no_elapsed_time') as no_elapsed_time, count(*) filter (where cause = 'implausible_speed') as implausible_speed from ints")
)
def reception_report(spark, sf_dir):
    return _coverage(spark, sf_dir).report


@query(with_(AIS, LEGS, OWN, select=f"select ix * {v.CELL_M}::double as x0, iy * {v.CELL_M}::double as y0, (ix + 1) * {v.CELL_M}::double as x1, (iy + 1) * {v.CELL_M}::double as y1, round(p, 6) + 0 as reception_p, n as intervals, round(t, 6) + 0 as observed_s from model"))
def reception_cells(spark, sf_dir):
    return rounded(reception.cells(_coverage(spark, sf_dir)))


MARKED = f"""marked as (select k.*, m.p as reception_p, case when m.p is null then 'insufficient_evidence' else 'estimated' end as reception_basis, coalesce(m.n, 0) as reception_intervals,
    case when k.status = 'dark' and m.p < 0.9 then 'shadowed' else k.status end as final
  from classed k left join model m on m.ix = cast(floor(k.x / {v.CELL_M}) as bigint) and m.iy = cast(floor(k.y / {v.CELL_M}) as bigint))"""


def _marked(spark, sf_dir):
    return reception.mark(_match(spark, sf_dir).detections, _coverage(spark, sf_dir), 0.9)


@query(with_(*CLASSIFIED, LEGS, OWN, MARKED, select="select det_id, final as status, round(reception_p, 6) + 0 as reception_p, reception_basis, cast(reception_intervals as double) as reception_intervals from marked"))
def reception_mark(spark, sf_dir):
    return rounded(_marked(spark, sf_dir).select("det_id", "status", "reception_p", "reception_basis", "reception_intervals"))


# -- declarations -----------------------------------------------------------------------------------------------

_PX, _PY = f"(w.x - {SCENE['c']}) / {SCENE['a']}", f"(w.y - {SCENE['f']}) / {SCENE['e']}"
REVIEWED = f"""near as (select p.mmsi, min(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y))) as m from drawn p, det d group by p.mmsi),
reviewed as (select w.*, p.det_id as detection, p.distance_m as match_distance_m, n.m as nearest_detection_m,
    case when p.det_id is not null then 'explained' when not ({_PX} > 0 and {_PX} < {SCENE['width']} and {_PY} > 0 and {_PY} < {SCENE['height']}) then 'outside_scene'
      when w.length_m < 20 then 'below_detectable' else 'undetected' end as status
  from drawn w left join pairs p on p.mmsi = w.mmsi left join near n on n.mmsi = w.mmsi)"""


def _reviewed(spark, sf_dir):
    found = _match(spark, sf_dir)
    return found.detections, declarations.review(found.declared, found.detections, v.scenes(spark), v.TOLERANCE_M)


@query(
    with_(*MATCHING, PAIRS, REVIEWED, select=f"select scene, mmsi, status, length_m, detection, {r6('match_distance_m', 'nearest_detection_m')}, position_basis, {r6('position_age_s', 'position_span_s', 'azimuth_shift_m')}, "
    f"cast({v.TOLERANCE_M} as double) as tolerance_m, cast(20 as double) as smallest_detectable_m, {r6('velocity_east_ms', 'velocity_north_ms', 'x', 'y')} from reviewed")
)
def declaration_review(spark, sf_dir):
    return rounded(_reviewed(spark, sf_dir)[1].drop("first_ord"))


@query(with_(*MATCHING, PAIRS, REVIEWED, select="select count(*) as total, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in declarations.VERDICTS) + " from reviewed"))
def declaration_counts(spark, sf_dir):
    return match.status_counts(_reviewed(spark, sf_dir)[1], declarations.VERDICTS)


@query(
    with_(*CLASSIFIED, REVIEWED, select="""select b as both, r as radar_only, a as ais_only, o as outside_scene, s as below_detectable, cast(0 as bigint) as masked,
  case when b + a > 0 then round(cast(b as double) / (b + a), 6) end as apparent_recall
from (select count(*) filter (where status = 'matched') as b, count(*) filter (where status = 'dark') as r from classed),
  (select count(*) filter (where status = 'undetected') as a, count(*) filter (where status = 'outside_scene') as o, count(*) filter (where status = 'below_detectable') as s from reviewed)""")
)
def agreement(spark, sf_dir):
    return rounded(declarations.agreement(*_reviewed(spark, sf_dir)))


def _placed(df):
    """With the pixel indices of x and y, which scene S does not turn."""
    return df.withColumns({"row": (F.col("y") - SCENE["f"]) / F.lit(SCENE["e"]) - F.lit(0.5), "col": (F.col("x") - SCENE["c"]) / F.lit(SCENE["a"]) - F.lit(0.5)})


NUMBERED = "numbered as (select *, row_number() over (order by y desc, x, det_id) - 1 as index from classed)"


@query(with_(*CLASSIFIED, REVIEWED, NUMBERED, "heard as (select mmsi, min(ord) as first_ord from ais group by mmsi)", select=f"""select mmsi, row_number() over (order by first_ord) - 1 as index, round(r.x, 6) as drawn_x, round(r.y, 6) as drawn_y,
  round((r.x - {SCENE['c']}) / {SCENE['a']}, 6) + 0 as px, round((r.y - {SCENE['f']}) / {SCENE['e']}, 6) + 0 as py, round(q.x, 6) as raw_x, round(q.y, 6) as raw_y, r.status, n.index as matched_index
from reviewed r join pos q using (mmsi) join heard using (mmsi) left join numbered n on n.det_id = r.detection"""))
def declaration_records(spark, sf_dir):
    """Raw and drawn place of every declaration, numbered as first heard, with the number of what explains it."""
    found, reviewed = _reviewed(spark, sf_dir)
    rows = payload.declaration_records(reviewed, _declared(spark, sf_dir), v.scenes(spark), _placed(found))
    number = lambda c: F.col(c).cast("long").alias(c)
    return rounded(rows.select("mmsi", number("index"), "drawn_x", "drawn_y", "drawn.px", "drawn.py", F.col("declared_x").alias("raw_x"), F.col("declared_y").alias("raw_y"), "status", number("matched_index")))


# -- structures -------------------------------------------------------------------------------------------------

EDGES = f"""edges as (select a.id as a, b.id as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from sight a join sight b on a.id < b.id
    and abs(a.x - b.x) <= {v.REGISTER_M} and abs(a.y - b.y) <= {v.REGISTER_M} and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {v.REGISTER_M})"""
STANDING = """both_ways as materialized (select a, b from edges union all select b, a from edges),
member as (select s.id, s.scene, s.x, s.y, coalesce(l.label, s.id) as position_id from sight s left join (
    with recursive walk(id, label) using key (id) as (
      select id, id from sight union select w.b, min(r.label) from walk r join both_ways w on w.a = r.id join recurring.walk o on o.id = w.b where r.label < o.label group by w.b)
    select id, label from walk) l on l.id = s.id),
position as (select position_id, avg(x) as x, avg(y) as y, count(distinct scene) as acquisitions, count(*) as crops from member group by position_id)"""


@query(with_(SIGHT, EDGES, select="select a, b, round(d, 6) + 0 as distance_m from edges"))
def structure_edges(spark, sf_dir):
    return rounded(structures.sighting_edges(v.sightings(spark, sf_dir), v.REGISTER_M))


@query(with_(SIGHT, EDGES, STANDING, select="select position_id, round(x, 6) as x, round(y, 6) as y, acquisitions, crops from position"))
def standing_positions(spark, sf_dir):
    return rounded(structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M).positions)


@query(with_(SIGHT, EDGES, STANDING, select="select m.id, m.position_id, p.acquisitions from member m join position p using (position_id)"))
def acquisitions_of_members(spark, sf_dir):
    return structures.acquisitions_of_members(structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M))


@query(
    with_(*CLASSIFIED, SIGHT, EDGES, STANDING, select=f"""select det_id, case when status = 'dark' and exists (select 1 from position p where p.acquisitions >= 2
  and sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) <= {v.REGISTER_M}) then 'structure' else status end as status from classed k""")
)
def register_mark(spark, sf_dir):
    known = structures.register(structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M))
    return structures.mark_structures(_match(spark, sf_dir).detections, known, v.REGISTER_M).select("det_id", "status")


@query(
    with_(SIGHT, EDGES, STANDING, DET, "ours as (select * from position where acquisitions >= 2)",
    f"""pairwise as (select p.position_id, d.det_id, sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) as m from ours p, det d),
here as (select position_id, min(m) as m from pairwise group by 1), there as (select det_id, min(m) as m from pairwise group by 1)""",
    select=f"""select (select count(*) from det) as known, (select count(*) from ours) as registered, (select count(*) from there where m <= {v.REGISTER_M}) as found,
  (select count(*) from here where m > {v.REGISTER_M}) as unpublished, (select round(median(m), 6) from here) as median_m, cast({v.REGISTER_M} as double) as tolerance_m""")
)
def verify_register(spark, sf_dir):
    known = structures.register(structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M))
    return rounded(structures.verify(known, v.detections(spark, sf_dir), v.REGISTER_M))


@query(with_(*CLASSIFIED, LEGS, OWN, MARKED, SIGHT, EDGES, STANDING, select=f"""select det_id, case when k.status <> 'dark' then k.status when exists (select 1 from position p where p.acquisitions >= 2
  and sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) <= {v.REGISTER_M}) then 'structure' when reception_p < 0.5 then 'shadowed' else 'dark' end as status from marked k"""))
def reapply(spark, sf_dir):
    known = structures.register(structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M))
    return sweep.reapply(_marked(spark, sf_dir), known, v.REGISTER_M, 0.5).select("det_id", "status")


# -- geometry ---------------------------------------------------------------------------------------------------


@query(
    """with t as (select cr, cc, least(cr + 64, 300) as cr1, least(cc + 64, 420) as cc1 from range(0, 300, 64) a(cr), range(0, 420, 64) b(cc))
select cast(greatest(cr - 32, 0) as int) as row0, cast(greatest(cc - 32, 0) as int) as col0, cast(least(cr1 + 32, 300) as int) as row1, cast(least(cc1 + 32, 420) as int) as col1,
  cast(cr as int) as core_row0, cast(cc as int) as core_col0, cast(cr1 as int) as core_row1, cast(cc1 as int) as core_col1 from t"""
)
def tiling(spark, sf_dir):
    return pixels.tiling(300, 420, 128, 32, spark)


_A, _B, _C, _D, _E, _F = 4.0, 0.5, 500000.0, -0.25, -5.0, 6140000.0


def _skewed(df):
    return df.withColumns({k: F.lit(x) for k, x in zip("abcdef", (_A, _B, _C, _D, _E, _F))})


@query(f"select c_custkey as det_id, round({_A} * (c_custkey % 300 + 0.5::double) + {_B} * (c_custkey % 200 + 0.5::double) + {_C}, 6) as x, round({_D} * (c_custkey % 300 + 0.5::double) + {_E} * (c_custkey % 200 + 0.5::double) + {_F}, 6) as y from customer")
def to_ground(spark, sf_dir):
    rows = _skewed(v.table(spark, sf_dir, "customer").select("c_custkey"))
    x, y = geo.ground((F.col("c_custkey") % 200).cast("double"), (F.col("c_custkey") % 300).cast("double"))
    return rounded(rows.select(F.col("c_custkey").alias("det_id"), x.alias("x"), y.alias("y")))


@query(with_(DET, select=f"select det_id, round(({_E} * (x - {_C}) - {_B} * (y - {_F})) / ({_A * _E - _B * _D}), 6) + 0 as px, round(({_A} * (y - {_F}) - {_D} * (x - {_C})) / ({_A * _E - _B * _D}), 6) + 0 as py from det"))
def to_pixel(spark, sf_dir):
    px, py = geo.pixel(F.col("x"), F.col("y"))
    return rounded(_skewed(v.detections(spark, sf_dir)).select("det_id", px.alias("px"), py.alias("py")))


_TM = geo.TransverseMercator.of("EPSG:25832")
_SERIES = lambda f, g: " + ".join(f"{a!r}::double * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(_TM.alpha, 1))


@query(
    f"""with p as (select c_custkey as id, radians(50 + (c_custkey % 1000) / 100.0::double) as lat, radians(6 + (c_custkey % 700) / 100.0::double) - {_TM.lon0!r}::double as dl from customer),
t as (select id, dl, sinh(atanh(sin(lat)) - {_TM.e!r}::double * atanh({_TM.e!r}::double * sin(lat))) as t from p),
q as (select id, atan2(t, cos(dl)) as xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) as eta from t)
select id, round(500000 + {geo.UTM_K0 * _TM.radius!r}::double * (eta + {_SERIES('cos', 'sinh')}), 3) as x, round({geo.UTM_K0 * _TM.radius!r}::double * (xi + {_SERIES('sin', 'cosh')}), 3) as y from q"""
)
def utm_forward(spark, sf_dir):
    key = F.col("c_custkey")
    x, y = _TM.forward(6 + (key % 700) / F.lit(100.0), 50 + (key % 1000) / F.lit(100.0))
    return rounded(v.table(spark, sf_dir, "customer").select(key.alias("id"), x.alias("x"), y.alias("y")), 3)


# -- images -----------------------------------------------------------------------------------------------------


def _blob_sql(condition: str, source: str) -> str:
    return f"""px as (select r, c, r * 96 + c as id, v from {source} where {condition}),
adj as (select a.id as a, b.id as b from px a join px b on (abs(a.r - b.r) + abs(a.c - b.c)) = 1),
walk(a, b) as (select id, id from px union select w.a, x.b from walk w join adj x on w.b = x.a),
lab as (select a as id, min(b) as region from walk group by a)"""


@query(with_(GRID, _blob_sql("v >= 1", "grid"), select="select region, round(avg(r), 6) as row, round(avg(c), 6) as col, count(*) as size from lab join px using (id) group by region"))
def stub_blobs(spark, sf_dir):
    return rounded(pixels.bright_blobs(_image(spark), 1.0, 96).drop("image"))


def box_sql(sizes: dict[str, int], source: str = "grid", image: str = "") -> str:
    """CFAR statistic of the pixels of ``source``, for each value of the columns ``image`` on its own."""
    cols = ("s", "n", "q")
    over = lambda k, by, along: f"sum({{}}) over (partition by {image}{by} order by {along} range between {sizes[k] // 2} preceding and {sizes[k] // 2} following)"
    one = ", ".join(f"{over(k, 'r', 'c').format(c)} as {k}_{c}" for k in sizes for c in cols)
    two = ", ".join(f"{over(k, 'c', 'r').format(f'{k}_{c}')} as {k}{c}" for k in sizes for c in cols)
    return f"""base as (select {image}r, c, v as s, cast(v <> 0 as int)::double as n, v * v as q from {source}),
h as (select *, {one} from base), w as (select {image}r, c, n, {two} from h),
ring as (select *, bn - gn as seen, greatest(bn - gn, 1) as m, (bs - gs) / greatest(bn - gn, 1) as mean from w),
stat as (select {image}r, c, case when n > 0 and seen >= {0.25 * (sizes['b'] ** 2 - sizes['g'] ** 2)} then (ts / greatest(tn, 1) - mean) / (sqrt(greatest((bq - gq) / m - mean * mean, 0)) + cast(1e-3 as double)) else 0 end as v from ring)"""


_STAT = box_sql({"t": 3, "g": 9, "b": 17})


def _z(spark):
    return pixels.cfar_statistic(_image(spark), 3, 9, 17)


@query(with_(GRID, _STAT, select="select r, c, round(v, 6) + 0 as z from stat"))
def cfar_statistic(spark, sf_dir):
    return rounded(_z(spark).drop("image"))


@query(
    with_(GRID, _STAT.replace("stat as (", "stat as materialized ("), _blob_sql("v >= 1.5", "stat"), select="""select region, round(sum((greatest(v - 1.5, 0) + cast(1e-6 as double)) * r) / sum(greatest(v - 1.5, 0) + cast(1e-6 as double)), 4) as row,
  round(sum((greatest(v - 1.5, 0) + cast(1e-6 as double)) * c) / sum(greatest(v - 1.5, 0) + cast(1e-6 as double)), 4) as col, round(max(v), 4) as score, count(*) as size
from lab join px using (id) group by region having count(*) >= 2""")
)
def cfar_blobs(spark, sf_dir):
    return rounded(pixels.cfar_blobs(_z(spark), 1.5, 96).drop("image"), 4)


@query(with_(GRID, """a as (select *, max(v) over (partition by r order by c range between 2 preceding and 2 following) as m1 from grid),
b as (select *, max(m1) over (partition by c order by r range between 2 preceding and 2 following) as m2 from a)""", select="select r, c, v from b where v = m2 and v >= 0.1 and v <> 0"))
def local_maxima(spark, sf_dir):
    return pixels.local_maxima(_image(spark), 0.1).drop("image")


@query(with_(GRID, "p as (select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.995) as hi from grid)", select="select r, c, cast(round_even((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255, 0) as int) as grey from grid, p"))
def stretch(spark, sf_dir):
    return pixels.stretch(_image(spark)).drop("image")


@query(with_(GRID, "m as (select median(v) as med from grid where v <> 0), d as (select median(abs(v - med)) as mad from grid, m where v <> 0)",
    select="select r, c, round(least(greatest((v - med) / (cast(1.4826 as double) * mad), -4), 40) / 10, 6) + 0 as z, v <> 0 as valid from grid, m, d"))
def robust_z(spark, sf_dir):
    return rounded(pixels.robust_z(_image(spark)).drop("image"))


_BOXED = "select s_suppkey as box_id, cast((s_suppkey * 37) % 300 as double) as x0, cast((s_suppkey * 53) % 200 as double) as y0, cast((s_suppkey * 37) % 300 + 2 + s_suppkey % 31 as double) as x1, cast((s_suppkey * 53) % 200 + 2 + s_suppkey % 23 as double) as y1 from supplier"


def _boxed(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 37) % 300, (k * 53) % 200
    return v.table(spark, sf_dir, "supplier").select(
        F.lit(0).cast("long").alias("image"), k.alias("box_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 2 + k % 31).cast("double").alias("x1"), (y + 2 + k % 23).cast("double").alias("y1")
    )


@query(f"""with b as ({_BOXED}), m as (select cast(floor((y0 + y1) / 2) as bigint) as mr, cast(floor((x0 + x1) / 2) as bigint) as mc, least(greatest(least(x1 - x0, y1 - y0) / cast(6 as double), 1), 4) as s from b),
n as (select *, cast(floor(3 * s) as bigint) + 1 as reach from m where mr between 0 and 199 and mc between 0 and 299)
select u.r, w.c, round(max(exp(-((u.r - mr) * (u.r - mr) + (w.c - mc) * (w.c - mc)) / (2 * s * s))), 6) as heat
from n, range(0, 200) u(r), range(0, 300) w(c) where abs(u.r - mr) <= reach and abs(w.c - mc) <= reach group by u.r, w.c""")
def heatmap(spark, sf_dir):
    out = pixels.heatmap(_boxed(spark, sf_dir), 200, 300)
    return rounded(out.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "heat"))


# -- scores -----------------------------------------------------------------------------------------------------

RANKED = """ranked as (select id, score, hit, sum(cast(hit as int)) over w as tp, sum(cast(not hit as int)) over w as fp from score window w as (order by score desc, id rows unbounded preceding)),
ships as (select count(*) as ships from score)"""
_SCORES = """round_even(case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 1 end, 4) as precision, round_even(cast(tp as double) / ships, 4) as recall, round_even(cast(2 * tp as double) / (tp + fp + ships), 4) as f1"""


@query(with_(SCORE, RANKED, select=f"select score as threshold, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives, cast(ships - tp as bigint) as false_negatives, {_SCORES} from ranked, ships order by cast(2 * tp as double) / (tp + fp + ships) desc, score desc, id limit 1"))
def best_f1(spark, sf_dir):
    scored = v.scored(spark, sf_dir)
    return evaluate.best_f1(scored, scored.count())


@query(with_(SCORE, "t as (select count(*) filter (where hit) as tp, count(*) filter (where not hit) as fp from score where score >= 1500), ships as (select count(*) as ships from score)",
    select=f"select cast(1500 as double) as threshold, tp as true_positives, fp as false_positives, ships - tp as false_negatives, {_SCORES} from t, ships"))
def at_threshold(spark, sf_dir):
    scored = v.scored(spark, sf_dir)
    return evaluate.at_threshold(scored, scored.count(), 1500.0)


@query(with_(SCORE, RANKED, "env as (select hit, max(cast(tp as double) / (tp + fp)) over (order by score desc, id rows between current row and unbounded following) as p from ranked)",
    select="select round(sum(p) filter (where hit) / (select ships from ships), 6) as average_precision from env"))
def average_precision(spark, sf_dir):
    scored = v.scored(spark, sf_dir)
    return rounded(evaluate.average_precision(scored, scored.count()))


# -- labels -----------------------------------------------------------------------------------------------------

_NAME = "lpad(cast(doc_id % 15 + 1 as varchar), 2, '0') || '_' || cast(doc_id as varchar)"


@query(f"""with n as (select {_NAME} as image, doc_id % 15 + 1 as s, quality, toxic from labels),
tr as (select image from n where s <= 11), te as (select image from n where s >= 11), ins as (select image from te where image in (select image from n where toxic = 1)),
off as (select image from n where s >= 12 and toxic = 0), disk as (select {_NAME} as image from documents),
b as (select image from ins union select image from off),
r as (select 1 as ordinal, 'sub-image in both train and test' as rule, (select count(*) from (select image from tr intersect select image from te)) as n
union all select 2, 'scene in both train and test', (select count(*) from (select split_part(image, '_', 1) from tr intersect select split_part(image, '_', 1) from te))
union all select 3, 'inshore + offshore does not equal test', (select count(*) from (select image from b except select image from te)) + (select count(*) from (select image from te except select image from b))
union all select 4, 'image on disk in no split', (select count(*) from (select image from disk except (select image from tr union select image from te))))
select * from r where n > 0""")
def split_audit(spark, sf_dir):
    name = F.concat(F.lpad((F.col("doc_id") % 15 + 1).cast("string"), 2, "0"), F.lit("_"), F.col("doc_id").cast("string")).alias("image")
    n = v.table(spark, sf_dir, "labels").select(name, (F.col("doc_id") % 15 + 1).alias("s"), "toxic")
    test = n.where("s >= 11")
    return boxes.audit_splits(n.where("s <= 11"), test, test.where("toxic = 1"), n.where("s >= 12 and toxic = 0"), v.table(spark, sf_dir, "documents").select(name))


_RAW = """select cast(o_custkey % 50 as bigint) as image, cast(o_orderkey as bigint) as box_id, cast((o_orderkey * 37) % 830 - 10 as double) as x0, cast((o_orderkey * 53) % 830 - 10 as double) as y0,
  cast((o_orderkey * 37) % 830 - 10 + (o_orderkey * 7) % 40 - 3 as double) as x1, cast((o_orderkey * 53) % 830 - 10 + (o_orderkey * 11) % 40 - 3 as double) as y1 from orders"""


def _raw_boxes(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    x, y = (k * 37) % 830 - 10, (k * 53) % 830 - 10
    d = lambda c: c.cast("double")
    return v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("long").alias("image"), k.alias("box_id"), d(x).alias("x0"), d(y).alias("y0"), d(x + (k * 7) % 40 - 3).alias("x1"), d(y + (k * 11) % 40 - 3).alias("y1"))


_FIXED = f"""raw as ({_RAW}), f as (select image, box_id, x0 > x1 or y0 > y1 as swap, least(x0, x1) as x0, least(y0, y1) as y0, greatest(x0, x1) as x1, greatest(y0, y1) as y1 from raw),
k as (select *, least(greatest(x0, 0), 800) as a0, least(greatest(y0, 0), 800) as b0, least(greatest(x1, 0), 800) as a1, least(greatest(y1, 0), 800) as b1 from f),
t as (select *, a0 <> x0 or b0 <> y0 or a1 <> x1 or b1 <> y1 as cut, a1 - a0 < 1 or b1 - b0 < 1 as tiny from k),
u as (select *, not tiny and row_number() over (partition by image, tiny, a0, b0, a1, b1 order by box_id) > 1 as again from t)"""


@query(with_(_FIXED, select="select image, box_id, a0 as x0, b0 as y0, a1 as x1, b1 as y1, swap as swapped, cut as clipped, tiny, again from u"))
def box_clean(spark, sf_dir):
    """The rules that do not depend on the order of overlaps; the whole chain is ``box_audit``."""
    marked = boxes.mark_boxes(_raw_boxes(spark, sf_dir))
    has = lambda r: F.array_contains("rules", r)
    return marked.select("image", "box_id", "x0", "y0", "x1", "y1", has(boxes.SWAPPED).alias("swapped"), has(boxes.CLIPPED).alias("clipped"), has(boxes.TINY).alias("tiny"), has(boxes.REPEATED).alias("again"))


_SHARED = "greatest(0, least(n.a1, q.a1) - greatest(n.a0, q.a0)) * greatest(0, least(n.b1, q.b1) - greatest(n.b0, q.b0))"
_UNION = f"((n.a1 - n.a0) * (n.b1 - n.b0) + (q.a1 - q.a0) * (q.b1 - q.b0) - {_SHARED})"


@query(
    with_(_FIXED, f"""n as (select image, box_id, a0, b0, a1, b1, row_number() over (partition by image order by box_id) as k from u where not tiny and not again),
walk(image, k, kept, twice) as (
  select distinct image, cast(0 as bigint), list_filter([struct_pack(a0 := 0::double, b0 := 0::double, a1 := 0::double, b1 := 0::double)], lambda q: false), list_filter([0::bigint], lambda q: false) from n
  union all select image, k, case when hit then kept else list_append(kept, box) end, case when hit then list_append(twice, box_id) else twice end
  from (select w.image, n.k, w.kept, w.twice, n.box_id, struct_pack({', '.join(f'{c} := n.{c}' for c in ('a0', 'b0', 'a1', 'b1'))}) as box, len(list_filter(w.kept, lambda q: {_SHARED} / {_UNION} > {boxes.NEAR_IOU}::double)) > 0 as hit
    from walk w join n on n.image = w.image and n.k = w.k + 1)),
dup as (select image, unnest(arg_max(twice, k)) as box_id from walk group by image),
met as (select image, 1 as ordinal from u where swap union all select image, 2 from u where cut union all select image, 3 from u where tiny union all select image, 4 from u where again
  union all select image, 5 from dup union all select image, 6 from u left join dup using (image, box_id) where not tiny and not again and dup.box_id is null and greatest(a1 - a0, b1 - b0) > {boxes.SUSPICIOUS_PX}),
named as (select * from (values {', '.join(f"({i}, '{r}')" for i, r in enumerate(boxes.BOX_RULES, 1))}) as t(ordinal, rule))""",
    select="""select ordinal, rule, (select count(*) from met m where m.ordinal = d.ordinal) as n,
  (select string_agg(cast(image as varchar), ',' order by image) from (select distinct image from met m where m.ordinal = d.ordinal order by image limit 5)) as examples
from named d where exists (select 1 from met m where m.ordinal = d.ordinal)""")
)
def box_audit(spark, sf_dir):
    """The whole chain with its greedy removal of overlapping boxes, box by box in the counterpart."""
    found = boxes.audit(boxes.mark_boxes(_raw_boxes(spark, sf_dir)))
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


# -- sweeps -----------------------------------------------------------------------------------------------------


@query(
    """with t as (select unnest(range(1, 21)) / cast(20 as double) as detector_threshold), g as (select unnest([1, 2, 5, 10, 15, 20, 30, 45, 60, 90, 120]::double[]) as max_gap_minutes),
a as (select unnest([true, false]) as apply_azimuth), m as (select unnest(range(25, 1001, 25))::double as tolerance_m)
select row_number() over (order by detector_threshold, max_gap_minutes, apply_azimuth desc, tolerance_m) - 1 as run, detector_threshold, max_gap_minutes, apply_azimuth, tolerance_m from t, g, a, m"""
)
def sweep_grid(spark, sf_dir):
    rows = sweep.grid(spark)
    return rows.withColumn("run", F.col("run").cast("long"))


GAPS = [30.0, 60.0, 120.0, 240.0, 360.0, 720.0, 1440.0, 2880.0, 100000.0, 200000.0]


@query(
    with_(AIS, POSITIONS.replace(f"<= {v.MAX_GAP_S})", "<= 1e12)"), f"g as (select unnest({GAPS}::double[]) as gap), n as (select gap, (select count(*) from pos where position_age_s <= gap * 60) as k from g)",
    select="select gap, min(gap) over (partition by k) as representative from n")
)
def run_dedup(spark, sf_dir):
    """Gaps that declare the same vessels share a run: the least of them stands for all."""
    placed = positions_at(v.ais(spark, sf_dir), v.scenes(spark), 1e12)
    plan = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in GAPS])).alias("gap"))
    kept = plan.join(placed, F.col("position_age_s") <= F.col("gap") * 60, "left")
    keys = sweep.digest(kept, ["gap"], ["mmsi", "position_basis"])
    return sweep.representatives(keys, "gap", "key")


@query()
def sweep_runs(spark, sf_dir):
    """Matched and dark of the whole grid in one job; tests hold each run against a run of its own."""
    plan = sweep.grid(spark)
    return rounded(sweep.outcomes(v.detections(spark, sf_dir), v.ais(spark, sf_dir), v.scenes(spark), plan.withColumn("max_gap_minutes", F.col("max_gap_minutes") * 36)))


@query(with_(DET, select="select det_id, x, y, e.embedding[1] as first_value, len(e.embedding) as n_values from det left join embeddings e on e.vec_id = det.det_id"))
def embedding_attach(spark, sf_dir):
    vectors = v.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "det_id")
    out = attach_embedding(v.detections(spark, sf_dir), vectors)
    return out.select("det_id", "x", "y", F.get("embedding", F.lit(0)).alias("first_value"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("n_values"))


# -- views of results -------------------------------------------------------------------------------------------


@query(with_(AIS, LEGS, OWN, select=f"""select round_even((least(ix * {v.CELL_M}, (ix + 1) * {v.CELL_M}) - {SCENE['c']})::double / {SCENE['a']}::double, 2) + 0 as px,
  round_even(({SCENE['f']} - (iy + 1) * {v.CELL_M})::double / {-SCENE['e']}::double, 2) + 0 as py, {v.CELL_M / SCENE['a']}::double as pw, {v.CELL_M / -SCENE['e']}::double as ph, round_even(p, 4) as reception_p, n as intervals
from model where (ix + 1) * {v.CELL_M} > {SCENE['c']} and ix * {v.CELL_M} < {SCENE['c'] + SCENE['width'] * SCENE['a']} and (iy + 1) * {v.CELL_M} > {SCENE['f'] + SCENE['height'] * SCENE['e']} and iy * {v.CELL_M} < {SCENE['f']}"""))
def reception_visible(spark, sf_dir):
    """Cells that overlap the scene, as pixel boxes for drawing."""
    box = (SCENE["c"], SCENE["f"] + SCENE["height"] * SCENE["e"], SCENE["c"] + SCENE["width"] * SCENE["a"], SCENE["f"])
    seen = reception.visible(reception.cells(_coverage(spark, sf_dir)), *box).withColumns({k: F.lit(SCENE[k]) for k in "abcdef"})
    drawn = seen.select(geo.pixel_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"), F.bround("reception_p", 4).alias("reception_p"), "intervals")
    return rounded(drawn.select("box.*", "reception_p", "intervals"))


@query(f"""select 'S' as scene, i as corner, {SCENE['c']}::double + case when i in (1, 2) then {SCENE['width'] * SCENE['a']} else 0 end as x, {SCENE['f']}::double + case when i in (2, 3) then {SCENE['height'] * SCENE['e']} else 0 end as y
from range(4) t(i)""")
def footprint(spark, sf_dir):
    corners = v.scenes(spark).select("scene", F.posexplode(geo.footprint()).alias("corner", "at"))
    return corners.select("scene", F.col("corner").cast("long").alias("corner"), "at.x", "at.y")


@query(with_(*CLASSIFIED, NUMBERED, select="select det_id, index, status from numbered"))
def detection_index(spark, sf_dir):
    """Positional index of detections: reading order of their places, per scene."""
    rows = payload.detection_records(_placed(_match(spark, sf_dir).detections))
    return rows.select("det_id", F.col("index").cast("long").alias("index"), "status")


@query(with_(*CLASSIFIED, LEGS, OWN, MARKED, NUMBERED, select="select n.index + 1 as detection, m.final as status, m.mmsi, m.x, m.y, round(m.match_distance_m, 6) as match_distance_m, m.position_basis, m.reception_basis, strftime(make_timestamp(m.acquired_at), '%Y-%m-%dT%H:%M:%SZ') as acquired_at, m.scene from marked m join numbered n using (det_id) where m.final = 'dark'"))
def dark_table(spark, sf_dir):
    """The table of one status, with the export's numbering and texts."""
    rows = payload.detections_for_csv(_placed(_marked(spark, sf_dir))).where(F.col("status") == match.DARK)
    return rounded(rows.select(F.col("detection").cast("long").alias("detection"), "status", "mmsi", "x", "y", "match_distance_m", "position_basis", "reception_basis", "acquired_at", "scene"))


@query(with_(SIGHT, EDGES, STANDING, select="select id, dense_rank() over (order by position_id) - 1 as position from member"))
def position_ids(spark, sf_dir):
    found = structures.standing(v.sightings(spark, sf_dir), v.REGISTER_M)
    return structures.dense_ids(found).withColumn("position", F.col("position").cast("long"))


@query(f"with b as ({_BOXED}) select box_id, (y0 + y1) / 2 as row, (x0 + x1) / 2 as col, split_part(lpad(cast(box_id % 15 as varchar), 2, '0') || '_' || cast(box_id as varchar), '_', 1) as scene from b")
def box_centres(spark, sf_dir):
    rows = boxes.centres(_boxed(spark, sf_dir)).withColumn("image", F.concat(F.lpad((F.col("box_id") % 15).cast("string"), 2, "0"), F.lit("_"), F.col("box_id").cast("string")))
    return rows.select("box_id", "row", "col", boxes.scene_of().alias("scene"))


@query("""select c_custkey % 40 as image, avg(case when c_custkey % 7 < c_custkey % 40 % 8 then 1 else 0 end) as nodata, avg(case when c_custkey % 7 < c_custkey % 40 % 8 then 1 else 0 end) >= 0.5 as mostly_outside from customer group by 1""")
def nodata_share(spark, sf_dir):
    k = F.col("c_custkey")
    px = v.table(spark, sf_dir, "customer").select((k % 40).alias("image"), F.when(k % 7 < k % 40 % 8, F.lit(0.0)).otherwise(F.lit(1.0)).alias("v"))
    return boxes.nodata_share(px)


@query("select event_id, case when isnan(v) or isinf(v) or v = -1 then 0 else v end as v from (select event_id, case event_id % 5 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then -1 else \"value\" end as v from events)")
def cleaned_pixels(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(-1.0)).otherwise(F.col("value"))
    return v.table(spark, sf_dir, "events").select("event_id", pixels.cleaned(raw, -1.0).alias("v"))


@query("select item as value, try_cast(split_part(item, ',', 1) as double) as x, try_cast(split_part(item, ',', 2) as double) as y from (select cast(c_custkey as varchar) || case when c_custkey % 9 = 0 then ';' else ',' end || cast(c_nationkey as varchar) as item from customer)")
def register_texts(spark, sf_dir):
    """Positions from ``x,y`` texts; what is malformed gives NULL, where the request parser refuses it."""
    sep = F.when(F.col("c_custkey") % 9 == 0, F.lit(";")).otherwise(F.lit(","))
    text = v.table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), sep, F.col("c_nationkey").cast("string")).alias("value"))
    return text.select("value", payload.position_of(F.col("value")).alias("at")).select("value", "at.x", "at.y")


@query(with_("m as (select unnest(range(25, 1001, 25))::double as tolerance_m), g as (select unnest([1, 2, 5, 10, 15, 20, 30, 45, 60, 90, 120]::double[]) as gap)",
    select="select gap as max_gap_minutes, tolerance_m, ((9 * 11 + (select count(*) from g x where x.gap < g.gap)) * 2) * 40 + cast(tolerance_m / 25 as bigint) - 1 as run from g, m"))
def run_lookup(spark, sf_dir):
    """The run of each grid position at the configured threshold with the correction on, found by its four keys."""
    grid = {"detector_threshold": sweep.THRESHOLDS, "max_gap_minutes": sweep.GAPS_MINUTES, "apply_azimuth": [True, False], "tolerance_m": sweep.TOLERANCES_M}
    manifest = {"order": bundle.ORDER, "grid": grid, "runs": range(17600)}
    rows = [(g, t, bundle.run_at(manifest, detector_threshold=0.5, max_gap_minutes=g, apply_azimuth=True, tolerance_m=t)) for g in sweep.GAPS_MINUTES for t in sweep.TOLERANCES_M]
    return spark.createDataFrame(rows, "max_gap_minutes double, tolerance_m double, run long")
