"""The driver's tables seen as archives, detections, sightings and scores, in Spark and in SQL.

None of those tables holds positions or images, so coordinates are integer arithmetic over all their rows.
Times of some vessels are mirrored at the instant, so that every way of placing a vessel occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-15T12:00Z, and the parameters of the catalogue's queries.
INSTANT_US = 1705320000000000
MAX_GAP_S, TOLERANCE_M, CELL_M, REGISTER_M = 21600.0, 600.0, 1000.0, 100.0
#: One scene of 10 m pixels; it does not cover the west of the area.
SCENE = dict(
    scene="S", t_us=INSTANT_US, a=10.0, b=0.0, c=510000.0, d=0.0, e=-10.0, f=6140000.0, width=3000, height=4000,
    crs="EPSG:25832", heading_deg=350.0, incidence_deg=35.0, shift_per_mps=113.0,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession) -> DataFrame:
    literals = [F.lit(v).alias(k) for k, v in SCENE.items()]
    return spark.range(1).select(*literals).withColumns({k: F.col(k).cast("long") for k in ("t_us", "width", "height")})


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    late, early = (F.col("user_id") % 4 == 1) & (t > INSTANT_US), (F.col("user_id") % 4 == 2) & (t <= INSTANT_US)
    return events.select(
        F.col("user_id").cast("string").alias("mmsi"),
        F.when(late, 2 * INSTANT_US - t).when(early, 2 * INSTANT_US - t + 1).otherwise(t).alias("t_us"),
        F.col("event_id").cast("long").alias("ord"),
        (500000 + (F.col("event_id") * 7919) % 40000).cast("double").alias("x"),
        (6100000 + (F.col("event_id") * 104729) % 40000).cast("double").alias("y"),
        F.when(F.col("user_id") % 11 != 3, (10 + F.col("user_id") % 97).cast("double")).alias("length_m"),
        (F.col("value") * F.lit(0.514444)).alias("speed_ms"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(
        F.lit("S").alias("scene"), key.alias("det_id"), (500000 + (key * 3571) % 40000).cast("double").alias("x"), (6100000 + (key * 15485863) % 40000).cast("double").alias("y")
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, cust = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    return table(spark, sf_dir, "orders").select(
        order.alias("id"),
        F.concat(F.lit("S"), F.year("o_orderdate").cast("string")).alias("scene"),
        (500000 + (cust * 3571) % 40000 + order % 40).cast("double").alias("x"),
        (6100000 + (cust * 15485863) % 40000 + F.floor(order / 40).cast("long") % 40).cast("double").alias("y"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("hit"))


def grid(spark: SparkSession, side: int = 96) -> DataFrame:
    """A small image: 2x2 plateaus on a patterned background."""
    cells = spark.range(side * side).select(F.floor(F.col("id") / side).cast("long").alias("r"), (F.col("id") % side).alias("c"))
    half = lambda c: F.floor(F.col(c) / 2).cast("long")
    bright = (half("r") * 31 + half("c") * 17) % 97 < 3
    dim = ((F.col("r") * 7 + F.col("c") * 13) % 10 + 1).cast("double") / F.lit(100.0)
    return cells.select("r", "c", F.when(bright, F.lit(1.0)).otherwise(dim).alias("v"))


# The same views for DuckDB, as common table expressions.
AIS = f"""ais as (
  select cast(user_id as varchar) as mmsi,
    case when user_id % 4 = 1 and epoch_us(ts) > {INSTANT_US} then {2 * INSTANT_US} - epoch_us(ts)
         when user_id % 4 = 2 and epoch_us(ts) <= {INSTANT_US} then {2 * INSTANT_US} - epoch_us(ts) + 1 else epoch_us(ts) end as t_us,
    cast(event_id as bigint) as ord, cast(500000 + (event_id * 7919) % 40000 as double) as x, cast(6100000 + (event_id * 104729) % 40000 as double) as y,
    case when user_id % 11 = 3 then null else cast(10 + user_id % 97 as double) end as length_m, "value" * cast(0.514444 as double) as speed_ms
  from events)"""

DET = """det as (select 'S' as scene, cast(c_custkey as bigint) as det_id, cast(500000 + (cast(c_custkey as bigint) * 3571) % 40000 as double) as x,
  cast(6100000 + (cast(c_custkey as bigint) * 15485863) % 40000 as double) as y from customer)"""

SIGHT = """sight as (select cast(o_orderkey as bigint) as id, 'S' || cast(year(o_orderdate) as varchar) as scene,
  cast(500000 + (cast(o_custkey as bigint) * 3571) % 40000 + o_orderkey % 40 as double) as x,
  cast(6100000 + (cast(o_custkey as bigint) * 15485863) % 40000 + (o_orderkey // 40) % 40 as double) as y from orders)"""

SCORE = """score as (select d.doc_id as id, cast(n_chars as double) as score, (quality = 1) as hit from documents d join labels l using (doc_id))"""

GRID = """grid as (select r, c, case when ((r // 2) * 31 + (c // 2) * 17) % 97 < 3 then cast(1 as double)
  else cast((r * 7 + c * 13) % 10 + 1 as double) / cast(100 as double) end as v from range(0, 96) a(r), range(0, 96) b(c))"""

#: Numbered reports of each vessel and what a placement needs of them.
POSITIONS = f"""num as (select *, row_number() over (partition by mmsi order by t_us, ord) as rn, count(*) over (partition by mmsi) as n,
    count(*) filter (where t_us <= {INSTANT_US}) over (partition by mmsi) as nb from ais),
trk as (select mmsi, max(n) as n, max(nb) as nb,
    {', '.join(f"max(case when rn = {w} then {c} end) as {k}_{c}" for k, w in (("l", "nb"), ("r", "nb + 1"), ("f", "1"), ("z", "n"), ("p", "n - 1")) for c in ("t_us", "x", "y", "length_m"))}
  from num group by mmsi),
fix as (select *, nb > 0 and nb < n as held, case when nb > 0 then z_t_us else f_t_us end as near_t, case when nb > 0 then z_x else f_x end as near_x,
    case when nb > 0 then z_y else f_y end as near_y, (r_t_us - l_t_us) / cast(1e6 as double) as span, (z_t_us - p_t_us) / cast(1e6 as double) as hist from trk),
pos as (select 'S' as scene, mmsi, z_length_m as length_m, case when held then 'interpolated' else 'nearest' end as position_basis,
    case when held then cast(0 as double) else abs({INSTANT_US} - near_t) / cast(1e6 as double) end as position_age_s, case when held then span end as position_span_s,
    case when held then (r_x - l_x) / span when hist > 0 then (z_x - p_x) / hist end as velocity_east_ms,
    case when held then (r_y - l_y) / span when hist > 0 then (z_y - p_y) / hist end as velocity_north_ms,
    case when held then l_x + (({INSTANT_US} - l_t_us) / cast(1e6 as double)) / span * (r_x - l_x) else near_x end as x,
    case when held then l_y + (({INSTANT_US} - l_t_us) / cast(1e6 as double)) / span * (r_y - l_y) else near_y end as y
  from fix where held or abs({INSTANT_US} - near_t) / cast(1e6 as double) <= {MAX_GAP_S})"""

#: Positions where the radar draws them, and the pairs within the tolerance.
DRAWN = f"""shift as (select *, {SCENE['shift_per_mps']}::double * ((velocity_east_ms * cos(radians({SCENE['heading_deg']}::double)) - velocity_north_ms * sin(radians({SCENE['heading_deg']}::double)))
    * sin(radians({SCENE['incidence_deg']}::double))) as along from pos),
drawn as (select scene, mmsi, length_m, position_basis, position_age_s, position_span_s, velocity_east_ms, velocity_north_ms,
    x + coalesce(along * sin(radians({SCENE['heading_deg']}::double)), 0) as x, y + coalesce(along * cos(radians({SCENE['heading_deg']}::double)), 0) as y,
    sqrt(along * sin(radians({SCENE['heading_deg']}::double)) * along * sin(radians({SCENE['heading_deg']}::double)) + along * cos(radians({SCENE['heading_deg']}::double)) * along * cos(radians({SCENE['heading_deg']}::double))) as azimuth_shift_m
  from shift)"""

CAND = f"""cand as (select d.scene, det_id, mmsi, sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) as distance_m from det d, drawn p
  where abs(d.x - p.x) <= {TOLERANCE_M} and abs(d.y - p.y) <= {TOLERANCE_M} and sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) <= {TOLERANCE_M})"""

#: The best subset of each connected part's pairs: most pairs, then least total.
PAIRS = """nodes as (select distinct 'd' || det_id as a, 'm' || mmsi as b from cand),
arcs as (select a, b from nodes union select b, a from nodes),
reach(a, b) as (select a, a from arcs union select r.a, x.b from reach r join arcs x on r.b = x.a),
part as (select a, min(b) as label from reach group by a),
edge as (select c.*, p.label, row_number() over (partition by p.label order by det_id, mmsi) - 1 as i, count(*) over (partition by p.label) as k
  from cand c join part p on p.a = 'd' || c.det_id),
subset as (select label, m from (select distinct label, k from edge) s, unnest(range(1, 1 << k)) as u(m)),
tally as (select s.label, s.m, count(*) as n, sum(distance_m) as total from subset s join edge e on e.label = s.label and (s.m >> e.i) & 1 = 1
  group by s.label, s.m having count(*) = count(distinct det_id) and count(*) = count(distinct mmsi)),
best as (select label, arg_min(m, total) as m from (select *, max(n) over (partition by label) as most from tally) where n = most group by label),
pairs as (select e.scene, e.det_id, e.mmsi, e.distance_m from best b join edge e on e.label = b.label and (b.m >> e.i) & 1 = 1)"""


def with_(*parts: str, select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select
