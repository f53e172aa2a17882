"""Queries of the spatial operators over the tables of a folder, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.vectors import Vec, pack_id
from .operators import compare, histogram, join, populations
from .operators.index import SpatialIndex
from .operators.placement import first_free
from .operators.shapes import Box, Cylinder, Sphere
from .plans import layout
from .plans.storage import shared_dir
from .schema import BOUNDS, P1, P2, XYZ
from .sources import builders
from .streaming import standing_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- elements from the tables


def pts(spark, d) -> SpatialIndex:
    e = _table(spark, d, "embeddings")
    return SpatialIndex.of(e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].alias(c) for i, c in enumerate(XYZ)]), "point")


def spheres(spark, d) -> SpatialIndex:
    e = _table(spark, d, "embeddings")
    return SpatialIndex.of(e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].alias(c) for i, c in enumerate(XYZ)], F.abs(F.col("embedding")[3]).alias("radius")), "sphere")


def spheres_grid(spark, d) -> SpatialIndex:
    """Integer centres: boundaries are hit exactly."""
    t = _table(spark, d, "lineitem")
    return SpatialIndex.of(t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"), F.lit(1.0).alias("radius")), "sphere")


def synapses(spark, d) -> SpatialIndex:
    t = _table(spark, d, "lineitem")
    return SpatialIndex.of(t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("pre_gid"), F.col("l_partkey").alias("post_gid"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_returnflag"), "synapse")


def segments(spark, d) -> SpatialIndex:
    """A segment for each embedding, and a soma for every tenth."""
    e = _table(spark, d, "embeddings")
    c = lambda i: F.col("embedding")[i]
    seg = e.select(F.col("vec_id").alias("gid"), F.lit(1).alias("section_id"), F.lit(0).alias("segment_id"), *[c(i).alias(n) for i, n in enumerate((*P1, *P2))], F.abs(c(6)).alias("radius"), F.lit(2).alias("section_type"), F.lit(False).alias("is_soma"))
    som = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("gid"), F.lit(0).alias("section_id"), F.lit(0).alias("segment_id"), *[c(7 + i).alias(n) for i, n in enumerate(P1)], *[F.lit(None).alias(n) for n in P2], F.abs(c(10)).alias("radius"), F.lit(1).alias("section_type"), F.lit(True).alias("is_soma"))
    return SpatialIndex.of(seg.unionByName(som), "morphology")


def trajectories(spark, d) -> DataFrame:
    """Points of users' tracks through (value, k, second of the hour), in order of time."""
    e = _table(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("gid"), F.lit(1).alias("section_id"), order.alias("point_idx"), F.col("value").cast("float").alias("x"), k.cast("float").alias("y"), (F.minute("ts") * 60 + F.second("ts")).cast("float").alias("z"), F.lit(1.0).cast("float").alias("radius"), F.lit(2).alias("section_type"))


def windows(spark, d, half: float = 0.08) -> DataFrame:
    """Every 50th point with a cube around it, as a table of query boxes."""
    e = _table(spark, d, "embeddings").where("vec_id % 50 = 0")
    at = [F.col("embedding")[i].cast("double") for i in range(3)]
    return e.select(F.col("vec_id").alias("window"), *[(v - half).alias(f"a{c}") for c, v in zip(XYZ, at, strict=True)], *[(v + half).alias(f"b{c}") for c, v in zip(XYZ, at, strict=True)], *[v.alias(f"q{c}") for c, v in zip(XYZ, at, strict=True)])


def window_box() -> Box:
    return Box(Vec.of(["ax", "ay", "az"]), Vec.of(["bx", "by", "bz"]))


# -- SQL of the same

_XYZ = "embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z"
_PTS = f"pts AS (SELECT vec_id id, {_XYZ} FROM embeddings)"
_SPHERES = f"spheres AS (SELECT vec_id id, {_XYZ}, abs(embedding[4]::DOUBLE) radius FROM embeddings)"
_GRID = "grid AS (SELECT l_orderkey*8+l_linenumber id, l_quantity::FLOAT::DOUBLE x, round(l_discount*100)::FLOAT::DOUBLE y, round(l_tax*100)::FLOAT::DOUBLE z, 1.0::DOUBLE radius FROM lineitem)"
_SYN = "syn AS (SELECT l_orderkey*8+l_linenumber id, l_suppkey pre_gid, l_partkey post_gid, l_quantity::FLOAT::DOUBLE x, (l_extendedprice/1000)::FLOAT::DOUBLE y, (l_discount*100)::FLOAT::DOUBLE z, l_returnflag FROM lineitem)"
_SEG = (
    "seg AS (SELECT vec_id gid, 1 section_id, 0 segment_id, embedding[1]::DOUBLE px, embedding[2]::DOUBLE py, embedding[3]::DOUBLE pz, embedding[4]::DOUBLE qx, embedding[5]::DOUBLE qy, embedding[6]::DOUBLE qz, abs(embedding[7]::DOUBLE) r FROM embeddings), "
    "som AS (SELECT vec_id gid, 0 section_id, 0 segment_id, embedding[8]::DOUBLE x, embedding[9]::DOUBLE y, embedding[10]::DOUBLE z, abs(embedding[11]::DOUBLE) radius FROM embeddings WHERE vec_id % 10 = 0)"
)
_TRACK = "track AS (SELECT user_id gid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, value::FLOAT x, coalesce((props->>'$.k')::DOUBLE, 0)::FLOAT y, (minute(ts)*60+second(ts))::FLOAT z FROM events)"
_WIN = "win AS (SELECT vec_id AS \"window\", embedding[1]::DOUBLE-0.08 ax, embedding[2]::DOUBLE-0.08 ay, embedding[3]::DOUBLE-0.08 az, embedding[1]::DOUBLE+0.08 bx, embedding[2]::DOUBLE+0.08 b_y, embedding[3]::DOUBLE+0.08 bz, embedding[1]::DOUBLE qx, embedding[2]::DOUBLE qy, embedding[3]::DOUBLE qz FROM embeddings WHERE vec_id % 50 = 0)"
_f = lambda v: f"({v}::FLOAT::DOUBLE)"


def _gap(x: str, low: str, high: str) -> str:
    return f"greatest({low} - {x}, 0, {x} - {high})"


def _box_gap(low, high, names=("x", "y", "z")) -> str:
    """Squared distance of a point and a box, by the gaps along the axes."""
    return " + ".join(f"power({_gap(n, _f(a) if not isinstance(a, str) else a, _f(b) if not isinstance(b, str) else b)}, 2)" for n, a, b in zip(names, low, high, strict=True))


def _away(c, names=("x", "y", "z")) -> str:
    return " + ".join(f"power({n} - {_f(v) if not isinstance(v, str) else v}, 2)" for n, v in zip(names, c, strict=True))


def _boxes_meet(low, high, r="radius", names=("x", "y", "z")) -> str:
    return " AND ".join(f"{n} - {r} <= {_f(b) if not isinstance(b, str) else b} AND {n} + {r} >= {_f(a) if not isinstance(a, str) else a}" for n, a, b in zip(names, low, high, strict=True))


LOW, HIGH = (-0.1, -0.12, -0.08), (0.11, 0.09, 0.1)
CENTRE, RADIUS = (0.02, -0.03, 0.01), 0.12
SYN_LOW, SYN_HIGH = (10.0, 20.0, 2.0), (30.0, 60.0, 7.0)
GRID_LOW, GRID_HIGH = (10.0, 3.0, 2.0), (20.0, 6.0, 5.0)


@query(f"WITH {_PTS} SELECT id, x::FLOAT x, y::FLOAT y, z::FLOAT z FROM pts WHERE " + " AND ".join(f"{n} > {_f(a)} AND {n} < {_f(b)}" for n, a, b in zip("xyz", LOW, HIGH, strict=True)))
def point_box(spark, d):
    return pts(spark, d).find(Box.of(LOW, HIGH)).select("id", *XYZ)


@query(f"WITH {_PTS} SELECT id FROM pts WHERE {_away(CENTRE)} <= power({_f(RADIUS)}, 2)")
def point_sphere(spark, d):
    return pts(spark, d).sphere_query(CENTRE, RADIUS, fields="id")


@query(f"WITH {_SPHERES} SELECT id, radius::FLOAT radius FROM spheres WHERE {_box_gap(LOW, HIGH)} <= radius*radius")
def sphere_box_be(spark, d):
    return spheres(spark, d).box_query(HIGH, LOW, fields=["id", "radius"])


@query(f"WITH {_SPHERES} SELECT id FROM spheres WHERE {_boxes_meet(LOW, HIGH)}")
def sphere_box_bb(spark, d):
    return spheres(spark, d).box_query(LOW, HIGH, fields="id", accuracy="bounding_box")


@query(f"WITH {_SPHERES} SELECT id FROM spheres WHERE sqrt({_away(CENTRE)}) <= radius + {_f(RADIUS)}")
def sphere_sphere_be(spark, d):
    return spheres(spark, d).sphere_query(CENTRE, RADIUS, fields="id")


@query(f"WITH {_SPHERES} SELECT id FROM spheres WHERE {_box_gap(['(x - radius)', '(y - radius)', '(z - radius)'], ['(x + radius)', '(y + radius)', '(z + radius)'], [_f(v) for v in CENTRE])} <= power({_f(RADIUS)}, 2)")
def sphere_sphere_bb(spark, d):
    return spheres(spark, d).sphere_query(CENTRE, RADIUS, fields="id", accuracy="bounding_box")


@query(f"WITH {_GRID} SELECT id, x::FLOAT x, y::FLOAT y, z::FLOAT z FROM grid WHERE {_box_gap(GRID_LOW, GRID_HIGH)} <= 1")
def grid_box_touching(spark, d):
    return spheres_grid(spark, d).find(Box.of(GRID_LOW, GRID_HIGH)).select("id", *XYZ)


@query(f"WITH {_SYN} SELECT id, pre_gid, post_gid FROM syn WHERE {_box_gap(SYN_LOW, SYN_HIGH)} <= 0")
def synapse_box(spark, d):
    return synapses(spark, d).box_query(SYN_LOW, SYN_HIGH, fields=["id", "pre_gid", "post_gid"])


@query(f"WITH {_SYN} SELECT count(*) n FROM syn WHERE {_box_gap(SYN_LOW, SYN_HIGH)} <= 0")
def synapse_count(spark, d):
    return synapses(spark, d).box_counts(SYN_LOW, SYN_HIGH)


@query(f"WITH {_SYN} SELECT post_gid, count(*) n FROM syn WHERE {_box_gap(SYN_LOW, SYN_HIGH)} <= 0 GROUP BY post_gid")
def synapse_count_by_post(spark, d):
    return synapses(spark, d).box_counts(SYN_LOW, SYN_HIGH, group_by="post_gid")


@query(f"WITH {_SYN} SELECT count(*) n FROM syn WHERE {_away((25.0, 30.0, 5.0))} <= power({_f(6.5)}, 2)")
def synapse_sphere_count(spark, d):
    return synapses(spark, d).sphere_counts((25.0, 30.0, 5.0), 6.5)


_AXIAL = "SELECT *, ((cx-px)*(qx-px)+(cy-py)*(qy-py)+(cz-pz)*(qz-pz))/len a FROM (SELECT *, sqrt(power(qx-px,2)+power(qy-py,2)+power(qz-pz,2)) len, " + ", ".join(f"{_f(v)} c{n}" for n, v in zip("xyz", CENTRE, strict=True)) + f", {_f(RADIUS)} cr FROM seg)"
_RADIAL = f"SELECT *, sqrt(greatest(0, power(cx-px,2)+power(cy-py,2)+power(cz-pz,2)-a*a)) rho FROM ({_AXIAL})"


@query(f"WITH {_SEG} SELECT gid, section_id, segment_id FROM ({_RADIAL}) WHERE CASE WHEN a BETWEEN 0 AND len THEN rho <= r + cr ELSE power(greatest(-a, a-len),2) + power(greatest(0, rho-r),2) <= cr*cr END UNION ALL SELECT gid, section_id, segment_id FROM som WHERE sqrt({_away(CENTRE)}) <= radius + {_f(RADIUS)}")
def segment_sphere_be(spark, d):
    return segments(spark, d).sphere_query(CENTRE, RADIUS, fields=["gid", "section_id", "segment_id"])


_SHARE = lambda n: f"r*sqrt(greatest(0, 1 - power(q{n}-p{n},2)/(1.1754943508222875e-38 + 1.1920928955078125e-07*greatest(r*r, px*px, py*py, pz*pz, qx*qx, qy*qy, qz*qz) + power(qx-px,2)+power(qy-py,2)+power(qz-pz,2))))"
_TIGHT = ", ".join(f"least(p{n},q{n}) - {_SHARE(n)} min_{n}, greatest(p{n},q{n}) + {_SHARE(n)} max_{n}" for n in "xyz")
_SEGBOX = f"segbox AS (SELECT gid, section_id, segment_id, {_TIGHT} FROM seg UNION ALL SELECT gid, section_id, segment_id, " + ", ".join(f"{n}-radius, {n}+radius" for n in "xyz") + " FROM som)"


@query(f"WITH {_SEG}, {_SEGBOX} SELECT gid, section_id, segment_id FROM segbox WHERE " + " AND ".join(f"min_{n} <= {_f(b)} AND max_{n} >= {_f(a)}" for n, a, b in zip("xyz", LOW, HIGH, strict=True)))
def segment_box_bb(spark, d):
    return segments(spark, d).box_query(LOW, HIGH, fields=["gid", "section_id", "segment_id"], accuracy="bounding_box")


_CUTS = ", ".join(f"least(1, greatest(0, ({_f(v)} - p{n}) / nullif(q{n}-p{n}, 0)))" for n, a, b in zip("xyz", LOW, HIGH, strict=True) for v in (a, b))
_OUT = lambda n, a, b: f"(least(p{n} + t*(q{n}-p{n}) - {_f(a)}, 0) + greatest(p{n} + t*(q{n}-p{n}) - {_f(b)}, 0))"
_OUTS = [_OUT(n, a, b) for n, a, b in zip("xyz", LOW, HIGH, strict=True)]
_NEAR = (
    f"cut AS (SELECT DISTINCT gid, px, py, pz, qx, qy, qz, r, t FROM (SELECT *, unnest([0.0::DOUBLE, 1.0::DOUBLE, {_CUTS}]) t FROM seg) WHERE t IS NOT NULL), "
    f"slope AS (SELECT *, {' + '.join(f'{o}*(q{n}-p{n})' for n, o in zip('xyz', _OUTS, strict=True))} g FROM cut), "
    "pair AS (SELECT *, lead(t) OVER w t2, lead(g) OVER w g2 FROM slope WINDOW w AS (PARTITION BY gid ORDER BY t)), "
    "cand AS (SELECT gid, px, py, pz, qx, qy, qz, r, t FROM cut UNION ALL SELECT gid, px, py, pz, qx, qy, qz, r, t - g*(t2-t)/(g2-g) t FROM pair WHERE g < 0 AND g2 > 0), "
    f"near AS (SELECT gid, any_value(r) r, min({' + '.join(f'power({o},2)' for o in _OUTS)}) m FROM cand GROUP BY gid)"
)


@query(f"WITH {_SEG}, {_NEAR}, {_SEGBOX} SELECT gid, 1 section_id, 0 segment_id FROM near JOIN segbox USING (gid) WHERE section_id = 1 AND (m < r*r OR m = 0) AND " + " AND ".join(f"min_{n} <= {_f(b)} AND max_{n} >= {_f(a)}" for n, a, b in zip("xyz", LOW, HIGH, strict=True)) + f" UNION ALL SELECT gid, section_id, segment_id FROM som WHERE {_box_gap(LOW, HIGH)} <= radius*radius")
def segment_box_be(spark, d):
    return segments(spark, d).box_query(LOW, HIGH, fields=["gid", "section_id", "segment_id"])


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{n}*{b}{n}" for n in "xyz") + ")"


def _less(a: str, b: str, out: str) -> str:
    return ", ".join(f"{a}{n} - {b}{n} {out}{n}" for n in "xyz")


def _end(x: str, a: str, v: str) -> str:
    """Squared distance of the point x and the segment from a along v."""
    t = f"greatest(0, least(1, coalesce(({' + '.join(f'({x}{n}-{a}{n})*{v}{n}' for n in 'xyz')}) / nullif({_dot(v, v)}, 0), 0)))"
    return "(" + " + ".join(f"power({x}{n} - {a}{n} - {t}*{v}{n}, 2)" for n in "xyz") + ")"


#: Of ``met`` (segments p-q of a query and e-f of an element, whose boxes meet): squared distances, as dd.
_APART = (
    f"axes AS (SELECT *, {_less('q', 'p', 'u')}, {_less('f', 'e', 'v')}, {_less('p', 'e', 'w')} FROM met), "
    f"dots AS (SELECT *, {_dot('u', 'u')}*{_dot('v', 'v')} - power({_dot('u', 'v')}, 2) det FROM axes), "
    f"lines AS (SELECT *, ({_dot('u', 'v')}*{_dot('v', 'w')} - {_dot('v', 'v')}*{_dot('u', 'w')})/nullif(det, 0) s, ({_dot('u', 'u')}*{_dot('v', 'w')} - {_dot('u', 'v')}*{_dot('u', 'w')})/nullif(det, 0) t FROM dots), "
    f"apart AS (SELECT *, least({_end('p', 'e', 'v')}, {_end('q', 'e', 'v')}, {_end('e', 'p', 'u')}, {_end('f', 'p', 'u')}, CASE WHEN s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN {' + '.join(f'power(w{n} + s*u{n} - t*v{n}, 2)' for n in 'xyz')} END) dd FROM lines)"
)
_MEET = " AND ".join(f"a.min_{n} <= b.max_{n} AND a.max_{n} >= b.min_{n}" for n in "xyz")
#: Of ``asked`` ("query", px ... qz, r): its cylinders against all segments, as capsules, and against somas, with flat caps.
_CAPSULES = (
    f"ask AS (SELECT *, {_TIGHT} FROM asked), own AS (SELECT *, {_TIGHT} FROM seg), "
    f"met AS (SELECT a.\"query\", a.px, a.py, a.pz, a.qx, a.qy, a.qz, a.r, b.px ex, b.py ey, b.pz ez, b.qx fx, b.qy fy, b.qz fz, b.r er, b.gid, b.section_id, b.segment_id FROM ask a, own b WHERE {_MEET}), {_APART}, "
    "ball AS (SELECT *, " + ", ".join(f"{n}-radius min_{n}, {n}+radius max_{n}" for n in "xyz") + " FROM som), "
    f"axial AS (SELECT *, ((x-px)*(qx-px)+(y-py)*(qy-py)+(z-pz)*(qz-pz))/len ax FROM (SELECT a.*, b.gid, b.section_id, b.segment_id, b.x, b.y, b.z, b.radius, sqrt(power(a.qx-a.px,2)+power(a.qy-a.py,2)+power(a.qz-a.pz,2)) len FROM ask a, ball b WHERE {_MEET})), "
    "radial AS (SELECT *, sqrt(greatest(0, power(x-px,2)+power(y-py,2)+power(z-pz,2)-ax*ax)) rho FROM axial), "
    "hit AS (SELECT \"query\", gid, section_id, segment_id FROM apart WHERE dd <= power(r+er, 2) UNION ALL "
    "SELECT \"query\", gid, section_id, segment_id FROM radial WHERE CASE WHEN ax BETWEEN 0 AND len THEN rho <= r + radius ELSE power(greatest(-ax, ax-len),2) + power(greatest(0, rho-r),2) <= radius*radius END)"
)
_ONE_CYLINDER = "asked AS (SELECT 0 \"query\", " + ", ".join(f"{_f(v)} {k}{n}" for k, corner in (("p", LOW), ("q", HIGH)) for n, v in zip("xyz", corner, strict=True)) + f", {_f(0.05)} r)"


@query(f"WITH {_SEG}, {_ONE_CYLINDER}, {_CAPSULES} SELECT gid, section_id, segment_id FROM hit")
def segment_cylinder(spark, d):
    return segments(spark, d).cylinder_query(LOW, HIGH, 0.05, fields=["gid", "section_id", "segment_id"])


@query(f"WITH {_SEG} SELECT gid, section_id, segment_id, ((px+qx)/2)::FLOAT cx, ((py+qy)/2)::FLOAT cy, r::FLOAT radius, false is_soma FROM seg UNION ALL SELECT gid, section_id, segment_id, x::FLOAT, y::FLOAT, radius::FLOAT, true FROM som")
def segment_fields(spark, d):
    i = segments(spark, d)
    rows = i.project(i.elements, ["gid", "section_id", "segment_id", "centroid", "radius", "is_soma"])
    return rows.select("gid", "section_id", "segment_id", F.col("centroid")[0].alias("cx"), F.col("centroid")[1].alias("cy"), "radius", "is_soma")


@query(f"WITH {_SPHERES}, {_WIN} SELECT \"window\", id FROM win, spheres WHERE {_box_gap(['ax', 'ay', 'az'], ['bx', 'b_y', 'bz'])} <= radius*radius AND {_boxes_meet(['ax', 'ay', 'az'], ['bx', 'b_y', 'bz'])}")
def spatial_join_boxes(spark, d):
    return join.spatial_join(spheres(spark, d), windows(spark, d), window_box()).select("window", "id")


@query(f"WITH {_SYN}, q AS (SELECT n_nationkey k, (n_nationkey*2)::FLOAT::DOUBLE a FROM nation) SELECT k, count(id) n FROM q LEFT JOIN syn ON x BETWEEN a AND a+5 AND y BETWEEN a AND a+20 AND z BETWEEN 2 AND 6 GROUP BY k")
def batch_box_counts(spark, d):
    q = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 2).cast("double").alias("a"))
    a = F.col("a")
    return join.batch_counts(synapses(spark, d), q, Box(Vec(a, a, F.lit(2.0)), Vec(a + 5, a + 20, F.lit(6.0))), "k")


@query(f"WITH {_PTS}, {_WIN} SELECT \"window\" FROM win WHERE NOT EXISTS (SELECT 1 FROM pts WHERE x > ax+0.3 AND x < bx+0.3 AND y > ay AND y < b_y AND z > az AND z < bz)")
def empty_windows(spark, d):
    q = windows(spark, d)
    shifted = Box(Vec(F.col("ax") + 0.3, F.col("ay"), F.col("az")), Vec(F.col("bx") + 0.3, F.col("by"), F.col("bz")))
    return join.empty(pts(spark, d), q, shifted, "window").select("window")


@query(f"WITH {_PTS}, {_WIN} SELECT \"window\" FROM win WHERE EXISTS (SELECT 1 FROM pts WHERE x > ax+0.3 AND x < bx+0.3 AND y > ay AND y < b_y AND z > az AND z < bz)")
def non_empty_windows(spark, d):
    q = windows(spark, d)
    shifted = Box(Vec(F.col("ax") + 0.3, F.col("ay"), F.col("az")), Vec(F.col("bx") + 0.3, F.col("by"), F.col("bz")))
    return join.non_empty(pts(spark, d), q, shifted, "window").select("window")


@query(f"WITH {_SPHERES} SELECT count(*) = 0 AS empty FROM spheres WHERE {_box_gap((0.9, 0.9, 0.9), (1.0, 1.0, 1.0))} <= radius*radius")
def empty_box(spark, d):
    return spark.createDataFrame([(spheres(spark, d).box_empty((0.9, 0.9, 0.9), (1.0, 1.0, 1.0)),)], "empty boolean")


_SPHERE_BOX_GAP = " + ".join(f"power(greatest({n}-radius-{{c{n}}}, 0, {{c{n}}}-{n}-radius), 2)" for n in "xyz")


@query(f"WITH {_SPHERES} SELECT id FROM spheres ORDER BY " + _SPHERE_BOX_GAP.format(cx=_f(0.01), cy=_f(0.02), cz=_f(0.03)) + ", id LIMIT 10")
def knn_k10(spark, d):
    return spheres(spark, d).nearest((0.01, 0.02, 0.03), 10).select("id")


@query(f"WITH {_PTS}, {_WIN} SELECT \"window\", id, rank FROM (SELECT \"window\", id, (row_number() OVER (PARTITION BY \"window\" ORDER BY {_away(['qx', 'qy', 'qz'])}, id))::INTEGER rank FROM win, pts) WHERE rank <= 5")
def knn_batch(spark, d):
    return join.batch_nearest(pts(spark, d), windows(spark, d), ["qx", "qy", "qz"], "window", 5).select("window", "id", "rank")


@query(f"WITH {_SPHERES} SELECT " + ", ".join(f"round(min({n}-radius), 6) min_{n}, round(max({n}+radius), 6) max_{n}" for n in "xyz") + " FROM spheres")
def bounds(spark, d):
    return spheres(spark, d).bounds().select(*[F.round(c, 6).alias(c) for c in BOUNDS])


@query(f"WITH {_SYN} SELECT count(*) n FROM syn")
def size(spark, d):
    return synapses(spark, d).size()


@query(f"WITH {_SEG} SELECT gid, section_id, segment_id FROM seg UNION ALL SELECT gid, section_id, segment_id FROM som")
def all_ids(spark, d):
    return segments(spark, d).all_ids()


@query(f"WITH {_SYN} SELECT id, post_gid, p_brand, p_size, s_name FROM syn LEFT JOIN part ON p_partkey = post_gid LEFT JOIN supplier ON s_suppkey = pre_gid WHERE {_box_gap(SYN_LOW, SYN_HIGH)} <= 0")
def attr_join(spark, d):
    part = _table(spark, d, "part").select(F.col("p_partkey"), "p_brand", "p_size")
    supplier = _table(spark, d, "supplier").select("s_suppkey", "s_name")
    index = synapses(spark, d).with_attributes(part, "p_partkey", "post_gid").with_attributes(supplier, "s_suppkey", "pre_gid")
    return index.box_query(SYN_LOW, SYN_HIGH, fields=["id", "post_gid", "p_brand", "p_size", "s_name"])


@query(f"WITH {_SYN} SELECT l_returnflag population, id FROM syn WHERE l_returnflag IN ('A', 'R') AND {_box_gap(SYN_LOW, SYN_HIGH)} <= 0")
def population_boxes(spark, d):
    all_ = populations.Populations.of(synapses(spark, d).elements, "synapse", "l_returnflag")
    return all_.find(Box.of(SYN_LOW, SYN_HIGH), populations=["A", "R"]).select("population", "id")


@query(f"WITH {_SYN} SELECT l_returnflag population, count(*) n FROM syn WHERE {_away((25.0, 30.0, 5.0))} <= power({_f(6.5)}, 2) GROUP BY l_returnflag")
def population_counts(spark, d):
    all_ = populations.Populations.of(synapses(spark, d).elements, "synapse", "l_returnflag")
    return all_.find(Sphere.of((25.0, 30.0, 5.0), 6.5)).groupBy("population").agg(F.count("*").alias("n"))


@query(f"WITH {_SYN} SELECT id, post_gid FROM syn WHERE post_gid IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def select_targets(spark, d):
    t = _table(spark, d, "lineitem")
    edges = t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("source_node"), F.col("l_partkey").alias("target_node"), F.col("l_quantity").alias("afferent_center_x"), (F.col("l_extendedprice") / 1000).alias("afferent_center_y"), (F.col("l_discount") * 100).alias("afferent_center_z"))
    targets = _table(spark, d, "part").where("p_size = 10").select("p_partkey")
    return builders.synapses_from_edges(edges, target_gids=targets).elements.select("id", "post_gid")


_STR = "a AS (SELECT *, ntile(3) OVER (ORDER BY x, y, z, id) - 1 i FROM pts), b AS (SELECT *, ntile(2) OVER (PARTITION BY i ORDER BY y, z, x, id) - 1 j FROM a), c AS (SELECT *, ntile(4) OVER (PARTITION BY i, j ORDER BY z, x, y, id) - 1 k FROM b)"


@query(f"WITH {_PTS}, {_STR} SELECT id, ((i*2+j)*4+k)::BIGINT part_id FROM c")
def str_parts(spark, d):
    return layout.str_parts(pts(spark, d).elements, "point", (3, 2, 4)).select("id", "part_id")


@query(f"WITH {_PTS}, {_STR} SELECT ((i*2+j)*4+k)::BIGINT part_id, count(*) n_elements, min(x) min_x, max(x) max_x, min(z) min_z, max(z) max_z FROM c GROUP BY 1")
def str_manifest(spark, d):
    tiled = layout.str_parts(pts(spark, d).elements, "point", (3, 2, 4))
    return layout.manifest_of(tiled, "point").select("part_id", "n_elements", "min_x", "max_x", "min_z", "max_z")


@query(f"WITH {_SPHERES} SELECT id FROM spheres WHERE {_box_gap(LOW, HIGH)} <= radius*radius")
def stored_box(spark, d):
    """Written in parts, opened again, and queried with pruning."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    layout.write(spheres(spark, d), path, (2, 2, 2))
    return layout.open_index(spark, path).box_query(LOW, HIGH, fields="id")


@query(f"WITH {_TRACK}, nxt AS (SELECT gid, i-1 segment_id, x, y, z, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2 FROM track WINDOW w AS (PARTITION BY gid ORDER BY i)) SELECT gid, segment_id::INTEGER segment_id, x p1_x, y p1_y, z p1_z, x2 p2_x, y2 p2_y, z2 p2_z, 1::FLOAT radius FROM nxt WHERE x2 IS NOT NULL")
def branch_assembly(spark, d):
    return builders.branches(trajectories(spark, d)).select("gid", "segment_id", *P1, *P2, "radius")


@query(f"WITH {_TRACK} SELECT gid, x, y, z FROM track WHERE i = 1")
def soma_assembly(spark, d):
    first = trajectories(spark, d).where("point_idx = 1")
    return builders.somas(first).select("gid", F.col("p1_x").alias("x"), F.col("p1_y").alias("y"), F.col("p1_z").alias("z"))


_EDGES = "[" + ", ".join(repr(e) + "::DOUBLE" for e in histogram.log10_bins()) + "]"


@query(f"WITH {_SEG}, len AS (SELECT sqrt(power(qx-px,2)+power(qy-py,2)+power(qz-pz,2)) v FROM seg), b AS (SELECT len(list_filter({_EDGES}, lambda e: e <= v)) bin FROM len) SELECT g.bin::INTEGER bin, count(b.bin) n FROM (SELECT unnest(range(0, 58)) bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin")
def length_histogram(spark, d):
    return histogram.segment_length_histogram(segments(spark, d))


_PLACES = "place AS (SELECT region, i*64+j*8+k place, " + ", ".join(f"low - {_f(-0.02)} + {c}*0.05::DOUBLE d{n}" for c, n in zip("ijk", "xyz", strict=True)) + " FROM (VALUES (0, -0.2::DOUBLE), (1, 0.1::DOUBLE)) g(region, low), range(8) a(i), range(8) b(j), range(8) c(k))"


@query(f"WITH {_SPHERES}, {_PLACES}, free AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY place) n FROM place WHERE NOT EXISTS (SELECT 1 FROM spheres WHERE power(x-dx,2)+power(y-dy,2)+power(z-dz,2) <= power(radius+{_f(0.02)}, 2))) SELECT region, round(dx, 9) dx, round(dy, 9) dy, round(dz, 9) dz FROM free WHERE n = 1")
def placement(spark, d):
    """The first free place of a sphere in two regions; a region without one has no row."""
    index, rows = spheres(spark, d), []
    for region, (low, high) in enumerate([(-0.2, 0.2), (0.1, 0.5)]):
        move = first_free(index, ((low,) * 3, (high,) * 3), Sphere.of((0.0, 0.0, 0.0), 0.02))
        rows += [(region, *[round(v, 9) for v in move])] if move else []
    return spark.createDataFrame(rows, "region int, dx double, dy double, dz double")


@query(f"WITH {_SPHERES}, {_WIN} SELECT \"window\", id FROM win, spheres WHERE id % 7 = 0 AND {_box_gap(['ax', 'ay', 'az'], ['bx', 'b_y', 'bz'])} <= radius*radius AND {_boxes_meet(['ax', 'ay', 'az'], ['bx', 'b_y', 'bz'])}")
def compare_missing(spark, d):
    """What an index without some elements lacks in windows."""
    whole = spheres(spark, d)
    fewer = SpatialIndex.of(whole.elements.where("id % 7 <> 0"), "sphere")
    return compare.missing_in_windows(whole, fewer, windows(spark, d)).select("window", "id")


@query(f"WITH {_SEG} SELECT gid, (gid::BIGINT << 28) | (section_id::BIGINT << 14) | segment_id::BIGINT packed FROM seg")
def pack_ids(spark, d):
    return segments(spark, d).elements.where("not is_soma").select("gid", pack_id(F.col("gid"), F.col("section_id"), F.col("segment_id")).alias("packed"))


def _hilbert_sql() -> str:
    """Skilling's transform, a subquery for each step: from cells x0, x1, x2 of ten bits to the position."""
    cell = ", ".join(f"least(1023, greatest(0, floor(({n} - min({n}) OVER ())/(max({n}) OVER () - min({n}) OVER ())*1024)))::BIGINT x{i}" for i, n in enumerate("xyz"))
    sql = f"SELECT id, {cell} FROM pts"
    for bit in range(9, 0, -1):
        p = (1 << bit) - 1
        for i in range(3):
            high, swap = f"((x{i} >> {bit}) & 1) = 1", f"(xor(x0, x{i}) & {p})"
            cols = [f"CASE WHEN {high} THEN xor(x0, {p}) ELSE xor(x0, {swap}) END x0", *[f"CASE WHEN {high} THEN x{k} ELSE xor(x{k}, {swap}) END x{k}" if k == i else f"x{k}" for k in (1, 2)]]
            sql = f"SELECT id, {', '.join(cols)} FROM ({sql})"
    sql = f"SELECT id, x0, xor(x0, x1) x1, x2 FROM ({sql})"
    sql = f"SELECT id, x0, x1, xor(x1, x2) x2 FROM ({sql})"
    t = "0"
    for bit in range(9, 0, -1):
        t = f"xor({t}, CASE WHEN ((x2 >> {bit}) & 1) = 1 THEN {(1 << bit) - 1} ELSE 0 END)"
    sql = f"SELECT id, xor(x0, t) x0, xor(x1, t) x1, xor(x2, t) x2 FROM (SELECT *, {t} t FROM ({sql}))"
    return f"SELECT id, ({' + '.join(f'(((x{i} >> {b}) & 1) << {3 * b + 2 - i})' for b in range(10) for i in range(3))})::BIGINT hilbert FROM ({sql})"


@query(f"WITH {_PTS} {_hilbert_sql()}")
def hilbert_order(spark, d):
    return layout.hilbert_order(pts(spark, d).elements, "point").select("id", "hilbert")


@query(f"WITH {_SPHERES} SELECT id FROM spheres UNION ALL SELECT 1000000 + id FROM spheres WHERE id < 10")
def insert_rows(spark, d):
    i = spheres(spark, d)
    return i.insert(i.elements.where("id < 10").withColumn("id", F.col("id") + 1000000)).all_ids()


@query(f"WITH {_SPHERES} SELECT id, sqrt({_away(CENTRE)}) <= {_f(RADIUS)} AS inside FROM spheres")
def contains_centres(spark, d):
    s = Sphere.of(CENTRE, RADIUS)
    return spheres(spark, d).elements.select("id", s.contains(Vec.of(XYZ)).alias("inside"))


@query(f"WITH {_SYN} SELECT id FROM syn WHERE {_box_gap(SYN_LOW, SYN_HIGH)} <= 0")
def standing_box(spark, d):
    return standing_query(synapses(spark, d).elements, "synapse", Box.of(SYN_LOW, SYN_HIGH)).select("id")


@query(f"WITH {_SEG}, asked AS (SELECT gid \"query\", px, py, pz, qx, qy, qz, r FROM seg), {_CAPSULES} SELECT \"query\", gid, section_id, segment_id FROM hit")
def segment_join_cylinders(spark, d):
    """All segments against all elements, as capsules."""
    a = segments(spark, d)
    q = a.elements.where("not is_soma").select(F.col("gid").alias("query"), *[F.col(c).alias(f"s_{c}") for c in (*P1, *P2)], F.col("radius").alias("s_radius"))
    shape = Cylinder.of([f"s_{c}" for c in P1], [f"s_{c}" for c in P2], "s_radius")
    return join.spatial_join(a, q, shape, fields=["query", "gid", "section_id", "segment_id"])


@query(f"WITH {_SPHERES} SELECT id, x::FLOAT x, radius::FLOAT radius FROM spheres WHERE {_box_gap(LOW, HIGH)} <= radius*radius")
def raw_elements(spark, d):
    return spheres(spark, d).box_query(LOW, HIGH, fields="raw_elements").select("raw_elements.id", "raw_elements.x", "raw_elements.radius")


@query(f"WITH {_SEG}, c AS (SELECT gid, {', '.join(f'{_f(v)} - p{n} c{n}, q{n} - p{n} v{n}' for n, v in zip('xyz', CENTRE, strict=True))}, r FROM seg), t AS (SELECT gid, (cx*vx+cy*vy+cz*vz)/nullif(vx*vx+vy*vy+vz*vz, 0) t, cx, cy, cz, vx, vy, vz, r FROM c) SELECT gid, coalesce(t BETWEEN 0 AND 1 AND power(cx-t*vx,2)+power(cy-t*vy,2)+power(cz-t*vz,2) <= r*r, false) AS inside FROM t")
def cylinder_contains(spark, d):
    """Which segments hold a point between their flat caps."""
    inside = Cylinder.of(P1, P2, "radius").contains(Vec.of(CENTRE))
    return segments(spark, d).elements.where("not is_soma").select("gid", inside.alias("inside"))


def _turned(v: tuple[str, str, str]) -> list[str]:
    """The rotation matrix of the unit quaternion w, x, y, z times a vector."""
    rows = [("1-2*(y*y+z*z)", "2*(x*y-w*z)", "2*(x*z+w*y)"), ("2*(x*y+w*z)", "1-2*(x*x+z*z)", "2*(y*z-w*x)"), ("2*(x*z-w*y)", "2*(y*z+w*x)", "1-2*(x*x+y*y)")]
    return [" + ".join(f"({m})*{c}" for m, c in zip(row, v, strict=True)) for row in rows]


@query(
    "WITH q AS (SELECT n_nationkey gid, sqrt(1 + power(n_nationkey%3,2) + power(n_regionkey,2) + 4) size, n_nationkey%3 a, n_regionkey b FROM nation), u AS (SELECT gid, 1/size w, a/size x, b/size y, 2/size z FROM q), "
    "lib AS (SELECT 0 i, 1.0 lx, 2.0 ly, 3.0 lz UNION ALL SELECT 1, -4.0, 5.0, 0.5 UNION ALL SELECT 2, 2.0, -1.0, 7.0) "
    f"SELECT gid, i segment_id, {', '.join(f'round({t} + {shift}, 3) {n}' for t, shift, n in zip(_turned(('lx', 'ly', 'lz')), ('gid', '2*gid', '3'), ('p1_x', 'p1_y', 'p1_z'), strict=True))} FROM u, lib WHERE i < 2"
)
def rotated_assembly(spark, d):
    """A small morphology put at each nation, turned by its quaternion."""
    key = F.col("n_nationkey")
    nodes = _table(spark, d, "nation").select(key.alias("node_id"), F.lit("m").alias("morphology"), key.cast("float").alias("x"), (2 * key).cast("float").alias("y"), F.lit(3.0).alias("z"), F.lit(1.0).alias("orientation_w"), (key % 3).cast("double").alias("orientation_x"), F.col("n_regionkey").cast("double").alias("orientation_y"), F.lit(2.0).alias("orientation_z"))
    points = [("m", 1, i, *p, 2.0, 2) for i, p in enumerate([(1.0, 2.0, 3.0), (-4.0, 5.0, 0.5), (2.0, -1.0, 7.0)])]
    library = spark.createDataFrame(points, "morphology string, section_id int, point_idx int, x double, y double, z double, diameter double, section_type int")
    centres = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 5.0)], "morphology string, soma_x double, soma_y double, soma_z double, soma_radius double")
    found = builders.morphologies_from_nodes(nodes, library, centres).elements.where("not is_soma")
    return found.select("gid", "segment_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in P1])


@query("SELECT true AS same, false AS other")
def index_similarity(spark, d):
    """An index against its own rows in another order, and against one with a sphere moved."""
    a = spheres(spark, d)
    b = SpatialIndex.of(a.elements.repartition(5, "id"), "sphere")
    moved = SpatialIndex.of(a.elements.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x")).otherwise(-F.col("x"))), "sphere")
    return spark.createDataFrame([(compare.likely_same(a, b), compare.likely_same(a, moved))], "same boolean, other boolean")
