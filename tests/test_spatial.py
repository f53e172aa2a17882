"""Spatial operators: SQL on the same tables, fixed cases at boundaries, brute force on random shapes."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra import cli
from volumetra.functions import vectors as v
from volumetra.functions.kernels import hilbert_index, segment_box_sq
from volumetra.functions.vectors import Vec
from volumetra.operators import compare, join
from volumetra.operators.index import SpatialIndex
from volumetra.operators.placement import grid_steps
from volumetra.operators.populations import Populations, wrapped
from volumetra.operators.shapes import Box, Cylinder, Point, Sphere, intersects
from volumetra.plans import layout
from volumetra.queries import ORACLE_SQL, QUERIES
from volumetra.sources import builders
from volumetra.sources.swc import read_swc, sections
from volumetra.streaming import standing_query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        columns = sorted(c[0] for c in cursor.description)
        assert sorted(df.columns) == columns
        names = [c[0] for c in cursor.description]
        expected = sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
        assert sorted(repr([r[c] for c in columns]) for r in rows) == expected


def test_segment_join_is_whole(spark):
    """Every segment asks; pairs of segments by brute force over their boxes and axes."""
    got = {(r["query"], r["gid"]) for r in QUERIES["segment_join_cylinders"](spark, SF).where("section_id = 1").collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", *[F.col("embedding")[i].cast("double") for i in range(7)]).collect()
    a = np.array([r[1:] for r in rows])
    p, d, radius = a[:, None, :3], a[:, None, 3:6] - a[:, None, :3], np.abs(a[:, 6])
    q, e = p.transpose(1, 0, 2), d.transpose(1, 0, 2)
    dot = lambda x, y: (x * y).sum(-1)
    at = lambda x, o, v: np.clip(dot(x - o, v) / dot(v, v), 0, 1)[..., None]
    # The least distance is from an end to the other segment, or between inner points of the lines.
    pairs = [(x, q + at(x, q, e) * e) for x in (p, p + d)] + [(p + at(y, p, d) * d, y) for y in (q, q + e)]
    dd, ee, de, w = dot(d, d), dot(e, e), dot(d, e), p - q
    det = np.where(np.abs(dd * ee - de**2) < 1e-12, np.inf, dd * ee - de**2)
    s, t = (de * dot(e, w) - ee * dot(d, w)) / det, (dd * dot(e, w) - de * dot(d, w)) / det
    inner = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    away = np.minimum.reduce([np.sqrt(dot(x - y, x - y)) for x, y in pairs] + [np.where(inner, np.linalg.norm(w + s[..., None] * d - t[..., None] * e, axis=-1), np.inf)])
    half = np.sqrt(np.maximum(0, 1 - d[:, 0] ** 2 / dot(d, d))) * radius[:, None]
    low, high = np.minimum(a[:, :3], a[:, 3:6]) - half, np.maximum(a[:, :3], a[:, 3:6]) + half
    apart = np.maximum(low[:, None] - high[None], low[None] - high[:, None]).max(-1)
    gap = np.maximum(away - radius[:, None] - radius[None, :], apart)
    ids = [r[0] for r in rows]
    assert {i for i, _ in got} == set(ids)
    sure = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(gap < -1e-5), strict=True)}
    assert sure <= got <= {(ids[i], ids[j]) for i, j in zip(*np.nonzero(gap < 1e-5), strict=True)}


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def cases():
    return [
        (Box.of((0, 0, 0), (1, 1, 1)), Box.of((1, 1, 1), (2, 2, 2)), True),
        (Box.of((0, 0, 0), (1, 1, 1)), Box.of((1.001, 0, 0), (2, 2, 2)), False),
        (Box.of((1, 1, 1), (0, 0, 0)), Point(v.Vec.of((1.0, 0.5, 0.5))), False),
        (Box.of((0, 0, 0), (1, 1, 1)), Point(v.Vec.of((0.999, 0.5, 0.5))), True),
        (Box.of((0, 0, 0), (1, 1, 1)), Sphere.of((2, 0.5, 0.5), 1), True),
        (Box.of((0, 0, 0), (1, 1, 1)), Sphere.of((2, 2, 2), 1.7), False),
        (Sphere.of((0, 0, 0), 1), Sphere.of((3, 0, 0), 2), True),
        (Sphere.of((0, 0, 0), 1), Sphere.of((3.01, 0, 0), 2), False),
        (Sphere.of((0, 0, 0), 1), Point(v.Vec.of((1.0, 0.0, 0.0))), True),
        (Sphere.of((0, 2, 0), 1), Cylinder.of((-5, 0, 0), (5, 0, 0), 1), True),
        (Sphere.of((0, 2.01, 0), 1), Cylinder.of((-5, 0, 0), (5, 0, 0), 1), False),
        (Sphere.of((5.9, 1.9, 0), 1), Cylinder.of((-5, 0, 0), (5, 0, 0), 1), False),  # a capsule would meet it
        (Sphere.of((6, 0.5, 0), 1), Cylinder.of((-5, 0, 0), (5, 0, 0), 1), True),
        (Sphere.of((0, 0, 0), 1), Cylinder.of((0, 0, 0), (0, 0, 0), 1), False),  # no axis
        (Box.of((0, 0, 0), (1, 1, 1)), Cylinder.of((-1, 2, 0.5), (2, 2, 0.5), 1.01), True),
        (Box.of((0, 0, 0), (1, 1, 1)), Cylinder.of((-1, 2, 0.5), (2, 2, 0.5), 1), False),  # strict
        (Box.of((0, 0, 0), (1, 1, 1)), Cylinder.of((-1, 1, 0.5), (2, 1, 0.5), 0), True),  # the axis touches
        (Cylinder.of((0, 0, 0), (1, 0, 0), 1), Cylinder.of((0, 2, 0), (1, 2, 0), 1), True),
        (Cylinder.of((0, 0, 0), (1, 0, 0), 1), Cylinder.of((0, 2.01, 0), (1, 2.01, 0), 1), False),
        (Cylinder.of((0, 0, 0), (2, 0, 0), 0.5), Cylinder.of((1, -1, 0.9), (1, 1, 0.9), 0.5), True),
        (Cylinder.of((0, 0, 0), (2, 0, 0), 1), Point(v.Vec.of((2.0, 1.0, 0.0))), True),
        (Cylinder.of((0, 0, 0), (2, 0, 0), 1), Point(v.Vec.of((2.01, 0.0, 0.0))), False),
    ]


@pytest.mark.parametrize("i", range(22))
def test_predicate(spark, i):
    a, b, expected = cases()[i]
    assert value(spark, intersects(a, b)) is expected
    assert value(spark, intersects(b, a)) is expected


def test_segment_box_kernel():
    rng = np.random.default_rng(0)
    p, q, low = (rng.uniform(-2, 2, (500, 3)) for _ in range(3))
    high = low + rng.uniform(0, 1.5, (500, 3))
    t = np.linspace(0, 1, 4001)
    x = p[:, None] + t[:, None] * (q - p)[:, None]
    brute = ((np.minimum(x - low[:, None], 0) + np.maximum(x - high[:, None], 0)) ** 2).sum(2).min(1)
    got = segment_box_sq(p, q, low, high)
    assert (got <= brute + 1e-12).all() and np.allclose(got, brute, atol=2e-3)
    assert np.allclose(segment_box_sq(p, p, low, high), ((np.clip(p, low, high) - p) ** 2).sum(1))


def test_vectors(spark):
    a, b = v.Vec.of((1.0, 2.0, 3.0)), v.Vec.of((-2.0, 0.5, 4.0))
    n, m = np.array([1.0, 2, 3]), np.array([-2.0, 0.5, 4])
    got = lambda vec: np.array(list(value(spark, vec.struct())))
    assert np.allclose(got(a.cross(b)), np.cross(n, m)) and value(spark, a.dot(b)) == n @ m
    assert np.allclose(got(a + b), n + m) and np.allclose(got(a / b), n / m) and np.allclose(got(2.0 * a - b), 2 * n - m)
    assert np.isclose(value(spark, v.distance(a, b)), np.linalg.norm(n - m))
    half = 0.5**0.5
    quarter = tuple(F.lit(c) for c in (half, 0.0, 0.0, half))
    assert np.allclose(got(v.rotate(quarter, v.Vec.of((1.0, 0.0, 0.0)))), [0, 1, 0])
    assert np.allclose(got(v.rotate(tuple(F.lit(0.0) for _ in range(4)), a)), n)
    assert np.allclose(got(v.project_on_segment(v.Vec.of((0.0, 0.0, 0.0)), v.Vec.of((1.0, 0.0, 0.0)), b)), [0, 0, 0])
    packed = v.pack_id(F.lit(7), F.lit(3), F.lit(9))
    assert [value(spark, c) for c in v.unpack_id(packed)] == [7, 3, 9]
    with pytest.raises(Exception, match="out of range"):
        value(spark, v.pack_id(F.lit(1 << 36), F.lit(0), F.lit(0)))
    assert v.balanced_chunks(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert [v.closest_factors(n) for n in (4, 10, 7, 1, 0)] == [(2, 2), (2, 5), (1, 7), (1, 1), (0, 1)]


def brute_boxes(index, low, high):
    return {r["id"] for r in index.elements.collect() if all(c - r["radius"] <= h and c + r["radius"] >= a for c, a, h in zip((r["x"], r["y"], r["z"]), low, high, strict=True))}


@pytest.fixture(scope="module")
def spheres(spark):
    rng = np.random.default_rng(3)
    return builders.spheres_from_arrays(spark, rng.uniform(-10, 10, (400, 3)), rng.uniform(0.01, 3, 400))


def test_random_boxes(spark, spheres):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(-10, 10, 3)), *map(float, rng.uniform(-10, 10, 3))) for i in range(15)]
    q = spark.createDataFrame(rows, "window int, ax double, ay double, az double, bx double, by double, bz double")
    shape = Box.of([F.col(c) for c in ("ax", "ay", "az")], [F.col(c) for c in ("bx", "by", "bz")])
    for accuracy in ("bounding_box", "best_effort"):
        joined = join.spatial_join(spheres, q, shape, accuracy).select("window", "id").collect()
        assert len(joined) == len(set(joined))
        for r in rows[:4]:
            low, high = np.minimum(r[1:4], r[4:]), np.maximum(r[1:4], r[4:])
            own = {x["id"] for x in joined if x["window"] == r[0]}
            direct = {x["id"] for x in spheres.box_query(r[1:4], r[4:], fields="id", accuracy=accuracy).collect()}
            assert own == direct
            if accuracy == "bounding_box":
                assert own == brute_boxes(spheres, low, high)
    counts = {r["window"]: r["n"] for r in join.batch_counts(spheres, q, shape, "window").collect()}
    assert len(counts) == 15
    none = {r["window"] for r in join.empty(spheres, q, shape, "window").collect()}
    assert none == {w for w, n in counts.items() if n == 0} and {r["window"] for r in join.non_empty(spheres, q, shape, "window").collect()} == set(counts) - none


def test_nearest(spark, spheres, tmp_path):
    def brute(p, k):
        rows = [(sum(max(abs(r[c] - a) - r["radius"], 0) ** 2 for c, a in zip("xyz", p, strict=True)), r["id"]) for r in spheres.elements.collect()]
        return [i for _, i in sorted(rows)[:k]]

    assert [r["id"] for r in spheres.nearest((1, 2, 3), 12).collect()] == brute((1, 2, 3), 12)
    layout.write(spheres, str(tmp_path / "i"), (2, 2, 2))
    assert [r["id"] for r in layout.open_index(spark, str(tmp_path / "i")).nearest((1, 2, 3), 12).collect()] == brute((1, 2, 3), 12)
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 90.0, 0.0, -50.0)], "q int, a double, b double, c double")
    got = join.batch_nearest(spheres, q, ["a", "b", "c"], "q", 500).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in got} == {0: 400, 1: 400}


def far_cubes(rng, n):
    """(n, 3) of points and radii of very different sizes."""
    return rng.uniform(-10, 10, (n, 3)).astype(np.float32), np.exp(rng.uniform(np.log(0.01), np.log(5), n)).astype(np.float32)


def nearest_by_boxes(spark, index, points, k):
    """What batch_nearest finds, and brute force over the boxes of all elements."""
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "q int, a double, b double, c double")
    keys = join.KEYS[index.element_type]
    got = {}
    for r in join.batch_nearest(index, q, ["a", "b", "c"], "q", k).collect():
        got.setdefault(r["q"], {})[r["rank"]] = tuple(r[c] for c in keys)
    found = join.with_box(index.elements, join.element_shape(index.element_type), "e_").select(*keys, *[f"e_{c}" for c in join.BOUNDS]).collect()
    table = np.array([r[len(keys) :] for r in found])
    expected = {}
    for i, p in enumerate(points):
        gap = np.maximum(np.maximum(table[:, :3] - p, p - table[:, 3:]), 0)
        order = sorted(zip((gap * gap).sum(1), [tuple(r[: len(keys)]) for r in found], strict=True))
        expected[i] = {n + 1: key for n, (_, key) in enumerate(order[:k])}
    return got, expected


def test_batch_nearest_of_spheres_off_corners(spark):
    # Half side 2.2 at first. The large sphere's box is 0.87 away; its body misses the cube, which the small one meets.
    rows = [(0, 5.5, 5.5, 5.5, 5.0), (1, 1.2, 0.0, 0.0, 0.1), *[(2 + i, 10.0, 10.0, 0.01 * i, 0.1) for i in range(110)]]
    index = SpatialIndex.of(spark.createDataFrame(rows, "id long, x float, y float, z float, radius float"), "sphere")
    got, expected = nearest_by_boxes(spark, index, np.zeros((1, 3)), 1)
    assert got == expected == {0: {1: (0,)}}


@pytest.mark.parametrize("k", [1, 3])
def test_batch_nearest_of_spheres_of_mixed_radii(spark, k):
    rng = np.random.default_rng(5)
    centres, radii = far_cubes(rng, 1500)
    rows = [(i, *map(float, c), float(r)) for i, (c, r) in enumerate(zip(centres, radii, strict=True))]
    index = SpatialIndex.of(spark.createDataFrame(rows, "id long, x float, y float, z float, radius float"), "sphere")
    got, expected = nearest_by_boxes(spark, index, rng.uniform(-25, 25, (300, 3)), k)
    assert got == expected


def test_batch_nearest_of_segments(spark):
    rng = np.random.default_rng(6)
    ends, radii = far_cubes(rng, 600)
    others = ends + rng.normal(0, 2, (600, 3)).astype(np.float32)
    rows = [(i, 1, 0, *map(float, a), *map(float, b), float(r), 2, False) for i, (a, b, r) in enumerate(zip(ends, others, radii, strict=True))]
    index = SpatialIndex.of(spark.createDataFrame(rows, "gid long, section_id int, segment_id int, p1_x float, p1_y float, p1_z float, p2_x float, p2_y float, p2_z float, radius float, section_type int, is_soma boolean"), "morphology")
    got, expected = nearest_by_boxes(spark, index, rng.uniform(-25, 25, (200, 3)), 2)
    assert got == expected


def test_batch_nearest_on_the_cubes_faces(spark):
    # Half side 3 at first: of two points 3 away, the one with the smaller key lies on a face.
    rows = [(0, 3.0, 0.0, 0.0), (1, 2.0, 2.0, 1.0), *[(2 + i, *[v] * 3) for i, v in enumerate([3.0, -3.0] * 3)]]
    index = SpatialIndex.of(spark.createDataFrame(rows, "id long, x float, y float, z float"), "point")
    got, expected = nearest_by_boxes(spark, index, np.zeros((1, 3)), 1)
    assert got == expected == {0: {1: (0,)}}


def test_stored_index(spark, spheres, tmp_path):
    path = str(tmp_path / "index")
    layout.write(spheres, path, (3, 2, 1))
    with pytest.raises(FileExistsError):
        layout.write(spheres, path)
    with pytest.raises(FileNotFoundError):
        layout.open_index(spark, str(tmp_path / "none"))
    stored = layout.open_index(spark, path)
    assert len(stored) == 400 and stored.manifest.count() == 6
    sizes = sorted(r["n_elements"] for r in stored.manifest.collect())
    assert sizes == [66, 66, 67, 67, 67, 67]
    low, high = (-3.0, -3.0, -3.0), (1.0, 2.0, 3.0)
    assert {r["id"] for r in stored.box_query(low, high, fields="id").collect()} == {r["id"] for r in spheres.box_query(low, high, fields="id").collect()}
    plan = stored.box_query((-9.9, -9.9, -9.9), (-9.8, -9.8, -9.8), fields="id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_id" in plan or "part_id" in plan
    assert all(abs(a - b) < 1e-5 for a, b in zip(stored.bounds().first(), spheres.bounds().first(), strict=True))
    attributes = spark.createDataFrame([(i, f"name{i}") for i in range(400)], "key long, name string")
    attributes.write.parquet(str(tmp_path / "attributes"))
    layout.add_attributes(spark, path, str(tmp_path / "attributes"), "key", "id")
    again = layout.open_index(spark, path)
    assert again.available_fields[-1] == "name" and all(r["name"] == f"name{r['id']}" for r in again.box_query(low, high, fields=["id", "name"]).collect())
    q = spark.createDataFrame([(0, -10.0, 10.0), (1, 50.0, 51.0)], "w int, a double, b double")
    used = layout.usage(stored, q, Box.of([F.col("a")] * 3, [F.col("b")] * 3)).collect()
    assert {r["n_queries"] for r in used} == {1}
    assert compare.likely_same(spheres, stored) and not compare.likely_same(spheres, spheres.insert_rows([(1000, 0.0, 0.0, 0.0, 1.0)]))
    moved = SpatialIndex.of(spheres.elements.withColumn("x", F.when(F.col("id") == 7, -F.col("x")).otherwise(F.col("x"))), "sphere")
    assert not compare.likely_same(spheres, moved)
    assert cli.main(["compare", path, path], spark) == 0


def test_hot_coordinate_layout(spark):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 < 2, 0.0).otherwise(F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 1.0).alias("z"))
    index = SpatialIndex.of(rows, "point")
    sizes = layout.str_parts(index.elements, "point", (4, 3, 2)).groupBy("part_id").count().collect()
    assert len(sizes) == 24 and {r["count"] for r in sizes} == {25}
    assert layout.parts_for(10**12) == (63, 63, 63)


def test_hilbert_visits_each_cell_once():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    at = hilbert_index(cells, 3)
    assert sorted(at) == list(range(512))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_fields(spark, spheres):
    with pytest.raises(ValueError):
        spheres.box_query((0, 0, 0), (1, 1, 1), fields=[])
    with pytest.raises(ValueError):
        spheres.box_query((0, 0, 0), (1, 1, 1), fields=["id", "raw_elements"])
    with pytest.raises(ValueError):
        spheres.box_query((0, 0, 0), (1, 1, 1), accuracy="exact")
    with pytest.raises(ValueError):
        spheres.box_counts((0, 0, 0), (1, 1, 1), group_by="post_gid")
    assert spheres.sphere_query((0, 0, 0), 5).columns == ["id", "centroid", "radius"]
    assert spheres.sphere_query((0, 0, 0), 5, fields="raw_elements").columns == ["raw_elements"]
    assert builders.empty(spark, "synapse").box_empty((0, 0, 0), (1, 1, 1))
    with pytest.raises(Exception, match="NaN"):
        builders.points_from_arrays(spark, [[np.nan, 0, 0]]).elements.collect()


def test_neurons(spark):
    points = [(1, 3, 5), (2, 4, 6), (2, 4, 6), (10, 10, 10)]
    rows = builders.neuron(spark, 1, points, [3, 2, 3, 1], [1], [2]).orderBy("section_id", "segment_id").collect()
    assert [(r["section_id"], r["segment_id"], r["radius"], r["is_soma"]) for r in rows] == [(0, 0, 3, True), (1, 0, 2.5, False), (1, 1, 2, False)]
    for bad in (
        dict(points=[], radii=[], offsets=[]), dict(points=points, radii=[1], offsets=[1]), dict(points=points, radii=[1] * 4, offsets=[1], section_types=[1, 2]),
        dict(points=points, radii=[1] * 4, offsets=[2, 1]), dict(points=points, radii=[1] * 4, offsets=[0]), dict(points=points, radii=[1] * 4, offsets=[9]), dict(points=points, radii=[1] * 4, offsets=[3]),
    ):
        with pytest.raises(ValueError):
            builders.neuron(spark, 1, **bad)
    with pytest.raises(ValueError):
        builders.neuron(spark, 1 << 36, points, [1] * 4, [1])


def test_placement(spark):
    index = builders.empty(spark, "sphere")
    region = ((0, 0, 0), (4, 1, 1))
    for i in range(3):
        done, index = index.place(region, {"id": i, "centre": (0, 0, 0), "radius": 0.8})
        assert done
    rows = index.elements.collect()
    for a in rows:
        for b in rows:
            assert a["id"] == b["id"] or sum((a[c] - b[c]) ** 2 for c in "xyz") > 1.6**2
    assert grid_steps((0, 0, 0), (8, 1, 0.5))[0] == [8, 1, 0]
    assert index.place(((0, 0, 0), (8, 1, 0.5)), {"id": 9, "centre": (0, 0, 0), "radius": 0.1})[0] is False


def test_populations(spark, spheres):
    both = Populations({"a": spheres, "b": builders.empty(spark, "sphere")})
    assert {k: d.count() for k, d in both.box_query((-99, -99, -99), (99, 99, 99)).items()} == {"a": 400, "b": 0} and len(both) == 400
    assert both.box_query((-99, -99, -99), (99, 99, 99), populations="a", population_mode="single").count() == 400
    with pytest.raises(ValueError):
        both.box_query((0, 0, 0), (1, 1, 1), population_mode="single")
    with pytest.raises(ValueError):
        both.bounds(populations=["c"])
    assert set(wrapped(spheres, lambda i: len(i), "a", "multi")) == {"a"}
    with pytest.raises(ValueError):
        Populations({"a": spheres, "b": builders.empty(spark, "point")})


def test_populations_of_one_table_take_one_scan(spark):
    rows = spark.range(60).select("id", F.col("id").cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("kind"))
    both = Populations.of(rows, "point", "kind")
    assert both.populations == ["a", "b", "c"] and len(both) == 60
    box, pair = Box.of((-0.5, -1, -1), (30.5, 1, 1)), lambda d: {(r["population"], r["id"]) for r in d.collect()}
    for names in (None, "b", ["a", "c"]):
        assert pair(both.find(box, populations=names)) == pair(both.together(lambda i: i.find(box), names))
    assert pair(Populations(both.indexes).find(box)) == {("abc"[i % 3], i) for i in range(31)}
    assert both.find(box)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert Populations.of(rows, "point", "kind", ["b"]).populations == ["b"]
    with pytest.raises(ValueError):
        both.find(box, populations=["d"])


def test_cache_has_a_budget(spark, spheres, tmp_path):
    path = str(tmp_path / "index")
    layout.write(spheres, path)
    kept = lambda cache: layout.open_index(spark, path, cache).elements.storageLevel.useMemory
    assert [kept(c) for c in (False, 0, 10, True)] == [False, False, False, True]
    spark.catalog.clearCache()
    assert kept(1 << 30)
    spark.catalog.clearCache()


SWC = """# a cell
1 1 0 0 0 3 -1
2 3 1 0 0 1 1
3 3 2 0 0 .5 2
4 3 3 1 0 .5 3

5 3 4 1 0 .5 4  # ends
6 3 3 -1 0 .5 3
7 4 3 -2 0 .25 6
8 2 -1 0 0 1 1
9 2 -2 0 0 1 8
"""


def test_sections_of_swc():
    found = {}
    for name, section, i, *place, diameter, kind in sections("cell", SWC):
        found.setdefault((section, kind), []).append((i, *place, diameter))
    assert found == {
        (0, 1): [(0, 0.0, 0.0, 0.0, 6.0)],
        (1, 3): [(0, 1.0, 0.0, 0.0, 2.0), (1, 2.0, 0.0, 0.0, 1.0)],
        (2, 3): [(0, 2.0, 0.0, 0.0, 1.0), (1, 3.0, 1.0, 0.0, 1.0), (2, 4.0, 1.0, 0.0, 1.0)],
        (3, 3): [(0, 2.0, 0.0, 0.0, 1.0), (1, 3.0, -1.0, 0.0, 1.0)],
        (4, 4): [(0, 3.0, -1.0, 0.0, 1.0), (1, 3.0, -2.0, 0.0, 0.5)],
        (5, 2): [(0, -1.0, 0.0, 0.0, 2.0), (1, -2.0, 0.0, 0.0, 2.0)],
    }
    assert sections("none", "# nothing\n\n") == []
    assert sections("soma", "1 1 0 0 0 3 -1\n2 1 4 0 0 3 1") == [("soma", 0, 0, 2.0, 0.0, 0.0, 4.0, 1)]
    long = "1 1 0 0 0 1 -1\n" + "\n".join(f"{i} 2 {i} 0 0 1 {i - 1}" for i in range(2, 20_002))
    assert len(sections("long", long)) == 20_001
    for wrong in ("1 1 0 0 0 3", "1 1 0 0 zero 3 -1", "1 2 0 0 0 3 7", "1 2 0 0 0 1 -1\n1 2 0 0 0 1 -1", "1 2 0 0 0 1 2\n2 2 0 0 0 1 1"):
        with pytest.raises(ValueError, match="bad"):
            sections("bad", wrong)


def test_cells_of_swc_files(spark, tmp_path):
    (tmp_path / "swc").mkdir()
    (tmp_path / "swc" / "cell.one.swc").write_text(SWC)
    (tmp_path / "swc" / "other.SWC").write_text("1 1 5 0 0 2 -1\n2 2 6 0 0 1 1\n3 2 7 0 0 1 2\n")
    (tmp_path / "swc" / "notes.txt").write_text("no points")
    library, centres = read_swc(spark, str(tmp_path / "swc"))
    assert {r["morphology"]: r["soma_radius"] for r in centres.collect()} == {"cell.one": 3.0, "other": 2.0}
    nodes = spark.createDataFrame([(4, "cell.one", 10.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (8, "other", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "node_id long, morphology string, x double, y double, z double, orientation_w double, orientation_x double, orientation_y double, orientation_z double")
    nodes.write.parquet(str(tmp_path / "nodes"))
    assert cli.main(["build-morphology-swc", str(tmp_path / "nodes"), str(tmp_path / "swc"), str(tmp_path / "out")], spark) == 0
    rows = layout.open_index(spark, str(tmp_path / "out")).elements.collect()
    assert {(r["gid"], r["section_id"], r["segment_id"]) for r in rows} == {(4, 0, 0), (4, 1, 0), (4, 2, 0), (4, 2, 1), (4, 3, 0), (4, 4, 0), (4, 5, 0), (8, 0, 0), (8, 1, 0)}
    at = {(r["gid"], r["section_id"], r["segment_id"]): r for r in rows}
    assert at[4, 2, 1]["p2_x"] == 14 and at[8, 1, 0]["p1_x"] == -6 and at[8, 0, 0]["p1_x"] == 5 and at[4, 4, 0]["section_type"] == 4


def test_circuit(spark, tmp_path):
    nodes = spark.createDataFrame([(4, "m", 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (8, "m", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "node_id long, morphology string, x double, y double, z double, orientation_w double, orientation_x double, orientation_y double, orientation_z double")
    library = spark.createDataFrame([("m", 1, 0, 1.0, 0.0, 0.0, 2.0, 2), ("m", 1, 1, 2.0, 0.0, 0.0, 4.0, 2)], "morphology string, section_id int, point_idx int, x double, y double, z double, diameter double, section_type int")
    centres = spark.createDataFrame([("m", 0.5, 0.0, 0.0, 3.0)], "morphology string, soma_x double, soma_y double, soma_z double, soma_radius double")
    for name, t in (("nodes", nodes), ("library", library), ("centres", centres)):
        t.write.parquet(str(tmp_path / name))
    out = str(tmp_path / "out")
    assert cli.main(["build-morphology", *[str(tmp_path / n) for n in ("nodes", "library", "centres")], out], spark) == 0
    rows = {(r["gid"], r["section_id"]): r for r in layout.open_index(spark, out).elements.collect()}
    assert rows[4, 0]["p1_x"] == 10.5 and rows[4, 1]["p1_x"] == 9 and rows[4, 1]["p2_x"] == 8 and rows[8, 1]["p2_x"] == 2 and rows[8, 1]["radius"] == 1.5
    edges = spark.createDataFrame([(0, "e", 1, 2, 0.0, 0.0, 0.0), (1, "f", 1, 3, 1.0, 0.0, 0.0)], "edge_id long, population string, source_node long, target_node long, afferent_center_x double, afferent_center_y double, afferent_center_z double")
    with pytest.raises(ValueError):
        builders.synapses_from_edges(edges)
    with pytest.raises(ValueError):
        builders.synapses_from_edges(edges, "g")
    assert len(builders.synapses_from_edges(edges, "f", [3])) == 1
    edges.write.parquet(str(tmp_path / "edges"))
    from volumetra.plans.storage import write_json

    config = {"networks": {"edges": [{"file": str(tmp_path / "edges"), "populations": {"e": {"type": "chemical"}, "f": {}, "v": {"type": "virtual"}}}], "nodes": []}}
    write_json(spark, str(tmp_path / "config.json"), config)
    assert cli.main(["build-circuit", "synapses", str(tmp_path / "config.json"), str(tmp_path / "circuit")], spark) == 0
    opened = layout.open_index(spark, str(tmp_path / "circuit"))
    assert opened.populations == ["e", "f"] and len(opened) == 2


def test_synthetic(spark):
    a = builders.synthetic_morphologies(spark, 5, 4, 10.0, 1)
    assert len(a) == 20 and a.elements.where("abs(p1_x) > 10 or abs(p2_x - p1_x) > 10.01").isEmpty()
    assert len(builders.synthetic_spheres(spark, 30, 5.0)) == 30


def test_stream(spark, spheres, tmp_path):
    spheres.elements.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spheres.elements.schema).parquet(str(tmp_path / "in"))
    box = Box.of((-3, -3, -3), (3, 3, 3))
    run = standing_query(stream, "sphere", box).select("id").writeStream.format("memory").queryName("standing").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["id"] for r in spark.table("standing").collect()} == {r["id"] for r in spheres.find(box).select("id").collect()}


def test_cells_of_boxes_of_very_different_sizes(spark):
    """One large box on each side does not make the small ones meet on its cells."""
    rng = np.random.default_rng(3)
    corners = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")

    def boxes(prefix, key):
        low = rng.uniform(0, 1000, (600, 3))
        box = np.vstack([np.hstack([low, low + 1]), [[0.0] * 3 + [1001.0] * 3]])
        rows = [(i, *map(float, b)) for i, b in enumerate(box)]
        return box, spark.createDataFrame(rows, f"{key} int, " + ", ".join(f"{prefix}{c} double" for c in corners))

    (x, left), (y, right) = boxes("q_", "q"), boxes("e_", "e")
    meet = ((x[:, None, :3] <= y[None, :, 3:]) & (x[:, None, 3:] >= y[None, :, :3])).all(2)
    got = sorted(map(tuple, join.box_pairs(left, right).select("q", "e").collect()))
    assert got == sorted(map(tuple, np.argwhere(meet).tolist()))

    def leveled(rows, p):
        return rows.withColumn(f"{p}level", join._level(Box(Vec.of([f"{p}{c}" for c in corners[:3]]), Vec.of([f"{p}{c}" for c in corners[3:]]))))

    a, b = leveled(left, "q_"), leveled(right, "e_")
    levels = [sorted({r[0] for r in t.select(f"{p}level").collect()}) for t, p in ((a, "q_"), (b, "e_"))]
    joined = join._met(a, b, ("q_", "e_"), levels[0], 0).count() + join._met(b, a, ("e_", "q_"), levels[1], 1).count()
    assert joined <= 10 * meet.sum()


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit(1).cast("long").alias("pre_gid"), F.lit(2).cast("long").alias("post_gid"), *[(F.col("id") % 10).cast("float").alias(c) for c in "xyz"])
    rows.write.parquet(str(tmp_path / "t"))
    found = SpatialIndex.of(spark.read.parquet(str(tmp_path / "t")), "synapse").box_query((1, 1, 1), (3, 3, 3), fields="id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(f"GreaterThanOrEqual({c},1.0)" in pushed and f"LessThanOrEqual({c},3.0)" in pushed for c in "xyz"), pushed
    assert found.count() == 300


def test_stored_index_prunes_parts_by_a_join(spark, tmp_path):
    rng = np.random.default_rng(5)
    index = builders.spheres_from_arrays(spark, rng.uniform(0, 1, (500, 3)), np.full(500, 0.01))
    layout.write(index, str(tmp_path / "i"), (2, 2, 2))
    stored = layout.open_index(spark, str(tmp_path / "i"))
    for low, high in (((0, 0, 0), (0.2, 0.2, 0.2)), ((2, 2, 2), (3, 3, 3)), ((0, 0, 0), (1, 1, 1))):
        ids = lambda i: sorted(r[0] for r in i.box_query(low, high, fields="id").collect())  # noqa: B023, E731
        assert ids(stored) == ids(index)
    assert "part_id IN" not in stored.box_query((0, 0, 0), (0.2, 0.2, 0.2))._jdf.queryExecution().optimizedPlan().toString()
    for k in (1, 7, 600):
        near = [list(map(tuple, i.nearest((0.3, 0.3, 0.3), k).collect())) for i in (stored, index)]
        assert near[0] == near[1] and len(near[0]) == min(k, 500)


def test_segment_tests_compile(spark, capfd):
    from volumetra import queries

    for name in ("segment_sphere_be", "segment_box_be", "segment_cylinder", "segment_join_cylinders"):
        queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    said = capfd.readouterr()
    assert "64 KB" not in said.err + said.out


def test_segment_and_box_distances_as_columns(spark):
    rng = np.random.default_rng(8)
    p, q, a, b = (rng.uniform(-1, 1, (300, 3)) for _ in range(4))
    q[:20] = p[:20]  # points
    q[20:60, 0] = p[20:60, 0]  # level along an axis
    low, high = np.minimum(a, b), np.maximum(a, b)
    rows = [tuple(float(v) for v in (*w, *x, *y, *z)) for w, x, y, z in zip(p, q, low, high, strict=True)]
    names = [f"{k}{i}" for k in "pqlh" for i in range(3)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = d.select(v.segment_box_sq(*[Vec.of([f"{k}{i}" for i in range(3)]) for k in "pqlh"]).alias("d")).collect()
    assert np.allclose([r[0] for r in got], segment_box_sq(p, q, low, high), atol=1e-12)


def test_neurons_of_a_soma_alone(spark):
    rows = builders.neuron(spark, 4, [[1, 2, 3]], [2], []).collect()
    assert [(r["gid"], r["section_id"], r["is_soma"], r["radius"]) for r in rows] == [(4, 0, True, 2.0)]
    with pytest.raises(ValueError, match="offset"):
        builders.neuron(spark, 4, [[1, 2, 3], [2, 2, 2], [3, 3, 3]], [2, 1, 1], [])


def test_synthetic_ids_and_sizes(spark):
    rows = builders.synthetic_morphologies(spark, 3, 4, 10.0).elements.collect()
    assert sorted(r["section_id"] for r in rows) == sorted([1, 2, 3, 4] * 3)
    assert {(r["gid"], r["segment_id"], r["section_type"], r["is_soma"]) for r in rows} == {(0, 0, 0, False)}
    for n in range(1, 400):
        small = max(i for i in range(1, n + 1) if n % i == 0 and i * i <= n)
        assert v.closest_factors(n) == (small, n // small)
    assert builders.synthetic_sizes(12) == (3, 4)


def test_histogram_edges(spark):
    from volumetra.operators import histogram

    edges = histogram.log10_bins()
    lengths = [0.0, 1e-9, *edges, *[e * (1 - 1e-12) for e in edges], *[e * (1 + 1e-12) for e in edges], 1e9]
    got = spark.createDataFrame([(x,) for x in lengths], "x double").select(histogram._bin(F.col("x"), edges)).collect()
    assert [r[0] for r in got] == [sum(e <= x for e in edges) for x in lengths]


def test_nan_is_refused_when_an_index_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"), 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "id long, x float, y float, z float")
    index = SpatialIndex.of(rows, "point")
    assert [r[0] for r in index.box_query((-1, -1, -1), (1, 1, 1), fields="id").collect()] == [2]
    with pytest.raises(Exception, match="NaN"):
        layout.write(index, str(tmp_path / "n"))


def test_hot_cell_is_dealt_out(spark):
    """All boxes in one cell: pairs come out of several partitions, none lost or twice."""
    rng = np.random.default_rng(11)
    corners = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")

    def boxes(prefix, key, n, side):
        low = rng.uniform(0.2, 0.3, (n, 3))
        box = np.hstack([low, low + side])
        return box, spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(box)], f"{key} int, " + ", ".join(f"{prefix}{c} double" for c in corners))

    (x, left), (y, right) = boxes("q_", "q", 700, 0.9), boxes("e_", "e", 5000, 0.001)
    meet = ((x[:, None, :3] <= y[None, :, 3:]) & (x[:, None, 3:] >= y[None, :, :3])).all(2)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = join.box_pairs(left, right).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.count_distinct("q", "e").alias("u")).collect()
    finally:
        for k, value_ in kept.items():
            spark.conf.set(k, value_)
    assert sum(r["n"] for r in got) == sum(r["u"] for r in got) == meet.sum()
    assert max(r["n"] for r in got) < 0.9 * meet.sum()


def test_cylinders_join_by_arrays_as_by_columns(spark, monkeypatch):
    """Tiles as arrays find what the columns' tests find, in hot cells and sparse ones, with axes of no length, nulls and NaN; fields can be any."""
    from pyspark.sql.types import StructType

    from volumetra.operators.shapes import condition, element_shape

    monkeypatch.setattr(join, "TILE", 16)
    rng = np.random.default_rng(12)
    schema = StructType.fromDDL("gid long, section_id int, segment_id int, p1_x float, p1_y float, p1_z float, p2_x float, p2_y float, p2_z float, radius float, section_type int, is_soma boolean, note string")
    rows = []
    for i in range(400):
        at = rng.uniform(-1, 1, 3) * (1 if i < 200 else 60)
        end = at if i % 9 == 0 else at + rng.normal(0, 0.3, 3)
        soma = i % 7 == 0
        rows.append((i, 0 if soma else 1, 0, *map(float, at), *([None] * 3 if soma else map(float, end)), float(rng.exponential(0.2) * (i % 11 > 0)), 1, soma, None if i % 5 else f"n{i}"))
    rows += [(900, 1, 0, *[float("nan")] * 3, 0.0, 0.0, 0.0, 1.0, 2, False, "nan"), (901, 1, 0, *[0.0] * 6, None, 2, False, "none"), (902, 1, 0, *[0.0] * 6, 30.0, 2, False, "large")]
    index = SpatialIndex.of(spark.createDataFrame(rows, schema), "morphology")
    q = index.elements.where("not is_soma").select(F.col("gid").alias("ask"), *[F.col(c).alias(f"s_{c}") for c in ("p1_x", "p1_y", "p1_z", "p2_x", "p2_y", "p2_z", "radius")])
    shape = Cylinder.of([f"s_p1_{c}" for c in "xyz"], [f"s_p2_{c}" for c in "xyz"], "s_radius")
    box_test, exact = condition(shape, element_shape("morphology"))
    expected = sorted(map(tuple, q.crossJoin(index.elements).where(box_test).where(exact).select("ask", "gid").collect()))
    joined = join.spatial_join(index, q, shape, fields=["ask", "gid", "note", "section_id"])
    assert joined.columns == ["ask", "gid", "note", "section_id"]
    got = joined.collect()
    assert len(expected) > 1000 and sorted((r["ask"], r["gid"]) for r in got) == expected
    assert {r["gid"]: r["note"] for r in got} == {r[0]: r[12] for r in rows if r[0] in {g["gid"] for g in got}}
    assert "FlatMapCoGroupsInArrow" in joined._jdf.queryExecution().executedPlan().toString()
    assert join.spatial_join(index, q.where("false"), shape).isEmpty() and set(join.spatial_join(index, q, shape).columns) == {*q.columns, *index.elements.columns}


def test_only_elements_that_differ_meet_the_windows(spark, monkeypatch):
    """Missing, moved and repeated elements against brute force; those that both indexes have alike are not joined."""
    rng = np.random.default_rng(13)
    alike = [(i, *map(float, rng.uniform(0, 1, 3)), 0.05) for i in range(300)]
    a = alike + [(500 + i, *map(float, rng.uniform(0, 1, 3)), 0.1) for i in range(40)] + [(700, 0.5, 0.5, 0.5, 0.1)] * 2 + [(701, 0.5, 0.5, 0.5, 0.1), (None, 0.2, 0.2, 0.2, 0.1)]
    b = alike[::-1] + [(500 + i, *map(float, rng.uniform(0, 1, 3)), 0.1) for i in range(20)] + [(700, 0.5, 0.5, 0.5, 0.1)] + [(701, 0.4, 0.5, 0.5, 0.1)] * 3 + [(999, 0.5, 0.5, 0.5, 9.0)]
    left, right = (SpatialIndex.of(spark.createDataFrame(r, "id long, x float, y float, z float, radius float"), "sphere") for r in (a, b))
    at = rng.uniform(0, 1, (30, 3))
    windows = spark.createDataFrame([(i, *map(float, p - 0.15), *map(float, p + 0.15)) for i, p in enumerate(at)], "window int, ax double, ay double, az double, bx double, by double, bz double")
    joined, real = [], compare.spatial_join
    monkeypatch.setattr(compare, "spatial_join", lambda index, *rest, **more: joined.append(index.elements.count()) or real(index, *rest, **more))

    def inside(rows, half):
        found = {}
        for i, *p, r in rows:
            p, r = np.float32(p).astype(float), float(np.float32(r))
            for w, c in enumerate(at):
                if (np.maximum(np.abs(p - c) - half, 0) ** 2).sum() <= r * r:
                    found[w, i] = found.get((w, i), 0) + 1
        return found

    for slack in (0.0, 0.02, -0.05):
        n, m = inside(a, 0.15), inside(b, 0.15 + slack)
        expected = {k for k, v in n.items() if v > m.get(k, 0)}
        got = [tuple(r) for r in compare.missing_in_windows(left, right, windows, slack).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
        if slack >= 0:
            assert sum(joined) < 60
        joined.clear()
