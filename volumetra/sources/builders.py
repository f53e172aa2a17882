"""Builders of indexes from arrays and tables.

Circuits come as tables (Parquet exports with the usual column names): edges
with source and target nodes and afferent centres, nodes with a position, an
orientation and the name of a morphology, and the morphologies' points.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, closest_factors, rotate
from ..operators.index import SpatialIndex
from ..schema import P1, P2, SCHEMAS, XYZ, conform

log = logging.getLogger("volumetra")
LARGE_SYNAPSES, LARGE_CELLS = 1_000_000_000, 100_000


def _points(points, what: str) -> np.ndarray:
    out = np.asarray(points, dtype=np.float32)
    if out.ndim != 2 or out.shape[1] != 3:
        raise ValueError(f"{what} must be n x 3")
    if np.isnan(out).any():
        raise ValueError(f"{what} hold NaN")
    return out


def spheres_from_arrays(spark: SparkSession, centroids, radii, ids=None) -> SpatialIndex:
    centroids, radii = _points(centroids, "centroids"), np.asarray(radii, dtype=np.float32)
    ids = np.arange(len(centroids)) if ids is None else np.asarray(ids)
    if not len(centroids) == len(radii) == len(ids):
        raise ValueError("centroids, radii and ids differ in length")
    frame = pd.DataFrame({"id": ids.astype(np.int64), **{c: centroids[:, i] for i, c in enumerate(XYZ)}, "radius": radii})
    return SpatialIndex.of(spark.createDataFrame(frame, SCHEMAS["sphere"]) if len(frame) else spark.createDataFrame([], SCHEMAS["sphere"]), "sphere")


def points_from_arrays(spark: SparkSession, positions, ids=None) -> SpatialIndex:
    positions = _points(positions, "positions")
    ids = np.arange(len(positions)) if ids is None else np.asarray(ids)
    if len(positions) != len(ids):
        raise ValueError("positions and ids differ in length")
    frame = pd.DataFrame({"id": ids.astype(np.int64), **{c: positions[:, i] for i, c in enumerate(XYZ)}})
    return SpatialIndex.of(spark.createDataFrame(frame, SCHEMAS["point"]) if len(frame) else spark.createDataFrame([], SCHEMAS["point"]), "point")


def empty(spark: SparkSession, element_type: str) -> SpatialIndex:
    return SpatialIndex.of(spark.createDataFrame([], SCHEMAS[element_type]), element_type)


def choose_population(rows: DataFrame, population: str | None = None) -> DataFrame:
    """The rows of a population; without a name, of the only one. Tables without that column have one."""
    if "population" not in rows.columns:
        return rows
    if population is None:
        names = [r[0] for r in rows.select("population").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError("several populations: name one")
        return rows.drop("population")
    rows = rows.where(F.col("population") == population)
    if rows.isEmpty():
        raise ValueError(f"no population {population!r}")
    return rows.drop("population")


def select_ids(rows: DataFrame, column: str, ids: DataFrame | Sequence[int] | None) -> DataFrame:
    """Rows whose column is among ids: a few numbers, or a table's first column (semi-join)."""
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return rows.where(F.col(column).isin([int(i) for i in ids]))


def synapses_from_edges(edges: DataFrame, population: str | None = None, target_gids=None) -> SpatialIndex:
    """Edges: edge_id, source_node, target_node, afferent_center_x, _y, _z."""
    rows = select_ids(choose_population(edges, population), "target_node", target_gids)
    own = [F.col("edge_id").alias("id"), F.col("source_node").alias("pre_gid"), F.col("target_node").alias("post_gid")]
    return SpatialIndex.of(rows.select(*own, *[F.col(f"afferent_center_{c}").alias(c) for c in XYZ]), "synapse")


def warn_if_large(index: SpatialIndex, stored: bool = False) -> None:
    most = LARGE_SYNAPSES if index.element_type == "synapse" else LARGE_CELLS
    if not stored and index.element_type == "synapse" and len(index) >= most:
        log.warning("an index of %d synapses or more should be stored in parts", most)
    if not stored and index.element_type == "morphology" and index.elements.select("gid").distinct().count() > most:
        log.warning("an index of more than %d cells should be stored in parts", most)


def branches(points: DataFrame) -> DataFrame:
    """Segments between consecutive points of a section: gid, section_id, point_idx, x, y, z, radius, section_type.

    N + 1 points make N segments; a segment's radius is the mean of its ends'.
    """
    w = Window.partitionBy("gid", "section_id").orderBy("point_idx")
    after = points.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (*XYZ, "radius")], (F.row_number().over(w) - 1).alias("segment_id")).where("next_x is not null")
    ends = [F.col(a).alias(b) for a, b in zip((*XYZ, *[f"next_{c}" for c in XYZ]), (*P1, *P2), strict=True)]
    radius = ((F.col("radius").cast("double") + F.col("next_radius").cast("double")) / 2).alias("radius")
    return conform(after.select("gid", "section_id", "segment_id", *ends, radius, "section_type", F.lit(False).alias("is_soma")), "morphology")


def somas(cells: DataFrame) -> DataFrame:
    """gid, x, y, z, radius: section 0, segment 0, no second end."""
    ends = [F.col(a).alias(b) for a, b in zip(XYZ, P1, strict=True)] + [F.lit(None).cast("float").alias(c) for c in P2]
    return conform(cells.select("gid", F.lit(0).alias("section_id"), F.lit(0).alias("segment_id"), *ends, "radius", F.lit(1).alias("section_type"), F.lit(True).alias("is_soma")), "morphology")


def neuron(spark: SparkSession, gid: int, points, radii, offsets, section_types=None, has_soma: bool = True) -> DataFrame:
    """One neuron's rows: the first point is its soma (if it has one), branch i the points from offset i to the next one."""
    points, radii = _points(points, "points"), np.asarray(radii, dtype=np.float32)
    offsets = np.asarray(offsets, dtype=np.int64)
    types = np.zeros(len(offsets), dtype=np.int64) if section_types is None else np.asarray(section_types)
    checks = {
        "no points": len(points) == 0,
        "points and radii differ in length": len(points) != len(radii),
        "section types and offsets differ in length": len(types) != len(offsets),
        "offsets must increase": bool((np.diff(offsets) <= 0).any()),
        "the first offset must follow the soma": len(offsets) > 0 and offsets[0] < int(has_soma),
        "an offset is beyond the points": len(offsets) > 0 and offsets[-1] >= len(points),
        "points after the soma need an offset": len(offsets) == 0 and len(points) > int(has_soma),
        "a branch needs two points": bool((np.diff([*offsets, len(points)]) < 2).any()) if len(offsets) else False,
        "an id is out of range": not 0 <= gid < 1 << 36,
    }
    for message, wrong in checks.items():
        if wrong:
            raise ValueError(message)
    parts = []
    if not len(offsets):
        log.warning("neuron %d has no branches", gid)
    if has_soma:
        parts.append(somas(spark.createDataFrame([(gid, *[float(v) for v in points[0]], float(radii[0]))], "gid long, x float, y float, z float, radius float")))
    rows = [(gid, s + 1, i, *[float(v) for v in points[i]], float(radii[i]), int(types[s])) for s, (a, b) in enumerate(zip(offsets, [*offsets, len(points)][1:], strict=True)) for i in range(int(a), int(b))]
    if rows:
        parts.append(branches(spark.createDataFrame(rows, "gid long, section_id int, point_idx int, x float, y float, z float, radius float, section_type int")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def morphologies_from_nodes(nodes: DataFrame, library: DataFrame, centres: DataFrame, population: str | None = None, gids=None) -> SpatialIndex:
    """Cells placed in space.

    ``nodes``: node_id, morphology, x, y, z, orientation_w, _x, _y, _z. ``library``:
    morphology, section_id, point_idx, x, y, z, diameter, section_type. ``centres``:
    morphology, soma_x, soma_y, soma_z, soma_radius. Neurites are rotated and
    moved; a soma's centre is moved only.
    """
    nodes = select_ids(choose_population(nodes, population), "node_id", gids)
    at, turn = Vec.of([f"n_{c}" for c in XYZ]), tuple(F.col(f"orientation_{c}").cast("double") for c in "wxyz")
    nodes = nodes.select("node_id", "morphology", *[F.col(c).alias(f"n_{c}") for c in XYZ], *[f"orientation_{c}" for c in "wxyz"])
    placed = rotate(turn, Vec.of(XYZ)) + at
    points = nodes.join(library, "morphology").select(
        F.col("node_id").alias("gid"), "section_id", "point_idx", *[v.cast("float").alias(c) for c, v in zip(XYZ, placed, strict=True)], (F.col("diameter") / 2).cast("float").alias("radius"), "section_type"
    )
    centre = Vec.of(["soma_x", "soma_y", "soma_z"]) + at
    bodies = nodes.join(centres, "morphology").select(F.col("node_id").alias("gid"), *[v.cast("float").alias(c) for c, v in zip(XYZ, centre, strict=True)], F.col("soma_radius").cast("float").alias("radius"))
    return SpatialIndex.of(somas(bodies).unionByName(branches(points)), "morphology")


def synthetic_spheres(spark: SparkSession, n: int, boundary: float, seed: int = 0) -> SpatialIndex:
    at = [((F.rand(seed + i) * 2 - 1) * boundary).cast("float").alias(c) for i, c in enumerate(XYZ)]
    return SpatialIndex.of(spark.range(n).select("id", *at, (F.rand(seed + 3) * 0.99 + 0.01).cast("float").alias("radius")), "sphere")


def synthetic_sizes(n_elements: int) -> tuple[int, int]:
    """(sections, segments of each) for a number of elements: its divisors nearest to each other."""
    return closest_factors(n_elements)


def synthetic_morphologies(spark: SparkSession, n_sections: int, n_segments: int, boundary: float, seed: int = 0) -> SpatialIndex:
    """Segments that start uniformly within the boundary and reach up to 10 further, of radius 1 and no section type, all of gid 0.

    Section ids go from 1 to ``n_segments`` over and over; every segment id is 0.
    """
    rows = spark.range(n_sections * n_segments).select(F.lit(0).cast("long").alias("gid"), (F.col("id") % n_segments + 1).cast("int").alias("section_id"), F.lit(0).alias("segment_id"), *[((F.rand(seed + i) * 2 - 1) * boundary).alias(c) for i, c in enumerate(P1)])
    rows = rows.select("*", *[(F.col(a) + F.rand(seed + 3 + i) * 20 - 10).alias(b) for i, (a, b) in enumerate(zip(P1, P2, strict=True))], F.lit(1.0).alias("radius"), F.lit(0).alias("section_type"), F.lit(False).alias("is_soma"))
    return SpatialIndex.of(rows, "morphology")


def circuit_populations(spark: SparkSession, config_path: str, kind: str) -> dict[str, dict]:
    """Populations of a circuit's JSON config: {"networks": {"nodes"|"edges": [{"file", "populations": {name: {"type", ...}}}]}}; virtual ones left out."""
    from ..plans.storage import read_json

    config = read_json(spark, config_path)
    section = {"segments": "nodes", "synapses": "edges"}[kind]
    supported = {"nodes": {"biophysical"}, "edges": {"chemical"}}[section]
    out = {}
    for entry in config["networks"][section]:
        for name, own in entry["populations"].items():
            of = (own or {}).get("type", next(iter(supported)))
            if of == "virtual":
                continue
            if of not in supported:
                raise ValueError(f"population {name}: type {of!r} is not supported")
            out[name] = {"file": entry["file"], **(config.get("components", {})), **(own or {})}
    return out


def chunks(n: int, size: int = 100_000) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]

