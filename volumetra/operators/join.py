"""Joins of a table of query boxes with elements, by grid cells of several sizes.

Each box has a level: the power of two that its longest side does not exceed. A
pair meets on the larger of its two levels: an equi-join on (level, cell), once
with the queries and once with the elements as the larger; boxes of one side never
meet on a level that neither has. An element is in the cell of its lower corner
alone, a query in all cells where a corner of an element that it meets can be, so
that no pair is joined twice. Cells that hold many rows of both sides are dealt
out in tiles of about TILE by TILE rows: no task holds a whole hot cell, and its
memory does not grow with the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.kernels import capsule_hits
from ..functions.vectors import Vec
from ..plans.storage import saved
from ..schema import BOUNDS, KEYS, P1, P2
from .index import SpatialIndex
from .shapes import Box, Cylinder, condition, element_shape

LEAST_LEVEL = -20
#: Rows of a side in a tile of a hot cell, on average. A side of at most FEW rows in all is not dealt out.
TILE, FEW = 2048, 64
#: Pairs of boxes in a partition, if pairs are many beside the rows; rows that a task makes for the tiles of the other side.
PAIRS, COPIES, MOST_PARTITIONS = 1 << 22, 1 << 20, 4096
CELL = ["_way", "_at", "_c0", "_c1", "_c2"]


def _level(box: Box) -> Column:
    side = F.greatest((box.high - box.low).maximum(), F.lit(2.0**LEAST_LEVEL))
    return F.ceil(F.log2(side)).cast("int")


def _celled(rows: DataFrame, prefix: str, level: Column, most: int | None) -> DataFrame:
    """A row for each cell of a level, ``_at``: an element's lower corner, or all where a query may meet one of level ``most`` or less."""
    rows = rows.withColumn("_at", level)
    size = F.pow(F.lit(2.0), F.col("_at"))
    low, high = [[F.col(f"{prefix}{m}_{c}") for c in "xyz"] for m in ("min", "max")]
    if prefix == "e_":  # of one place, but exploded: else tests for null would be pushed below, and write out the boxes' arithmetic again
        rows = rows.withColumn("_c", F.explode(F.array(F.struct(*[F.floor(a / size).alias(f"_c{i}") for i, a in enumerate(low)]))))
        return rows.select("*", "_c.*").drop("_c")
    reach = size if most is None else F.least(size, F.lit(2.0**most))
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        a = a - reach * (1 + 1e-6) - F.abs(a) * 1e-12  # sides and levels are rounded
        rows = rows.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(a / size), F.floor(b / size))))
    return rows


def _sides(large: DataFrame, small: DataFrame, of: tuple[str, str], levels: list[int], more: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables by cells of the level of the ``large`` side's boxes; the small ones' levels are lower by ``more`` or more.

    A small box goes to the cells of those levels alone that a large one has.
    """
    at = F.explode(F.filter(F.lit(levels).cast("array<int>"), lambda v: v >= F.col(f"{of[1]}level") + more))
    sides = _celled(large, of[0], F.col(f"{of[0]}level"), most), _celled(small, of[1], at, most)
    return tuple(side.withColumn("_way", F.lit(more)) for side in sides)


def _met(large: DataFrame, small: DataFrame, of: tuple[str, str], levels: list[int], more: int) -> DataFrame:
    """Pairs of boxes of one cell, see ``_sides``."""
    a, b = _sides(large, small, of, levels, more)
    return a.join(b, CELL)


def _in_tiles(queries: DataFrame, elements: DataFrame, few: bool) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides with ``_tq``, ``_te``, ``_hot``: which tile of its cell a row goes to; rows and pairs of cells that both have.

    A row of a hot cell has one place on its own side, by a hash of the whole row,
    and goes to all tiles of the other's.
    """
    if few:
        places = [F.lit(0).alias(c) for c in ("_tq", "_te")]
        return *[side.select("*", *places, F.lit(False).alias("_hot")) for side in (queries, elements)], 0, 0
    n = [side.groupBy(*CELL).agg(F.count("*").alias(c)) for side, c in ((queries, "_nq"), (elements, "_ne"))]
    seen = Observation()
    met = n[0].join(n[1], CELL)
    copies = [F.sum(F.col(f"_n{own}") * F.ceil(F.col(f"_n{other}") / TILE).cast("double")).alias(own) for own, other in ("qe", "eq")]
    met = met.observe(seen, *copies, F.sum(F.col("_nq").cast("double") * F.col("_ne")).alias("pairs"), F.sum(F.col("_nq") + F.col("_ne")).alias("rows"))
    tiles = [F.ceil(F.col(c) / TILE).cast("int").alias(f"{c}_tiles") for c in ("_nq", "_ne")]
    hot = saved(met.where((F.col("_nq") > TILE) | (F.col("_ne") > TILE)).select(*CELL, *tiles))
    out = []
    for side, own, other in ((queries, "q", "e"), (elements, "e", "q")):
        named = [c for c in side.columns if "map<" not in side.schema[c].dataType.simpleString() and c not in CELL]
        place = F.pmod(F.xxhash64(*named), F.coalesce(f"_n{own}_tiles", F.lit(1))).cast("int")
        rows = side.join(F.broadcast(hot), CELL, "left").withColumn("_hot", F.col("_nq_tiles").isNotNull()).withColumn(f"_t{own}", place)
        if (many := seen.get[own] or 0) > 4 * COPIES:
            shuffled = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.repartition(min(MOST_PARTITIONS, max(shuffled, math.ceil(many / COPIES))), *CELL, f"_t{own}")
        rows = rows.withColumn(f"_t{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_n{other}_tiles", F.lit(1)) - 1)))
        out.append(rows.drop("_nq_tiles", "_ne_tiles"))
    return *out, int(seen.get["rows"] or 0), int(seen.get["pairs"] or 0)


def _partitions(pairs: int) -> int:
    return min(MOST_PARTITIONS, max(1, math.ceil(pairs / PAIRS)))


def _dealt(queries: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """``_in_tiles`` of two tables of boxes, q_min_x ... and e_min_x ..., by the cells of all levels."""

    def leveled(rows: DataFrame, p: str) -> DataFrame:
        box = Box(Vec(*[F.col(f"{p}min_{c}") for c in "xyz"]), Vec(*[F.col(f"{p}max_{c}") for c in "xyz"]))
        return rows.withColumn(f"{p}level", _level(box))

    queries, elements = leveled(queries, "q_"), leveled(elements, "e_")
    # A few dozen rows: the exponents of box sides.
    found = queries.select("q_level", F.lit(True).alias("q")).union(elements.select("e_level", F.lit(False))).groupBy("q_level", "q").count().collect()
    levels = [sorted(r[0] for r in found if r["q"] is q and r[0] is not None) for q in (True, False)]
    few = min(sum(r["count"] for r in found if r["q"] is q) for q in (True, False)) <= FEW
    most = max(levels[1], default=LEAST_LEVEL)
    by_query = _sides(queries, elements, ("q_", "e_"), levels[0], 0, most)
    by_element = _sides(elements, queries, ("e_", "q_"), levels[1], 1)
    q, e = by_query[0].unionByName(by_element[1]), by_query[1].unionByName(by_element[0])
    return _in_tiles(q.drop("q_level"), e.drop("e_level"), few)


def box_pairs(queries: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs whose boxes intersect. Both tables have a box: q_min_x ... of queries, e_min_x ... of elements."""
    q, e, rows, pairs = _dealt(queries, elements)
    on = [*CELL, "_tq", "_te"]
    if pairs > 64 * rows:  # many more pairs than rows: partitions by rows would be too few
        q, e = (side.repartition(_partitions(pairs), *on) for side in (q, e))
    pairs = q.drop("_hot").join(e.drop("_hot"), on)
    for c in "xyz":
        pairs = pairs.where((F.col(f"q_min_{c}") <= F.col(f"e_max_{c}")) & (F.col(f"q_max_{c}") >= F.col(f"e_min_{c}")))
    return pairs.drop(*on)


def _capsule_pairs(index: SpatialIndex, queries: DataFrame, query: Cylinder, names: list[str]) -> DataFrame:
    """``spatial_join`` of cylinders with morphologies, the columns named only: tiles are tested whole, as arrays."""
    shape = [c.alias(f"q_{n}") for n, c in zip((*P1, *P2, "radius"), [*query.p1, *query.p2, query.radius], strict=True)]
    q = with_box(queries, query, "q_").select(*[c for c in queries.columns if c in names], *shape, *[f"q_{b}" for b in BOUNDS])
    own = index.elements.drop(*BOUNDS)
    shape = [F.col(c).cast("double").alias(f"e_{c}") for c in (*P1, *P2, "radius")]
    e = with_box(own, element_shape("morphology"), "e_").select(*[c for c in own.columns if c in names], *shape, F.col("is_soma").alias("e_soma"), *[f"e_{b}" for b in BOUNDS])
    schema = DataFrame.select(queries.crossJoin(own), *names).schema
    q, e, rows, pairs = _dealt(q, e)
    # Cells of few rows share a group, so that no group is much smaller than a tile.
    groups = max(1, rows // (4 * TILE))
    tile = [*CELL, "_tq", "_te"]
    group = F.when(F.col("_hot"), F.xxhash64(*tile)).otherwise(F.pmod(F.xxhash64(*tile), F.lit(groups)))
    parts = max(_partitions(pairs), math.ceil(rows / (64 * TILE)))
    q, e = (side.withColumn("_group", group).drop("_hot").repartition(parts, "_group").groupBy("_group") for side in (q, e))
    return q.cogroup(e).applyInArrow(capsule_hits(tile, names), schema)


def with_box(rows: DataFrame, shape, prefix: str) -> DataFrame:
    box = shape.box()
    return rows.select("*", *[v.alias(f"{prefix}{c}") for c, v in zip(BOUNDS, [*box.low, *box.high], strict=True)])


def spatial_join(index: SpatialIndex, queries: DataFrame, query, accuracy: str = "best_effort", fields: list[str] | None = None) -> DataFrame:
    """All (query, element) rows that intersect.

    ``query`` is a shape over columns of ``queries``, whose names must differ
    from the elements'. ``fields``: the columns to return, of both; all if None.
    """
    elements = index.elements.drop(*BOUNDS)
    names = fields or [*queries.columns, *elements.columns]
    box_test, exact = condition(query, element_shape(index.element_type), accuracy)
    if isinstance(query, Cylinder) and index.element_type == "morphology" and accuracy == "best_effort":
        return _capsule_pairs(index, queries, query, names)
    pairs = box_pairs(with_box(queries, query, "q_"), with_box(elements, element_shape(index.element_type), "e_"))
    return pairs.where(box_test).where(exact).select(*names)


def batch_counts(index: SpatialIndex, queries: DataFrame, query, key: str, accuracy: str = "best_effort") -> DataFrame:
    """(key, n) for every query, 0 included."""
    counts = spatial_join(index, queries, query, accuracy).groupBy(key).agg(F.count("*").alias("n"))
    return queries.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def non_empty(index: SpatialIndex, queries: DataFrame, query, key: str, accuracy: str = "best_effort") -> DataFrame:
    """Queries that meet an element (semi-join)."""
    return queries.join(spatial_join(index, queries, query, accuracy).select(key).distinct(), key, "left_semi")


def empty(index: SpatialIndex, queries: DataFrame, query, key: str, accuracy: str = "best_effort") -> DataFrame:
    """Queries that meet none (anti-join)."""
    return queries.join(spatial_join(index, queries, query, accuracy).select(key).distinct(), key, "left_anti")


def batch_nearest(index: SpatialIndex, queries: DataFrame, point: list[str], key: str, k: int) -> DataFrame:
    """(key, element key, distance_sq, rank): the k elements nearest to each query point by their boxes, ties by key.

    Cubes around the points grow until each meets the boxes of k elements nearer
    than its half side: one join a round, for the queries still open. Any element
    whose box misses the cube is at least the half side away.
    """
    bounds = index.bounds().first()
    n = len(index)
    keys = KEYS[index.element_type]
    p = Vec.of(point)
    if not n:
        return queries.limit(0).select(key, *[F.lit(None).cast("long").alias(c) for c in keys], F.lit(0.0).alias("distance_sq"), F.lit(0).alias("rank"))
    sides = [max(bounds[f"max_{c}"] - bounds[f"min_{c}"], 1e-3) for c in "xyz"]
    reach = max((math.prod(sides) * k / n) ** (1 / 3), max(sides) * 1e-4)
    corner = queries.agg(*[f(c).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i, c in enumerate(point)]).first()
    far = [max(abs(v) for v in (bounds[f"max_{c}"], bounds[f"min_{c}"], corner[f"min{i}"] or 0, corner[f"max{i}"] or 0)) for i, c in enumerate("xyz")]
    most = 4 * max(far) + 1
    shape = element_shape(index.element_type)
    away = shape.box().distance_sq(p)
    elements = with_box(index.elements.drop(*BOUNDS), shape, "e_")
    done, open_ = None, queries.select(key, *point)
    while True:
        last = reach >= most
        near = box_pairs(with_box(open_, Box(p - F.lit(reach), p + F.lit(reach)), "q_"), elements)
        near = near.select(key, *keys, away.alias("distance_sq"))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance_sq", *keys))).where(F.col("rank") <= k)
        full = ranked if last else ranked.join(ranked.where((F.col("rank") == min(k, n)) & (F.col("distance_sq") < reach**2)).select(key), key, "left_semi")
        full = saved(full)
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        open_ = saved(open_.join(full.select(key).distinct(), key, "left_anti"))
        if open_.isEmpty():
            return done
        reach *= 2.5
