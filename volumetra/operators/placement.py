"""Placing a shape where nothing is: the first free position of a grid over a region.

The grid has a step of an eighth of the region's longest side or a little more,
in x, then y, then z order. A side shorter than that step has no position, and a
shape may reach beyond the region's far side.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ..functions.vectors import Vec
from .index import SpatialIndex
from .join import spatial_join
from .shapes import Box, Cylinder, Sphere, element_shape


def grid_steps(low, high) -> tuple[list[int], list[float]]:
    sides = [float(h) - float(v) for v, h in zip(low, high, strict=True)]
    step = max(sides) / 8
    numbers = [int(s / step) if step else 0 for s in sides]
    return numbers, [s / n if n else 0.0 for s, n in zip(sides, numbers, strict=True)]


def first_free(index: SpatialIndex, region: tuple, shape) -> tuple[float, float, float] | None:
    """How far to move the shape. At most 512 candidates meet the elements near the region, which a scan's filter finds first."""
    spark = index.elements.sparkSession
    low, high = [[f(a, b) for a, b in zip(*region, strict=True)] for f in (min, max)]
    numbers, steps = grid_steps(low, high)
    if not all(numbers):
        return None
    box = shape.box()
    own = spark.range(1).select(*[v.alias(c) for c, v in zip(("ax", "ay", "az", "bx", "by", "bz"), [*box.low, *box.high], strict=True)]).first()
    cells = [(i, j, k) for i in range(numbers[0]) for j in range(numbers[1]) for k in range(numbers[2])]
    moves = [tuple(float(low[d] - own[d] + c[d] * steps[d]) for d in range(3)) for c in cells]
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(moves)], "place int, dx double, dy double, dz double")
    moved = shape.translate(Vec.of(["dx", "dy", "dz"]))
    size = [own[3 + d] - own[d] for d in range(3)]
    near = index.elements.where(element_shape(index.element_type).box().meets(Box.of(low, [h + s for h, s in zip(high, size, strict=True)])))
    taken = spatial_join(replace(index, elements=near, manifest=None), table, moved).select("place").distinct()
    free = table.join(taken, "place", "left_anti").orderBy("place").limit(1).collect()
    return tuple(free[0][1:]) if free else None


def place(index: SpatialIndex, region: tuple, shape) -> tuple[bool, SpatialIndex]:
    """shape: {'id': ..., 'centre': ..., 'radius': ...}, or for morphologies {'gid', 'section_id', 'segment_id', 'p1', 'p2', 'radius', 'section_type'}."""
    solid = Cylinder.of(shape["p1"], shape["p2"], shape["radius"]) if "p1" in shape else Sphere.of(shape["centre"], shape["radius"])
    move = first_free(index, region, solid)
    if move is None:
        return False, index
    by = lambda p: [float(np.float32(a + d)) for a, d in zip(p, move, strict=True)]
    if "p1" in shape:
        row = (shape["gid"], shape["section_id"], shape["segment_id"], *by(shape["p1"]), *by(shape["p2"]), float(shape["radius"]), shape.get("section_type", 0), False)
    else:
        row = (shape["id"], *by(shape["centre"]), float(shape["radius"]))
    return True, index.insert_rows([row])
