"""Whether two indexes hold the same elements."""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec
from ..schema import BOUNDS, KEYS, SCHEMAS
from .index import SpatialIndex
from .join import spatial_join
from .shapes import Box, condition, element_shape


def missing_in_windows(left: SpatialIndex, right: SpatialIndex, windows: DataFrame, slack: float = 0.0) -> DataFrame:
    """(window, key) of left elements in a window that are not among right's in the window grown by ``slack``.

    ``windows`` has (window, ax, ay, az, bx, by, bz). Keys may repeat: they are compared with how often they occur.
    An element that both have alike is in both or none of two windows, so only the
    others meet the windows; the rows of a pair are counted only for keys that repeat.
    """
    own = KEYS[left.element_type]
    low, high, grow = Vec.of(["ax", "ay", "az"]), Vec.of(["bx", "by", "bz"]), F.lit(float(slack))
    window, grown = Box(low, high), Box(low - grow, high + grow)
    shapes = {p: [f.name for f in SCHEMAS[index.element_type].fields if f.name not in own] for p, index in (("", left), ("_r_", right))}
    both = [index.elements.select(*own, *[F.col(c).alias(f"{p}{c}") for c in shapes[p]], F.lit(p == "").alias("_left")) for p, index in (("", left), ("_r_", right))]
    both = both[0].unionByName(both[1], allowMissingColumns=True)
    # Of a key with one row on a side, max is that row's value.
    values = [F.max(f"{p}{c}").alias(f"{p}{c}") for p, names in shapes.items() for c in names]
    keys = both.groupBy(*own).agg(F.count_if("_left").alias("_n"), F.count_if(~F.col("_left")).alias("_m"), *values)
    alike = F.lit(slack >= 0 and left.element_type == right.element_type) & (F.col("_m") == 1)
    alike = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shapes[""] if c in shapes["_r_"]], alike)
    once = keys.where((F.col("_n") == 1) & (F.col("_m") <= 1) & ~alike)
    there = functools.reduce(lambda a, b: a & b, condition(grown, element_shape(right.element_type, "_r_")))
    met = spatial_join(SpatialIndex(once, left.element_type), windows, window)
    found = met.where((F.col("_m") == 0) | ~F.coalesce(there, F.lit(False))).select("window", *own)
    repeated = keys.where((F.col("_n") > 0) & ((F.col("_n") > 1) | (F.col("_m") > 1))).select(*[F.col(c).alias(f"_of_{c}") for c in own])
    if repeated.isEmpty():
        return found

    def same(names: list[str], p: str) -> Column:
        return functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{p}{c}")) for c in names])

    def counted(index: SpatialIndex, box: Box, n: str) -> DataFrame:
        rows = index.elements.join(repeated, same(own, "_of_"), "left_semi")
        return spatial_join(SpatialIndex(rows, index.element_type), windows, box).groupBy("window", *own).agg(F.count("*").alias(n))

    names = ["window", *own]
    a, b = counted(left, window, "n"), counted(right, grown, "m").select("m", *[F.col(c).alias(f"_of_{c}") for c in names])
    return found.union(a.join(b, same(names, "_of_"), "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select(*names))


def windows_equal(left: SpatialIndex, right: SpatialIndex, windows: DataFrame, slack: float = 0.0) -> bool:
    return missing_in_windows(left, right, windows, slack).isEmpty() and missing_in_windows(right, left, windows, slack).isEmpty()


def n_windows(confidence: float, error_rate: float) -> int:
    return math.ceil(math.log(1 - confidence) / math.log(1 - error_rate))


def likely_same(left: SpatialIndex, right: SpatialIndex, confidence: float = 0.99, error_rate: float = 0.001, rtol: float = 1e-5, seed: int = 0) -> bool:
    """Same type, size and bounds, and equal answers in random windows, as many as the confidence takes, in one join."""
    if left.element_type != right.element_type or len(left) != len(right):
        return False
    a, b = left.bounds().first(), right.bounds().first()
    if any((a[c] is None) != (b[c] is None) or (a[c] is not None and not math.isclose(a[c], b[c], rel_tol=rtol, abs_tol=rtol)) for c in BOUNDS):
        return False
    if a[0] is None:
        return True
    rng, rows = random.Random(seed), []
    # Windows of about one element, were they spread evenly.
    extent = [a[f"max_{c}"] - a[f"min_{c}"] for c in "xyz"]
    half = [e / len(left) ** (1 / 3) / 2 for e in extent]
    for i in range(n_windows(confidence, error_rate)):
        at = [rng.uniform(a[f"min_{c}"], a[f"max_{c}"]) for c in "xyz"]
        rows.append((i, *[x - h for x, h in zip(at, half, strict=True)], *[x + h for x, h in zip(at, half, strict=True)]))
    windows = left.elements.sparkSession.createDataFrame(rows, "window int, ax double, ay double, az double, bx double, by double, bz double")
    return windows_equal(left, right, windows, rtol * max(extent))
