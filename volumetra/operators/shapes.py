"""Shapes of queries and elements, their boxes, and which pairs intersect.

A query shape is given by numbers, or by columns of a table of queries. Every
test is two-fold: the boxes intersect (closed, plain comparisons that reach the
scan), and an exact test holds. With accuracy ``bounding_box`` the element is
its box, while the query keeps its shape.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import Vec, along, clamp, dist_sq, held, let, lower, number, project_on_segment, segment_box_sq, segment_segment_sq, upper, vec
from ..schema import P1, P2, XYZ

ACCURACIES = ("best_effort", "bounding_box")
TINY, EPSILON = float(np.finfo(np.float32).tiny), float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class Box:
    low: Vec
    high: Vec

    @staticmethod
    def of(corner, opposite) -> Box:
        """From any two opposite corners."""
        if not isinstance(corner, Vec) and not any(isinstance(v, (str, Column)) for v in (*corner, *opposite)):
            pairs = [sorted((float(np.float32(a)), float(np.float32(b)))) for a, b in zip(corner, opposite, strict=True)]
            return Box(Vec.of([p[0] for p in pairs]), Vec.of([p[1] for p in pairs]))
        a, b = Vec.of(corner), Vec.of(opposite)
        return Box(lower(a, b), upper(a, b))

    def box(self) -> Box:
        return self

    def meets(self, other: Box) -> Column:
        return functools.reduce(lambda a, b: a & b, [c for i in "xyz" for c in (getattr(self.low, i) <= getattr(other.high, i), getattr(self.high, i) >= getattr(other.low, i))])

    def centroid(self) -> Vec:
        return (self.low + self.high) * F.lit(0.5)

    def characteristic_length(self) -> Column:
        return (self.high - self.low).maximum()

    def translate(self, by: Vec) -> Box:
        return Box(self.low + by, self.high + by)

    def contains_inside(self, p: Vec) -> Column:
        """Strictly within."""
        return functools.reduce(lambda a, b: a & b, [c for i in "xyz" for c in (getattr(p, i) > getattr(self.low, i), getattr(p, i) < getattr(self.high, i))])

    def distance_sq(self, p: Vec) -> Column:
        return dist_sq(p, clamp(p, self.low, self.high))


@dataclass(frozen=True)
class Sphere:
    centre: Vec
    radius: Column
    #: Of radius 0: its box is bare columns, so that filters reach the scan.
    dot: bool = False

    @staticmethod
    def of(centre, radius) -> Sphere:
        return Sphere(Vec.of(centre), number(F.col(radius) if isinstance(radius, str) else radius))

    def box(self) -> Box:
        return Box(self.centre, self.centre) if self.dot else Box(self.centre - self.radius, self.centre + self.radius)

    def centroid(self) -> Vec:
        return self.centre

    def characteristic_length(self) -> Column:
        return self.radius * 2

    def translate(self, by: Vec) -> Sphere:
        return Sphere(self.centre + by, self.radius)

    def contains(self, p: Vec) -> Column:
        return dist_sq(self.centre, p) <= self.radius * self.radius


@dataclass(frozen=True)
class Cylinder:
    p1: Vec
    p2: Vec
    radius: Column

    @staticmethod
    def of(p1, p2, radius) -> Cylinder:
        return Cylinder(Vec.of(p1), Vec.of(p2), number(F.col(radius) if isinstance(radius, str) else radius))

    def box(self) -> Box:
        """The tight box; for ends so near that the axis has no direction, that of their spheres."""
        v = self.p2 - self.p1
        scale = F.greatest(self.radius * self.radius, self.p1.square().maximum(), self.p2.square().maximum())
        share = v.square() / (F.lit(TINY) + scale * EPSILON + v.norm_sq())
        e = share.map(lambda s: F.sqrt(F.greatest(F.lit(0.0), 1 - s)) * self.radius)
        return Box(lower(self.p1, self.p2) - e, upper(self.p1, self.p2) + e)

    def centroid(self) -> Vec:
        return (self.p1 + self.p2) * F.lit(0.5)

    def length(self) -> Column:
        return F.sqrt(dist_sq(self.p1, self.p2))

    def characteristic_length(self) -> Column:
        return F.greatest(self.radius, self.length())

    def translate(self, by: Vec) -> Cylinder:
        return Cylinder(self.p1 + by, self.p2 + by, self.radius)

    def contains(self, p: Vec) -> Column:
        """Within the flat caps and the radius; a cylinder of no length contains nothing."""
        u, v = p - self.p1, self.p2 - self.p1
        uv, vv = u.dot(v), v.norm_sq()
        inside = uv.between(0, vv) & (u.norm_sq() - F.try_divide(uv * uv, vv) <= self.radius * self.radius)
        return F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class Point:
    at: Vec

    def box(self) -> Box:
        return Box(self.at, self.at)

    def centroid(self) -> Vec:
        return self.at

    def characteristic_length(self) -> Column:
        return F.lit(0.0)


@dataclass(frozen=True)
class SomaOrSegment:
    """A row that is a sphere where ``is_soma`` holds, else a cylinder."""

    is_soma: Column
    sphere: Sphere
    cylinder: Cylinder

    def _either(self, a: Vec, b: Vec) -> Vec:
        return a.zip(b, lambda x, y: F.when(self.is_soma, x).otherwise(y))

    def box(self) -> Box:
        a, b = self.sphere.box(), self.cylinder.box()
        return Box(self._either(a.low, b.low), self._either(a.high, b.high))

    def centroid(self) -> Vec:
        return self._either(self.sphere.centroid(), self.cylinder.centroid())

    def characteristic_length(self) -> Column:
        return F.when(self.is_soma, self.sphere.characteristic_length()).otherwise(self.cylinder.characteristic_length())


def sphere_cylinder(s: Sphere, c: Cylinder) -> Column:
    """Exact for flat caps: with the axial and the radial distance from the barrel. No axis, no intersection."""
    def near(f: Column) -> Column:
        u, v = vec(f, "c") - vec(f, "p"), vec(f, "q") - vec(f, "p")
        return let(distances, length=v.norm(), uu=u.norm_sq(), uv=u.dot(v), r=f["r"], s=f["s"])

    def distances(f: Column) -> Column:
        return let(hit, axial=F.try_divide(f["uv"], f["length"]), length=f["length"], uu=f["uu"], r=f["r"], s=f["s"])

    def hit(f: Column) -> Column:
        radial = F.sqrt(F.greatest(F.lit(0.0), f["uu"] - f["axial"] * f["axial"]))
        beyond = F.greatest(-f["axial"], f["axial"] - f["length"])
        aside = F.greatest(F.lit(0.0), radial - f["r"])
        return F.when(beyond <= 0, radial <= f["s"] + f["r"]).otherwise(beyond * beyond + aside * aside <= f["s"] * f["s"])

    return F.coalesce(let(near, **held(c=s.centre, p=c.p1, q=c.p2), r=c.radius, s=s.radius), F.lit(False))


def intersects(a, b) -> Column:
    """The exact test of two shapes, in either order."""
    for first, second in ((a, b), (b, a)):
        match first, second:
            case SomaOrSegment(), _:
                return F.when(first.is_soma, intersects(first.sphere, second)).otherwise(intersects(first.cylinder, second))
            case Box(), Box():
                return first.meets(second)
            case Box(), Point():
                return first.contains_inside(second.at)
            case Box(), Sphere():
                return first.distance_sq(second.centre) <= second.radius * second.radius
            case Box(), Cylinder():
                away = segment_box_sq(second.p1, second.p2, first.low, first.high)
                return let(lambda f: (f["d"] < f["r"] * f["r"]) | (f["d"] == 0), d=away, r=second.radius)
            case Sphere(), Sphere():
                reach = first.radius + second.radius
                return reach * reach >= dist_sq(first.centre, second.centre)
            case Sphere(), Point():
                return first.contains(second.at)
            case Sphere(), Cylinder():
                return sphere_cylinder(first, second)
            case Cylinder(), Cylinder():
                reach = first.radius + second.radius
                return segment_segment_sq(first.p1, first.p2, second.p1, second.p2) <= reach * reach
            case Cylinder(), Point():
                return first.contains(second.at)
    raise TypeError(f"no test for {type(a).__name__} and {type(b).__name__}")


def element_shape(element_type: str, prefix: str = ""):
    """The shape that a row of the type stands for. Synapses are spheres of no radius."""
    name = lambda names: [F.col(f"{prefix}{n}") for n in names]
    match element_type:
        case "point":
            return Point(Vec.of(name(XYZ)))
        case "sphere":
            return Sphere.of(name(XYZ), F.col(f"{prefix}radius"))
        case "synapse":
            return Sphere(Vec.of(name(XYZ)), F.lit(0.0), dot=True)
        case "box":
            return Box(Vec.of(name(["min_x", "min_y", "min_z"])), Vec.of(name(["max_x", "max_y", "max_z"])))
        case "morphology":
            radius = F.col(f"{prefix}radius")
            return SomaOrSegment(F.col(f"{prefix}is_soma"), Sphere.of(name(P1), radius), Cylinder.of(name(P1), name(P2), radius))
    raise ValueError(f"unknown element type: {element_type!r}")


def condition(query, element, accuracy: str = "best_effort") -> tuple[Column, Column]:
    """(test of the boxes, exact test) of a query shape and an element."""
    if accuracy not in ACCURACIES:
        raise ValueError(f"accuracy must be one of {ACCURACIES}, not {accuracy!r}")
    box = element.box()
    exact = intersects(query, box) if accuracy == "bounding_box" and not isinstance(element, Point) else intersects(query, element)
    return query.box().meets(box), exact


__all__ = ["Box", "Cylinder", "Point", "SomaOrSegment", "Sphere", "along", "condition", "element_shape", "intersects", "project_on_segment"]
