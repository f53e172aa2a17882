"""Vector arithmetic as Column expressions."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GID_BITS, SECTION_BITS, SEGMENT_BITS


def number(value) -> Column:
    """A double: of a column, or of a Python number as single precision holds it."""
    return value.cast("double") if isinstance(value, Column) else F.lit(float(np.float32(value)))


@dataclass(frozen=True)
class Vec:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(values) -> Vec:
        if isinstance(values, Vec):
            return values
        values = [F.col(v) if isinstance(v, str) else v for v in values]
        return Vec(*[number(v) for v in values])

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def zip(self, other, f) -> Vec:
        other = other if isinstance(other, Vec) else Vec(other, other, other)
        return Vec(*[f(a, b) for a, b in zip(self, other, strict=True)])

    def map(self, f) -> Vec:
        return Vec(*[f(a) for a in self])

    def __add__(self, o):
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self.zip(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self.zip(o, lambda a, b: a * b)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return self.zip(o, lambda a, b: b - a)

    def __truediv__(self, o):
        """Division by zero gives null, which matches nothing."""
        return self.zip(o, lambda a, b: F.try_divide(a, F.lit(b) if isinstance(b, (int, float)) else b))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def cross_2d(self, o: Vec) -> Column:
        return self.x * o.y - self.y * o.x

    def norm_sq(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm_sq())

    def square(self) -> Vec:
        return self * self

    def sqrt(self) -> Vec:
        return self.map(F.sqrt)

    def abs(self) -> Vec:
        return self.map(F.abs)

    def maximum(self) -> Column:
        return F.greatest(*self)

    def minimum(self) -> Column:
        return F.least(*self)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def dist_sq(a: Vec, b: Vec) -> Column:
    return (a - b).norm_sq()


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(dist_sq(a, b))


def lower(a: Vec, b: Vec) -> Vec:
    return a.zip(b, F.least)


def upper(a: Vec, b: Vec) -> Vec:
    return a.zip(b, F.greatest)


def nearly_equal(a: Vec, b: Vec) -> Column:
    """Equal, or nearer than 1e-4 of the first's norm."""
    d = dist_sq(a, b)
    return (d == 0) | (d < a.norm_sq() * 1e-8)


def clamp(x, low, high):
    if isinstance(x, Vec):
        return lower(upper(x, low), high)
    return F.greatest(low, F.least(x, high))


def along(base: Vec, direction: Vec, x: Vec) -> Column:
    """Where x projects on the line, in units of its direction; null for no direction."""
    return F.try_divide((x - base).dot(direction), direction.norm_sq())


def project_on_line(base: Vec, direction: Vec, x: Vec) -> Vec:
    return base + direction * along(base, direction, x)


def project_on_segment(base: Vec, direction: Vec, x: Vec) -> Vec:
    return base + direction * clamp(along(base, direction, x), F.lit(0.0), F.lit(1.0))


def point_segment_sq(x: Vec, a: Vec, b: Vec) -> Column:
    """Squared distance of a point and a segment, which may be a point."""
    t = clamp(F.coalesce(along(a, b - a, x), F.lit(0.0)), F.lit(0.0), F.lit(1.0))
    return dist_sq(x, a + (b - a) * t)


def let(body, **values: Column) -> Column:
    """``body`` of values that are computed once a row: each is a field of a struct, so that no expression is written out again at every use."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(held), body), 1)


def held(**vectors: Vec) -> dict[str, Column]:
    """The components of vectors as fields for ``let``; ``vec`` reads them there."""
    return {f"{k}{i}": c for k, v in vectors.items() for i, c in enumerate(v)}


def vec(fields: Column, name: str) -> Vec:
    return Vec(*[fields[f"{name}{i}"] for i in range(3)])


def segment_segment_sq(a0: Vec, a1: Vec, b0: Vec, b1: Vec) -> Column:
    """Squared distance of two segments: of the lines' nearest points if both lie inside, else an end is nearest."""

    def products(f: Column) -> Column:
        u, v, w = (vec(f, n) for n in "uvw")
        return let(nearest, uu=u.norm_sq(), uv=u.dot(v), vv=v.norm_sq(), uw=u.dot(w), vw=v.dot(w), ww=w.norm_sq())

    def nearest(f: Column) -> Column:
        uu, uv, vv, uw, vw, ww = (f[n] for n in ("uu", "uv", "vv", "uw", "vw", "ww"))

        def end(away: Column, dot: Column, size: Column) -> Column:
            """From an end to the other segment: its squared distance from that one's start, its dot with that one's axis, the axis squared."""
            t = clamp(F.coalesce(F.try_divide(dot, size), F.lit(0.0)), F.lit(0.0), F.lit(1.0))
            return let(lambda g: g["away"] - g["t"] * (2 * g["dot"] - g["t"] * g["size"]), t=t, away=away, dot=dot, size=size)

        def inner(g: Column) -> Column:
            s, t = g["s"], g["t"]
            return F.when(s.between(0.0, 1.0) & t.between(0.0, 1.0), ww + s * (s * uu + 2 * uw) + t * (t * vv - 2 * vw) - 2 * s * t * uv)

        det = uu * vv - uv * uv
        lines = let(inner, s=F.try_divide(uv * vw - vv * uw, det), t=F.try_divide(uu * vw - uv * uw, det))
        ends = [end(ww, vw, vv), end(ww + 2 * uw + uu, vw + uv, vv), end(ww, -uw, uu), end(ww - 2 * vw + vv, uv - uw, uu)]
        return F.greatest(F.lit(0.0), F.least(*ends, lines))  # least passes over a null

    return let(products, **held(u=a1 - a0, v=b1 - b0, w=a0 - b0))


def segment_box_sq(p1: Vec, p2: Vec, low: Vec, high: Vec) -> Column:
    """Squared distance of a segment and a box.

    Along a segment the squared distance is convex and piecewise quadratic: its
    derivative is linear between the points where a coordinate enters or leaves
    the box's range, so the minimum is at one of these, an end, or the root of the
    derivative between two of them.
    """

    def over(f: Column) -> Column:
        p, d, low, high = (vec(f, n) for n in ("p", "d", "l", "h"))
        outside = lambda t: (p + d * t).zip(low, lambda x, a: F.least(x - a, F.lit(0.0))) + (p + d * t).zip(high, lambda x, b: F.greatest(x - b, F.lit(0.0)))
        cuts = [clamp(F.coalesce(F.try_divide(edge - at, way), F.lit(0.0)), F.lit(0.0), F.lit(1.0)) for corner in (low, high) for edge, at, way in zip(corner, p, d, strict=True)]

        def nearest(g: Column) -> Column:
            between = F.transform(F.sequence(F.lit(0), F.size(g["t"]) - 2), lambda i: root(g["t"][i], g["t"][i + 1], g["slope"][i], g["slope"][i + 1]))
            return F.array_min(F.transform(F.concat(g["t"], between), lambda t: outside(t).norm_sq()))

        def root(t: Column, t2: Column, g: Column, g2: Column) -> Column:
            return F.when((g < 0) & (g2 > 0), t - g * (t2 - t) / (g2 - g)).otherwise(t)

        at = F.array_sort(F.array(F.lit(0.0), F.lit(1.0), *cuts))
        return let(lambda g: let(nearest, t=g["t"], slope=F.transform(g["t"], lambda t: outside(t).dot(d))), t=at)

    return let(over, **held(p=p1, d=p2 - p1, l=low, h=high))


def rotate(q: tuple[Column, Column, Column, Column], p: Vec) -> Vec:
    """p rotated by the quaternion (w, x, y, z), normalised; one of no length turns nothing."""
    size = F.sqrt(functools.reduce(lambda a, b: a + b, [c * c for c in q]))
    w, x, y, z = [F.coalesce(F.try_divide(c, size), F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q)]
    axis = Vec(x, y, z)
    twice = axis.cross(p) * F.lit(2.0)
    return p + twice * w + axis.cross(twice)


def pack_id(gid: Column, section: Column, segment: Column) -> Column:
    """36, 14 and 14 bits in one LONG (negative from gid 2^35 on); an id out of range is an error."""
    ok = gid.between(0, (1 << GID_BITS) - 1) & section.between(0, (1 << SECTION_BITS) - 1) & segment.between(0, (1 << SEGMENT_BITS) - 1)
    packed = F.shiftleft(gid.cast("long"), SECTION_BITS + SEGMENT_BITS).bitwiseOR(F.shiftleft(section.cast("long"), SEGMENT_BITS)).bitwiseOR(segment.cast("long"))
    return F.when(ok, packed).otherwise(F.raise_error(F.lit("id out of range")).cast("long"))


def unpack_id(packed: Column) -> tuple[Column, Column, Column]:
    mask = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftrightunsigned(packed, SECTION_BITS + SEGMENT_BITS), mask(F.shiftright(packed, SEGMENT_BITS), SECTION_BITS).cast("int"), mask(packed, SEGMENT_BITS).cast("int")


def balanced_chunk(rank: Column, n: Column, k: int) -> Column:
    """Which of k chunks the row of that rank (from 0) is in: n // k rows each, one more in the first n % k."""
    size, more = F.floor(n / k), n % k
    edge = more * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(more + F.floor(F.try_divide(rank - edge, size))).cast("int")


def balanced_chunks(n: int, k: int) -> list[tuple[int, int]]:
    cuts = [i * (n // k) + min(i, n % k) for i in range(k + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def closest_factors(n: int) -> tuple[int, int]:
    """The two factors of n nearest to each other, the smaller first; (0, 1) for 0.

    Every divisor is a product of some of n's prime factors, so all of them are
    gathered prime by prime; the largest whose square is at most n is the smaller.
    """
    if n == 0:
        return 0, 1
    divisors, rest, prime = {1}, n, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        while rest % prime == 0:
            divisors |= {d * prime for d in divisors}
            rest //= prime
        prime += 1
    small = max(d for d in divisors if d * d <= n)
    return small, n // small
