"""Kernels on arrays, for what built-in expressions would say at too great a length."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_box_sq(p1: np.ndarray, p2: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of segments and boxes (n x 3 each), for arrays on the driver; tests hold the Column form against it.

    Along a segment the squared distance is convex and piecewise quadratic: its
    derivative is linear between the points where a coordinate enters or leaves
    the box's range, so the minimum is at one of these, an end, or the root of the
    derivative between two of them.
    """
    d = p2 - p1
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts = np.concatenate([(low - p1) / d, (high - p1) / d], axis=1)
    cuts = np.clip(np.nan_to_num(cuts, nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
    t = np.sort(np.concatenate([cuts, np.zeros((len(d), 1)), np.ones((len(d), 1))], axis=1), axis=1)

    def outside(at: np.ndarray) -> np.ndarray:
        x = p1[:, None, :] + at[:, :, None] * d[:, None, :]
        return np.minimum(x - low[:, None, :], 0) + np.maximum(x - high[:, None, :], 0)

    out = outside(t)
    slope = (out * d[:, None, :]).sum(2)
    rise = slope[:, 1:] - slope[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        root = t[:, :-1] - slope[:, :-1] * (t[:, 1:] - t[:, :-1]) / rise
    root = np.clip(np.where(np.isfinite(root), root, t[:, :-1]), t[:, :-1], t[:, 1:])
    return np.minimum((out**2).sum(2).min(1), (outside(root) ** 2).sum(2).min(1))


def _stack(columns) -> np.ndarray:
    return np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)


def hilbert_index(cells: np.ndarray, order: int = 10) -> np.ndarray:
    """Position on a 3-D Hilbert curve of integer cells (n x 3, each below 2**order), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(3):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    x[1] ^= x[0]
    x[2] ^= x[1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t = np.where((x[2] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(3):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _hilbert(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    cells = np.clip((_stack((x, y, z)) * 1024).astype(np.int64), 0, 1023)
    return pd.Series(hilbert_index(cells))


def hilbert(x: Column, y: Column, z: Column) -> Column:
    """Hilbert position of coordinates scaled to [0, 1]."""
    return F.pandas_udf(_hilbert, "long")(x, y, z)


#: Pairs that are tested at once (some dozens of arrays of this length are held), and least rows of a batch but the last.
PAIRS_AT_ONCE, BATCH_ROWS = 1 << 13, 1 << 16


def _dot(a, b) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def segments_apart_sq(a0, a1, b0, b1) -> np.ndarray:
    """Squared distances of segments, whose ends are three arrays each that broadcast; as ``vectors.segment_segment_sq``."""
    u, v, w = ([q - p for p, q in zip(x, y, strict=True)] for x, y in ((a0, a1), (b0, b1), (b0, a0)))
    uu, uv, vv, uw, vw, ww = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w), _dot(w, w)

    def end(away, dot, size):
        """A segment of no length has a dot of 0."""
        t = dot / np.where(size == 0, 1.0, size)
        np.minimum(np.maximum(t, 0.0, out=t), 1.0, out=t)
        x = t * size
        np.subtract(2 * dot, x, out=x)
        np.multiply(x, t, out=x)
        return np.subtract(away, x, out=x)

    det = uu * vv - uv * uv
    uw2, vw2 = 2 * uw, 2 * vw
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        s, t = (uv * vw - vv * uw) / det, (uu * vw - uv * uw) / det
        lines = ww + s * (s * uu + uw2) + t * (t * vv - vw2) - 2 * s * t * uv
        inner = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1) & (det != 0)
    lines[~inner] = np.inf
    for away, dot, size in ((ww, vw, vv), (ww + uw2 + uu, vw + uv, vv), (ww, -uw, uu), (ww - vw2 + vv, uv - uw, uu)):
        np.minimum(lines, end(away, dot, size), out=lines)
    return np.maximum(lines, 0.0, out=lines)


def sphere_meets_cylinder(centre, r, p, q, radius) -> np.ndarray:
    """Whether spheres meet cylinders of flat caps, of arrays that broadcast; as ``shapes.sphere_cylinder``."""
    u, v = [a - b for a, b in zip(centre, p, strict=True)], [a - b for a, b in zip(q, p, strict=True)]
    uu, uv, length = _dot(u, u), _dot(u, v), np.sqrt(_dot(v, v))
    axial = uv / np.where(length == 0, np.nan, length)
    radial = np.sqrt(np.maximum(0.0, uu - axial * axial))
    beyond, aside = np.maximum(-axial, axial - length), np.maximum(0.0, radial - radius)
    return np.where(beyond <= 0, radial <= r + radius, beyond * beyond + aside * aside <= r * r)


_ENDS = [f"p{i}_{c}" for i in (1, 2) for c in "xyz"]
_BOX = [f"{m}_{c}" for m in ("min", "max") for c in "xyz"]


def _meet(q: np.ndarray, e: np.ndarray, somas: bool) -> np.ndarray:
    """Of queries and elements, whose numbers (ends, radius, box) are rows of arrays that broadcast."""
    near = (q[7] <= e[10]) & (q[10] >= e[7])
    for i in (8, 9):
        near &= (q[i] <= e[i + 3]) & (q[i + 3] >= e[i])
    if somas:
        return near & sphere_meets_cylinder(e[:3], e[6], q[:3], q[3:6], q[6])
    reach = e[6] + q[6]
    return near & (segments_apart_sq(e[:3], e[3:6], q[:3], q[3:6]) <= reach * reach)


def _hits(q: np.ndarray, e: np.ndarray, somas: bool):
    """(places in q, places in e) of pairs that meet, in pieces."""
    step = max(1, PAIRS_AT_ONCE // max(1, e.shape[1]))
    for start in range(0, q.shape[1] if e.shape[1] else 0, step):
        i, j = np.divmod(np.flatnonzero(_meet(q[:, start : start + step, None], e[:, None, :], somas)), e.shape[1])
        yield i + start, j


def _flat_hits(q: np.ndarray, e: np.ndarray, tiles: list, soma: np.ndarray):
    """The same of many small tiles, each (places in q, places in e), their pairs laid out one after another."""
    places = [np.concatenate(x) for x in zip(*[(np.repeat(a, len(b)), np.tile(b, len(a))) for a, b in tiles], strict=True)]
    for somas in (False, True):
        mine = soma[places[1]] == somas
        for k in range(0, int(mine.sum()), PAIRS_AT_ONCE):
            i, j = (x[mine][k : k + PAIRS_AT_ONCE] for x in places)
            hit = _meet(q[:, i], e[:, j], somas)
            yield i[hit], j[hit]


def _found(q: np.ndarray, e: np.ndarray, soma: np.ndarray, q_tile: np.ndarray, e_tile: np.ndarray):
    by_tile = [np.argsort(t, kind="stable") for t in (q_tile, e_tile)]
    cuts = [np.searchsorted(t[o], np.arange(max(q_tile.max(), e_tile.max()) + 2)) for t, o in zip((q_tile, e_tile), by_tile, strict=True)]
    small, waiting = [], 0
    for k in np.intersect1d(q_tile, e_tile):
        a, b = (o[c[k] : c[k + 1]] for o, c in zip(by_tile, cuts, strict=True))
        if len(a) * len(b) >= PAIRS_AT_ONCE // 2:
            for somas in (False, True):
                own = b[soma[b] == somas]
                for i, j in _hits(q[:, a], e[:, own], somas):
                    yield a[i], own[j]
            continue
        small.append((a, b))
        waiting += len(a) * len(b)
        if waiting >= 32 * PAIRS_AT_ONCE:
            yield from _flat_hits(q, e, small, soma)
            small, waiting = [], 0
    if small:
        yield from _flat_hits(q, e, small, soma)


def _batched(pieces):
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= BATCH_ROWS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def capsule_hits(tile: list[str], names: list[str]):
    """For a cogroup of queries (cylinders) and elements (segments and somas): the named columns of pairs that share a tile and meet."""

    def numbers(rows: pa.Table, p: str) -> np.ndarray:
        return np.stack([rows[f"{p}{c}"].to_numpy().astype(np.float64) for c in (*_ENDS, "radius", *_BOX)])

    def hits(queries: pa.Table, elements: pa.Table) -> pa.Table:
        of = [(name, queries if name in queries.column_names else elements) for name in names]
        schema = pa.schema([t.schema.field(name) for name, t in of])
        if not len(queries) or not len(elements):
            return schema.empty_table()
        cells = np.concatenate([np.stack([t[c].to_numpy() for c in tile], axis=1) for t in (queries, elements)]).astype(np.int64)
        tiles = np.unique(cells, axis=0, return_inverse=True)[1].reshape(-1)
        soma = elements["e_soma"].to_numpy().astype(bool)
        columns = [(t is queries, t[name].combine_chunks()) for name, t in of]
        found = _found(numbers(queries, "q_"), numbers(elements, "e_"), soma, tiles[: len(queries)], tiles[len(queries) :])
        batches = [pa.record_batch([c.take(pa.array(i if own else j)) for own, c in columns], schema=schema) for i, j in _batched(found)]
        return pa.Table.from_batches(batches, schema)

    return hits
