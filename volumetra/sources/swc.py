"""Morphologies from SWC text files: a line a point, of number, type, x, y, z, radius and the parent's number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOMA = 1
POINTS = "morphology string, section_id int, point_idx int, x double, y double, z double, diameter double, section_type int"


def _points(name: str, text: str) -> dict[int, tuple]:
    out = {}
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if not words:
            continue
        try:
            number, kind, *place, parent = words[:7]
            x, y, z, radius = map(float, place)
            row = (int(kind), x, y, z, radius, int(parent))
        except ValueError:
            raise ValueError(f"{name}: {line.strip()!r} is no point") from None
        if int(number) in out:
            raise ValueError(f"{name}: two points have the number {number}")
        out[int(number)] = row
    return out


def sections(name: str, text: str) -> list[tuple]:
    """Rows of ``POINTS``: sections from 1 on, parents before their children, and the soma as the only point of section 0.

    A section begins after the soma, where its parent has several children, and
    where the type changes; unless it begins at the soma, its first point is the
    parent's last one. The soma's centre is the mean of its points, its radius the
    largest distance from there, or a single point's own. A file without points
    has no rows.
    """
    points = _points(name, text)
    children: dict[int, list[int]] = {}
    roots = []
    for number, (kind, *_, parent) in points.items():
        if parent >= 0 and parent not in points:
            raise ValueError(f"{name}: point {number} has no parent {parent}")
        if kind != SOMA:
            (roots if parent < 0 or points[parent][0] == SOMA else children.setdefault(parent, [])).append(number)
    row = lambda section, i, number: (name, section, i, *points[number][1:4], 2 * points[number][4], points[number][0])
    rows, seen = [], 0
    soma = np.array([p[1:5] for p in points.values() if p[0] == SOMA])
    if len(soma):
        centre = soma[:, :3].mean(axis=0)
        radius = soma[0, 3] if len(soma) == 1 else np.linalg.norm(soma[:, :3] - centre, axis=1).max()
        rows.append((name, 0, 0, *map(float, centre), 2 * float(radius), SOMA))
    section, waiting = 0, [(r, None) for r in reversed(roots)]
    while waiting:
        at, before = waiting.pop()
        section += 1
        run = [at] if before is None else [before, at]
        while len(after := children.get(run[-1], [])) == 1 and points[after[0]][0] == points[run[-1]][0]:
            run.append(after[0])
        kind = points[at][0]
        rows += [(*row(section, i, number)[:-1], kind) for i, number in enumerate(run)]
        seen += len(run) - (before is not None)
        waiting += [(c, run[-1]) for c in reversed(after)]
    if seen != sum(p[0] != SOMA for p in points.values()):
        raise ValueError(f"{name}: points in a circle")
    return rows


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in POINTS.split(", ")]
    for batch in batches:
        for name, text in zip(batch["morphology"], batch["value"], strict=True):
            yield pd.DataFrame(sections(name, text), columns=columns)


def read_swc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(library, centres) as ``morphologies_from_nodes`` takes them, from a file or a folder of them; a file's name without its ending is the morphology's. No shuffle."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.[sS][wW][cC]")
    named = files.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("morphology"), "value")
    points = named.mapInPandas(_read, POINTS)
    soma = points.where("section_id = 0")
    return points.where("section_id > 0"), soma.select("morphology", *[F.col(c).alias(f"soma_{c}") for c in "xyz"], (F.col("diameter") / 2).alias("soma_radius"))
