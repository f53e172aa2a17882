"""Histogram of segment lengths in logarithmic bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import SpatialIndex
from .shapes import element_shape


def log10_bins(low: int = -8, high: int = 6, per_decade: int = 4) -> list[float]:
    """Edges 10**low ... 10**high, so many in each decade."""
    return [10.0 ** (low + i / per_decade) for i in range((high - low) * per_decade + 1)]


def _bin(length: Column, edges: list[float]) -> Column:
    """How many of the edges, equally spaced in their logarithms, a length reaches: a guess from its logarithm, corrected by the edges beside it."""
    span = math.log10(edges[-1] / edges[0]) / (len(edges) - 1)
    guess = F.floor((F.log10(F.greatest(length, F.lit(edges[0] / 10))) - math.log10(edges[0])) / span).cast("int") + 1
    guess = F.least(F.lit(len(edges)), F.greatest(F.lit(0), guess))
    edge = lambda i: F.get(F.lit(edges), i)  # noqa: E731  (null beyond the ends)
    return guess - F.coalesce(edge(guess - 1) > length, F.lit(False)).cast("int") + F.coalesce(edge(guess) <= length, F.lit(False)).cast("int")


def segment_length_histogram(index: SpatialIndex, edges: list[float] | None = None) -> DataFrame:
    """(bin, n): bin i holds lengths in [edge i-1, edge i), 0 what is shorter, the last what is longer; empty bins too. Somas do not count."""
    edges = edges or log10_bins()
    length = element_shape(index.element_type).cylinder.length()
    counts = index.elements.where(~F.col("is_soma")).select(length.alias("_length")).select(_bin(F.col("_length"), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = index.elements.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
