"""Several populations under one set of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import SpatialIndex


@dataclass(frozen=True)
class Populations:
    indexes: dict[str, SpatialIndex]
    #: All elements in one table, and the column of it that names populations; None where each has a table of its own.
    table: SpatialIndex | None = None
    column: str = "population"

    def __post_init__(self):
        kinds = {i.element_type for i in self.indexes.values()}
        if len(kinds) > 1:
            raise ValueError(f"populations of different element types: {sorted(kinds)}")

    @staticmethod
    def of(elements: DataFrame, element_type: str, column: str = "population", names: list[str] | None = None) -> Populations:
        """One index for each value of a column (a few); without their names, these are looked up."""
        if names is None:
            names = [r[0] for r in elements.select(column).distinct().orderBy(column).collect()]
        own = {n: SpatialIndex.of(elements.where(F.col(column) == n).drop(column), element_type) for n in names}
        return Populations(own, SpatialIndex.of(elements, element_type), column)

    @property
    def populations(self) -> list[str]:
        return list(self.indexes)

    @property
    def element_type(self) -> str:
        return next(iter(self.indexes.values())).element_type

    @property
    def builtin_fields(self) -> list[str]:
        return next(iter(self.indexes.values())).builtin_fields

    def _chosen(self, populations) -> list[str]:
        names = self.populations if populations is None else [populations] if isinstance(populations, str) else list(populations)
        unknown = [n for n in names if n not in self.indexes]
        if unknown:
            raise ValueError(f"unknown populations {unknown}")
        return names

    def each(self, query: Callable[[SpatialIndex], object], populations=None, population_mode: str | None = None):
        """The query's result by population; with mode ``single``, that of the only one."""
        names = self._chosen(populations)
        if population_mode == "single":
            if len(names) != 1:
                raise ValueError(f"mode 'single' needs one population, not {len(names)}")
            return query(self.indexes[names[0]])
        return {n: query(self.indexes[n]) for n in names}

    def together(self, query: Callable[[SpatialIndex], DataFrame], populations=None) -> DataFrame:
        """One table with a ``population`` column."""
        out = None
        for n in self._chosen(populations):
            part = query(self.indexes[n]).withColumn("population", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    def find(self, query, accuracy: str = "best_effort", populations=None) -> DataFrame:
        """Whole rows that intersect a shape, with a ``population`` column; populations of one table are answered by one scan of it."""
        names = self._chosen(populations)
        if self.table is None:
            return self.together(lambda i: i.find(query, accuracy), names)
        chosen = replace(self.table, elements=self.table.elements.where(F.col(self.column).isin(names)))
        return chosen.find(query, accuracy).withColumnRenamed(self.column, "population")

    def __getattr__(self, name: str):
        if name in ("box_query", "sphere_query", "cylinder_query", "box_counts", "sphere_counts", "box_empty", "sphere_empty", "bounds", "size", "nearest"):
            return lambda *a, populations=None, population_mode=None, **how: self.each(lambda i: getattr(i, name)(*a, **how), populations, population_mode)
        raise AttributeError(name)

    def __len__(self) -> int:
        return sum(len(i) for i in self.indexes.values())


def wrapped(index: SpatialIndex, query: Callable[[SpatialIndex], object], populations=None, population_mode: str | None = None):
    """A single index's result; with a mode other than ``single``, in a dict under the population's name."""
    if population_mode in (None, "single"):
        return query(index)
    name = populations if populations is None or isinstance(populations, str) else next(iter(populations))
    return {name: query(index)}
