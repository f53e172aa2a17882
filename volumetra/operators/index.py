"""SpatialIndex: a table of elements and the queries on it.

Elements are never copied into a tree: a query is a filter of the table, the
stored boxes (if any) first, so that scans skip row groups and partitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec
from ..schema import BOUNDS, BUILTIN_FIELDS, KEYS, P1, P2, XYZ, conform
from .shapes import Box, Cylinder, Sphere, condition, element_shape

GROUPS = (None, "post_gid", "gid")


@dataclass(frozen=True)
class SpatialIndex:
    elements: DataFrame
    element_type: str
    #: One row a part: part_id, n_elements, min_x ... max_z. Only of stored, partitioned indexes.
    manifest: DataFrame | None = None
    #: Attribute tables: (table, its key, the element's key).
    attributes: tuple = ()
    meta: dict = field(default_factory=dict)

    @staticmethod
    def of(elements: DataFrame, element_type: str) -> SpatialIndex:
        return SpatialIndex(conform(elements, element_type), element_type)

    # -- fields

    @property
    def builtin_fields(self) -> list[str]:
        return list(BUILTIN_FIELDS[self.element_type])

    @property
    def available_fields(self) -> list[str]:
        return self.builtin_fields + [c for table, key, _ in self.attributes for c in table.columns if c != key]

    def with_attributes(self, table: DataFrame, key: str, element_key: str) -> SpatialIndex:
        """Rows of ``table`` whose key equals an element's key become fields of that element."""
        return replace(self, attributes=(*self.attributes, (table, key, element_key)))

    def field(self, name: str) -> Column:
        shape = element_shape(self.element_type)
        match name:
            case "position":
                return F.array(*[F.col(c) for c in XYZ])
            case "centroid":
                return F.array(*[c.cast("float") for c in shape.centroid()])
            case "endpoints":  # an absent second end is NaN at this edge only
                return F.struct(F.array(*[F.col(c) for c in P1]).alias("p1"), F.array(*[F.coalesce(F.col(c), F.lit(float("nan")).cast("float")) for c in P2]).alias("p2"))
            case "ids":
                return F.struct(*KEYS["morphology"])
        return F.col(name)

    def project(self, rows: DataFrame, fields=None) -> DataFrame:
        """Columns asked for: a name, several names, or None for all builtin ones. ``raw_elements`` (alone) gives whole rows as a struct."""
        if fields == "raw_elements":
            return rows.select(F.struct(*[c for c in self.elements.columns if c not in BOUNDS]).alias("raw_elements"))
        names = [fields] if isinstance(fields, str) else self.builtin_fields if fields is None else list(fields)
        if not names or "raw_elements" in names:
            raise ValueError("fields must name at least one field; raw_elements stands alone")
        unknown = [n for n in names if n not in self.available_fields]
        if unknown:
            raise ValueError(f"unknown fields {unknown}; available: {self.available_fields}")
        for i, (table, key, own) in enumerate(self.attributes):
            wanted = [c for c in table.columns if c in names and c != key and c not in self.builtin_fields]
            if wanted:
                side = table.select(F.col(key).alias(f"_key{i}"), *wanted)
                rows = rows.join(side, rows[own] == side[f"_key{i}"], "left").drop(f"_key{i}")
        return rows.select(*[self.field(n).alias(n) for n in names])

    # -- queries

    def _of_parts(self, test: Column) -> DataFrame:
        """Rows of the parts that pass: a semi-join with the filtered manifest, by which the partitions to read are pruned at run time."""
        return self.elements.join(self.manifest.where(test).select("part_id"), "part_id", "left_semi")

    def find(self, query, accuracy: str = "best_effort") -> DataFrame:
        """Whole rows of elements that intersect a shape."""
        rows, shape = self.elements, element_shape(self.element_type)
        box_test, exact = condition(query, shape, accuracy)
        if self.manifest is not None:  # parts whose box does not meet the query are not read
            rows = self._of_parts(element_shape("box").meets(query.box()))
        if set(BOUNDS) <= set(rows.columns):  # plain comparisons reach the scan
            rows = rows.where(element_shape("box").meets(query.box()))
        return rows.where(box_test).where(exact)

    def box_query(self, corner, opposite, *, fields=None, accuracy="best_effort") -> DataFrame:
        return self.project(self.find(Box.of(corner, opposite), accuracy), fields)

    def sphere_query(self, centre, radius, *, fields=None, accuracy="best_effort") -> DataFrame:
        return self.project(self.find(Sphere.of(centre, radius), accuracy), fields)

    def cylinder_query(self, p1, p2, radius, *, fields=None, accuracy="best_effort") -> DataFrame:
        return self.project(self.find(Cylinder.of(p1, p2, radius), accuracy), fields)

    def counts(self, query, *, accuracy="best_effort", group_by=None) -> DataFrame:
        """One row with the number, or a row for each post_gid."""
        if group_by not in GROUPS or (group_by and "post_gid" not in self.elements.columns):
            raise ValueError(f"cannot group {self.element_type} by {group_by!r}")
        found = self.find(query, accuracy)
        if group_by is None:
            return found.agg(F.count("*").alias("n"))
        return found.groupBy("post_gid").agg(F.count("*").alias("n"))

    def box_counts(self, corner, opposite, **how):
        return self.counts(Box.of(corner, opposite), **how)

    def sphere_counts(self, centre, radius, **how):
        return self.counts(Sphere.of(centre, radius), **how)

    def is_empty(self, query, accuracy="best_effort") -> bool:
        return self.find(query, accuracy).isEmpty()

    def box_empty(self, corner, opposite, *, accuracy="best_effort") -> bool:
        return self.is_empty(Box.of(corner, opposite), accuracy)

    def sphere_empty(self, centre, radius, *, accuracy="best_effort") -> bool:
        return self.is_empty(Sphere.of(centre, radius), accuracy)

    def nearest(self, point, k: int) -> DataFrame:
        """The k elements whose boxes are nearest to a point, ties by key. A stored index reads its nearest parts first."""
        p = Vec.of(point)
        away, keys = element_shape(self.element_type).box().distance_sq(p), KEYS[self.element_type]

        def top(rows: DataFrame) -> DataFrame:
            return rows.withColumn("distance_sq", away).orderBy("distance_sq", *keys).limit(k)

        if self.manifest is None:
            return top(self.elements).select(*keys, "distance_sq")
        d = element_shape("box").distance_sq(p)
        # No part is empty, so that k of them have k elements: at most k numbers.
        near = [r[0] for r in self.manifest.orderBy(d, "part_id").limit(k).select("part_id").collect()]
        first = top(self.elements.where(F.col("part_id").isin(near))).agg(F.max("distance_sq").alias("d"), F.count("*").alias("n")).first()
        rows = self._of_parts(d <= F.lit(first["d"])) if first["n"] == k else self.elements
        return top(rows).select(*keys, "distance_sq")

    def bounds(self) -> DataFrame:
        """min_x ... max_z over the boxes of all elements; of a stored index from its manifest."""
        if self.manifest is not None:
            return self.manifest.agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOUNDS])
        box = element_shape(self.element_type).box()
        corners = [*box.low, *box.high]
        return self.elements.agg(*[(F.min if c.startswith("min") else F.max)(v).alias(c) for c, v in zip(BOUNDS, corners, strict=True)])

    def size(self) -> DataFrame:
        if self.manifest is not None:
            return self.manifest.agg(F.coalesce(F.sum("n_elements"), F.lit(0)).alias("n"))
        return self.elements.agg(F.count("*").alias("n"))

    def __len__(self) -> int:
        return self.size().first()["n"]

    def all_ids(self) -> DataFrame:
        return self.elements.select(*KEYS[self.element_type])

    def sample(self, n: int = 50) -> str:
        """The first n rows as text."""
        return "\n".join(str(r) for r in self.all_ids().limit(n).collect())

    # -- insertion: a new index, as tables do not change

    def insert(self, rows: DataFrame) -> SpatialIndex:
        if self.manifest is not None:
            raise ValueError("a stored index is appended to by writing it anew")
        return replace(self, elements=self.elements.unionByName(conform(rows, self.element_type), allowMissingColumns=True))

    def insert_rows(self, rows: Iterable[tuple]) -> SpatialIndex:
        """Rows in the order of the type's columns."""
        from ..schema import SCHEMAS

        return self.insert(self.elements.sparkSession.createDataFrame(list(rows), SCHEMAS[self.element_type]))

    def place(self, region: tuple, shape) -> tuple[bool, SpatialIndex]:
        from .placement import place

        return place(self, region, shape)

