"""Element types and their columns. Coordinates are stored as FLOAT and computed with as DOUBLE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FloatType, IntegerType, LongType, StructField, StructType

XYZ = ("x", "y", "z")
P1, P2 = ("p1_x", "p1_y", "p1_z"), ("p2_x", "p2_y", "p2_z")
BOUNDS = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")

_COLUMNS = {
    "point": [("id", LongType()), *[(c, FloatType()) for c in XYZ]],
    "sphere": [("id", LongType()), *[(c, FloatType()) for c in (*XYZ, "radius")]],
    "synapse": [("id", LongType()), ("pre_gid", LongType()), ("post_gid", LongType()), *[(c, FloatType()) for c in XYZ]],
    "morphology": [("gid", LongType()), ("section_id", IntegerType()), ("segment_id", IntegerType()), *[(c, FloatType()) for c in (*P1, *P2, "radius")], ("section_type", IntegerType()), ("is_soma", BooleanType())],
}
SCHEMAS = {name: StructType([StructField(c, t) for c, t in columns]) for name, columns in _COLUMNS.items()}
KEYS = {"point": ["id"], "sphere": ["id"], "synapse": ["id"], "morphology": ["gid", "section_id", "segment_id"]}
#: Fields that queries offer, in the order of listing (fixed values).
BUILTIN_FIELDS = {
    "point": ["id", "position"],
    "sphere": ["id", "centroid", "radius"],
    "synapse": ["id", "pre_gid", "post_gid", "position"],
    "morphology": ["gid", "section_id", "segment_id", "ids", "centroid", "endpoints", "radius", "section_type", "is_soma"],
}
#: Section types (fixed values).
SECTION_TYPES = {0: "undefined", 1: "soma", 2: "axon", 3: "basal_dendrite", 4: "apical_dendrite"}
STRUCT_VERSION, META_VERSION = 5, 0
GID_BITS, SECTION_BITS, SEGMENT_BITS = 36, 14, 14


def conform(df: DataFrame, element_type: str) -> DataFrame:
    """The type's columns in order, cast; then any others. A NaN meets no box, so such rows are in no result; ``checked`` refuses them."""
    if element_type not in SCHEMAS:
        raise ValueError(f"unknown element type: {element_type!r}")
    fields = SCHEMAS[element_type].fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{element_type} needs columns {missing}")
    own = {f.name for f in fields}

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], *[F.col(f"`{c}`") for c in df.columns if c not in own])


def checked(df: DataFrame, element_type: str) -> DataFrame:
    """Rows on their way into a stored index: a NaN coordinate is an error. Not for tables to be queried, as no filter would pass it to their scan."""
    guard = lambda c: F.when(F.isnan(c), F.raise_error(F.lit(f"{c} is NaN")).cast("float")).otherwise(F.col(c))
    return df.withColumns({f.name: guard(f.name) for f in SCHEMAS[element_type].fields if isinstance(f.dataType, FloatType)})
