"""Sort-tile-recursive layout, Hilbert order, and stored indexes.

Ranks are global without a window over all rows: rows are range-partitioned on
the order's columns (ties by further columns, so a hot coordinate spreads), saved
with their partition's number, ranked within it, and shifted by the counts of the
partitions before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import hilbert
from ..functions.vectors import balanced_chunk
from ..operators.index import SpatialIndex
from ..operators.shapes import element_shape
from ..schema import BOUNDS, KEYS, META_VERSION, STRUCT_VERSION, XYZ, checked
from .storage import exists, is_empty_or_new, read_json, saved, stored_bytes, write_json

DATA, MANIFEST, META = "elements", "manifest", "meta_data.json"
LARGEST_PART = 4_000_000


def global_rank(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the row's place from 0 in the order of the columns (which should tell rows apart)."""
    spread = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition.
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")


def parts_for(n: int, largest: int = LARGEST_PART) -> tuple[int, int, int]:
    """Parts in each dimension for n elements."""
    parts = max(n ** (1 / 3), n / largest)
    each = max(1, math.ceil(round(parts ** (1 / 3), 9)))
    return each, each, each


def str_parts(rows: DataFrame, element_type: str, parts: tuple[int, int, int]) -> DataFrame:
    """Adds part_id: balanced slices by the centroids' x (ties by y, z), of each by y (z), of each by z; ties by key at last.

    The next level's order is by (slice, coordinates); a slice's first rank is arithmetic.
    """
    centre = element_shape(element_type).centroid()
    columns = rows.columns
    n = F.lit(rows.count())
    rows = rows.select("*", *[c.alias(f"_{n}") for n, c in zip(XYZ, centre, strict=True)], F.lit(0).cast("long").alias("part_id"), F.lit(0).cast("long").alias("_first"), n.cast("long").alias("_size"))
    ties = [f"_{c}" for c in XYZ] + KEYS[element_type]
    for level, k in enumerate(parts):
        order = [f"_{c}" for c in XYZ[level:]]
        rows = global_rank(rows, ["part_id", *order, *[t for t in ties if t not in order]], "_place")
        rows = rows.withColumn("_slice", balanced_chunk(F.col("_place") - F.col("_first"), F.col("_size"), k).cast("long"))
        each, more = F.floor(F.col("_size") / k), F.col("_size") % k
        rows = rows.withColumns(
            {
                "part_id": F.col("part_id") * k + F.col("_slice"),
                "_first": F.col("_first") + F.col("_slice") * each + F.least(F.col("_slice"), more),
                "_size": each + (F.col("_slice") < more).cast("long"),
            }
        ).drop("_place", "_slice")
    return rows.select(*columns, "part_id")


def manifest_of(rows: DataFrame, element_type: str) -> DataFrame:
    box = element_shape(element_type).box()
    corners = zip(BOUNDS, [*box.low, *box.high], strict=True)
    return rows.groupBy("part_id").agg(F.count("*").alias("n_elements"), *[(F.min if c.startswith("min") else F.max)(v).alias(c) for c, v in corners])


def hilbert_order(rows: DataFrame, element_type: str) -> DataFrame:
    """Adds ``hilbert``: the centroid's position on a curve of order 10 through the bounds of all."""
    centre = element_shape(element_type).centroid()
    named = rows.select("*", *[c.alias(f"_{n}") for n, c in zip(XYZ, centre, strict=True)])
    b = named.agg(*[f(f"_{c}").alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)]).first()
    scaled = [(F.col(f"_{c}") - F.lit(b[f"min_{c}"] or 0.0)) / F.lit(max((b[f"max_{c}"] or 0.0) - (b[f"min_{c}"] or 0.0), 1e-30)) for c in XYZ]
    return named.withColumn("hilbert", hilbert(*scaled)).drop(*[f"_{c}" for c in XYZ])


def write(index: SpatialIndex, path: str | None, parts: tuple[int, int, int] | None = None, extra: dict | None = None) -> None:
    """Store an index in a new or empty folder: elements by part with their boxes, a manifest, metadata. No path, no action."""
    if path is None:
        return
    spark = index.elements.sparkSession
    if not is_empty_or_new(spark, path):
        raise FileExistsError(path)
    rows = index.elements.drop("part_id", *BOUNDS)
    box = element_shape(index.element_type).box()
    parts = parts or parts_for(rows.count())
    tiled = saved(str_parts(checked(rows, index.element_type), index.element_type, parts))
    boxed = tiled.select("*", *[v.alias(c) for c, v in zip(BOUNDS, [*box.low, *box.high], strict=True)])
    boxed.repartition("part_id").sortWithinPartitions("part_id", "min_x").write.partitionBy("part_id").parquet(f"{path}/{DATA}")
    manifest_of(tiled, index.element_type).coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    meta = {"version": META_VERSION, "struct_version": STRUCT_VERSION, "element_type": index.element_type, "multi_index": {"heavy_data_path": DATA, "manifest": MANIFEST}}
    write_json(spark, f"{path}/{META}", meta | (extra or {}))


def meta_path(path: str) -> str:
    """The metadata file of an index's folder, or the path itself if it names that file."""
    return path if path.endswith(".json") else f"{path.rstrip('/')}/{META}"


def resolve(meta_file: str, data: str) -> str:
    return data if data.startswith("/") or "://" in data else f"{meta_file.rpartition('/')[0]}/{data}"


def open_index(spark: SparkSession, path: str, cache: bool | int = False):
    """A stored index, or the populations of one that has several.

    ``cache`` keeps its elements on the executors, in memory or else on their
    disks; a number is a budget of stored bytes, above which they are read anew by
    each query.
    """
    file = meta_path(path)
    if not exists(spark, file):
        raise FileNotFoundError(file)
    meta = read_json(spark, file)
    if meta.get("version", 0) > META_VERSION:
        raise ValueError(f"metadata version {meta['version']} is newer than {META_VERSION}")
    if "multi_population" in meta:
        from ..operators.populations import Populations

        return Populations({name: open_index(spark, resolve(file, p), cache) for name, p in meta["multi_population"].items()})
    if not 4 <= meta.get("struct_version", STRUCT_VERSION) <= STRUCT_VERSION:
        raise ValueError(f"struct version {meta['struct_version']} cannot be read")
    own = meta["multi_index"]
    elements, manifest = spark.read.parquet(resolve(file, own["heavy_data_path"])), spark.read.parquet(resolve(file, own["manifest"]))
    if meta["element_type"] == "morphology" and "section_type" not in elements.columns:
        elements = elements.withColumn("section_type", F.lit(0))
    if cache is not True and cache:
        cache = stored_bytes(spark, resolve(file, own["heavy_data_path"])) <= cache
    index = SpatialIndex(elements.cache() if cache else elements, meta["element_type"], manifest, meta=meta)
    if "extended" in meta:
        e = meta["extended"]
        index = index.with_attributes(spark.read.parquet(resolve(file, e["path"])), e["key"], e["element_key"])
    return index


def add_attributes(spark: SparkSession, path: str, table: str, key: str, element_key: str) -> None:
    """Name a table of attributes in a stored index's metadata."""
    meta = read_json(spark, meta_path(path))
    write_json(spark, meta_path(path), meta | {"extended": {"path": table, "key": key, "element_key": element_key}})


def write_populations(spark: SparkSession, path: str, populations: dict[str, str]) -> None:
    write_json(spark, meta_path(path), {"version": META_VERSION, "multi_population": populations})


def usage(index: SpatialIndex, queries: DataFrame, box) -> DataFrame:
    """(part_id, n_queries): how many of a table's query boxes read each part; a report of how a stored index is used."""
    from ..operators.join import box_pairs, with_box

    parts = index.manifest.select("part_id", *[F.col(c).alias(f"e_{c}") for c in BOUNDS])
    hits = box_pairs(with_box(queries, box, "q_"), parts).groupBy("part_id").agg(F.count("*").alias("n_queries"))
    return index.manifest.select("part_id").join(hits, "part_id", "left").select("part_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"))

