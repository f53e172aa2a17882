"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns cannot clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def held_out(modulus: int, remainder: int = 2) -> Column:
    """Whether a row belongs to the fold that no model learns from. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one, under local masters only: executors elsewhere could not see it."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="volumetra-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


#: Bytes in an Arrow batch of whole texts (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20
_open: list[list[tuple[SparkSession, str]]] = []


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python workers get batches of at most BATCH_BYTES, so that their memory, and Arrow's, stays small beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The job's shuffle files go when it ends. Inside ``scratch`` the table goes when
    that ends; one that is kept, when the ``scratch`` around that one ends, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append((spark, path))
    small_batches(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """The tables saved meanwhile, but for kept ones, are deleted at the end: what follows must read kept ones only."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            dropped(spark, path)


#: A key with more than this share of a table's rows, and more rows than HOT_ROWS, is hot. There are fewer than HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 1000, 100


def hot_keys(rows: DataFrame, key: str, counts: str | None = None) -> list:
    """The hot keys of a saved table, fewer than HOT_SHARE. ``counts``: the column that has a key's rows, if ``rows`` has one row a key."""
    by_key = rows.select(key, F.col(counts).alias("_n")) if counts else rows.groupBy(key).agg(F.count("*").alias("_n"))
    by_key = by_key.where(F.col(key).isNotNull() & (F.col("_n") > HOT_ROWS))
    most = by_key.orderBy(F.desc("_n"), key).limit(HOT_SHARE).collect()
    if not most:
        return []
    total = rows.agg(F.sum(counts)).first()[0] if counts else rows.count()
    return [r[0] for r in most if r["_n"] * HOT_SHARE > total]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left.join(right, key, how), inner or left, for a right side of short rows, one a key.

    Rows of ``left`` with a hot key stay where they are and meet a broadcast copy
    of the right rows of hot keys (fewer than HOT_SHARE rows); the others are joined as usual.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    joined = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return joined.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, so that a lambda does not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP, -1), "")
