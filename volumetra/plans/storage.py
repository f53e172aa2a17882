"""Small files and intermediate tables, by Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one under local masters only, as other machines could not see it."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="volumetra-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_empty_or_new(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return not fs.exists(p) or (fs.getFileStatus(p).isDirectory() and not len(fs.listStatus(p)))


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=1, default=_plain).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0])


def _plain(value):
    """numpy scalars and arrays."""
    return value.tolist()
