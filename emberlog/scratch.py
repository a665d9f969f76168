"""Folders that the driver and the executors share, and small tables written there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str = "emberlog") -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on this machine
    alone. It is deleted when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="emberlog-")
    _made.append((spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def kept(table: DataFrame) -> DataFrame:
    """The table written out and read back: worked out once, whatever reads it, and safe from lost executors."""
    spark = table.sparkSession
    path = folder(spark)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
