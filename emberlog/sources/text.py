"""Log lines: (source, n, value), n counting from 1 within a source.

A source is a file, or whatever the caller names one. A file may be read by many tasks; its lines are numbered by the
tasks' blocks and, within a block, by reading order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERN = "*.{log,txt,jsonl,gz}"
LINES = "source string, n long, value string"
MAX_UPLOAD_BYTES = 25 * 1024 * 1024


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Text files, directories (``*.log *.txt *.jsonl *.gz``, with all below) and ``-`` for standard input.

    Invalid UTF-8 is replaced; ``.gz`` is decompressed; ``\\r``, ``\\n`` and ``\\r\\n`` end lines. A file's lines are
    numbered by the order of (split offset, row), so a large file may be read by many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    if "-" in paths:
        parts.append(from_iterable(spark, sys.stdin, "-"))
    if files := [p for p in paths if p != "-"]:
        parts.append(_read_files(spark, files, recursive))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read_files(spark: SparkSession, files: list[str], recursive: bool) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    is_dir = lambda p: fs_path(p).getFileSystem(conf).getFileStatus(fs_path(p)).isDirectory()
    dirs = [p for p in files if is_dir(p)]
    frames = []
    if dirs:
        frames.append(spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", PATTERN).text(dirs))
    if single := [p for p in files if p not in dirs]:
        frames.append(spark.read.text(single))
    keyed = [
        f.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.expr("make_valid_utf8(value)").alias("value"))
        for f in frames
    ]
    rows = keyed[0] if len(keyed) == 1 else keyed[0].unionByName(keyed[1])
    return number_lines(rows, ["__block", "__at"]).select("source", "n", "value")


def number_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """Dense numbers from 1 within each source, in two steps: counts of blocks, then numbers within a block.

    A source is one partition of the first window only by its blocks, so a huge file isn't sorted in one task.
    """
    block, at = order
    within = Window.partitionBy("source", block).orderBy(at)
    counts = rows.groupBy("source", block).count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return rows.join(before, ["source", block]).withColumn("n", F.row_number().over(within) + F.col("__before"))


def from_iterable(spark: SparkSession, lines: Iterable[str], source: str = "memory") -> DataFrame:
    return spark.createDataFrame([(source, i, x.rstrip("\n")) for i, x in enumerate(lines, 1)], LINES)


def renumber(entries: DataFrame) -> DataFrame:
    """Entries of many sources as one log: dense line numbers over (source, line_no), and one source.

    Sources are numbered by their sizes first, so no window holds more than a source.
    """
    sizes = entries.groupBy("source").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = entries.withColumn("__at", F.row_number().over(Window.partitionBy("source").orderBy("line_no")))
    return ranked.join(before, "source").withColumn("line_no", F.col("__at") + F.col("__before")).drop("__at", "__before")


def check_upload(size: int) -> None:
    if size > MAX_UPLOAD_BYTES:
        raise ValueError(f"the upload has {size} bytes; the most is {MAX_UPLOAD_BYTES}")
