"""Shared plumbing of the training-data operators: scratch tables, byte-level text batches, grouped streams.

Texts are handled as the UTF-8 bytes of an Arrow column, so that one NumPy pass covers many documents; a slice
never holds more than ``SLICE_BYTES`` unless one document alone is longer.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_emberlog_scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark._emberlog_scratch = "file://" + tempfile.mkdtemp(prefix="emberlog-")
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/emberlog-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._emberlog_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by `stored` that nothing reads any more."""
    if path := getattr(df, "_emberlog_path", None):
        _delete(df.sparkSession, path)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now; it does so when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.java.lang.System.gc()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: For the operators' SQL: A-Z lowered and nothing else.
SQL_UPPER, SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components_sql(nodes: str, edges: str) -> str:
    """DuckDB: the common table com (id, component) of ``nodes`` (id) under ``edges`` (a, b), each given both ways."""
    return f"""com(id, component) USING KEY (id) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT e.a, min(c.component) FROM com c JOIN {edges} e ON e.b = c.id JOIN recurring.com o ON o.id = e.a WHERE c.component < o.component GROUP BY e.a)"""


# --- byte-level text -----------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most ``most`` text bytes (one row at least), each with its bytes and offsets."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    x ^= x >> np.uint64(33)
    return x


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES, _POWERS = byte_values(7), powers(256)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes (runs end with their row), and the n + 1 offsets of the rows in them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    inside[-1] = False
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] = inside[edges]
    shuts = inside[:-1] & ~inside[1:]
    before = edges[edges > 0] - 1
    shuts[before] = inside[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    within = np.arange(total) - np.repeat(first, length)
    at = within + np.repeat(starts, length)
    power = _POWERS if length.max() <= len(_POWERS) else powers(int(length.max()))
    sums = np.add.reduceat(values[data[at]] * power[within], first)
    return mix(sums ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


# --- groups in sorted partitions -----------------------------------------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in a partition that is sorted by it, whole, one at a time."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if rest and keys[a] != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = keys[a]
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)
