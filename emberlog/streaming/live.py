"""Following logs: parse, threshold, template, and whether a signature is new, as a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import severity, text
from ..operators.parsing import parse_with
from ..scratch import folder

SURFACED = "source string, line_no long, ts timestamp, level int, message string, template string, is_new boolean"


def surface(lines: DataFrame, fmt: str = "text", least: int = 40, redact: bool = False) -> DataFrame:
    """(source, n, value) lines -> source, line_no, ts, level, message, template of those at a level. Stateless; no stitching.

    The template is of the message as it came; redaction changes what is shown only.
    """
    parsed = lines.where(~F.col("value").rlike(r"(?U)^\s*$")).select("source", F.col("n").alias("line_no"), parse_with(F.col("value"), fmt).alias("e"))
    kept = parsed.where(severity.at_least(F.col("e.level"), least))
    message = text.redact(F.col("e.message")) if redact else F.col("e.message")
    return kept.select("source", "line_no", "e.ts", "e.level", message.alias("message"), text.normalize(F.col("e.message")).alias("template"))


def flag_new(surfaced: DataFrame, forget_after: str | None = None) -> DataFrame:
    """Streaming rows with ``is_new``: the first sighting of (source, template). forget_after: a state lifetime, e.g. "7 days"."""
    milliseconds = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else None

    def flag(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        # only the earliest line can be new; a signature's rows are held in its first batch only
        first = None
        held: list[pd.DataFrame] = []
        for rows in batches:
            if known:
                yield rows.assign(is_new=False)
                continue
            low = rows["line_no"].min()
            first = low if first is None else min(first, low)
            held.append(rows)
        for rows in held:
            yield rows.assign(is_new=rows["line_no"] == first)
        state.update((True,))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout
    rows = surfaced.select("source", "line_no", "ts", "level", "message", "template")
    return rows.groupBy("source", "template").applyInPandasWithState(flag, SURFACED, "seen boolean", "append", timeout)


def only_new(surfaced: DataFrame) -> DataFrame:
    """Only first sightings, with the engine's own state."""
    return surfaced.dropDuplicates(["source", "template"])


def run_available(stream: DataFrame, where: str) -> DataFrame:
    """Run a streaming query to the end of its input, into Parquet; the result is read back."""
    query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def novelty_of_table(spark: SparkSession, entries: DataFrame, least: int) -> DataFrame:
    """A whole table of entries through the stateful stream: it is laid down as files and then streamed."""
    where = folder(spark, "stream")
    kept = entries.where(severity.at_least(F.col("level"), least)).select("source", "line_no", "ts", "level", "message", text.normalize(F.col("message")).alias("template"))
    kept.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(kept.schema).parquet(f"{where}/in")
    return run_available(flag_new(stream), where).select("source", "line_no", "level", "template", "is_new")


def head_format(spark: SparkSession, path: str, sample: int = 20) -> str:
    """The format of a growing file by its first ``sample`` lines, blank ones among them; text if it is empty."""
    from ..operators.parsing import detect_formats
    from ..sources.text import from_iterable

    head = [r["value"] for r in spark.read.text(path).limit(sample).collect()]
    found = detect_formats(from_iterable(spark, head, path), sample).first() if head else None
    return found["format"] if found else "text"


def each_batch(entries_stream: DataFrame, analyse, folder: str, **trigger):
    """Re-run a batch analysis on all entries so far whenever new ones come: ``analyse(entries DataFrame, batch id)``.

    The entries of each batch are laid down as Parquet and the analysis reads them all back, as a batch job.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        analyse(batch.sparkSession.read.parquet(folder).drop("batch"), number)

    return entries_stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}-state").trigger(**(trigger or {"availableNow": True})).start()
