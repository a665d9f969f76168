"""When an incident began: time buckets, expected error rates, spikes, change points and bursts, for each source.

Entries are only ever aggregated; what is ordered are buckets, one row for each width of time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scoring, severity

#: Bucket widths in seconds and how many buckets there should be.
WIDTHS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 1800, 3600, 7200, 21600, 86400)
MOST_BUCKETS = 40
ALPHA, SPIKE_Z, FLAT = 0.3, 2.5, 1e-9
DRIFT, ALARM, MAD_SCALE = 0.5, 4.0, 1.4826
BURST_EVENTS, BURST_SHARE = 4, 0.6
CHANGE_ONLY_CONFIDENCE = 0.6

_DAY = 86_400
SLOT_RUN = 65_536  # buckets that are laid out as one array
MOST_SLOTS = 100_000_000  # buckets of a source; more is an error


def choose_width(span_seconds: Column) -> Column:
    """The smallest width by which a span has at most ``MOST_BUCKETS``; the largest for longer ones."""
    out = F.lit(WIDTHS[-1])
    for width in reversed(WIDTHS):
        out = F.when(span_seconds / width <= MOST_BUCKETS, width).otherwise(out)
    return F.when(span_seconds <= 0, WIDTHS[0]).otherwise(out).cast("int")


def spans(entries: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """(source, origin, width, buckets) of the sources that have times."""
    ends = entries.where("ts is not null").groupBy("source").agg(F.min("ts").alias("origin"), F.max("ts").alias("end"))
    span = (F.unix_micros("end") - F.unix_micros("origin")) / 1e6
    width = F.lit(bucket_seconds) if bucket_seconds else choose_width(span)
    out = ends.withColumn("width", width.cast("int"))
    return out.select("source", "origin", "width", (F.floor((F.unix_micros("end") - F.unix_micros("origin")) / (F.col("width").cast("long") * 1_000_000)) + 1).alias("buckets"))


def bucket_of(ts: Column, origin: Column, width: Column) -> Column:
    return F.floor((F.unix_micros(ts) - F.unix_micros(origin)) / (width.cast("long") * 1_000_000))


def bucketize(entries: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """(source, idx, start, width, total, errors, warnings), without gaps: counted first, the grid joined after."""
    grid = spans(entries, bucket_seconds)
    counted = entries.where("ts is not null").select("source", "ts", "level").join(grid, "source").select("source", bucket_of(F.col("ts"), F.col("origin"), F.col("width")).alias("idx"), "level")
    counts = counted.groupBy("source", "idx").agg(F.count(F.lit(1)).alias("total"), F.count_if(severity.is_error(F.col("level"))).alias("errors"), F.count_if(severity.is_warning(F.col("level"))).alias("warnings"))
    few = F.when(F.col("buckets") <= MOST_SLOTS, F.col("buckets")).otherwise(F.raise_error(F.format_string("source %s spans %d buckets: give a larger width, or look for a stray time", "source", "buckets")).cast("long"))
    runs = grid.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((few - 1) / SLOT_RUN))))
    slots = runs.withColumn("idx", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("run") * SLOT_RUN + SLOT_RUN, "buckets") - 1))).drop("run")
    start = F.timestamp_micros(F.unix_micros("origin") + F.col("idx") * F.col("width") * 1_000_000)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return slots.join(counts, ["source", "idx"], "left").select("source", "idx", start.alias("start"), "width", zero("total"), zero("errors"), zero("warnings"))


def learn_baseline(buckets: DataFrame) -> DataFrame:
    """(hour, expected, overall): mean errors of a healthy log's buckets by hour of day, and of all buckets."""
    overall = buckets.agg(F.avg("errors").alias("overall"))
    return buckets.groupBy(F.hour("start").alias("hour")).agg(F.avg("errors").alias("expected")).join(F.broadcast(overall))  # one row


def seasonal_z(buckets: DataFrame, baseline: DataFrame) -> DataFrame:
    """Buckets with z against the hour's expectation; an hour that the baseline lacks gets its overall mean."""
    hours = F.broadcast(baseline.select("hour", "expected"))  # 24 rows at most
    overall = F.broadcast(baseline.agg(F.max("overall").alias("overall")))  # one row
    expected = F.coalesce("expected", "overall", F.lit(0.0))
    joined = buckets.join(hours, F.hour("start") == F.col("hour"), "left").join(overall)
    return joined.withColumn("z", (F.col("errors") - expected) / F.sqrt(expected + 1)).drop("hour", "expected", "overall")


def _ewma(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z of each value against the exponentially weighted mean and variance before it; rows come by source and time."""
    last, mean, var = None, 0.0, 0.0
    for batch in batches:
        out = []
        for source, errors in zip(batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("errors")).to_pylist(), strict=True):
            if source != last:
                last, mean, var = source, float(errors), 0.0
            off, spread = errors - mean, math.sqrt(var)
            out.append(off / spread if spread > FLAT else math.inf if off > 0 else 0.0)
            mean, var = mean + ALPHA * off, (1 - ALPHA) * (var + ALPHA * off * off)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "z"])


def ewma_z(buckets: DataFrame) -> DataFrame:
    """Buckets with z. The recurrence is sequential, so a source's buckets pass one task in order, two numbers being carried."""
    series = buckets.select("source", "idx", "start", "width", "total", "errors", "warnings").where("source is not null")
    schema = StructType([*series.schema.fields, StructField("z", DoubleType())])
    return series.repartition("source").sortWithinPartitions("source", "idx").mapInArrow(_ewma, schema)


def spikes(scored: DataFrame) -> DataFrame:
    """(source, idx, start, errors, z, baseline, confidence) of the buckets far above what was expected."""
    before = Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    base = scored.withColumn("baseline", F.coalesce(F.avg("errors").over(before), F.lit(0.0)))
    return base.where((F.col("z") >= SPIKE_Z) & (F.col("errors") > 0)).select("source", "idx", "start", "errors", "z", "baseline", scoring.onset(F.col("z"), F.lit(1)).alias("confidence"))


def robust_centre(buckets: DataFrame) -> DataFrame:
    """(source, centre, scale): exact median of errors and 1.4826 times the median absolute deviation; a flat one is 1."""
    centre = buckets.groupBy("source").agg(F.percentile("errors", 0.5).alias("centre"))
    off = buckets.join(centre, "source").groupBy("source", "centre").agg((F.percentile(F.abs(F.col("errors") - F.col("centre")), 0.5) * MAD_SCALE).alias("mad"))
    return off.select("source", "centre", F.when(F.col("mad") <= 0, 1.0).otherwise(F.col("mad")).alias("scale"))


def cusum(buckets: DataFrame) -> DataFrame:
    """Buckets with the cumulative sum ``s`` = max(0, s before + errors - centre - scale / 2), in closed form."""
    drift = buckets.join(robust_centre(buckets), "source").withColumn("d", F.col("errors") - F.col("centre") - DRIFT * F.col("scale"))
    so_far = Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = drift.withColumn("p", F.sum("d").over(so_far))
    return summed.withColumn("s", F.col("p") - F.least(F.lit(0.0), F.min("p").over(so_far))).drop("d", "p")


def change_point(buckets: DataFrame) -> DataFrame:
    """(source, changed): the first bucket in which the cumulative sum is above the alarm and errors above the centre."""
    hit = cusum(buckets).where((F.col("s") > ALARM * F.col("scale")) & (F.col("errors") > F.col("centre")))
    return hit.groupBy("source").agg(F.min("start").alias("changed"))


def onset(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(source, width, onset, baseline_errors, peak_errors, spikes, onset_confidence), one row for each source with times."""
    first = found.groupBy("source").agg(F.min("start").alias("spiked"), F.min_by("z", "idx").alias("z"), F.count(F.lit(1)).alias("spikes"))
    when = F.least("spiked", "changed")
    ends = buckets.groupBy("source").agg(F.max("errors").alias("peak_errors"), F.max("width").alias("width")).join(first, "source", "left").join(change_point(buckets), "source", "left").withColumn("onset", when)
    pre = buckets.join(ends.select("source", "onset"), "source").where(F.col("onset").isNull() | (F.col("start") < F.col("onset"))).groupBy("source").agg(F.avg("errors").alias("pre"))
    confidence = F.when(F.col("spikes") > 0, scoring.onset(F.col("z"), F.col("spikes"))).when(F.col("onset").isNotNull(), CHANGE_ONLY_CONFIDENCE).otherwise(0.0)
    out = ends.join(pre, "source", "left")
    return out.select("source", "width", "onset", F.coalesce("pre", F.lit(0.0)).alias("baseline_errors"), "peak_errors", F.coalesce("spikes", F.lit(0)).cast("long").alias("spikes"), confidence.alias("onset_confidence"))


def densest_windows(assigned: DataFrame, widths: DataFrame, key: list[str]) -> DataFrame:
    """(key, events, peak_count, peak_start): the most events within one closed window of the source's width.

    Equal times are counted first, so a hot signature is its distinct times. A RANGE frame needs a fixed bound, so time
    is scaled: every width divides a day, and a day is the bound.
    """
    times = assigned.where("ts is not null").groupBy(*key, "ts").agg(F.count(F.lit(1)).alias("n")).join(widths.select("source", "width", "origin"), "source")
    scaled = (F.unix_micros("ts") - F.unix_micros("origin")) * (F.lit(_DAY) / F.col("width")).cast("long")
    frame = Window.partitionBy(*key).orderBy("scaled").rangeBetween(-_DAY * 1_000_000, 0)
    held = times.withColumn("scaled", scaled).withColumn("held", F.sum("n").over(frame)).withColumn("from", F.min("ts").over(frame))
    best = F.max_by(F.struct("held", "from"), F.struct("held", -F.unix_micros("ts")))
    return held.groupBy(*key).agg(F.sum("n").alias("events"), best.alias("best")).select(*key, "events", F.col("best.held").alias("peak_count"), F.col("best.from").alias("peak_start"))


def bursts(assigned: DataFrame, clusters: DataFrame, widths: DataFrame) -> DataFrame:
    """(source, template, level, count, peak_start, peak_count, concentration, confidence, order) of the ranked clusters that
    have most of their events in one window."""
    key = ["source", "template", "level"]
    same = lambda a, b: (a["source"] == b["source"]) & (a["template"] == b["template"]) & a["level"].eqNullSafe(b["level"])
    dense = densest_windows(assigned, widths, key).where(F.col("events") >= BURST_EVENTS)
    joined = clusters.join(dense, same(clusters, dense)).select(clusters["source"], clusters["template"], clusters["level"], "count", "rank", "events", "peak_count", "peak_start")
    found = joined.withColumn("concentration", F.col("peak_count") / F.col("events")).where(F.col("concentration") >= BURST_SHARE).withColumn("confidence", scoring.burst(F.col("concentration"), F.col("count")))
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("peak_count"), F.desc("concentration"), "rank"))
    return found.withColumn("order", order).select(*key, "count", "peak_start", "peak_count", "concentration", "confidence", "order")
