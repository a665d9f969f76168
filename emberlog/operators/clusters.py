"""Failure signatures: group by template and level, rank, take the top; many logs in one job, each by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity, text

#: Keys whose values name a component, and the severity of a cluster without one.
COMPONENT_KEYS = ("service", "component", "module", "logger", "subsystem")
DEFAULT_SCORE_LEVEL = 20

KEY = ["source", "template", "level"]
SLICE_SECONDS = 3600  # of a push stream's row


def assign_templates(entries: DataFrame, least: int | None = 30) -> DataFrame:
    """Entries at or above a level, with their templates. The filter comes first, so nothing else is templated."""
    return entries.where(severity.at_least(F.col("level"), least)).withColumn("template", text.normalize(F.col("message")))


def cluster(assigned: DataFrame, fields: bool = True) -> DataFrame:
    """One row for each (source, template, level): count, timed, first_line, rep_message, component, first_seen, last_seen, score.

    Everything is a mergeable aggregate: partial sums are made before the shuffle, members are never gathered.
    """
    rep = F.struct("line_no", "message", *(["fields"] if fields else []))
    out = assigned.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("count"), F.count("ts").alias("timed"), F.min("line_no").alias("first_line"), F.min_by(rep, "line_no").alias("rep"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    named = [F.nullif(text.strip(F.try_element_at(F.col("rep.fields"), F.lit(k))), F.lit("")) for k in COMPONENT_KEYS] if fields else []
    component = F.coalesce(*named, text.component_of(F.col("template")), text.component_of(F.col("rep.message")))
    return out.select(*KEY, "count", "timed", "first_line", F.col("rep.message").alias("rep_message"), component.alias("component"), "first_seen", "last_seen", severity_score(F.col("level"), F.col("count")).alias("score"))


def severity_score(level: Column, count: Column) -> Column:
    return F.coalesce(level, F.lit(DEFAULT_SCORE_LEVEL)) * 1000 + F.log1p(count.cast("double"))


def rank(clusters: DataFrame, top: int | None = None, tie: str = "first_line") -> DataFrame:
    """``rank`` from 1 within a source: the highest score first, then the smallest ``tie``. top: so many of each source."""
    ranked = clusters.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), tie)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def cluster_and_rank(entries: DataFrame, top: int | None = None, least: int | None = 30, method: str = "regex") -> tuple[DataFrame, DataFrame]:
    """(assigned entries, ranked clusters) by ``regex`` templates or the ``drain`` miner."""
    if method == "drain":
        from .drain import assign_drain

        assigned = assign_drain(entries, least)
    elif method == "regex":
        assigned = assign_templates(entries, least)
    else:
        raise ValueError(f"unknown clustering method {method!r}: regex or drain")
    return assigned, rank(cluster(assigned), top)


#: The order of a diff's rows.
STATUS_ORDER = ("new", "worsened", "improved", "resolved", "unchanged")


def diff_clusters(before: DataFrame, after: DataFrame) -> DataFrame:
    """(template, level, before, after, delta, status, order) of two ranked cluster tables, matched by template.

    A template that a side has at several levels counts by its lowest-ranked one.
    """

    def last(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("template").agg(F.max_by(F.struct("level", "count"), "rank").alias("c")).select("template", F.col("c.count").alias(name), F.col("c.level").alias(f"{name}_level"))

    both = last(before, "before").join(last(after, "after"), "template", "full_outer")
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    status = F.when((b == 0) & (a > 0), "new").when((a == 0) & (b > 0), "resolved").when(a > b, "worsened").when(a < b, "improved").otherwise("unchanged")
    out = both.select("template", F.coalesce("after_level", "before_level").alias("level"), b.alias("before"), a.alias("after"), (a - b).alias("delta"), status.alias("status"))
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")) - 1
    return out.withColumn("order", place.cast("int"))


def ordered_diff(diff: DataFrame) -> DataFrame:
    return diff.orderBy("order", F.desc(F.abs("delta")), "template")


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").count()


def totals(clusters: DataFrame) -> DataFrame:
    """(source, clusters, total): how many clusters there are, and entries in them."""
    return clusters.groupBy("source").agg(F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("total"))


def severe_total(entries: DataFrame) -> DataFrame:
    """(n): errors and worse in all logs."""
    return entries.where(severity.is_error(F.col("level"))).agg(F.count(F.lit(1)).alias("n"))


def line_filter(entries: DataFrame, contains: str | None = None, without: str | None = None, case: bool = True) -> DataFrame:
    """Entries whose line holds one string and not another; ``case`` false ignores the case of the first."""
    out = entries
    if contains is not None:
        out = out.where(F.contains("raw", F.lit(contains)) if case else F.contains(F.lower("raw"), F.lit(contains.lower())))
    return out if without is None else out.where(~F.contains("raw", F.lit(without)))


def streams(entries: DataFrame, redact: bool = False, base_ns: int = 0, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Push streams: (source, level_name, cluster, slice, values array<struct<ts_ns, line>>), values by time then line number.

    A stream comes in slices of time, so that a noisy signature is many rows. A row without a time gets ``base_ns`` and
    its line number; every million lines of those are a slice.
    """
    line = F.regexp_replace("raw", r"\n+$", "")
    line = text.redact(line) if redact else line
    ns = F.coalesce(F.unix_micros("ts") * 1000, F.lit(base_ns) + F.col("line_no") - 1)
    rows = entries.select("source", F.coalesce(F.lower(severity.level_name(F.col("level"))), F.lit("unknown")).alias("level_name"), text.signature(F.col("message")).alias("cluster"), F.struct(ns.alias("ts_ns"), "line_no", line.alias("line")).alias("v"), F.col("ts").isNotNull().alias("timed"))
    rows = rows.withColumn("slice", F.floor(F.when(F.col("timed"), F.col("v.ts_ns") / (slice_seconds * 10**9)).otherwise(-1 - F.col("v.line_no") / 10**6)))
    values = F.transform(F.array_sort(F.collect_list("v")), lambda v: F.struct(v["ts_ns"].alias("ts_ns"), v["line"].alias("line")))
    return rows.groupBy("source", "level_name", "cluster", "slice").agg(values.alias("values"))
