"""Which failures led to which: first appearances, shared time buckets, cause-effect links, and the likely trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..scratch import kept

MOST_LAG, LEAST_OVERLAP = 600.0, 0.2
KEY = ["source", "template", "level"]


def timeline(clusters: DataFrame) -> DataFrame:
    """The ranked clusters that have times, with ``order`` from 0 by first appearance, then rank, within a source."""
    order = F.row_number().over(Window.partitionBy("source").orderBy("first_seen", "rank")) - 1
    return clusters.where("first_seen is not null").withColumn("order", order)


def occupancy(assigned: DataFrame, events: DataFrame, widths: DataFrame) -> DataFrame:
    """Distinct (source, order, idx): the buckets that a cluster has events in, counted from the first cluster's first."""
    origin = events.groupBy("source").agg(F.min("first_seen").alias("origin")).join(widths.select("source", "width"), "source")
    e = events.select(F.col("source").alias("s"), F.col("template").alias("t"), F.col("level").alias("l"), "order")
    rows = assigned.where("ts is not null").select(*KEY, "ts").join(e, (F.col("source") == F.col("s")) & (F.col("template") == F.col("t")) & F.col("level").eqNullSafe(F.col("l")))
    idx = F.floor((F.unix_micros("ts") - F.unix_micros("origin")) / (F.col("width").cast("long") * 1_000_000))
    return rows.select("source", "order", "ts").join(origin, "source").select("source", "order", idx.alias("idx")).distinct()


def overlaps(held: DataFrame) -> DataFrame:
    """(source, cause, effect, shared, jaccard) of the pairs cause < effect that share a bucket: an equi-join on buckets."""
    sizes = held.groupBy("source", "order").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: held.select("source", "idx", F.col("order").alias(x))
    shared = side("cause").join(side("effect"), ["source", "idx"]).where("cause < effect").groupBy("source", "cause", "effect").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda x: sizes.select("source", F.col("order").alias(x), F.col("n").alias(f"n_{x}"))
    both = shared.join(size("cause"), ["source", "cause"]).join(size("effect"), ["source", "effect"])
    return both.select("source", "cause", "effect", "shared", (F.col("shared") / (F.col("n_cause") + F.col("n_effect") - F.col("shared"))).alias("jaccard"))


def links(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, cause, effect, lag_seconds, jaccard, score, confidence): for each effect its best cause.

    Causes are tried in order, and one replaces the best if its overlap is above the best's *rounded* overlap; so at a
    third (stored as 0.333) a later equal cause wins, at two thirds (0.667) the earlier one stays.
    """
    node = lambda x: events.select("source", F.col("order").alias(x), F.col("first_seen").alias(f"seen_{x}"), F.coalesce("level", F.lit(0)).alias(f"level_{x}"))
    joined = pairs.join(node("cause"), ["source", "cause"]).join(node("effect"), ["source", "effect"])
    lag = (F.unix_micros("seen_effect") - F.unix_micros("seen_cause")) / 1e6
    able = joined.withColumn("lag", lag).where((F.col("lag") > 0) & (F.col("lag") <= MOST_LAG) & (F.col("jaccard") >= LEAST_OVERLAP))
    row = F.struct("cause", "jaccard", "lag", (F.col("level_cause") >= F.col("level_effect")).alias("ordered"))
    gathered = able.groupBy("source", "effect").agg(F.array_sort(F.collect_list(row)).alias("causes"))

    def better(best: Column, x: Column) -> Column:
        return F.when(x["jaccard"] > F.bround(best["jaccard"], 3), x).otherwise(best)

    best = F.aggregate(F.slice("causes", 2, F.greatest(F.size("causes") - 1, F.lit(0))), F.element_at("causes", 1), better)
    chosen = gathered.select("source", "effect", best.alias("b"))
    return chosen.select(
        "source", F.col("b.cause").alias("cause"), "effect", F.col("b.lag").alias("lag_seconds"), F.bround("b.jaccard", 3).alias("jaccard"), F.col("b.jaccard").alias("score"),
        scoring.link(F.col("b.jaccard"), F.col("b.lag"), MOST_LAG, F.col("b.ordered")).alias("confidence"),
    )


def trigger(events: DataFrame, found: DataFrame) -> DataFrame:
    """(source, trigger, is_root, effects, severity_rank, confidence): a cause that is no effect, the earliest and then most
    severe; else the earliest error; else the first event."""
    causes = found.groupBy("source", F.col("cause").alias("order")).agg(F.count(F.lit(1)).alias("effects"))
    caused = found.select("source", F.col("effect").alias("order")).distinct().withColumn("caused", F.lit(True))
    ranks = F.dense_rank().over(Window.partitionBy("source", F.col("level").isNull()).orderBy("level"))
    levels = events.groupBy("source").agg(F.count_distinct("level").alias("levels"))
    nodes = events.select("source", "order", "first_seen", "level", ranks.alias("place")).join(causes, ["source", "order"], "left").join(caused, ["source", "order"], "left").join(levels, "source")
    nodes = nodes.withColumn("is_root", F.col("effects").isNotNull() & F.col("caused").isNull()).withColumn("severity_rank", F.when(F.col("level").isNotNull(), F.col("place") / F.col("levels")).otherwise(0.0))
    tier = F.when(F.col("is_root"), 0).when(F.col("level") >= 40, 1).otherwise(2)
    level = F.when(F.col("is_root"), -F.coalesce("level", F.lit(0))).otherwise(0)
    pick = F.min_by(F.struct("order", "is_root", F.coalesce("effects", F.lit(0)).alias("effects"), "severity_rank"), F.struct(tier, "first_seen", level, "order"))
    best = nodes.groupBy("source").agg(pick.alias("p")).select("source", F.col("p.order").alias("trigger"), "p.is_root", "p.effects", "p.severity_rank")
    return best.withColumn("confidence", scoring.trigger(F.col("is_root"), F.col("effects"), F.col("severity_rank")))


def correlate(assigned: DataFrame, clusters: DataFrame, widths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(timeline, links, trigger) of ranked clusters and their entries.

    The timeline, the buckets held and the links are each read several times and small once made (a row for each ranked
    cluster, for each of its buckets, and for each effect), so they are written out; the entries are read twice in all.
    """
    events = kept(timeline(clusters))
    found = kept(links(events, overlaps(kept(occupancy(assigned, events, widths)))))
    return events, found, trigger(events, found)


def components_in_order(events: DataFrame) -> DataFrame:
    """(source, component, first): by first appearance."""
    return events.groupBy("source", F.coalesce("component", F.lit("(uncomponented)")).alias("component")).agg(F.min("order").alias("first"))


def chain(cascade: list[tuple[int, int, float]], start: int | None) -> list[int]:
    """The nodes from ``start`` on, each time along the first of the strongest links (cause, effect, jaccard)."""
    if not cascade:
        return []
    path = [start if start is not None else cascade[0][0]]
    while True:
        onward = [x for x in cascade if x[0] == path[-1]]
        if not onward:
            return path
        step = max(onward, key=lambda x: x[2])[1]
        if step in path:
            return path
        path.append(step)
