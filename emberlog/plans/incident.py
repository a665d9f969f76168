"""A whole triage: entries to clusters, anomalies, cascade, and the few rows that a report is made of."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity, text
from ..operators import anomaly, clusters, correlation, parsing, semantic
from ..scratch import kept

NAMES = {v: k for k, v in severity.LEVELS.items()}


@dataclass
class Options:
    top: int | None = 8
    least: int | None = 30
    method: str = "regex"
    semantic: bool = False
    infer: bool = False
    bucket_seconds: int | None = None
    baseline: DataFrame | None = None  # entries of a healthy log
    embedder: str = "tfidf"


@dataclass
class Plan:
    """The lazy tables of an analysis; all are keyed by source."""

    entries: DataFrame
    assigned: DataFrame
    clusters: DataFrame
    widths: DataFrame
    buckets: DataFrame
    spikes: DataFrame
    onset: DataFrame
    bursts: DataFrame
    timeline: DataFrame
    links: DataFrame
    trigger: DataFrame

    def release(self) -> None:
        """Give back what the plan keeps in memory."""
        for table in (self.entries, self.assigned):
            table.unpersist()


def plan(entries: DataFrame, options: Options | None = None) -> Plan:
    """Buckets cover all entries; bursts and the cascade the ``top`` clusters only.

    Entries and their templates are read by several of the tables, so they are cached (memory, then disk) until `release`;
    buckets, clusters and the cascade, which are small, are written out.
    """
    o = options or Options()
    if o.infer:
        entries = parsing.infer_levels(entries)
    entries = entries.cache()
    assigned, ranked = clusters.cluster_and_rank(entries, None if o.semantic else o.top, o.least, o.method)
    if o.semantic:
        ranked = kept(ranked)
        ranked = semantic.merge_similar(ranked, pairs=semantic.get_similarity(o.embedder)(ranked))
        ranked = ranked if o.top is None else ranked.where(F.col("rank") <= o.top)
    assigned = assigned.cache()
    ranked = kept(ranked)
    widths = anomaly.spans(entries, o.bucket_seconds)
    buckets = kept(anomaly.bucketize(entries, o.bucket_seconds))  # a row for each bucket
    if o.baseline is not None:
        width = o.bucket_seconds or (widths.agg(F.max("width")).first()[0] or anomaly.WIDTHS[0])  # one row
        scored = anomaly.seasonal_z(buckets, anomaly.learn_baseline(anomaly.bucketize(o.baseline, width)))
    else:
        scored = anomaly.ewma_z(buckets)
    found = anomaly.spikes(scored)
    events, links, trigger = correlation.correlate(assigned, ranked, widths)
    return Plan(entries, assigned, ranked, widths, buckets, found, anomaly.onset(buckets, found), anomaly.bursts(assigned, ranked, widths), events, links, trigger)


@dataclass
class Findings:
    """One source's findings, as plain values."""

    source: str
    bucket_seconds: int = 1
    onset: datetime | None = None
    onset_confidence: float = 0.0
    baseline_errors: float = 0.0
    peak_errors: int = 0
    clusters: list[dict] = field(default_factory=list)
    spikes: list[dict] = field(default_factory=list)
    bursts: list[dict] = field(default_factory=list)
    timeline: list[dict] = field(default_factory=list)
    cascade: list[dict] = field(default_factory=list)
    trigger: int | None = None
    trigger_confidence: float = 0.0
    total: int = 0  # entries in all clusters, shown or not
    not_shown: dict[str, int] = field(default_factory=dict)  # rows of a kind beyond ``SHOWN``
    events: dict[int, dict] = field(default_factory=dict)  # by order: the timeline, and what else links and the trigger name

    def chain(self) -> list[int]:
        return correlation.chain([(x["cause"], x["effect"], x["jaccard"]) for x in self.cascade], self.trigger)


#: Most rows of a kind that a report is given of one source.
SHOWN = 10_000


def findings(p: Plan, source: str, redact: bool = False) -> Findings:
    """Gather one source's rows: the first ``SHOWN`` of a kind; ``not_shown`` says how many more there are, and totals cover all."""
    mine = lambda df: df.where(F.col("source") == source)

    def of(df: DataFrame, order: str, kind: str = "") -> list[dict]:
        rows = [r.asDict() for r in mine(df).orderBy(order).limit(SHOWN + 1).collect()]
        if kind and len(rows) > SHOWN:
            out.not_shown[kind] = mine(df).count() - SHOWN
        return rows[:SHOWN]

    mask = (lambda df, *names: df.withColumns({c: text.redact(F.col(c)) for c in names})) if redact else (lambda df, *names: df)
    out = Findings(source)
    if head := of(p.onset, "source"):
        h = head[0]
        out.bucket_seconds, out.onset, out.peak_errors = h["width"], h["onset"], h["peak_errors"]
        out.baseline_errors, out.onset_confidence = round(h["baseline_errors"], 3), round(h["onset_confidence"], 3)
    out.clusters = of(mask(p.clusters, "template", "rep_message"), "rank", "clusters")
    out.total = mine(p.clusters).agg(F.sum("count")).first()[0] or 0 if "clusters" in out.not_shown else sum(c["count"] for c in out.clusters)
    out.spikes = of(p.spikes, "idx", "spikes")
    out.bursts = of(mask(p.bursts, "template"), "order", "bursts")
    out.timeline = of(mask(p.timeline, "template", "rep_message"), "order", "timeline")
    out.cascade = of(p.links, "effect", "cascade")
    for row in [*out.spikes, *out.bursts, *out.cascade]:
        row["confidence"] = round(row["confidence"], 3)
    if head := of(p.trigger, "source"):
        out.trigger, out.trigger_confidence = head[0]["trigger"], round(head[0]["confidence"], 3)
    out.events = {e["order"]: e for e in out.timeline}
    if far := ({x[end] for x in out.cascade for end in ("cause", "effect")} | {out.trigger} - {None}) - out.events.keys():  # past those shown; two a link at most
        out.events |= {r["order"]: r.asDict() for r in mask(mine(p.timeline).where(F.col("order").isin(*far)), "template", "rep_message").collect()}
    return out


def to_dict(f: Findings) -> dict:
    """For JSON. An infinite z is the string ``Infinity``."""
    when = lambda t: t.isoformat() if t else None
    number = lambda z: "Infinity" if isinstance(z, float) and math.isinf(z) else z
    component = lambda i: f.events[i]["component"]
    return {
        "source": f.source, "bucket_seconds": f.bucket_seconds, "onset": when(f.onset), "onset_confidence": f.onset_confidence, "baseline_errors": f.baseline_errors, "peak_errors": f.peak_errors,
        "spikes": [{"start": when(s["start"]), "errors": s["errors"], "zscore": number(s["z"])} for s in f.spikes],
        "bursts": [{"template": b["template"], "level": NAMES.get(b["level"]), "count": b["count"], "peak_count": b["peak_count"], "concentration": b["concentration"], "confidence": b["confidence"]} for b in f.bursts],
        "trigger": f.trigger, "trigger_confidence": f.trigger_confidence, "total": f.total, "not_shown": f.not_shown,
        "timeline": [{"order": e["order"], "first_seen": when(e["first_seen"]), "level": NAMES.get(e["level"]), "count": e["count"], "component": e["component"], "template": e["template"], "is_trigger": e["order"] == f.trigger} for e in f.timeline],
        "cascade": [{"cause": x["cause"], "effect": x["effect"], "cause_component": component(x["cause"]), "effect_component": component(x["effect"]), "lag_seconds": x["lag_seconds"], "jaccard": x["jaccard"], "confidence": x["confidence"]} for x in f.cascade],
    }
