"""Confidence scores. Each has an unrounded form, for comparisons, and is rounded to three places for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the evidence.
LINK_OVERLAP, LINK_LAG, LINK_SEVERITY, LINK_BIAS = 4.0, 1.5, 0.6, -2.5
ONSET_Z, ONSET_CENTRE, ONSET_SPIKES, ONSET_INFINITE = 0.9, 2.5, 0.5, 6.0
TRIGGER_ROOT, TRIGGER_OTHER, TRIGGER_EFFECT, TRIGGER_RANK, TRIGGER_BIAS = 1.2, -0.5, 0.5, 0.3, -1.0
BURST_CONCENTRATION, BURST_CENTRE, BURST_VOLUME, BURST_BIAS = 4.0, 0.6, 0.4, -0.5
LABELS = ((0.8, "high"), (0.55, "moderate"), (0.35, "low"))


def logistic(x: Column) -> Column:
    """exp is only ever taken of a number below zero."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def three(x: Column) -> Column:
    return F.bround(x, 3)


def link(jaccard: Column, lag: Column, most: float, ordered: Column) -> Column:
    close = 1 - F.least(F.greatest(lag, F.lit(0.0)) / most, F.lit(1.0))
    return logistic(LINK_OVERLAP * jaccard + LINK_LAG * close + F.when(ordered, LINK_SEVERITY).otherwise(-LINK_SEVERITY) + LINK_BIAS)


def onset(z: Column, spikes: Column) -> Column:
    shown = F.when(F.abs(z) == float("inf"), ONSET_INFINITE).otherwise(F.greatest(z, F.lit(0.0)))
    return logistic(ONSET_Z * (shown - ONSET_CENTRE) + ONSET_SPIKES * F.greatest(spikes - 1, F.lit(0)))


def trigger(is_root: Column, effects: Column, rank: Column) -> Column:
    return logistic(F.when(is_root, TRIGGER_ROOT).otherwise(TRIGGER_OTHER) + TRIGGER_EFFECT * effects + TRIGGER_RANK * rank + TRIGGER_BIAS)


def burst(concentration: Column, count: Column) -> Column:
    return logistic(BURST_CONCENTRATION * (concentration - BURST_CENTRE) + BURST_VOLUME * F.log1p(F.greatest(count, F.lit(0)).cast("double")) + BURST_BIAS)


def label(confidence: Column) -> Column:
    out = F.lit("tentative")
    for least, name in reversed(LABELS):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def label_of(confidence: float) -> str:
    return next((name for least, name in LABELS if confidence >= least), "tentative")
