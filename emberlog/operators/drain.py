"""Structural template mining: routing in SQL, mining per leaf, ids from first appearances.

The tree of token count and prefix tokens is a set of columns, so each leaf is mined by itself and no task sees the
whole log. A node's surviving keys are its first ``max_children`` distinct ones by first appearance; later ones go to
the wildcard. Group ids are the rank of the groups' first lines, as one sequential pass would give them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity, text

WILDCARD = "<*>"


def check_depth(depth: int) -> None:
    if depth < 3:
        raise ValueError("depth counts the length layer, at least one prefix layer and the leaf: it is 3 or more")


def _route(messages: DataFrame, depth: int, max_children: int) -> DataFrame:
    """The messages with ``tokens`` and ``leaf``: the node keys on the way down."""
    out = messages.withColumn("tokens", text.split_words(F.col("message"))).withColumn("leaf", F.array(F.size("tokens").cast("string")))
    for layer in range(depth - 2):
        token = F.get("tokens", F.lit(layer))
        key = F.when(token.rlike(r"(?U)\d"), WILDCARD).otherwise(token)
        out = out.withColumn("__key", key)
        firsts = out.where(F.col("__key").isNotNull() & (F.col("__key") != WILDCARD)).groupBy("source", "leaf", "__key").agg(F.min("line_no").alias("__first"))
        place = F.row_number().over(Window.partitionBy("source", "leaf").orderBy("__first"))
        kept = firsts.withColumn("__place", place).where(F.col("__place") <= max_children).select("source", "leaf", "__key", F.lit(True).alias("__own"))
        joined = out.join(kept, ["source", "leaf", "__key"], "left")
        step = F.when(F.col("__own"), F.concat(F.lit("="), F.col("__key"))).otherwise(WILDCARD)
        out = joined.withColumn("leaf", F.when(F.col("__key").isNull(), F.col("leaf")).otherwise(F.concat(F.col("leaf"), F.array(step)))).drop("__key", "__own")
    return out


def _mine_leaf(threshold: float):
    """A leaf's messages in line order: the group each joins, and the group's template at that moment.

    A message that was seen before joins the group it joined then, unless a template of the leaf has changed since.
    """

    def mine(leaf: pd.DataFrame) -> pd.DataFrame:
        leaf = leaf.sort_values("line_no", kind="stable")
        firsts: list[int] = []
        shapes: list[list[str]] = []
        joined, running = [], []
        known: dict[tuple[str, ...], tuple[int, int]] = {}
        changes = 0
        for line, tokens in zip(leaf["line_no"], leaf["tokens"], strict=True):
            key = tuple(tokens)
            when, best = known.get(key, (-1, None))
            if when == changes:
                joined.append(best)
                running.append(" ".join(shapes[best]))
                continue
            tokens = list(tokens)
            fits = [sum(a in (WILDCARD, b) for a, b in zip(shape, tokens, strict=True)) / len(tokens) for shape in shapes]
            best = max(range(len(fits)), key=fits.__getitem__, default=None)
            if best is None or fits[best] < threshold:
                best = len(shapes)
                firsts.append(int(line))
                shapes.append(tokens)
                changes += 1
            elif (merged := [a if a == b else WILDCARD for a, b in zip(shapes[best], tokens, strict=True)]) != shapes[best]:
                shapes[best] = merged
                changes += 1
            known[key] = changes, best
            joined.append(best)
            running.append(" ".join(shapes[best]))
        return pd.DataFrame({"source": leaf["source"], "line_no": leaf["line_no"], "first": [firsts[g] for g in joined], "running": running, "final": [" ".join(shapes[g]) for g in joined]})

    return mine


def mine(messages: DataFrame, depth: int = 4, threshold: float = 0.4, max_children: int = 100) -> DataFrame:
    """(source, line_no, message) -> source, line_no, group_id, running, template.

    running: the template as it was when the line came; template: the final one. An empty message has id -1 and ``""``.
    """
    check_depth(depth)
    routed = _route(messages.select("source", "line_no", "message"), depth, max_children)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("first", T.LongType()), T.StructField("running", T.StringType()), T.StructField("final", T.StringType())])
    some = routed.where(F.size("tokens") > 0).select("source", "leaf", "line_no", "tokens")
    mined = some.groupBy("source", "leaf").applyInPandas(_mine_leaf(threshold), schema)
    ids = mined.select("source", "first").distinct().withColumn("group_id", F.row_number().over(Window.partitionBy("source").orderBy("first")) - 1)
    found = mined.join(ids, ["source", "first"]).select("source", "line_no", "group_id", "running", F.col("final").alias("template"))
    blank = routed.where(F.size("tokens") == 0).select("source", "line_no", F.lit(-1).alias("group_id"), F.lit("").alias("running"), F.lit("").alias("template"))
    return found.unionByName(blank)


def assign_drain(entries: DataFrame, least: int | None = 30, **options) -> DataFrame:
    """Entries at or above a level with their groups' final templates; blank messages are their own templates."""
    kept = entries.where(severity.at_least(F.col("level"), least))
    mined = mine(kept, **options).select("source", "line_no", "group_id", "template")
    return kept.join(mined, ["source", "line_no"]).withColumn("template", F.when(F.col("group_id") < 0, F.col("message")).otherwise(F.col("template")))
