"""Merging clusters of similar wording: sparse TF-IDF, a self-join on tokens, connected components, an ordered fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import kept
from .clusters import rank, severity_score

THRESHOLD = 0.85


def tfidf(clusters: DataFrame) -> DataFrame:
    """(source, rank, token, w): term frequency by ln((N + 1) / (df + 1)) + 1."""
    tokens = clusters.select("source", "rank", F.explode(text.letter_words(F.col("template"))).alias("token"))
    counts = tokens.groupBy("source", "rank", "token").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source", "rank").agg(F.sum("n").alias("words"))
    df = counts.groupBy("source", "token").agg(F.count(F.lit(1)).alias("df"))
    n = clusters.groupBy("source").agg(F.count(F.lit(1)).alias("clusters"))
    idf = F.log((F.col("clusters") + 1) / (F.col("df") + 1)) + 1
    return counts.join(totals, ["source", "rank"]).join(df, ["source", "token"]).join(n, "source").select("source", "rank", "token", (F.col("n") / F.col("words") * idf).alias("w"))


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, a, b, cosine) of the rank pairs a < b that share a token and are similar enough."""
    norms = vectors.groupBy("source", "rank").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = lambda x: vectors.join(norms, ["source", "rank"]).select("source", "token", F.col("rank").alias(x), F.col("w").alias(f"w{x}"), F.col("norm").alias(f"n{x}"))
    both = side("a").join(side("b"), ["source", "token"]).where("a < b")
    dots = both.groupBy("source", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    cosine = F.when((F.col("na") < 1e-12) | (F.col("nb") < 1e-12), 0.0).otherwise(F.col("dot") / (F.col("na") * F.col("nb")))
    return dots.withColumn("cosine", cosine).where(F.col("cosine") >= threshold).select("source", "a", "b", "cosine")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


MOST_EMBEDDED = 20_000  # clusters of a source whose dense vectors are compared all with all


class LocalServer:
    """Embeddings from a model server on this machine: one request a text, so nothing leaves it."""

    #: The server's public address and model.
    URL, MODEL, SECONDS = "http://localhost:11434/api/embeddings", "nomic-embed-text", 60.0

    def __init__(self, url: str = URL, model: str = MODEL, seconds: float = SECONDS):
        self.url, self.model, self.seconds = url, model, seconds

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        out = []
        for t in texts:
            request = urllib.request.Request(self.url, json.dumps({"model": self.model, "prompt": t}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                out.append(json.load(answer)["embedding"])
        return out


def get_similarity(name: str = "tfidf", **options) -> Callable[[DataFrame, float], DataFrame]:
    """A function of (clusters, threshold) that gives the similar pairs: by ``ollama``, a local model server, or else by
    ``tfidf``, which any other name stands for."""
    if name == "ollama":
        embed = LocalServer(**options)
        return lambda clusters, threshold=THRESHOLD: embedded_pairs(clusters, embed, threshold)
    return lambda clusters, threshold=THRESHOLD: similar_pairs(tfidf(clusters), threshold)


def embedded_pairs(clusters: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = THRESHOLD, most: int = MOST_EMBEDDED) -> DataFrame:
    """The pairs under an embedder of dense vectors, which is called on the cluster templates of each task.

    All pairs of a source are compared, so a source of over ``most`` clusters is an error: take a top-n first.
    """
    import pandas as pd

    clusters = kept(clusters)
    if large := clusters.groupBy("source").count().where(F.col("count") > most).first():
        raise ValueError(f"{large['source']} has {large['count']} clusters; at most {most} can be compared all with all")

    def vectors(batches):
        for batch in batches:
            out = batch[["source", "rank"]].copy()
            out["v"] = [list(map(float, v)) for v in embed(batch["template"].tolist())]
            yield pd.DataFrame(out)

    v = clusters.select("source", "rank", "template").mapInPandas(vectors, "source string, rank int, v array<double>")
    left, right = v.select("source", F.col("rank").alias("a"), F.col("v").alias("va")), v.select("source", F.col("rank").alias("b"), F.col("v").alias("vb"))
    return left.join(right, "source").where("a < b").withColumn("cosine", cosine(F.col("va"), F.col("vb"))).where(F.col("cosine") >= threshold).select("source", "a", "b", "cosine")


def groups_of(clusters: DataFrame, pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(source, rank, group): the smallest rank that similar pairs reach, by repeated least-label joins."""
    pairs = kept(pairs)
    both = pairs.select("source", "a", "b").unionByName(pairs.select("source", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = clusters.select("source", "rank", F.col("rank").alias("group"))
    for _ in range(rounds):
        near = both.join(labels, (both["source"] == labels["source"]) & (both["b"] == labels["rank"])).groupBy(both["source"], both["a"]).agg(F.min("group").alias("near"))
        new = labels.join(near, (labels["source"] == near["source"]) & (labels["rank"] == near["a"]), "left").select(labels["source"], labels["rank"], F.col("group").alias("old"), F.least("group", F.coalesce("near", "group")).alias("group"))
        new = kept(new)
        changed = new.where("old <> group").limit(1).count()
        labels = new.select("source", "rank", "group")
        if not changed:
            break
    return labels


def merge_similar(clusters: DataFrame, threshold: float = THRESHOLD, pairs: DataFrame | None = None) -> DataFrame:
    """Ranked clusters with similar ones folded together, ranked anew.

    Members fold in rank order: the side with at least the other's count gives template, sample and component; counts
    add up and the highest level stays.
    """
    clusters = kept(clusters)
    pairs = similar_pairs(tfidf(clusters), threshold) if pairs is None else pairs
    row = F.struct("rank", "template", "level", "count", "timed", "first_line", "rep_message", "component", "first_seen", "last_seen")
    gathered = clusters.join(groups_of(clusters, pairs), ["source", "rank"]).groupBy("source", "group").agg(F.array_sort(F.collect_list(row)).alias("m"))
    first = F.element_at("m", 1)

    def fold(acc: Column, x: Column) -> Column:
        own = acc["count"] >= x["count"]
        pick = lambda c: F.when(own, acc[c]).otherwise(x[c]).alias(c)
        return F.struct(
            acc["rank"].alias("rank"), pick("template"), F.greatest(acc["level"], x["level"]).alias("level"), (acc["count"] + x["count"]).alias("count"), (acc["timed"] + x["timed"]).alias("timed"),
            F.least(acc["first_line"], x["first_line"]).alias("first_line"), pick("rep_message"), pick("component"), F.least(acc["first_seen"], x["first_seen"]).alias("first_seen"), F.greatest(acc["last_seen"], x["last_seen"]).alias("last_seen"),
        )

    folded = gathered.select("source", F.aggregate(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), first, fold).alias("c"))
    out = folded.select("source", "c.*").withColumnRenamed("rank", "was").withColumn("score", severity_score(F.col("level"), F.col("count")))
    return rank(out, tie="was").drop("was")
