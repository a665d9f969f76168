"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by what its bytes show (marks, capitals,
digits, word lengths, repeats) and a learned layer; gated attention weights, learned from document labels alone, say how
much each passage counts, and the weighted mean of the encodings is scored. The model is fitted by full-batch Adam on a
bounded sample of labelled documents; all passages of all documents are scored.

Defined cases: a null or wordless text is one passage without words; its score is the model's for that. Without labels
of both kinds every score is the share of label 1 (0.5 without any). Repeated rows are scored alike, each by itself;
texts of any length are read in whole, a slice at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import read, slices, word_hashes, words_of

PASSAGE = 64
TRAIN_ROWS = {0: 2500, 1: 3500}
WIDTH = 12
STEPS, RATE, DECAY = 300, 0.02, 1e-3

_is_word = np.ones(256, bool)
_is_word[[32, *range(9, 14)]] = False
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_UPPER, _DIGIT, _LOWER, _LINE, _HIGH, _OTHER = range(len(_MARKS), len(_MARKS) + 6)
_KINDS = _OTHER + 1
_kind = np.full(256, _OTHER, np.int64)
_kind[_MARKS] = np.arange(len(_MARKS))
_kind[65:91], _kind[48:58], _kind[97:123], _kind[10], _kind[128:] = _UPPER, _DIGIT, _LOWER, _LINE, _HIGH
FEATURES = len(_MARKS) + 11


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and the n + 1 offsets of the rows in them; each row has one at least."""
    starts, ends, bounds = words_of(data, offsets, _is_word)
    n_words = np.diff(bounds)
    count = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(n_words)), n_words)
    of = first[row] + (np.arange(len(row)) - bounds[row]) // PASSAGE
    words = np.bincount(of, minlength=total)
    # bytes up to the next word belong to the word before them
    owner = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    inside = owner >= 0
    kinds = np.bincount(of[owner[inside]] * _KINDS + _kind[data[inside]], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float64)
    size = ends - starts
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    keys = np.lexsort((hashes, of))
    new = np.ones(len(keys), bool)
    new[1:] = (hashes[keys][1:] != hashes[keys][:-1]) | (of[keys][1:] != of[keys][:-1])
    distinct = np.bincount(of[keys][new], minlength=total)
    per = np.maximum(words, 1)
    letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH] / 2, 1)
    mean = np.bincount(of, size, total) / per
    return np.column_stack(
        [
            np.sqrt(kinds[:, : len(_MARKS)] / per[:, None]),
            kinds[:, _UPPER] / letters,
            np.sqrt(kinds[:, _DIGIT] / per),
            np.sqrt(kinds[:, _LINE] / per),
            kinds[:, _HIGH] / 2 / letters,
            np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(0, np.bincount(of, size.astype(float) ** 2, total) / per - mean**2))),
            np.bincount(of, again, total) / per,
            distinct / per,
            np.bincount(of, size <= 2, total) / per,
            np.log1p(words) / 4,
            words == 0,
        ]
    ).astype(np.float32), first


@dataclass
class Attention:
    """Parameters: encoder (E, e), attention (V, U, w), output (c, b), and the features' mean and spread."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, at, n = self.p, first[:-1], np.diff(first)
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        a = s / np.repeat(np.add.reduceat(s, at), n)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)["y"]

    @staticmethod
    def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Attention:
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-2
        rng = np.random.default_rng(4)
        draw = lambda *shape: rng.normal(scale=shape[0] ** -0.5, size=shape)
        model = Attention(mean, spread, {"E": draw(x.shape[1], WIDTH), "e": np.zeros(WIDTH), "V": draw(WIDTH, WIDTH), "U": draw(WIDTH, WIDTH), "w": draw(WIDTH), "c": draw(WIDTH), "b": np.zeros(1)})
        first_moment = {k: np.zeros_like(v) for k, v in model.p.items()}
        second = {k: np.zeros_like(v) for k, v in model.p.items()}
        n = np.diff(first)
        for step in range(1, STEPS + 1):
            f, p = model._forward(x, first), model.p
            d = (f["y"] - y) / len(y)
            dz = d[:, None] * p["c"]
            dz_each = np.repeat(dz, n, axis=0)
            da = (dz_each * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
            dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz_each + dt @ p["V"].T + dg @ p["U"].T
            de = dh * (1 - f["h"] ** 2)
            grad = {"E": f["x"].T @ de, "e": de.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}
            for k, v in p.items():
                g = grad[k] + (DECAY * v if k != "b" else 0) / 10
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = v - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model


@dataclass
class Constant:
    value: float

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.value)


def train(documents: DataFrame, labels: DataFrame, target: str = "quality") -> Attention | Constant:
    """Fit on at most about ``TRAIN_ROWS`` labelled documents of each label; their passages' features come to the driver."""

    def encode(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                x, first = passages(data, offsets)
                packed = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(packed, pa.binary())], ["doc_id", "label", "x"])

    got = labelled.sample(documents, labels, target, TRAIN_ROWS).mapInArrow(encode, "doc_id long, label int, x binary").toPandas()
    got = got.assign(raw=got["x"].map(bytes)).sort_values(["doc_id", "raw"])
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["raw"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Attention.fit(np.concatenate(bags).astype(np.float64), first, y)


def score_quality(documents: DataFrame, model: Attention | Constant) -> DataFrame:
    """The documents' columns and score double; a column of that name is replaced. Only texts go to Python and scores come back."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [shared.value.score(*passages(data, offsets)) for _, data, offsets in slices(pa.record_batch([texts], ["text"]))]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    names = [F.col(f"`{c}`") for c in documents.columns if c != "score"]
    return documents.select(*names, F.arrow_udf(score, "double").asNondeterministic()("text").alias("score"))  # else a filter would run it again


def query(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(documents, train(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
