"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are lowered, stripped of zero-width characters and accents, and look-alike letters and digits are folded to
plain ones, so that ``1d10t`` reads ``idiot``. The lexicon's entries are words and word beginnings with weights: log
odds learned from labels on a bounded sample of different texts. One automaton finds all entries and all exception
phrases; a word counts by its heaviest entry, not inside an exception phrase, and each repetition of an entry counts
less than the one before. The weight per 100 words and the total are turned into a score by a logistic regression,
fitted on what the lexicon of either half of the sample finds in the other half.

Defined cases: a null or empty text has no hits, so it has the score of a text without hits. Without labels of both
kinds a short general list of words stands in; with labels, no entry comes from anywhere else. Repeated rows are scored
alike, each by itself; long texts are read in whole; doc_id is read as a long; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import read, slices, stored

TRAIN_ROWS = {0: 6000, 1: 4000}
BEGINNINGS = (4, 5, 6, 7)  # letters of word beginnings that may become entries
LEAST_TEXTS, LEAST_SHARE = 4, 0.004  # toxic texts of the sample that must hold an entry, and their share
LEAST_WEIGHT = 2.0
DOUBT = 1.0  # standard errors taken off an entry's log odds
MOST_ENTRIES = 20_000
THRESHOLD = 0.7

#: Look-alike letters and digits, and what they read as.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ℓ": "l", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
#: A general list for use without any labels; a trained lexicon holds only what its labels say.
FALLBACK_WEIGHT = 4.0
FALLBACK = ("arsehole", "asshole", "bastard", "bitch", "cretin", "dickhead", "dumbass", "fuckwit", "halfwit", "imbecile", "jackass", "scumbag", "shithead", "subhuman", "tosser", "twat", "vermin", "wanker")
#: Phrases in which an entry means no harm; a caller may give others.
EXCEPTIONS = ("bastard file", "bastard sword", "bastard title", "vermin control", "vermin proof")


class _Fold(dict):
    """A translation table for lowered text that works characters out as they come."""

    def __missing__(self, code: int) -> str | None:
        letter = chr(code)
        plain = LOOK_ALIKES.get(letter)
        if plain is None:
            kind = unicodedata.category(letter)
            if kind in ("Cf", "Mn"):
                plain = ""
            elif kind[0] in "LN":
                base = "".join(c for c in unicodedata.normalize("NFKD", letter) if unicodedata.category(c) != "Mn")
                plain = "".join(LOOK_ALIKES.get(c, c) for c in base.lower())
            else:
                plain = " "
        self[code] = plain
        return plain


_FOLD = _Fold()
_SPACES = re.compile(" {2,}")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces."""
    return _SPACES.sub(" ", f" {(text or '').lower().translate(_FOLD)} ")


@dataclass
class Lexicon:
    """weights: by entry, ``" word "`` for a whole word or ``" begin"`` for a beginning; coefficients: of 1, any hit, log total, log density."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0, -1.0, 1.5, 1.5]))

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (entry, weight))
            for phrase in self.exceptions:
                phrase = fold(phrase)
                self._automaton.add_word(phrase, (phrase, None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, tuple[str, float]]:
        """(entry, weight) of each word that an entry fits, by where it begins."""
        found: dict[int, tuple[str, float]] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.automaton):
            return found
        for end, (entry, weight) in self.automaton.iter(folded):
            start = end - len(entry) + 1
            if weight is None:
                spared.append((start, end))
            elif start not in found or weight > found[start][1]:
                found[start] = entry, weight
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), 4))
        for i, text in enumerate(texts):
            folded = fold(text)
            counts = Counter(self.hits(folded).values())
            total, words = sum(weight * (1 + math.log(n)) for (_, weight), n in counts.items()), max(0, folded.count(" ") - 1)
            out[i] = 1, total > 0, np.log1p(total), np.log1p(100 * total / (words + 20))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.coefficients, -40, 40)))


def fallback() -> Lexicon:
    return Lexicon({f" {w} ": FALLBACK_WEIGHT for w in FALLBACK})


def _entries(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in BEGINNINGS if len(word) > k)
    return out


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by damped Newton steps; those of the totals can't be negative."""

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        free = (w > 0) | (grad < 0)
        free[:2] = True
        of = x[:, free]
        step = np.zeros(len(w))
        step[free] = np.linalg.solve((of * (p * (1 - p))[:, None]).T @ of + penalty * np.eye(free.sum()), grad[free])
        for damp in 0.5 ** np.arange(12):
            new = w - damp * step
            new[2:] = np.maximum(new[2:], 0)
            if loss(new) < loss(w) - 1e-9:
                break
        else:
            break
        w = new
    return w


def _count(batches):
    """(entry, half, toxic, clean): in how many texts of a half each entry is, summed up as far as a task's memory allows."""

    def out():
        for (half, label), counts in seen.items():
            n, none = list(counts.values()), [0] * len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([half] * len(n), pa.int32()), pa.array(n if label else none, pa.int64()), pa.array(none if label else n, pa.int64())], ["entry", "half", "toxic", "clean"])
        seen.clear()

    seen: dict[tuple[int, int], Counter] = {}
    for batch in batches:
        for rows, _, _ in slices(batch):
            for text, label, half in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                seen.setdefault((half, label), Counter()).update(_entries(fold(text)))
            if sum(map(len, seen.values())) > 500_000:
                yield from out()
    yield from out()


def _chosen(counted: DataFrame, sizes: dict[int, int]) -> Lexicon:
    """The lexicon of (entry, toxic, clean) counts; sizes: texts by label."""
    weight = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    weight = weight - DOUBT * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = min(max(LEAST_TEXTS, LEAST_SHARE * sizes[1]), sizes[1])
    likely = counted.withColumn("weight", weight).where((F.col("toxic") >= least) & (F.col("weight") >= LEAST_WEIGHT))
    rows = likely.orderBy(F.desc("toxic"), F.desc("weight"), "entry").limit(MOST_ENTRIES).collect()
    weights = {r["entry"]: float(r["weight"]) for r in rows}
    return Lexicon(weights)


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic") -> Lexicon:
    """Learn from at most about ``TRAIN_ROWS`` labelled documents of each label.

    Entries are counted on the executors; at most ``MOST_ENTRIES`` of them, those in the most toxic texts, come to the driver.
    """
    sample = stored(labelled.sample(documents, labels, target, TRAIN_ROWS).dropDuplicates(["text", "label"]).select("text", "label", "half"))
    by_half: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in sample.groupBy("half", "label").count().collect():
        by_half[r["half"]][r["label"]] = r["count"]
    whole = {x: sum(h.get(x, 0) for h in by_half.values()) for x in (0, 1)}
    if not all(whole.values()):
        return fallback()
    counted = stored(sample.mapInArrow(_count, "entry string, half int, toxic long, clean long").groupBy("entry", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    lexicon = _chosen(counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), whole)
    if not all(len(h) == 2 for h in by_half.values()):
        return lexicon
    other = {half: _chosen(counted.where(F.col("half") == 1 - half), by_half[1 - half]) for half in (0, 1)}

    def measure(batches):
        for batch in batches:
            texts, labels, halves = (c.to_pylist() for c in batch.columns)
            x = np.array([other[h].features([t])[0] for t, h in zip(texts, halves, strict=True)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 2]), pa.array(x[:, 3]), pa.array(labels, pa.int32())], ["total", "density", "label"])

    got = sample.mapInArrow(measure, "total double, density double, label int").toPandas().sort_values(["label", "total", "density"])
    lexicon.coefficients = _fit(np.column_stack([np.ones(len(got)), got["total"] > 0, got["total"], got["density"]]), got["label"].to_numpy(float))
    return lexicon


def score_toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_ENTRIES entries

    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(rows.column(1).to_pylist()))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(documents, train(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
