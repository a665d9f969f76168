"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams.

Rules settle what they fit; the longest wins. Any other url is scored by a logistic regression over the hashed n-grams
(3 to 5 characters, with edge marks) of its host and, apart from those, of its path, trained at call time from a small
labelled table of urls, whose names are made by rule from general words. Scores of ``THRESHOLD`` and above block.

Defined cases: a null url, or one without ``://``, has an empty host and path and no n-grams, so the regression's
intercept, below 0.5, allows it. Only A-Z is lowered in hosts; ports and user names stay part of the host. Repeated
rows are judged alike, each by itself; an empty table works; page_id is read as a long; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, read, slices

BITS = 16
GRAMS = (3, 4, 5)
THRESHOLD = 0.7  # scores from here on block: a page wrongly blocked is lost
STEPS, RATE, PENALTY = 1000, 8.0, 2e-5

#: (host, path start, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The labelled url table is made of these words of either kind, by `labelled_urls`.
BLOCKED_WORDS = (
    "spam", "cheap", "pills", "casino", "poker", "lottery", "jackpot", "bets", "betting", "free", "prize", "winner", "viagra", "meds", "pharma", "payday", "loans", "replica", "fake", "clickbait",
    "adult", "xxx", "porn", "cams", "dating", "singles", "torrent", "warez", "crack", "keygen", "phishing", "malware", "ads", "adserver", "tracker", "pixel", "popup", "seo", "backlinks", "doubler",
)
ALLOWED_WORDS = (
    "news", "library", "university", "docs", "blog", "wiki", "museum", "weather", "science", "history", "cooking", "garden", "travel", "music", "forum", "health", "school", "journal", "archive", "python",
    "maps", "recipes", "photos", "research", "letters", "theatre", "parliament", "hospital", "railway", "orchestra", "stories", "notes", "city", "open", "river", "mountain", "study", "data", "field", "book",
)
_BLOCKED_PATHS = ("/buy-now", "/win/free-prize", "/cheap/viagra", "/casino/bonus", "/xxx/")
_ALLOWED_PATHS = ("/", "/en/104", "/de/77.html", "/fr/archive/2021/", "/article/how-to-read", "/es/about", "/2019/05/notes.html", "/index.html")
_BEGINNINGS = ("", "www.", "m.", "blog.")
_ENDINGS = (".example.org", ".example.net", ".example.com", ".org", ".net", ".com", ".info", ".de")


def names_of(words: tuple[str, ...]) -> list[str]:
    """Each word alone, and with two others, joined by a hyphen and without."""
    n = len(words)
    return [name for i, w in enumerate(words) for name in (w, f"{w}-{words[(7 * i + 3) % n]}", f"{w}{words[(11 * i + 5) % n]}")]


def invented_names(n: int) -> list[str]:
    """Names of two to four syllables that say nothing, as many ordinary hosts have."""
    rng = random.Random(8)
    begins, middles, ends = "b c d f g h j k l m n p r s t v w z br ch cl dr fl gr pl sh st th tr".split(), "a e i o u ai ea ou".split(), ["", "n", "r", "s", "t", "l", "nd", "ng", "st"]
    return ["".join(rng.choice(begins) + rng.choice(middles) + rng.choice(ends) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): every name with some beginnings, endings and paths, and ordinary hosts with blocked paths."""
    out = []
    for label, names in ((1, names_of(BLOCKED_WORDS)), (0, names_of(ALLOWED_WORDS) + invented_names(120))):
        for i, name in enumerate(names):
            for k, begin in enumerate(_BEGINNINGS):
                out.append((begin + name + _ENDINGS[(i + 3 * k) % len(_ENDINGS)], _ALLOWED_PATHS[(i // 3 + 5 * k) % len(_ALLOWED_PATHS)], label))
    for i, path in enumerate(_BLOCKED_PATHS):
        out.append((ALLOWED_WORDS[i] + _ENDINGS[i], path, 1))
    return out


def _gram_rows(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the n-grams of ``^text$``; an empty text has none."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    full = sizes > 0
    padded = np.full(len(data) + 2 * n, 36, np.int64)  # $
    begin = offsets[:-1] + 2 * np.arange(n)
    padded[begin] = 94  # ^
    inner = np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1
    padded[inner] = data
    row = np.repeat(np.arange(n), sizes + 2)
    rows, places = [], []
    for g in GRAMS:
        if len(padded) < g:
            continue
        code = np.full(len(padded) - g + 1, 1000 * salt + g, np.uint64)
        for k in range(g):
            code = code * np.uint64(257) + padded[k : len(code) + k].astype(np.uint64)
        whole = (row[: len(code)] == row[g - 1 :]) & full[row[: len(code)]]
        rows.append(row[: len(code)][whole])
        places.append((mix(code[whole]) & np.uint64((1 << BITS) - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(places)


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def features(hosts: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value): each part's n-grams weigh one together, by the root of their number."""
    out = []
    for salt, (data, offsets) in enumerate((hosts, paths)):
        row, place = _gram_rows(data, offsets, salt)
        n = np.bincount(row, minlength=len(offsets) - 1)
        out.append((row, place, 1 / np.sqrt(n[row])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class UrlModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    @staticmethod
    def train(urls: list[tuple[str, str, int]]) -> UrlModel:
        row, place, value = features(_column([u[0] for u in urls]), _column([u[1] for u in urls]))
        y = np.array([u[2] for u in urls], float)
        weights, intercept = np.zeros(1 << BITS), 0.0
        for _ in range(STEPS):
            z = np.bincount(row, weights[place] * value, len(y)) + intercept
            error = (1 / (1 + np.exp(-z)) - y) / len(y)
            weights -= RATE * (np.bincount(place, error[row] * value, 1 << BITS) + PENALTY * weights)
            intercept -= RATE * error.sum()
        return UrlModel(weights, min(intercept, -1e-6))

    def scores(self, hosts: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        row, place, value = features(hosts, paths)
        z = np.bincount(row, self.weights[place] * value, len(hosts[1]) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@lru_cache(1)
def default_model() -> UrlModel:
    return UrlModel.train(labelled_urls())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for of, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules=RULES) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score (the regression's, of every url)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # 2^BITS weights
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "host"):
                paths = next(slices(rows, "path", 1 << 62))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.scores((data, offsets), paths[1:]))], ["page_id", "host", "path", "score"])

    scored = parts.mapInArrow(run, "page_id long, host string, path string, score double").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")


def query(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
