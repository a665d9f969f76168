"""Packing documents into training sequences by non-negative least squares on the histogram of lengths.

A document is its token ids and an end id. Whole windows are cut off long documents; what remains of each document, a
rest of 1 to ``window - 1`` tokens, is packed with others:

1. the lengths' histogram (at most ``window - 1`` bins) is gathered, and the combinations of two or three lengths that
   fill a window exactly are enumerated; ``COLUMNS`` of them are drawn, more of frequent lengths;
2. non-negative least squares gives how often each combination should be used; the counts are rounded, cut where that
   would overdraw a bin, and what they leave is solved again with others, until no combination is used any more;
3. what is left is packed greedily, the longest that fits first; a gap that nothing fits is filled with the first
   tokens of a longer rest, whose other part goes back to the stock;
4. the last tokens, less than a window, become sequences of a power of two each, which need no padding.

The plan names ranges of documents by length and running number, not documents, so its size depends on the window
only; numbers are dealt by (task, length) counts, and no group of rows meets in one task.

Defined cases: a null or empty text is its end id alone. Repeated rows and doc_ids are packed as often as they occur;
a null doc_id is kept; doc_id is read as a long. An empty table gives no pieces. Long texts are cut; no token is dropped. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, slices, stored
from .token_ids import encoder

WINDOW = 2048
END_ID = 1
COLUMNS = 8192  # combinations that are solved for at once; each is three ranges of the plan
SWEEPS, CLOSE = 150, 1e-3
MOST_BROADCAST = 500_000  # plan rows of 64 bytes that are sent to every task; a longer plan is joined by length

_PLAN = ["length", "part_start", "part_length", "low", "high", "sequence", "offset"]


def combinations(histogram: np.ndarray, window: int, most: int | None = None, seed: int = 0) -> np.ndarray:
    """Rows a <= b <= c of lengths that fill the window exactly and of which there are documents enough: all pairs (a is 0)
    and triples, at most window^2 / 12 of them; of more than ``most``, so many drawn by their rarest length's count."""
    have = np.zeros(max(window, len(histogram)), np.int64)
    have[1 : len(histogram)] = histogram[1:]
    present = np.flatnonzero(have)
    out = [np.zeros((0, 3), np.int64)]
    for a in [0, *present[present <= window // 3]]:
        b = present[(present >= a) & (2 * present <= window - a)]
        c = window - a - b
        b, c = b[have[c] > 0], c[have[c] > 0]
        enough = (have[b] >= 1 + (b == a)) & (have[c] >= 1 + (c == b) + ((c == b) & (b == a)))
        out.append(np.stack([np.full(enough.sum(), a), b[enough], c[enough]], axis=1))
    rows = np.concatenate(out)
    if most is None or len(rows) <= most:
        return rows
    have[0] = have.max()
    wait = np.random.default_rng(seed).exponential(size=len(rows)) / have[rows].min(axis=1)
    return rows[np.sort(np.argpartition(wait, most)[:most])]


def solve_counts(histogram: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """min |A x - h| over x >= 0, where column c of A counts the lengths of combination c: accelerated projected gradient,
    until the gradient that could still be followed is ``CLOSE`` of what it was at first."""
    if not len(columns):
        return np.zeros(0)
    goal = histogram.astype(float)
    goal[0] = 0
    m = len(goal)

    def at(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], weights=x, minlength=m) for k in range(3))
        out[0] = 0  # of pairs
        return out

    back = lambda y: y[columns[:, 0]] + y[columns[:, 1]] + y[columns[:, 2]]
    v = np.ones(len(columns))
    for _ in range(20):
        v = back(at(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(at(v))))
    x = y = np.zeros(len(columns))
    t, first = 1.0, None
    for _ in range(SWEEPS):
        slope = back(at(y) - goal)
        new = np.maximum(0, y - step * slope)
        moved = np.linalg.norm(new - y)
        first = first or moved
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.sum((y - new) * (new - x)) > 0:  # overshot: momentum starts anew
            s = 1.0
            y = new
        else:
            y = new + (t - 1) / s * (new - x)
        x, t = new, s
        if moved <= CLOSE * first:
            break
    return x


def round_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts, the largest first, with their columns: each is rounded together with what earlier ones left over, so
    that the sum is right to one half, however thinly the solution is spread."""
    order = np.argsort(-x, kind="stable")
    counts = np.diff(np.concatenate([[0], np.floor(np.cumsum(x[order]) + 0.5)])).astype(np.int64)
    return order[counts > 0], counts[counts > 0]


class Stock:
    """Rests to be packed: by length, ranges [low, high) of running numbers of (document rest length, start in it)."""

    def __init__(self, histogram: np.ndarray):
        self.ranges = {int(x): [(int(x), 0, 0, int(histogram[x]))] for x in np.flatnonzero(histogram)}
        self.counts = {x: r[0][3] for x, r in self.ranges.items()}
        self.lengths = sorted(self.counts)
        self.tokens = sum(x * n for x, n in self.counts.items())
        self.plan: list[tuple[int, ...]] = []
        self.sequences = 0

    def _take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.counts[length] -= n
        self.tokens -= length * n
        while n:
            of, start, low, high = self.ranges[length].pop()
            used = min(n, high - low)
            out.append((of, start, low, low + used))
            if used < high - low:
                self.ranges[length].append((of, start, low + used, high))
            n -= used
        if not self.counts[length]:
            del self.counts[length], self.ranges[length]
            self.lengths.remove(length)
        return out

    def _give(self, length: int, piece: tuple[int, int, int, int]) -> None:
        if length not in self.counts:
            self.counts[length], self.ranges[length] = 0, []
            insort(self.lengths, length)
        n = piece[3] - piece[2]
        self.counts[length] += n
        self.ranges[length].append(piece)
        self.tokens += length * n

    def emit(self, lengths: list[int], times: int, cut: tuple[int, int] | None = None) -> None:
        """``times`` sequences of these lengths; cut: (length to cut, tokens of it) fills the rest of each."""
        offset = 0
        for length in lengths:
            at = self.sequences
            for of, start, low, high in self._take(length, times):
                self.plan.append((of, start, length, low, high, at, offset))
                at += high - low
            offset += length
        if cut:
            length, used = cut
            at = self.sequences
            for of, start, low, high in self._take(length, times):
                self.plan.append((of, start, used, low, high, at, offset))
                self._give(length - used, (of, start + used, low, high))
                at += high - low
        self.sequences += times

    def greedy(self, window: int) -> None:
        while self.tokens >= window:
            used: dict[int, int] = {}
            left, chosen = window, []
            while left:
                k = bisect_right(self.lengths, left)
                while k and self.counts[self.lengths[k - 1]] <= used.get(self.lengths[k - 1], 0):
                    k -= 1
                if not k:
                    break
                x = self.lengths[k - 1]
                n = min(left // x, self.counts[x] - used.get(x, 0))
                used[x] = used.get(x, 0) + n
                chosen += [x] * n
                left -= x * n
            cut = None
            if left:  # nothing fits: the longest rest that is to be had is cut
                longest = next(x for x in reversed(self.lengths) if self.counts[x] > used.get(x, 0))
                used[longest] = used.get(longest, 0) + 1
                cut = (longest, left)
            self.emit(chosen, min(self.counts[x] // n for x, n in used.items()), cut)

    def tail(self) -> None:
        """Less than a window is left: sequences of powers of two, no padding."""
        left = self.tokens
        for bit in reversed(range(left.bit_length())):
            if not left >> bit & 1:
                continue
            room, offset = 1 << bit, 0
            while room:
                x = self.lengths[-1]
                (of, start, low, high), = self._take(x, 1)
                n = min(x, room)
                self.plan.append((of, start, n, low, high, self.sequences, offset))
                if n < x:
                    self._give(x - n, (of, start + n, low, high))
                room, offset = room - n, offset + n
            self.sequences += 1


def plan_rests(histogram: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """Plan rows: documents number low..high-1 of a rest length lay part_start.. of part_length tokens at ``offset`` of sequences from ``sequence`` on."""
    stock = Stock(histogram)
    made, rounds = True, 0
    while made:  # what rounding leaves is a histogram again
        made, rounds = False, rounds + 1
        left = np.zeros(len(histogram), np.int64)
        left[list(stock.counts)] = list(stock.counts.values())
        columns = combinations(left, window, COLUMNS, rounds)
        for c, count in zip(*round_counts(solve_counts(left, columns)), strict=True):
            lengths = [int(x) for x in columns[c] if x]
            times = min(int(count), *(stock.counts.get(x, 0) // lengths.count(x) for x in lengths))
            if times > 0:
                stock.emit(lengths, times)
                made = True
    solved = stock.sequences
    stock.greedy(window)
    full = stock.sequences
    stock.tail()
    plan = pd.DataFrame(stock.plan, columns=_PLAN).astype("int64")
    plan.attrs |= {"solved": solved, "full": full}  # sequences that least squares filled, and all full ones
    size = plan.groupby("sequence")["part_length"].transform("sum")
    return plan.assign(padded_to=np.where(plan["sequence"] < full, window, size).astype("int64"))


def _tokenised(documents: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Each document's token count, CRCs of its whole windows, the ids of its rest, and running numbers within its task."""

    def run(batches):
        encode = encoder(tokenizer).encode
        task, seen, windows = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            for rows, _, _ in slices(batch, most=4 << 20):
                n_tokens, crcs, rests, number, before = [], [], [], [], []
                for ids in encode(rows.column(1).to_pylist()):
                    raw = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    whole, rest = divmod(len(raw), window)
                    n_tokens.append(len(raw))
                    crcs.append([zlib.crc32(raw[k * window : (k + 1) * window].tobytes()) for k in range(whole)])
                    rests.append(raw[whole * window :].tobytes())
                    number.append(int(seen[rest]))
                    before.append(windows)
                    seen[rest] += 1
                    windows += whole
                n = len(n_tokens)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([task] * n, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x % window for x in n_tokens], pa.int64()), pa.array(number, pa.int64()), pa.array(before, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], ["doc_id", "task", "doc_tokens", "rest", "number", "before", "crcs", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, task long, doc_tokens long, rest long, number long, before long, crcs array<long>, ids binary")


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to."""
    spark = documents.sparkSession
    tokens = stored(_tokenised(documents, tokenizer, window))
    cells = stored(tokens.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("windows")))
    histogram = np.zeros(window, np.int64)
    for row in cells.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["rest"]] = row["n"]
    histogram[0] = 0
    tasks = cells.groupBy("task").agg(F.sum("windows").alias("windows")).orderBy("task").toPandas()  # a row for each task that read documents
    first = np.concatenate([[0], np.cumsum(tasks["windows"].to_numpy(np.int64))])
    plan = plan_rests(histogram, window)
    starts = spark.createDataFrame(pd.DataFrame({"task": tasks["task"].astype("int64"), "task_windows": first[:-1]}), "task long, task_windows long")
    numbered = cells.withColumn("base", F.sum("n").over(Window.partitionBy("rest").orderBy("task")) - F.col("n")).join(starts, "task").select("task", "rest", "base", "task_windows")
    placed = tokens.join(numbered, ["task", "rest"]).withColumn("number", F.col("number") + F.col("base")).withColumn("before", F.col("before") + F.col("task_windows"))
    whole = placed.select("doc_id", "doc_tokens", "before", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("padded_to")
    )
    plans = spark.createDataFrame(plan, ", ".join(f"{c} long" for c in [*_PLAN, "padded_to"])).withColumnRenamed("length", "plan_length")
    fits = (F.col("rest") == F.col("plan_length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    rests = placed.where("rest > 0").join(F.broadcast(plans) if len(plan) <= MOST_BROADCAST else plans, fits)
    rests = rests.select(
        "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("part_start")).alias("start"), F.col("part_length").alias("length"),
        F.crc32(F.expr("substring(ids, cast(4 * part_start + 1 as int), cast(4 * part_length as int))")).alias("ids_crc32"), "doc_tokens",
        (F.col("sequence") + F.col("number") - F.col("low") + int(first[-1])).alias("sequence_id"), "offset", "padded_to",
    )
    return whole.union(rests)


def query(spark, sf_dir, tokenizer: str | None = None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(read(spark, sf_dir, "documents"), tokenizer)
