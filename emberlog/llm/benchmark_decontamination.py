"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``WINDOW`` consecutive words of the benchmark's items (all words of an item that has
fewer). Texts and patterns are sequences of 64-bit word hashes; a block is ``BLOCK`` (or one) adjacent words. For the
patterns of one length m, the shift table gives for a hashed block the least distance from it to the end of any
pattern: a text position whose block is in no pattern is passed by m - BLOCK + 1 words at once. Where the shift is
zero, the bucket of that block's hash gives the patterns that end so; their first words are compared, then all their
words, by hash, and what is left is compared letter by letter. All texts of a slice are searched in step, each cursor
by its own shifts, so that NumPy does the scanning.

The patterns are sent to the executors in parts of at most ``PART_BYTES`` of item text. A benchmark larger than that
makes several passes, each of which adds its hits to those before it.

Defined cases: null and wordless texts have no words and no hits; wordless items have no window. Items that share an
item_id count as one. A null item_id counts under no name (its windows still hit). Repeated document rows are judged
each by itself. Empty tables work; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_LOWER, SQL_UPPER, mix, read, release, slices, stored, text_bytes, word_hashes, words_of

WINDOW = 10
BLOCK = 2
PART_BYTES = 16 << 20
STRIDE = 512  # text words of one cursor
_LEAST_BITS, _MOST_BITS = 12, 22  # of a table; it has 16 places for each pattern between these

_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[97:123] = True
_is_word[128:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_ADDED = ["n_words", "n_hit", "n_items", "items", "spans"]
_STATE = pa.struct([("hit", pa.binary()), ("items", pa.list_(pa.string()))])
_STATE_TYPE = "struct<hit: binary, items: array<string>>"
_FOUND = pa.struct([*((c, pa.int64()) for c in _ADDED[:3]), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_FOUND_TYPE = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"


@dataclass
class Text:
    """Words of some texts: hashes, their bytes, and the n + 1 offsets of the texts in them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Text:
        data = _lower[data]
        starts, ends, bounds = words_of(data, offsets, _is_word)
        return Text(data, starts, ends, word_hashes(data, starts, ends), bounds)

    def words(self, at: int, n: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)]


def _blocks(hashes: np.ndarray, ends: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The place in a table of 2^bits of the block of ``size`` words that ends at each of ``ends``."""
    h = hashes[ends]
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[ends - k]
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


class WuManber:
    """All patterns of one length m, as positions in a `Text` of the benchmark."""

    def __init__(self, source: Text, first: np.ndarray, m: int):
        self.source, self.m, self.size = source, m, min(BLOCK, m)
        self.bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * len(first)).bit_length()))
        order = np.argsort(_blocks(source.hashes, first + m - 1, self.size, self.bits), kind="stable")
        self.first = first[order]
        self.default = m - self.size + 1
        self.shift = np.full(1 << self.bits, self.default, np.int32)
        for end in range(self.size - 1, m):
            np.minimum.at(self.shift, _blocks(source.hashes, first + end, self.size, self.bits), m - 1 - end)
        self.buckets = np.searchsorted(_blocks(source.hashes, self.first + m - 1, self.size, self.bits), np.arange((1 << self.bits) + 1))

    def find(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(word position in the text, word position in the source) of every occurrence."""
        n_words = np.diff(text.bounds)
        long = np.flatnonzero(n_words >= self.m)
        ends_of = n_words[long] - self.m + 1  # window ends of each text
        pieces = -(-ends_of // STRIDE)
        of = np.repeat(np.arange(len(long)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = text.bounds[long][of] + self.m - 1 + k * STRIDE
        stop = np.minimum(at + STRIDE, text.bounds[long + 1][of])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            place = _blocks(text.hashes, at, self.size, self.bits)
            shift = self.shift[place]
            if len(hit := np.flatnonzero(shift == 0)):
                found.append(self._compare(text, at[hit], place[hit]))
            at = at + np.maximum(shift, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(where):
            return where, what
        # letters: each different (text words, pattern) pair of equal hashes is looked at once
        _, one = np.unique(what, return_index=True)
        same = {int(what[i]): self.source.words(int(what[i]), self.m) for i in one}
        good = np.fromiter((text.words(int(w), self.m) == same[int(p)] for w, p in zip(where, what, strict=True)), bool, len(where))
        return where[good], what[good]

    def _compare(self, text: Text, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.buckets[place], self.buckets[place + 1]
        n = high - low
        where = np.repeat(ends - self.m + 1, n)
        what = self.first[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for k in range(self.m):  # the prefix first, which settles most
            same = text.hashes[where + k] == self.source.hashes[what + k]
            where, what = where[same], what[same]
        return where, what


class Benchmark:
    """The patterns of some items."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.item_ids = item_ids
        self.source = Text.of(*text_bytes(pa.array(texts, pa.string())))
        n = np.diff(self.source.bounds)
        self.item_of = np.repeat(np.arange(len(n)), n)
        windows: dict[int, list[np.ndarray]] = {}
        for i, words in enumerate(n):
            if words:
                m = min(window, int(words))
                windows.setdefault(m, []).append(self.source.bounds[i] + np.arange(words - m + 1))
        self.searches = [WuManber(self.source, np.concatenate(x), m) for m, x in sorted(windows.items())]

    def search(self, text: Text) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit; for each text the items that occur."""
        rows = len(text.bounds) - 1
        edge = np.zeros(len(text.hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(rows)]
        for search in self.searches:
            where, what = search.find(text)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + search.m, -1)
            row = np.searchsorted(text.bounds, where, "right") - 1
            for r, i in np.unique(np.stack([row, self.item_of[what]]), axis=1).T:
                if self.item_ids[i] is not None:
                    items[r].add(self.item_ids[i])
        return np.cumsum(edge)[:-1] > 0, items


def _parts(benchmark: DataFrame, most: int):
    """The benchmark's items in parts of at most ``most`` bytes of text (or one item), one part at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if texts and held + len(row[1]) > most:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    if texts:
        yield ids, texts


def _finished(text: Text, offsets: np.ndarray, bits: list[bytes], items: list[list[str]]) -> pa.Array:
    """The result's struct from the packed hit words and the items of each text."""
    n_words, n_hit, spans = np.diff(text.bounds), [], []
    for r, packed in enumerate(bits):
        hit = np.unpackbits(np.frombuffer(packed, np.uint8), count=n_words[r])
        n_hit.append(int(hit.sum()))
        if not n_hit[-1]:
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
        a, b = text.starts[text.bounds[r] + edge[::2]] - offsets[r], text.ends[text.bounds[r] + edge[1::2] - 1] - offsets[r]
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
    return pa.StructArray.from_arrays([pa.array(n_words.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _FOUND.field("spans").type)], fields=list(_FOUND))


def _searching(shared, last: bool):
    """A column function of (text, state before): the state, or with the last part the result."""

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = _FOUND if last else _STATE
        for texts, states in parts:
            out = [pa.array([], kind)]
            for rows, data, offsets in slices(pa.record_batch([texts, states], ["text", "state"])):
                text = Text.of(data, offsets)
                hit, items = shared.value.search(text)
                bits = [np.packbits(hit[a:b]) for a, b in zip(text.bounds[:-1], text.bounds[1:], strict=True)]
                for r, old in enumerate(rows.column(1).to_pylist()):
                    if old:
                        bits[r], items[r] = bits[r] | np.frombuffer(old["hit"], np.uint8), items[r] | set(old["items"])
                bits, names = [x.tobytes() for x in bits], [sorted(x) for x in items]
                out.append(_finished(text, offsets, bits, names) if last else pa.StructArray.from_arrays([pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], fields=list(_STATE)))
            yield pa.concat_arrays(out)

    return F.arrow_udf(run, _FOUND_TYPE if last else _STATE_TYPE).asNondeterministic()


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents' columns and n_words, n_hit, n_items long, items array<string> (sorted), spans array<struct<start, end>>:
    the hit words as byte ranges of the UTF-8 text, joined where they touch. Only texts go to Python, the rest comes back.

    Between parts the documents and their hits so far are written out, and the part's tables are dropped."""
    context = documents.sparkSession.sparkContext
    own = {c: c if c == "text" else f"__c{i}" for i, c in enumerate(c for c in documents.columns if c not in _ADDED)}  # no name of ours can clash
    out = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()], F.lit(None).cast(_STATE_TYPE).alias("__state"))
    held = None
    for part in _parts(benchmark, part_bytes):
        if held is not None:
            done = stored(out.withColumn("__state", _searching(held, False)("text", "__state")))
            held.destroy()
            release(out)
            out = done
        held = context.broadcast(Benchmark(*part, window))  # of at most part_bytes of item text
    if held is None:
        held = context.broadcast(Benchmark([], [], window))
    out = out.withColumn("__found", _searching(held, True)("text", "__state"))
    return out.select(*[F.col(x).alias(c) for c, x in own.items()], *[F.col(f"__found.{c}").alias(c) for c in _ADDED])


def _words_sql(table: str, key: str) -> str:
    return rf"SELECT {key}, coalesce(regexp_extract_all(translate(text, '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {table}"


#: Every window of every text, joined as strings.
SQL = f"""
WITH ite AS ({_words_sql("benchmark", "item_id")}), doc AS ({_words_sql("documents", "doc_id")}),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM (SELECT *, least({WINDOW}, len(w)) AS m FROM ite WHERE len(w) > 0))),
siz AS (SELECT DISTINCT m FROM win),
gra AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM doc, siz WHERE len(w) >= m)),
hit AS (SELECT doc_id, g.m, k, item_id FROM gra g JOIN win USING (m, s)),
wor AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT doc_id, m, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(wor.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(wor.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN wor USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def query(spark, sf_dir):
    found = benchmark_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
