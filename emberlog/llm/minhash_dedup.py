"""Near-duplicate documents: MinHash bands propose pairs, odd sketches judge them, full shingle sets confirm them.

Every document becomes the set of its distinct five-word shingles (64-bit hashes; one for all words if there are
fewer). Documents of equal sets are one node from here on. A node has ``BANDS`` x ``ROWS`` MinHash samples: the bands
are bucket keys, and all samples are folded into an odd sketch, a bitmap in which each (position, sample) flips one
bit, so that the XOR of two sketches keeps the samples in which they differ and its population count estimates the
similarity. Links are confirmed in two passes, so that a bucket never becomes all its pairs:

1. each node of a bucket is held against the bucket's leader (its node of the smallest hash); confirmed links give
   components, in which a group of copies is one component already;
2. where the buckets of one leader still hold several components, their nodes are compared by sketch, and by their full
   sets where sketches are near enough, inside the task where they meet. A pair inside one component can't change the
   result and isn't looked at; over ``MEETING`` nodes are compared block by block in tasks of their own.

A row of a bucket carries one bit of each of 64 samples; nodes that differ from their leader in over ``MOST_BITS`` of them,
which four standard deviations put below the threshold, aren't held against it in the first pass.

The chance that bands miss a pair of similarity 0.75 is (1 - 0.75^ROWS)^BANDS, about 2e-5; the sketch's bound is more
than four standard deviations below the threshold. Nothing is capped: every pair that bands propose is judged.

Defined cases: a null or wordless text has an empty set and links with nothing; its component is its own doc_id. Rows
that repeat a doc_id are documents of their own under that id. A null doc_id has a null component and ``kept`` false
unless linked with an id, and doesn't count as the smallest id of its group; its links count as any. doc_id is read
as a long. Very long texts are read in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_LOWER, SQL_UPPER, components_sql, groups, mix, read, slices, stored, swept, word_hashes, words_of
from .components import connected_components

WIDTH = 5  # words of a shingle
NUM, DEN = 75, 100  # documents link at NUM / DEN similarity and above
ROWS, BANDS = 5, 40
SKETCH_WORDS = 8  # 64-bit words of an odd sketch
MOST_BITS = 18  # of the 64 bits that a bucket's rows carry may differ; at similarity 0.75 it is 8 +- 2.6
MEMBERS = 256  # of a leader that are held against it together
MEETING, MOST_SHINGLES = 1024, 1 << 20  # nodes of a block, and shingles of their sets
LEAST_ESTIMATE = 0.60  # sketches estimating less than this aren't confirmed

_is_word = np.ones(256, bool)
_is_word[[32, *range(9, 14)]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_random = np.random.default_rng(9)
_A = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_BAND = np.random.default_rng(10).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_COEFFICIENTS = np.random.default_rng(11).integers(0, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BLOCK = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending within a row, and the n + 1 offsets of the rows."""
    data = _lower[data]
    starts, ends, bounds = words_of(data, offsets, _is_word)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(bounds)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    out, of = [], []
    if len(hashes) >= WIDTH:
        n = len(hashes) - WIDTH + 1
        sums = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            sums += hashes[k : n + k] * _COEFFICIENTS[k]
        whole = rows[:n] == rows[WIDTH - 1 :]
        out.append(mix(sums[whole]))
        of.append(rows[:n][whole])
    for row in np.flatnonzero((n_words > 0) & (n_words < WIDTH)):
        few = hashes[bounds[row] : bounds[row + 1]]
        out.append(mix(np.array([np.sum(few * _COEFFICIENTS[: len(few)], dtype=np.uint64) ^ np.uint64(len(few))])))
        of.append(np.array([row]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sums, of = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((sums, of))
    sums, of = sums[order], of[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (of[1:] != of[:-1])
    sums, of = sums[new], of[new]
    return sums, np.searchsorted(of, np.arange(len(offsets)))


def min_hashes(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x (ROWS * BANDS) MinHash samples; an empty set has the largest value everywhere."""
    n = len(bounds) - 1
    out = np.full((n, len(_A)), 0xFFFFFFFF, np.uint32)
    low = (sums >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), _BLOCK):
        b = min(a + _BLOCK, len(low))
        values = low[a:b, None] * _A
        values += _B
        first = int(np.searchsorted(bounds, a, "right")) - 1
        last = int(np.searchsorted(bounds, b, "left"))
        cuts = np.maximum(bounds[first:last], a) - a
        full = np.diff(np.append(cuts, b - a)) > 0
        least = np.minimum.reduceat(values, cuts[full], axis=0)
        at = np.arange(first, last)[full]
        out[at] = np.minimum(out[at], least)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for k in range(ROWS):
        keys += mix(parts[:, :, k]) * _BAND[:, k]
    return mix(keys ^ np.arange(BANDS, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: bit j is the parity of the number of (position, sample) pairs that hash to j."""
    n, k = samples.shape
    size = 64 * SKETCH_WORDS
    at = (mix((samples.astype(np.uint64) << np.uint64(12)) | np.arange(k, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * size + at).ravel(), minlength=n * size).reshape(n, size)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.uint64)


def brief_bits(samples: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 samples."""
    bits = (mix(samples[:, :64].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def set_digests(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    if len(sums):
        out[n > 0] = np.add.reduceat(mix(sums ^ np.uint64(0xA0761D6478BD642F)), bounds[:-1][n > 0])
    return mix(out + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _signatures(batches):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            sums, bounds = shingle_sets(data, offsets)
            samples = min_hashes(sums, bounds)
            n = np.diff(bounds)
            keys, sketches = band_keys(samples), odd_sketches(samples)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64))) for x in (keys, sketches)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(set_digests(sums, bounds).view(np.int64)), pa.array(brief_bits(samples).view(np.int64)), *lists], ["doc_id", "text_key", "n", "node", "bits", "bands", "sketch"])


def _sets(batches):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            sums, bounds = shingle_sets(data, offsets)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sums.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_digests(sums, bounds).view(np.int64)), sets], ["node", "shingles"])


def estimate(a: str, b: str):
    """The similarity that two odd sketches estimate; 0 once the bitmap is saturated."""
    size, samples = 64 * SKETCH_WORDS, ROWS * BANDS
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    left = F.greatest(F.lit(1.0 / size), 1 - 2.0 * differ / size)
    return 1 + F.log(left) * (size / (4.0 * samples))


def _near(a: str, b: str):
    return (F.col(f"{a}_n") * DEN >= F.col(f"{b}_n") * NUM) & (F.col(f"{b}_n") * DEN >= F.col(f"{a}_n") * NUM) & (estimate(f"{a}_sketch", f"{b}_sketch") >= LEAST_ESTIMATE)


def _sets_of(wanted: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the document that stands for each."""
    ids = wanted.join(nodes.select("node", "doc_id", "text_key"), "node").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__of")).distinct()
    texts = documents.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__of")), "left_semi").select("doc_id", "text")
    return stored(texts.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """The (a, b) pairs whose full shingle sets are similar enough. The members b of a leader a are dealt out to groups of
    about ``MEMBERS``, each of which gets the leader's set once, however many members there are."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, documents)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    dealt = pairs.join(stored(salts), "a").withColumn("salt", F.pmod(F.xxhash64("b", F.lit(5)), F.col("salts")).cast("int"))
    members = dealt.select("a", "salt", F.col("b").alias("node")).join(sets, "node").select("a", "salt", F.lit(1).alias("place"), "node", "shingles")
    leaders = dealt.select("a", "salt").distinct().withColumn("node", F.col("a")).join(sets, "node").select("a", "salt", F.lit(0).alias("place"), "node", "shingles")
    met = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "place")
    return met.mapInArrow(_like_their_leader, "a long, b long")


def _like_their_leader(batches):
    """Of rows by (a, salt), the leader's first: (a, b) of the members that are similar enough. A group is never held."""
    of, lead = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, place, node = (batch.column(k).to_numpy() for k in range(4))
        lists = batch.column(4)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1), len(a)]
        out = [np.zeros((2, 0), np.int64)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            if place[low] == 0:
                of, lead = (a[low], salt[low]), values[offsets[low] : offsets[low + 1]].copy()
                low += 1
            if low == high or of != (a[low], salt[low]):
                continue
            own = values[offsets[low] : offsets[high]]
            same = lead[np.minimum(np.searchsorted(lead, own), len(lead) - 1)] == own
            common = np.add.reduceat(same.astype(np.int64), offsets[low:high] - offsets[low])
            n = np.diff(offsets[low : high + 1])
            ok = DEN * common >= NUM * (len(lead) + n - common)
            out.append(np.stack([a[low:high][ok], node[low:high][ok]]))
        found = np.concatenate(out, axis=1)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _links_across(shared: DataFrame, components: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between different components among the nodes that share buckets of one leader: compared by sketch where they meet, and where those are near
    enough, by their full sets. Tasks hand on nodes and links that join components, never pairs.

    The leader's largest component is the main one; blocks of the rest meet each other and those of the main one, which
    don't meet among themselves. A block has about ``MEETING`` nodes or ``MOST_SHINGLES``, whichever is less."""
    placed = shared.select(F.col("a").alias("leader"), F.col("b").alias("node")).distinct().join(components, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("component"))
    placed = placed.join(nodes.select("node", "n", "sketch"), "node")
    parts = placed.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    blocks = lambda size, shingles: F.ceil(F.greatest(size / MEETING, shingles / MOST_SHINGLES)).cast("int")
    mixed = parts.groupBy("leader").agg(F.max(F.struct("size", "component", "shingles")).alias("main"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles")).where("main.size < size")
    mixed = stored(mixed.select("leader", F.col("main.component").alias("main"), blocks(F.col("main.size"), F.col("main.shingles")).alias("main_blocks"), blocks(F.col("size") - F.col("main.size"), F.col("shingles") - F.col("main.shingles")).alias("blocks")))
    met = placed.join(mixed, "leader")
    in_main, hashed = F.col("component") == F.col("main"), F.xxhash64("node", F.lit(3))
    met = met.withColumn("own", F.when(in_main, F.col("blocks") + F.pmod(hashed, F.col("main_blocks"))).otherwise(F.pmod(hashed, F.col("blocks"))).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1 + F.when(in_main, 0).otherwise(F.col("main_blocks")))))
    task = F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(task.alias("task"), "node", "component", "n", "sketch", (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("same"))
    near = stored(met.repartition("task").sortWithinPartitions("task").mapInArrow(_near_nodes, met.schema))
    sets = _sets_of(near.select("node").distinct(), nodes, documents)
    with_sets = near.join(sets, "node")
    return stored(with_sets.repartition("task").sortWithinPartitions("task").mapInArrow(_joining_links, "a long, b long")).distinct()


class _Meeting:
    """The nodes of a task's group, and which pairs of them are to be looked at."""

    def __init__(self, group: pa.Table):
        get = lambda c: group.column(c).to_numpy()
        self.node, self.component, self.n, self.side, self.same = get("node"), get("component"), get("n"), get("side"), get("same")
        self.sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)

    def pairs(self):
        """(i, j, estimate) arrays, a block of rows at a time: different components, sizes and sketches near enough."""
        size, k = 64 * SKETCH_WORDS, len(self.node)
        for a in range(0, k, 256):
            i, j = np.nonzero(self.component[a : a + 256, None] != self.component[None, :])
            i += a
            ok = (i < j) & ((self.side[i] != self.side[j]) | self.same[i]) & (self.n[i] * DEN >= self.n[j] * NUM) & (self.n[j] * DEN >= self.n[i] * NUM)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                differ = np.bitwise_count(self.sketch[p] ^ self.sketch[q]).sum(axis=1)
                guess = 1 + np.log(np.maximum(1 / size, 1 - 2.0 * differ / size)) * (size / (4.0 * ROWS * BANDS))
                ok = guess >= LEAST_ESTIMATE
                yield p[ok], q[ok], guess[ok]


def _near_nodes(batches):
    for group in groups(batches, "task"):
        meeting = _Meeting(group)
        some = np.zeros(group.num_rows, bool)
        for i, j, _ in meeting.pairs():
            some[i] = some[j] = True
        if some.any():
            yield from group.filter(pa.array(some)).to_batches()


def _joining_links(batches):
    for group in groups(batches, "task"):
        meeting = _Meeting(group)
        sets = [np.asarray(x.values.to_numpy()) for x in group.column("shingles")]
        up = {c: c for c in meeting.component.tolist()}

        def root(c: int) -> int:
            while up[c] != c:  # noqa: B023
                up[c] = up[up[c]]  # noqa: B023
                c = up[c]  # noqa: B023
            return c

        out = []
        for i, j, guess in meeting.pairs():
            for k in np.argsort(-guess):
                x, y = int(i[k]), int(j[k])
                a, b = root(int(meeting.component[x])), root(int(meeting.component[y]))
                if a == b:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if DEN * common >= NUM * (len(sets[x]) + len(sets[y]) - common):
                    up[max(a, b)] = min(a, b)
                    out.append((meeting.node[x], meeting.node[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row for each document: doc_id, n_shingles, component_id, kept, node, group_id, text_key.

    ``node`` is the digest of the document's set and ``group_id`` that of its component; both are null without words.
    ``text_key`` is xxhash64(text).
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = stored(documents.mapInArrow(_signatures, "doc_id long, text_key long, n long, node long, bits long, bands array<long>, sketch array<long>"))
    # a node is a distinct set; the document of the smallest id stands for it, one without an id only if all lack it
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min(rank).alias("stands"), *[F.first(c).alias(c) for c in ("n", "bits", "bands", "sketch")])
    nodes = stored(nodes.select("node", "stands.doc_id", "stands.text_key", "n", "bits", "bands", "sketch"))
    rank = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("bits").alias("bits"))
    banded = nodes.select("node", "bits", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min(rank).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.col("lead.node").alias("a"), F.col("lead.bits").alias("a_bits"))
    shared = stored(banded.join(stored(leaders), "bucket").select("bucket", "a", F.col("node").alias("b"), F.bit_count(F.col("a_bits").bitwiseXOR(F.col("bits"))).alias("differ")))
    swept(documents.sparkSession)
    brief = nodes.select("node", "n", "sketch")
    side = lambda x: brief.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    stars = shared.where((F.col("a") != F.col("b")) & (F.col("differ") <= MOST_BITS)).select("a", "b").distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").where(_near("a", "b")).select("a", "b")
    stars = stored(stars)
    links = stored(_confirmed(stars, nodes, documents))
    swept(documents.sparkSession)
    first = connected_components(links)
    found = links.union(_links_across(shared, first, nodes, documents))
    grouped = connected_components(found)
    swept(documents.sparkSession)
    least = nodes.select("node", "doc_id").join(grouped, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(smallest, "component").select("node", "component_id", F.col("component").alias("group_id"))
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "node", "group_id", "text_key")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each group the row of the smallest (doc_id, node, text_key) stays, null ids last.

    Documents without words all stay. Rows are told apart by doc_id and text, so repeated ids do no harm; of rows that
    repeat both, one stays. Texts don't leave the JVM: the documents are joined with the list of those that go.
    """
    own = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(documents.columns)}  # no name of ours can clash
    plain = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", F.xxhash64("text"))
    rows = near_duplicates(documents.select("doc_id", "text")).where("node is not null").groupBy("group_id", "doc_id", "node", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows)
    stays = rows.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "text_key")).alias("k"))
    rows = rows.join(stays, "group_id").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key")))
    marked = stored(rows.where("not stays or n > 1").select(F.col("doc_id").alias("__of"), F.col("text_key").alias("__text"), "stays"))
    swept(documents.sparkSession)
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__text"))
    kept = plain.join(marked, same, "left_anti")
    repeated = marked.where("stays")
    if repeated.limit(1).count():  # of rows that repeat both id and text, one
        kept = kept.union(plain.join(repeated, same, "left_semi").dropDuplicates(["__id", "__key"]).select(*kept.columns))
    return kept.select(*[F.col(x).alias(c) for c, x in own.items()])


#: The links are those of all pairs that share a shingle, by exact sets.
SQL = rf"""
WITH RECURSIVE wor AS (SELECT doc_id, regexp_extract_all(translate(text, '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shi AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS k FROM wor WHERE len(w) > 0)),
siz AS (SELECT doc_id, count(*) AS n FROM shi GROUP BY doc_id),
bot AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shi a JOIN shi b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
edg AS (SELECT a, b FROM bot JOIN siz x ON x.doc_id = a JOIN siz y ON y.doc_id = b WHERE {DEN} * common >= {NUM} * (x.n + y.n - common)),
nod AS (SELECT doc_id AS id FROM documents),
{components_sql("nod", "edg")}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, id = component AS kept FROM com LEFT JOIN siz ON siz.doc_id = id
"""


def query(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
