"""Near-duplicate embeddings by lattice hashing.

Equal vectors of a label are one node with a multiplicity. Each of ``TABLES`` random projections takes a unit vector
to eight dimensions, where it is decoded to its nearest point of the E8 lattice; that point is the vector's cell, and
the ``PROBES`` lattice neighbours that lie most in its direction are cells it visits. Two nodes are compared where one
lives in a cell that the other lives in or visits, and linked if their cosine, in double precision, reaches the
threshold. A pair that meets in several cells is counted in the first of them, which both rows' cell lists tell, so no
pair is ever written out: a cell's task returns for each node its number of links there and a local representative.
Cells of over ``BLOCK`` rows are compared block by block in tasks of their own.

At cosine 0.93 a table finds a pair with probability 0.82, so six miss one in about 30,000; nearer pairs far less.
`tests/llm` measures the recall against brute force. ``SCALE`` is the cells' fineness: a larger table wants a larger
one, with more tables.

Labels of any type are compared as their text. Defined cases: a vector that is null, empty or zero, or holds a null or a number that isn't finite, or has a null label
links with nothing, is its own component and is kept. Vectors of different lengths aren't compared. Rows that repeat a
vec_id are vectors of their own under that id; a null vec_id counts as a link of others but names no component, and is
kept only alone. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components_sql, groups, mix, read, stored, swept
from .components import connected_components

THRESHOLD = 0.93
TABLES, PROBES, SCALE = 6, 4, 0.55
BLOCK = 1024
PER = TABLES * (1 + PROBES)
STEP = 512  # rows of a cell that are compared with the others at once


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_NEIGHBOURS = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points of an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _code(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.astype(np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """rows x TABLES x (1 + PROBES) cell codes; the first of each table is the own cell."""
    n, size = vectors.shape
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        projection = np.random.default_rng((size, t)).normal(size=(size, 8)) * SCALE
        x = vectors @ projection
        own = nearest_e8(x)
        salt = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1000 * size + t))
        out[:, t, 0] = _code(own, salt)
        toward = (x - own) @ _NEIGHBOURS.T
        best = np.argsort(-toward, axis=1, kind="stable")[:, :PROBES]
        out[:, t, 1:] = _code(own[:, None, :] + _NEIGHBOURS[best], salt[:, None])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(batches):
    """The nodes with the codes of their cells: of each table the own one, then those visited."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            rows = batch.slice(at, STEP)
            column = rows.column(rows.schema.get_field_index("embedding"))
            labels = rows.column(rows.schema.get_field_index("label")).to_numpy()
            sizes = np.diff(column.offsets.to_numpy())
            codes = np.empty((rows.num_rows, PER), np.int64)
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                codes[of] = cells(unit(_matrix(column.take(pa.array(of)))), labels[of]).reshape(len(of), PER).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, PER, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "codes"])


def _new_pairs(codes: np.ndarray, u: np.ndarray, v: np.ndarray, table: int, cell: np.ndarray) -> np.ndarray:
    """Whether (u, v), which meet in ``cell``, hadn't met in an earlier table, or in a smaller cell of this one."""
    new = np.ones(len(u), bool)
    for t in range(table + 1):
        a, b = codes[u, t, 0], codes[v, t, 0]
        visits_b = (codes[u, t, 1:] == b[:, None]).any(axis=1)
        visits_a = (codes[v, t, 1:] == a[:, None]).any(axis=1)
        if t < table:
            new &= ~((a == b) | visits_b | visits_a)
        else:
            least = np.where(a == b, a, np.where(visits_a & visits_b, np.minimum(a, b), np.where(visits_a, a, b)))
            new &= least == cell
    return new


def _components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(u):
        old = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == old).all():
            break
    return label


def _compare(threshold: float):
    def links_of(group: pa.Table):
        get = lambda c: group.column(c).to_numpy()
        node, copies, place, side, low = get("node"), get("copies"), get("place"), get("side"), get("low")
        cell, n = get("cell").view(np.uint64), group.num_rows  # one cell, unless two tasks' hashes are equal
        x = unit(_matrix(group.column("embedding").combine_chunks()))
        codes = _matrix(group.column("codes").combine_chunks()).view(np.uint64).reshape(n, TABLES, 1 + PROBES)
        table, lives = place // (1 + PROBES), place % (1 + PROBES) == 0
        links = np.zeros(n, np.int64)
        label = np.arange(n)
        for a in range(0, n, STEP):
            b = min(a + STEP, n)
            near = x[a:b] @ x[a:].T >= threshold
            u, v = np.nonzero(near)
            u, v = u + a, v + a
            ok = (u < v) & (cell[u] == cell[v]) & (lives[u] | lives[v]) & ((side[u] != side[v]) | (low[u] == 2))
            u, v = u[ok], v[ok]
            for k in range(0, len(u), 1 << 18):
                p, q = u[k : k + (1 << 18)], v[k : k + (1 << 18)]
                new = np.zeros(len(p), bool)
                for t in np.unique(table[p]):
                    of = np.flatnonzero(table[p] == t)
                    new[of] = _new_pairs(codes, p[of], q[of], int(t), cell[p[of]])
                p, q = p[new], q[new]
                links += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
                label = _components(n, np.concatenate([label, p]), np.concatenate([np.arange(n), q]))
        if (some := links > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], ["node", "links", "root"])

    def run(batches):
        for group in groups(batches, "task"):
            sizes = np.diff(group.column("embedding").combine_chunks().offsets.to_numpy())
            for size in np.unique(sizes):  # one, unless two tasks' hashes are equal
                of = np.flatnonzero(sizes == size)
                if len(of) > 1:
                    yield from links_of(group if len(of) == group.num_rows else group.take(pa.array(of)))

    return run


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, embedding, label) -> one row for each vector: vec_id, n_links, component_id, kept."""
    single = isinstance(embeddings.schema["embedding"].dataType, T.ArrayType) and isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType)
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.col("label").isNotNull() & sound, F.xxhash64("label", "embedding")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes.mapInArrow(_coded, T.StructType([*nodes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])))
    # keys alone are counted and dealt out; vectors follow to the cells that several nodes have in common
    keys = nodes.select("node", F.posexplode("codes").alias("place", "cell"))
    lives = (F.col("place") % (1 + PROBES) == 0).cast("int")
    sizes = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(lives).alias("lived_in")).where("n > 1 and lived_in = 1")
    blocks = stored(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = keys.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(task.alias("task"), "cell", "place", "node", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), F.when(F.col("own") == F.col("other"), 2).otherwise(0).alias("low"))
    swept(embeddings.sparkSession)
    met = dealt.join(nodes.select("node", "copies", "codes", "embedding"), "node")
    found = stored(met.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(threshold), "node long, links long, root long"))
    swept(embeddings.sparkSession)
    component = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = nodes.select("node", "copies", "least").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = of.join(smallest, "component").join(counts, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(facts, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))


#: All pairs of a label, by cosine in double precision.
SQL = f"""
WITH RECURSIVE sou AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edg AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sou a JOIN sou b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
nod AS (SELECT vec_id AS id FROM embeddings),
{components_sql("nod", "edg")},
cou AS (SELECT a, count(*) AS n FROM edg GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept FROM com LEFT JOIN cou ON a = id
"""


def query(spark, sf_dir):
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))
