"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors x, y of cosine c differ on a random Gaussian projection by a normal
amount of deviation d = sqrt(2 - 2c).  Each of M projections is sorted, and every
vector is the centre of a window of half-width w = WIDTH * d_t on it, d_t being d
at the threshold: a pair collides there if one stands in the other's window, which
happens with p1 = P(|N| <= WIDTH).  A pair that collides on at least L of the M
projections is verified by its true cosine; L is the largest count that a pair at
the threshold still reaches with probability COUNT_RECALL.

A window on one projection holds a third of all vectors, so over the whole table
windows would meet n**2 times.  Therefore the table is first cut into cells: T
times, space is cut along g further projections, at random shifts, into slabs
CUT * d_t wide.  Two vectors at the threshold fall into one slab with
p = 1 - 2 Phi(-CUT) - 2 (1 - exp(-CUT**2 / 2)) / (CUT sqrt(2 pi)), so
T = log(1 - CELL_RECALL) / log(1 - p**g).  g grows with the logarithm of n, which
keeps cells from filling up, and T follows: every vector is sent T times, a low
power of n.  Within a cell all M projections are sorted and the collisions of all
pairs counted, in blocks of queries.  A pair that shares several cells is counted
in the first of them.  Cells of more than MOST vectors are dealt to block pairs.

No pair of vectors is shuffled: a cell gives for each of its vectors the number of
links found there and one link towards the least vector of its linked group, so
results and shuffles follow the number of vectors, while every link is counted.
Recall at the threshold is CELL_RECALL * COUNT_RECALL by design, and more above.

The result has one row a row of the table: its id, the id of its class (the least
id of all vectors linked to it, directly or through others) and its links (the
number of other rows whose cosine with it reaches the threshold, copies included).

Defined cases: rows of null id are left out; null vectors, vectors with null or
non-finite parts and zero vectors have no links and are classes of their own; so
are vectors of different lengths to one another; equal vectors are counted and
stand for each other under their least id, repeated rows among them; rows that
repeat an id with another vector share a class; an empty table gives an empty
result; only id and vector are read.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import drop, forest, join_groups, mix, saved
from .groups import components

THRESHOLD, M, WIDTH, COUNT_RECALL, CELL_RECALL, CUT = 0.95, 32, 2.0, 0.998, 0.985, 4.0
#: Vectors of a cell, aimed at; vectors of a cell or block at most; queries of a block; projections counted before the first look; seed.
CELL, MOST, QUERIES, FIRST, SEED = 2048, 4096, 64, 16, 20240607


def _together(r: float) -> float:
    """Chance that two points a normal step apart fall into one slab r steps wide."""
    return erf(r / sqrt(2)) - 2 / (r * sqrt(2 * pi)) * (1 - exp(-r * r / 2))


class Plan:
    """Projections, windows and cells for n vectors of one length."""

    def __init__(self, n: int, dim: int, t: float = THRESHOLD, cell: int = CELL):
        d = sqrt(2 - 2 * t)
        self.t, self.w = t, WIDTH * d
        p1 = erf(WIDTH / sqrt(2))
        tail, self.least = 0.0, M
        while self.least > 0 and tail < COUNT_RECALL:
            tail += comb(M, self.least) * p1**self.least * (1 - p1) ** (M - self.least)
            self.least -= 1
        self.least += 1
        far = _together(CUT * d / sqrt(2))  # unrelated vectors differ by a deviation of sqrt(2)
        self.g = max(1, ceil(log(max(n, 2) / cell) / log(1 / far)))
        self.groups = ceil(log(1 - CELL_RECALL) / log(1 - _together(CUT) ** self.g))
        rng = np.random.default_rng([SEED, dim])
        self.a = rng.standard_normal((dim, M))
        self.cut = rng.standard_normal((dim, self.groups * self.g)) / (CUT * d)
        self.shift = rng.random(self.groups * self.g)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Key of the cell of each vector in each group."""
        slab = np.floor(x @ self.cut + self.shift).astype(np.int64).reshape(len(x), self.groups, self.g).view(np.uint64)
        key = np.broadcast_to(np.arange(self.groups, dtype=np.uint64), slab.shape[:2])
        for k in range(self.g):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slab[:, :, k])
        return key.view(np.int64)


@lru_cache(64)
def plan_of(n: int, dim: int, t: float, cell: int) -> Plan:
    return Plan(n, dim, t, cell)


def candidates(p: np.ndarray, w: float, least: int, apart: np.ndarray | None = None):
    """Pairs (i, j), i < j, whose projections (rows of p) collide at least `least` times, a block of queries i at a time.

    apart: sides of the vectors; only pairs of different sides count.
    """
    c, m = p.shape
    rank, low, wide = (np.empty((m, c), np.uint16) for _ in range(3))
    for k in range(m):
        order = np.argsort(p[:, k], kind="stable")
        line = p[order, k]
        rank[k, order] = np.arange(c)
        low[k] = np.searchsorted(line, p[:, k] - w, "left")
        wide[k] = np.searchsorted(line, p[:, k] + w, "right") - low[k]
    first = min(FIRST, m)
    for i in range(0, c, QUERIES):
        e = min(i + QUERIES, c)
        hits = np.zeros((e - i, c - i), np.uint8)
        for k in range(first):
            hits += (rank[k, None, i:] - low[k, i:e, None] < wide[k, i:e, None]).view(np.uint8)
        a, b = np.nonzero(hits >= max(least - (m - first), 0))
        count = hits[a, b].astype(np.int64)
        a, b = a + i, b + i
        ok = a < b if apart is None else (a < b) & (apart[a] != apart[b])
        a, b, count = a[ok], b[ok], count[ok]
        for k in range(first, m):
            count += rank[k, b] - low[k, a] < wide[k, a]
            if k % 4 == 3:
                ok = count >= least - (m - 1 - k)
                a, b, count = a[ok], b[ok], count[ok]
        ok = count >= least
        yield a[ok], b[ok]


def _linked(table: pa.Table, plan: Plan) -> pa.Table:
    """(id, links, root) of the linked vectors of one cell or pair of blocks."""
    table = table.combine_chunks()
    ids = np.asarray(table["id"])
    by = np.argsort(ids, kind="stable")
    ids, times, side, group = ids[by], np.asarray(table["n"])[by], np.asarray(table["side"])[by], int(table["grp"][0].as_py())
    x = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)[by].astype(float)
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64).reshape(len(ids), -1)[by]
    norm = np.sqrt((x * x).sum(1))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in candidates(x / norm[:, None] @ plan.a, plan.w, plan.least, None if (side == side[0]).all() else side):
        for s in range(0, len(a), 1 << 15):
            i, j = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
            new = ~(keys[i, :group] == keys[j, :group]).any(1)
            i, j = i[new], j[new]
            ok = (x[i] * x[j]).sum(1) / norm[i] / norm[j] >= plan.t
            i, j = i[ok], j[ok]
            links += np.bincount(i, times[j], len(ids)).astype(np.int64) + np.bincount(j, times[i], len(ids)).astype(np.int64)
            root = forest(len(ids), i, j, root)
    some = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(ids[root[some]])})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", t: float = THRESHOLD, cell: int = CELL, most: int = MOST) -> DataFrame:
    """(id, class_id, links) of every row, as described above."""
    kind = "double" if vectors.schema[vec_col].dataType.elementType.simpleString() == "double" else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where("id is not null")
    usable = F.coalesce(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal vectors stand under their least id; the hash of a vector is 128 bits wide
    h = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("quern"), "v").alias("h2")]
    one = saved(rows.where(usable).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "v", *h), "vectors")
    sizes = {r.dim: r.n for r in one.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length of vectors

    def cells(batches):
        for b in batches:
            dims = np.asarray(b.column(3))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = b if len(at) == b.num_rows else b.take(pa.array(at))
                plan = plan_of(sizes[dim], dim, t, cell)
                x = np.asarray(part.column(2).flatten()).reshape(len(at), -1).astype(float)
                key = plan.cells(x / np.sqrt((x * x).sum(1, keepdims=True)))
                all_keys = pa.array([r.tobytes() for r in key], pa.binary())
                for g in range(plan.groups):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), g, np.int16)), pa.array(key[:, g]), part.column(0), part.column(1), all_keys, part.column(2)], ["dim", "grp", "cell", "id", "n", "keys", "v"]
                    )

    def only_cells(batches):
        for b in cells(batches):
            yield b.select(["dim", "grp", "cell"])

    src = one.select("id", "n", "v", F.size("v").alias("dim"))
    place = "dim int, grp short, cell long"
    sent = src.mapInArrow(cells, f"{place}, id long, n long, keys binary, v array<{kind}>")
    hot = saved(src.mapInArrow(only_cells, place).groupBy("dim", "grp", "cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most), "hot")
    one_part = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).alias("side")))
    if hot.isEmpty():
        parts = sent.withColumn("p", one_part)
    else:  # block i of a hot cell meets itself in part (i, i) and block j in part (min, max), on the side of the lesser one or the other
        m = F.ceil(F.col("c") / (most // 2))
        i = F.pmod(F.xxhash64("id"), m)
        dealt = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda j: F.struct((F.least(i, j) * m + F.greatest(i, j)).alias("part"), (i > j).cast("int").alias("side")))
        few = hot.count() <= 1 << 16
        parts = sent.join(F.broadcast(hot) if few else hot, ["dim", "grp", "cell"], "left").withColumn("p", F.when(F.col("c").isNull(), one_part).otherwise(dealt)).drop("c")
    parts = parts.select("*", F.explode("p").alias("q")).select("dim", "grp", "cell", "id", "n", "keys", "v", "q.part", "q.side")

    def meet(table):
        dim = int(table["dim"][0].as_py())
        return _linked(table, plan_of(sizes[dim], dim, t, cell))

    met = saved(parts.groupBy("dim", "grp", "cell", "part").applyInArrow(meet, "id long, links long, root long"), "met")
    links = met.groupBy("id").agg(F.sum("links").alias("found"))
    classes = components(met.select("id", "root").where("id != root").distinct())
    known = one.select("id", "n", "h1", "h2").join(links, "id", "left").join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
    known = saved(known.select("h1", "h2", "n", F.coalesce("root", "id").alias("class_id"), (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("links")), "known")
    drop(one, hot, met, classes)
    joined = join_groups(rows.where(usable).select("id", *h), known, ["h1", "h2"]).select("id", "class_id", "links")
    return joined.unionByName(rows.where(~usable).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
