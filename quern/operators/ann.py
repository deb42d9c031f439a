"""Clustered vector search: k-means, an index on disk by cluster, probing, recall-aware planning, recall.

The index is the table itself, written as Parquet partitioned by `cluster_id`, so
a search reads the folders of the probed clusters only.  Centroids are fitted on
a bounded sample (FIT_ROWS); every row is assigned and written.

A search is exact.  It first looks into the nearest clusters, then into all that
may hold a row as near as the last one found, by the triangle inequality with
each cluster's radius; where the vectors have no clusters these are all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.vectors import distance
from quern.sources.scratch import shared

PROBES, MOST_PROBES = 16, 64
#: Rows on which centroids are fitted at most; clusters at most, freshly written and compacted; rows of a selectivity sample.
FIT_ROWS, NEW_CLUSTERS, CLUSTERS, SAMPLE_ROWS = 50_000, 32, 256, 1000
CLUSTER = "cluster_id"


def cluster_count(n: int, most: int = CLUSTERS) -> int:
    return max(1, min(int(sqrt(max(n, 1))), most))


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of x to each row of q."""
    if metric == "euclidean_squared":
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1), 0)
    dot = x @ q.T
    if metric == "dot_product":
        return -dot
    scale = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    return np.where(scale == 0, 1.0, 1 - dot / np.where(scale == 0, 1, scale))


def matrix(lists: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Some rows of an Arrow array of lists of doubles, all of this length."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(np.append(0, np.asarray(lists.value_lengths())))[:-1]
    return values[start[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))


def kmeans(x: np.ndarray, k: int, metric: str, rounds: int = 20, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cluster of each row): k-means++ and Lloyd's rounds on unit vectors for cosine; with 0 rounds one pass assigns."""
    rng = np.random.default_rng(seed)
    if metric == "cosine_distance":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = min(k, len(x))
    c = x[rng.integers(len(x))][None]
    near = distances(x, c, "euclidean_squared")[:, 0]
    while len(c) < k:  # the next centre by its squared distance
        total = near.sum()
        i = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        c = np.vstack([c, x[i]])
        near = np.minimum(near, distances(x, x[i : i + 1], "euclidean_squared")[:, 0])
    of = distances(x, c, "euclidean_squared").argmin(1)
    for _ in range(rounds):
        n = np.bincount(of, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, of, x)
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
        moved = float(np.sqrt(((new - c) ** 2).sum() / k))
        c, of = new, distances(x, new, "euclidean_squared").argmin(1)
        if moved < tolerance:
            break
    return c, of


def split_oversized(x: np.ndarray, c: np.ndarray, of: np.ndarray, metric: str, least: int = 1000, seed: int = 7) -> np.ndarray:
    """Centroids with those of over max(2 x mean, `least`) rows split into 2 to 16."""
    most = max(2 * len(x) / max(len(c), 1), least)
    out = []
    for i in range(len(c)):
        rows = np.flatnonzero(of == i)
        parts = 2
        while len(rows) / parts > most and parts < 16:
            parts *= 2
        out.append(kmeans(x[rows], parts, metric, seed=seed)[0] if len(rows) > most else c[i : i + 1])
    return np.concatenate(out) if out else c


@dataclass
class Ivf:
    """Rows by cluster, the clusters' centroids, and rows that are not clustered yet."""

    assigned: DataFrame
    centroids: np.ndarray
    metric: str
    vector: str
    fresh: DataFrame | None = None
    rows: int = 0
    radii: np.ndarray | None = None  # without them every search looks into all clusters

    @staticmethod
    def fit(df: DataFrame, vector: str = "vector", metric: str = "cosine_distance", clusters: int | None = None, seed: int = 7, rounds: int = 20, most: int = CLUSTERS) -> tuple[np.ndarray, int]:
        """(centroids, rows with a vector), on a seeded sample beyond FIT_ROWS; vectors of another length than the most common one take no part."""
        has = df.where(F.col(f"`{vector}`").isNotNull())
        sizes = has.groupBy(F.size(f"`{vector}`").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).collect()
        if not sizes:
            return np.zeros((0, 0)), 0
        n, dim = sum(r.n for r in sizes), sizes[0].dim
        same = has.where(F.size(f"`{vector}`") == dim).select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
        fit = same.sample(min(1.0, 1.1 * FIT_ROWS / n), seed).limit(FIT_ROWS) if n > FIT_ROWS else same
        x = np.array([r.v for r in fit.collect()]).reshape(-1, dim)
        if metric == "cosine_distance":
            x = x[np.abs(x).sum(1) > 0]
        if not len(x):
            return np.zeros((0, dim)), n
        k = clusters or cluster_count(n, most)
        centroids, of = kmeans(x, k, metric, rounds, seed)
        return (centroids if clusters else split_oversized(x, centroids, of, metric)), n

    @staticmethod
    def assign(df: DataFrame, centroids: np.ndarray, vector: str, metric: str) -> DataFrame:
        """df with the number of each row's nearest centroid; -1 without a vector of their length.  One narrow pass."""
        c = centroids
        if metric == "cosine_distance" and len(c):
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        shared_c = df.sparkSession.sparkContext.broadcast(c)

        def run(series):
            import pandas as pd

            for col in series:
                out, cs = np.full(len(col), -1, np.int32), shared_c.value
                at = [i for i, v in enumerate(col) if v is not None and len(cs) and len(v) == cs.shape[1]]
                for i in range(0, len(at), 4096):
                    some = at[i : i + 4096]
                    x = np.stack([np.asarray(col.iloc[j], float) for j in some])
                    out[some] = distances(x, cs, "cosine_distance" if metric == "cosine_distance" else "euclidean_squared").argmin(1)
                yield pd.Series(out)

        import pandas as pd

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn(CLUSTER, F.pandas_udf(run, "int")(F.col(f"`{vector}`")))

    @staticmethod
    def measured(assigned: DataFrame, centroids: np.ndarray, vector: str, metric: str) -> np.ndarray:
        """Radius of each cluster: the greatest Euclidean distance of its rows to its centroid, of unit vectors for cosine; infinite where a row has no such distance."""
        if not len(centroids):
            return np.zeros(0)
        shared_c = assigned.sparkSession.sparkContext.broadcast(centroids)

        def run(batches):
            cs = shared_c.value
            for b in batches:
                of, x = np.asarray(b.column(0)), matrix(b.column(1), np.arange(b.num_rows), cs.shape[1])
                if metric == "cosine_distance":
                    norm = np.sqrt((x * x).sum(1))[:, None]
                    x = np.where(norm == 0, np.inf, x / np.where(norm == 0, 1, norm))  # a zero vector is no unit vector
                far, at = np.zeros(len(cs)), np.zeros(len(cs), bool)
                d = np.sqrt(((x - cs[of]) ** 2).sum(1))
                np.maximum.at(far, of, np.where(np.isnan(d), np.inf, d))
                at[of] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(at).astype(np.int32)), pa.array(far[at])], ["c", "r"])

        rows = assigned.where(F.col(CLUSTER) >= 0).select(CLUSTER, F.col(f"`{vector}`").cast("array<double>"))
        got = rows.mapInArrow(run, "c int, r double").groupBy("c").agg(F.max("r").alias("r")).collect()  # a row a cluster
        out = np.zeros(len(centroids))
        out[[r.c for r in got]] = [r.r for r in got]
        return out

    @staticmethod
    def write(df: DataFrame, path: str, vector: str, metric: str, clusters: int | None = None, seed: int = 7, rounds: int = 20, most: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray, int]:
        """Write df by cluster below path; (centroids, radii, rows with a vector).  Large clusters become several files (a skewed one is no task of its own)."""
        centroids, n = Ivf.fit(df, vector, metric, clusters, seed, rounds, most)
        assigned = Ivf.assign(df, centroids, vector, metric)
        assigned.hint("rebalance", CLUSTER).write.partitionBy(CLUSTER).parquet(path)
        written = df.sparkSession.read.schema(assigned.schema).parquet(path)
        return centroids, Ivf.measured(written, centroids, vector, metric), n

    @staticmethod
    def build(df: DataFrame, vector: str = "vector", metric: str = "cosine_distance", clusters: int | None = None, seed: int = 7, rounds: int = 20, path: str | None = None) -> Ivf:
        """An index of df on disk, in a scratch folder unless `path` names one."""
        path = path or shared(df.sparkSession, "ivf")
        centroids, radii, n = Ivf.write(df, path, vector, metric, clusters, seed, rounds)
        schema = T.StructType([*df.schema.fields, T.StructField(CLUSTER, T.IntegerType())])
        return Ivf(df.sparkSession.read.schema(schema).parquet(path), centroids, metric, vector, rows=n, radii=radii)

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The clusters to look into: a driver-side choice over the centroids."""
        return np.argsort(distances(self.centroids, np.asarray(query, float)[None], self.metric)[:, 0], kind="stable")[:probes].tolist()

    def bounds(self, query: Sequence[float]) -> np.ndarray:
        """No row of a cluster is nearer to the query than this."""
        c, q = self.centroids, np.asarray(query, float)
        norm = float(np.linalg.norm(q))
        if norm == 0 or not np.isfinite(norm):
            return np.full(len(c), -np.inf)
        if self.metric == "dot_product":
            return -(c @ q) - norm * self.radii
        if self.metric == "cosine_distance":
            q = q / norm
        gap = np.maximum(np.linalg.norm(c - q, axis=1) - self.radii, 0)
        return gap * gap / (2 if self.metric == "cosine_distance" else 1)

    def prunes(self, query: Sequence[float]) -> bool:
        """Whether clusters can be left out at all."""
        return self.radii is not None and len(self.centroids) > 0 and len(query) == self.centroids.shape[1]

    def needed(self, query: Sequence[float], last: float, probed: list[int]) -> list[int]:
        """The clusters that can hold one of the nearest rows, if of those of the probed clusters the last is at distance `last`."""
        slack = 1e-9 * (1 + abs(last) + float(np.abs(self.centroids).max()) ** 2 + float(np.square(query).sum()))
        return sorted(set(probed) | set(np.flatnonzero(self.bounds(query) <= last + slack).tolist()))

    def search(self, query: Sequence[float], top_k: int, ties: str | list[str], probes: int = PROBES, where: Column | None = None) -> DataFrame:
        """The top_k nearest rows. The nearest `probes` clusters are searched first, then those that may hold nearer rows than these do."""
        return self._search(query, top_k, ties, SearchPlan(False, top_k, probes), where)

    def search_filtered(self, query: Sequence[float], top_k: int, ties: str | list[str], where: Column) -> DataFrame:
        """The top_k nearest rows that pass a filter: a sampled selectivity sets the clusters searched first."""
        return self._search(query, top_k, ties, plan_filtered(selectivity(self.assigned, where, self.rows), top_k), where)

    def _search(self, query: Sequence[float], top_k: int, ties: str | list[str], plan: SearchPlan, where: Column | None) -> DataFrame:
        while not plan.exact and plan.probes < len(self.centroids) and self.prunes(query):
            probed = self.nearest(query, plan.probes)
            found = [r[0] for r in self._top(query, top_k, ties, probed, where).select("`$dist`").collect()]  # at most top_k
            wider = widen(plan, len(found), top_k)
            if wider is None:
                return self._top(query, top_k, ties, self.needed(query, found[-1], probed), where)
            plan = wider
        return self._top(query, top_k, ties, None, where)

    def _top(self, query: Sequence[float], top_k: int, ties: str | list[str], clusters: list[int] | None, where: Column | None) -> DataFrame:
        """The top_k nearest rows of some clusters, of rows in none and of the fresh rows; filters go below the distances, clusters are partition filters."""
        df = self.assigned
        if clusters is not None:
            df = df.where(F.col(CLUSTER).isin(-1, *clusters))
        df = df.drop(CLUSTER)
        if self.fresh is not None:
            df = df.unionByName(self.fresh)
        df = df if where is None else df.where(where)
        out = df.where(F.col(f"`{self.vector}`").isNotNull()).withColumn("$dist", distance(F.col(f"`{self.vector}`"), query, self.metric))
        return out.orderBy(F.col("`$dist`").asc(), *[F.col(f"`{t}`").asc() for t in ([ties] if isinstance(ties, str) else ties)]).limit(top_k)


@dataclass(frozen=True)
class SearchPlan:
    exact: bool
    candidates: int
    probes: int


def plan_filtered(selectivity: float, top_k: int) -> SearchPlan:
    """Exact below 1 % selectivity; else candidates over-sampled by 1/selectivity (2 to 10 times) and more probes the rarer the matches."""
    if selectivity < 0.01:
        return SearchPlan(True, 0, 0)
    if selectivity >= 1:
        return SearchPlan(False, top_k, PROBES)
    over = min(max(1 / selectivity, 2.0), 10.0)
    return SearchPlan(False, max(top_k, int(top_k * over)), MOST_PROBES - int((selectivity - 0.01) / 0.99 * (MOST_PROBES - PROBES)))


def widen(plan: SearchPlan, found: int, top_k: int) -> SearchPlan | None:
    """The plan of a retry after too few results: twice the candidates and probes; None if none is needed."""
    return None if plan.exact or found >= top_k else SearchPlan(False, plan.candidates * 2, plan.probes * 2)


def selectivity(df: DataFrame, where: Column, rows: int, sample: int = SAMPLE_ROWS, seed: int = 7) -> float:
    """Share of a seeded sample of about `sample` of the `rows` rows that passes a filter; 0 of an empty one."""
    got = df.sample(min(1.0, sample / max(rows, 1)), seed).agg(F.avg(F.coalesce(where, F.lit(False)).cast("double")).alias("s")).first()
    return float(got.s or 0.0)


def recall(ivf: Ivf, key: str, num: int = 10, top_k: int = 10, probes: int | None = None, seed: int = 7) -> dict[str, float]:
    """Mean share of the exact top_k that the clustered search finds, for `num` sampled vectors; 1, 0, 0 without vectors.  With `probes` that of the nearest so many clusters alone.

    All queries are compared with all rows in one pass: each task keeps its best
    top_k a query, over all its rows and over those of the probed clusters.  A
    second pass measures the clusters that a search adds to these.
    """
    v = F.col(f"`{ivf.vector}`")
    table = ivf.assigned.select(F.col(f"`{key}`").alias("key"), v.cast("array<double>").alias("v"), CLUSTER)
    if ivf.fresh is not None:
        table = table.unionByName(ivf.fresh.select(F.col(f"`{key}`").alias("key"), v.cast("array<double>").alias("v"), F.lit(-1).alias(CLUSTER)))
    table = table.where("v is not null")
    queries = table.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(num).select("v").collect()
    if not queries:
        return {"avg_recall": 1.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}
    q = [np.asarray(r.v, float) for r in queries]
    first = [ivf.nearest(x, probes or PROBES) if len(ivf.centroids) and len(x) == ivf.centroids.shape[1] and (probes or ivf.prunes(x)) else None for x in q]
    best = _best(table, q, first, ivf.metric, top_k)
    if probes is None:
        last = {r.q: r.true_d for r in best if len(r.true_keys or []) == top_k}
        clusters = [ivf.needed(x, last[n], c) if c is not None and n in last else None for n, (x, c) in enumerate(zip(q, first))]
        best = _best(table, q, clusters, ivf.metric, top_k) if clusters != first else best
    pairs = [(set(r.false_keys or []), set(r.true_keys or [])) for r in best]
    m = max(len(pairs), 1)
    return {
        "avg_recall": sum(len(e & a) / max(len(e), 1) for e, a in pairs) / m, "avg_ann_count": sum(len(a) for _, a in pairs) / m, "avg_exhaustive_count": sum(len(e) for e, _ in pairs) / m,
    }


def _best(table: DataFrame, q: list[np.ndarray], clusters: list[list[int] | None], metric: str, top_k: int) -> list:
    """For each query, by number: the keys and the last distance of its nearest rows, of all and of its clusters (None: of all)."""
    kind = table.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            of, size, rows = np.asarray(b.column(2)), np.asarray(b.column(1).value_lengths()), {}
            for n, x in enumerate(q):
                if len(x) not in rows:
                    same = np.flatnonzero(size == len(x))
                    rows[len(x)] = same, matrix(b.column(1), same, len(x))
                same, some = rows[len(x)]
                if not len(same):
                    continue
                d = distances(some, x[None], metric)[:, 0]
                inside = np.ones(len(same), bool) if clusters[n] is None else np.isin(of[same], [-1, *clusters[n]])
                for ann in (False, True):
                    at = np.flatnonzero(inside | (not ann))
                    at = at[np.argsort(d[at], kind="stable")[: 2 * top_k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(np.full(len(at), ann)), b.column(0).take(pa.array(same[at])), pa.array(d[at])], ["q", "ann", "key", "d"])

    best = table.mapInArrow(run, f"q int, ann boolean, key {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("q", "ann").orderBy(F.round("d", 12), "key"))
    return best.withColumn("r", rank).where(F.col("r") <= top_k).groupBy("q").pivot("ann", [False, True]).agg(F.collect_list("key").alias("keys"), F.max("d").alias("d")).collect()  # top lists
