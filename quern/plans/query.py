"""Queries over a collection: requests become DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.filters import Compiler
from quern.functions.textproc import Fts
from quern.functions.vectors import METRICS, decode_vector, distance
from quern.operators import aggregate, ann, ordering, text_rank

DEFAULT_LIMIT, MOST_ROWS, MOST_QUERIES = 10, 10_000, 16
_KEYS = {"filters", "filter", "rank_by", "limit", "top_k", "per", "include_attributes", "exclude_attributes", "aggregate_by", "group_by", "consistency", "vector", "stats_scope"}


class QueryError(ValueError):
    """The request is malformed."""


@dataclass
class Collection:
    """A DataFrame that can be queried as a set of documents.

    key: column(s) that identify a row, the first doubling as `id`; fts: settings
    of full-text columns; regex: columns open to Regex filters (None: all); index
    and text: vector and text indexes of the same rows; dims: length of a vector.
    """

    df: DataFrame
    key: str | Sequence[str] = "id"
    vector: str | None = None
    metric: str = "cosine_distance"
    fts: dict[str, Fts] = field(default_factory=dict)
    regex: set[str] | None = None
    allow_dot_product: bool = False
    index: ann.Ivf | None = None
    text: dict[str, text_rank.Postings] = field(default_factory=dict)
    dims: int | None = None

    def __post_init__(self):
        if self.metric not in METRICS or (self.metric == "dot_product" and not self.allow_dot_product):
            raise QueryError(f"distance metric {self.metric!r} is not allowed")
        self.keys = [self.key] if isinstance(self.key, str) else list(self.key)
        if self.vector is None and "vector" in self.df.columns:
            self.vector = "vector"

    def compiler(self) -> Compiler:
        return Compiler(self.df.schema, self.regex)

    def where(self, filters: object) -> DataFrame:
        return self.df if filters is None else self.df.where(self.compiler().compile(filters))

    def query(self, request: dict) -> DataFrame:
        """The result of one request, lazily."""
        if unknown := set(request) - _KEYS:
            raise QueryError(f"unknown fields: {sorted(unknown)}")
        filters = request.get("filters", request.get("filter"))
        limit = request.get("top_k") or request.get("limit") or DEFAULT_LIMIT
        if not isinstance(limit, int) or isinstance(limit, bool) or not 0 < limit <= MOST_ROWS:
            raise QueryError(f"limit lies between 1 and {MOST_ROWS}")
        rank, spec = request.get("rank_by"), request.get("aggregate_by")
        if spec is not None:
            if rank is not None:
                raise QueryError("rank_by and aggregate_by exclude each other")
            return aggregate.aggregate(self.where(filters), spec, request.get("group_by"), limit if request.get("group_by") else None)
        if request.get("group_by"):
            raise QueryError("group_by needs aggregate_by")
        if rank is None:
            raise QueryError("a query needs rank_by or aggregate_by")
        include, exclude = request.get("include_attributes"), request.get("exclude_attributes")
        if include and exclude:
            raise QueryError("include_attributes and exclude_attributes exclude each other")
        out = self._ranked(rank, filters, limit, request)
        return self._project(out, include, exclude)

    def multi_query(self, requests: list[dict]) -> list[DataFrame]:
        """Results of several requests over this one snapshot, in order; a malformed one fails them all."""
        if not 0 < len(requests) <= MOST_QUERIES:
            raise QueryError(f"between 1 and {MOST_QUERIES} queries")
        return [self.query(r) for r in requests]

    def _settings(self, name: str) -> Fts:
        if name not in self.df.columns:
            raise QueryError(f"unknown attribute {name!r}")
        if self.fts and name not in self.fts:
            raise QueryError(f"attribute {name!r} is not enabled for full-text search")
        return self.fts.get(name) or Fts()

    def _ranked(self, rank: object, filters: object, limit: int, request: dict) -> DataFrame:
        if not isinstance(rank, (list, tuple)) or not rank:
            raise QueryError(f"no ranking: {rank!r}")
        per = request.get("per")
        if len(rank) == 2 and rank[1] in ("asc", "desc"):
            if rank[0] not in self.df.columns:
                raise QueryError(f"unknown attribute {rank[0]!r}")
            return ordering.order_by(self.where(filters), rank[0], rank[1], limit, self.keys, per)
        if per:
            raise QueryError("per needs an order by attribute")
        ties = [F.col(f"`{k}`").asc() for k in self.keys]
        if len(rank) == 3 and rank[1] == "ANN":
            return self._nearest(rank, filters, limit, ties)
        if len(rank) == 3 and rank[1] == "BM25" or text_rank.is_composite(rank):
            order, filtered = [F.col("`$dist`").desc(), *ties], request.get("stats_scope") == "filtered"
            if rank[1] == "BM25" and isinstance(rank[2], str) and rank[0] in self.text and not (filtered and filters is not None):
                self._settings(rank[0])
                scored = self.text[rank[0]].score(self.df, rank[2])
                if filters is None:  # the rows are fetched for the top list only
                    scored = F.broadcast(scored.orderBy(*order).limit(limit))
                return self.where(filters).join(scored, self.keys[0]).where(F.col("`$dist`") > 0).orderBy(*order).limit(limit)
            # all of the collection counts for the statistics, but only rows that pass the filter are scored
            base = self.where(filters)
            scored = text_rank.ranked(base, list(rank), self._settings, self.compiler(), stats=base if filtered else self.df)
            return scored.where(F.col("`$dist`") > 0).orderBy(*order).limit(limit)
        raise QueryError(f"no ranking: {rank!r}")

    def _nearest(self, rank: Sequence, filters: object, limit: int, ties: list) -> DataFrame:
        if self.vector is None or rank[0] not in ("vector", self.vector):
            raise QueryError("the collection has no such vector")
        q = decode_vector(rank[2], self.dims)
        if self.index is not None:
            if filters is None:
                return self.index.search(q, limit, self.keys)
            return self.index.search_filtered(q, limit, self.keys, self.compiler().compile(filters))
        return self._exact(q, filters, limit, ties)

    def _exact(self, q: list[float], filters: object, limit: int, ties: list) -> DataFrame:
        v = F.col(f"`{self.vector}`")
        out = self.where(filters).where(v.isNotNull()).withColumn("$dist", distance(v, q, self.metric))
        return out.orderBy(F.col("`$dist`").asc(), *ties).limit(limit)

    def _project(self, df: DataFrame, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
        always = [*self.keys, "$dist"]
        names = [c for c in df.columns if c != self.vector]
        if include:
            names = [c for c in names if c in include or c in always]
        elif exclude:
            names = [c for c in names if c not in exclude or c in always]
        return df.select(*[F.col(f"`{c}`") for c in names])
