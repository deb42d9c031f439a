"""Attribute order, diversification by key, keyset pages, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(attribute: str, direction: str, ties: list[str]) -> list[Column]:
    """Nulls are least: first when ascending, last when descending; ties ascend by id."""
    c = F.col(f"`{attribute}`")
    head = c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last()
    return [head, *(F.col(f"`{t}`").asc() for t in ties if t != attribute)]


def order_by(df: DataFrame, attribute: str, direction: str, limit: int | None, ties: list[str], per: list[str] | None = None) -> DataFrame:
    """The first `limit` rows, or with `per` the first `limit` rows of each key in that order (a group limit before the shuffle)."""
    order = ordering(attribute, direction, ties)
    if not per:
        out = df.orderBy(*order)
        return out if limit is None else out.limit(limit)
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{p}`") for p in per]).orderBy(*order))
    out = df.withColumn("$rank", rank)
    if limit is not None:
        out = out.where(F.col("`$rank`") <= limit)
    return out.drop("$rank").orderBy(*order)


def page(df: DataFrame, key: str, after: object | None, limit: int) -> DataFrame:
    """The next page of an export in order of a unique key."""
    if after is not None:
        df = df.where(F.col(f"`{key}`") > F.lit(after))
    return df.orderBy(F.col(f"`{key}`").asc()).limit(limit)


def fuse(parts: list[DataFrame], key: str, scores: list[Column], k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of bounded rankings: the sum of 1 / (k + rank) over the parts, best first.

    `scores` order the parts, least first; each part is a top list, so its ranks
    are numbered in one small partition.
    """
    ranked = None
    for part, score in zip(parts, scores):
        rank = F.row_number().over(Window.orderBy(score.asc(), F.col(f"`{key}`").asc()))
        one = part.select(F.col(f"`{key}`"), (F.lit(1.0) / (k + rank)).alias("share"))
        ranked = one if ranked is None else ranked.unionByName(one)
    out = ranked.groupBy(f"`{key}`").agg(F.sum("share").alias("$dist")).orderBy(F.col("`$dist`").desc(), F.col(f"`{key}`").asc())
    return out if limit is None else out.limit(limit)
