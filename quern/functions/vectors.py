"""Distances between vectors, and the decoding of query vectors."""

from __future__ import annotations

import base64
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine_distance", "euclidean_squared", "dot_product")
FAR = 1.7976931348623157e308


class VectorError(ValueError):
    """The vector or metric is malformed."""


def decode_vector(value: str | Sequence[float], dims: int | None = None) -> list[float]:
    """Floats of a list, or of base64 of little-endian 32-bit floats."""
    if isinstance(value, str):
        try:
            raw = base64.b64decode(value, validate=True)
        except ValueError as e:
            raise VectorError("vector is not base64") from e
        if len(raw) % 4:
            raise VectorError("a base64 vector has 4 bytes a dimension")
        out = list(struct.unpack(f"<{len(raw) // 4}f", raw))
    else:
        out = [float(np.float32(x)) for x in value]
    if dims is not None and len(out) != dims:
        raise VectorError(f"vector has {len(out)} dimensions, not {dims}")
    return out


def encode_vector(values: Sequence[float]) -> str:
    return base64.b64encode(struct.pack(f"<{len(values)}f", *values)).decode()


def half_to_floats(raw: bytes) -> list[float]:
    """Floats of little-endian 16-bit floats."""
    return np.frombuffer(raw, "<f2").astype(np.float32).tolist()


def floats_to_half(values: Sequence[float]) -> bytes:
    return np.asarray(values, "<f2").tobytes()


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def distance(v: Column, query: Sequence[float] | Column, metric: str = "cosine_distance") -> Column:
    """Distance of an array column to a query vector in double precision; less is nearer.

    Vectors of another length are at the greatest double; a zero vector is at
    cosine distance 1; NULL vectors give NULL.
    """
    if metric not in METRICS:
        raise VectorError(f"unknown distance metric {metric!r}")
    if isinstance(query, Column):
        q, size, norm = query.cast("array<double>"), F.size(query), F.sqrt(_sum(F.transform(query.cast("array<double>"), lambda x: x * x)))
    else:
        q, size = F.array(*[F.lit(float(x)) for x in query]), F.lit(len(query))
        norm = F.lit(float(np.sqrt(sum(float(x) ** 2 for x in query))))
    v = v.cast("array<double>")
    if metric == "euclidean_squared":
        out = _sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    else:
        dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
        if metric == "dot_product":
            out = -dot
        else:
            scale = F.sqrt(_sum(F.transform(v, lambda x: x * x))) * norm
            out = F.when(scale == 0, 1.0).otherwise(1.0 - dot / F.nullif(scale, F.lit(0.0)))
    return F.when(v.isNotNull(), F.when(F.size(v) == size, out).otherwise(F.lit(FAR)))
