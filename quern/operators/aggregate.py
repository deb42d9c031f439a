"""Count and Sum, with and without groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import NUMERIC


class AggregateError(ValueError):
    """The aggregation is malformed."""


def parse(spec: dict[str, list], schema: T.StructType) -> list[Column]:
    """Columns of {label: ["Count"] | ["Sum", attribute]}."""
    if not isinstance(spec, dict) or not spec:
        raise AggregateError("aggregate_by names at least one aggregate")
    types = {f.name: f.dataType for f in schema.fields}
    out = []
    for label, e in spec.items():
        if e == ["Count"] or e == ("Count",):
            out.append(F.count(F.lit(1)).alias(label))
        elif isinstance(e, (list, tuple)) and len(e) == 2 and e[0] == "Sum" and isinstance(e[1], str):
            c = F.col(f"`{e[1]}`").cast("double") if isinstance(types.get(e[1]), NUMERIC) else F.lit(None).cast("double")
            out.append(F.coalesce(F.sum(c), F.lit(0.0)).alias(label))
        else:
            raise AggregateError(f"unknown aggregate {e!r}")
    return out


def aggregate(df: DataFrame, spec: dict[str, list], group_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One row of aggregates, or one a group; groups ascend by their keys, nulls first, up to the limit."""
    columns = parse(spec, df.schema)
    if not group_by:
        return df.agg(*columns)
    for k in group_by:
        if k not in df.columns:
            df = df.withColumn(k, F.lit(None).cast("string"))
    out = df.groupBy(*[F.col(f"`{k}`") for k in group_by]).agg(*columns).orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in group_by])
    return out if limit is None else out.limit(limit)
