"""Reading tables so that all cores have work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores where it has fewer partitions than there are cores (a small table in one row group); else df itself, as any plan with a shuffle of its own."""
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # to ask for its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at path, for work that is heavy for its size."""
    return spread(spark.read.parquet(path))
