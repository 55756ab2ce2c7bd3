"""Apply the stateless case projections to a stream of case rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casekit.plans.features import case_features


def case_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """A stream of case-table parquet files (same columns as ``case_table``)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def featurize_stream(stream: DataFrame) -> DataFrame:
    """Labels and features on each micro-batch (pure projection: no state, no watermark needed)."""
    return case_features(stream)
