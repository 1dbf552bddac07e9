"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.schemas import METRICS


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes inside cells are doubled, null is an empty cell."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        # Without these two the blanks around a cell would be cut.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def append_json_lines(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines cache; null fields are kept."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_best_parameters(best: DataFrame, path: str) -> None:
    """One-row result of a grid search as JSON."""
    best.write.mode("overwrite").json(path)


def log_metrics(spark: SparkSession, path: str, run: str, metrics: DataFrame) -> None:
    """Append the single row of ``metrics`` to the metrics table as (run, metric, value) rows."""
    names = metrics.columns
    long = metrics.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot(
        [], names, "metric", "value"
    )
    rows = long.select(F.lit(run).alias("run"), "metric", "value")
    rows.to(METRICS).write.mode("append").parquet(path)
