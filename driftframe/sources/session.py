"""A query's own settings, apart from those of the caller's session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def copied(df: DataFrame, **settings: str) -> DataFrame:
    """df in a copy of its session with settings (names with __ for dots): what is derived from the result runs there."""
    spark = df.sparkSession
    copy = spark._jsparkSession.cloneSession()
    for name, value in settings.items():
        copy.conf().set(name.replace("__", "."), value)
    moved = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    return DataFrame(moved, SparkSession(spark.sparkContext, copy))


def small_batches(df: DataFrame, rows: int, nbytes: int) -> DataFrame:
    """df whose Python stages get at most so many rows, or about so many bytes, at once."""
    return copied(df, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch=str(nbytes))
