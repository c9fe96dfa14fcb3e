"""Reading tables, with the rows of small files dealt to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below so many bytes for each core, a table of fewer files than cores is dealt anew; larger tables have row groups enough.
SMALL = 16 << 20


#: Rows of an Arrow batch, where the session leaves Spark's 10,000: a batch of texts is held several times over by a task.
BATCH_ROWS = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of files for a task that reads texts in Python; a row group, which one task reads, may have a hundred times as many.
DEALT = 8 << 20


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it lies in a few small files, whose row groups are read by a task each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def dealt(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a table, its rows dealt by their hash to parts of about DEALT bytes, so that no task grows with the table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(spark.sparkContext.defaultParallelism, -(-size // DEALT))
    return df.select(columns).repartition(parts, F.xxhash64(*columns))
