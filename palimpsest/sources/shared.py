"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/palimpsest-tmp").rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/m-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input, by the optimiser's estimate, up to which rows are dealt anew to use all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over the cores if it is small: a small file is often one row group, hence one task.

    Larger inputs have enough splits of their own and aren't shuffled.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) <= SMALL else df
