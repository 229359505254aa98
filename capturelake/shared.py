"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on one machine, where none is set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    root = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is dear to compute and used several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many partitions as shuffles have, and as tasks run, at least: for steps that are dear by row, where Spark
    would put rows of few bytes into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))
