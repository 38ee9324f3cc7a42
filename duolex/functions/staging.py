"""Written tables between stages: they cut long plans, feed several branches without computing twice, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df under spark.checkpoint.dir and reads it again. Where that is unset, a single machine (tests) gets a folder of its own; a
    cluster is refused, for its executors couldn't see it. Spark deletes the table when the driver ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark._duolex_stage = getattr(spark, "_duolex_stage", None) or tempfile.mkdtemp(prefix="duolex-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_pair(df: DataFrame) -> DataFrame:
    """Deals rows by pair to as many tasks as shuffles have. Texts are small before they grow into tokens and cells, so the number isn't left to their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")
