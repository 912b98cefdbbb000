"""Where results are kept between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where that is unset and Spark runs in one process, as in tests) a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gatherline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gatherline-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder: its lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an iterative job writes in the shared folder and drops when nothing lazy reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths, self.n = spark, new_path(spark), {}, 0

    def saved(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that saved has returned; others are passed over."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
