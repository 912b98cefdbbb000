"""Numbered folders of tables, through Spark's file system, so that any store will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers n of the complete tables v<n> in a folder, ascending."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        fs, path = file_system(spark, folder)
        fs.delete(path, True)
