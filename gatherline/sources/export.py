"""Export of a table in ordered parts, and reading it back by its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "part int, n long, first string, last string"


def shaped(df: DataFrame, schema: T.StructType, leave_out: list[str] = []) -> DataFrame:  # noqa: B006
    """df's rows with the columns of a schema but those left out, in its order and types; a column that df lacks is null, one that the schema lacks goes."""
    if not schema.fields:
        raise ValueError("the table has no columns")
    held = {c.lower(): c for c in df.columns}
    fields = [f for f in schema.fields if f.name not in leave_out]
    return df.select(*((F.col(f"`{held[f.name.lower()]}`") if f.name.lower() in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def export(df: DataFrame, schema: T.StructType, folder: str, *, key: str = "id", leave_out: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """Writes df in the shape of a schema to JSON files in ascending order of key (null first; rows that repeat a key by all they hold): a folder data/part=N for each range of keys, and a manifest of parts (their rows, first and last key), which is returned.

    Parts are ranges, so each is sorted by itself and none holds the table. A folder that exists is an error. Nulls are written, so that every row names every column."""
    spark, rows = df.sparkSession, shaped(df, schema, leave_out)
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    keyed = rows.select(F.col(f"`{key}`").alias("key"), every.alias("value")).repartitionByRange(*([parts] if parts else []), "key", "value")
    ordered = keyed.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key", "value")
    ordered.select("value", "part").write.mode("errorifexists").partitionBy("part").text(f"{folder}/data")
    value = F.from_json("value", T.StructType([rows.schema[key]]))[key].alias("key")
    held = written(spark, folder).select("part", value).groupBy("part").agg(F.count("*").alias("n"), F.min("key").cast("string").alias("first"), F.max("key").cast("string").alias("last"))
    held.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(PART).parquet(f"{folder}/manifest")


def written(spark: SparkSession, folder: str) -> DataFrame:
    """value and part of all lines that are there; an empty table has no parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    if not any(s.isDirectory() for s in found):
        return spark.createDataFrame([], "value string, part int")
    return spark.read.schema("value string, part int").text(f"{folder}/data")


def read_back(spark: SparkSession, folder: str, schema: T.StructType, leave_out: list[str] = []) -> DataFrame:  # noqa: B006
    """The exported rows in the shape of a schema. An error if a part has not the rows that the manifest states."""
    fields = T.StructType([f for f in schema.fields if f.name not in leave_out])
    lines = written(spark, folder)
    counted = lines.groupBy("part").agg(F.count("*").alias("held"))
    stated = spark.read.schema(PART).parquet(f"{folder}/manifest")
    wrong = stated.join(counted, "part", "full").where(~F.col("n").eqNullSafe(F.col("held")))
    if not wrong.isEmpty():
        raise ValueError(f"parts differ from the manifest: {[r['part'] for r in wrong.select('part').limit(10).collect()]}")
    return lines.select(F.from_json("value", fields).alias("r")).select("r.*")
