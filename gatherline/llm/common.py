"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """df, written once as Parquet in the shared folder: lineage is cut, later readers survive a lost executor and see the true size."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job writes in the shared folder, each under a name. A name that is written anew loses its former table, which nothing lazy may read then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir, self.written = spark, f"{shared_dir(spark)}/gatherline-{uuid.uuid4().hex}", Counter()

    def saved(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.dir}/{name}-{self.written[name] + 1}"
        df.write.parquet(path)
        if self.written[name]:
            self.drop(name)
        self.written[name] += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}-{self.written[name]}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame) -> Column:
    """A 128-bit hash of all of a row's columns: equal for rows that repeat each other, so that either may stand for both."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in docs.columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder_of_crc32(doc_id: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo mod; an id that is null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects of few rows exist at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def portions(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows, whose values of a text or binary column are not much longer than size together (a longer value is alone)."""
    for batch in batches:
        ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to


def ddl(df: DataFrame, *more: str) -> str:
    """df's columns and more, as a schema string."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def with_text(df: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns in keep and df's text, under the name that is returned."""
    return (df.select(*keep), "text") if "text" in keep else (df.select(*keep, F.col("text").alias("_text")), "_text")
