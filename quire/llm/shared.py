"""Where llm jobs keep tables and files that every machine must see."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import require_checkpoint_dir


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (as a Spark path)."""
    return f"{require_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, and
    a lost executor costs no recomputation of what stands before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_fold(doc_id, n: int) -> int:
    """The same remainder in Python."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
