"""Helpers shared by the operators: tables in the shared folder and Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bounds of one Arrow batch handed to a Python worker; long texts make batches of few rows.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


#: Where this package lies; a cluster ships it with --py-files instead.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(df: DataFrame, batch_bytes: int | None = None) -> SparkSession:
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes or BATCH_BYTES))
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset, a session of one machine gets a local one; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, batch_bytes: int | None = None) -> DataFrame:
    """mapInArrow with batches of bounded size; batch_bytes holds for what runs next."""
    session(df, batch_bytes)
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in text_bytes(column)]


def strings(column: pa.Array) -> pa.Array:
    """The same as an Arrow column."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array(texts(column), pa.large_string())


def sources(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holdout(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: A key with over one of so many of the rows is hot; there are no more hot keys than that.
HOT = 1000


def join_spread(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, spread: int = 256) -> DataFrame:
    """rows joined to ``counted``, which has a row for each key and the number of rows that have it in the column ``count``.

    Rows of hot keys are dealt to ``spread`` places, and the few rows of counted that they meet are repeated there. ``counted`` is a stored table."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in counted.where(F.col(count) > max(total / HOT, spread)).select(keys[-1]).collect()]  # no more than HOT
    places = F.when(F.col(keys[-1]).isin(hot), spread).otherwise(1).cast("long")
    left = rows.withColumn("__place", F.pmod(F.monotonically_increasing_id(), places))
    right = counted.withColumn("__place", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)))
    return left.join(right, [*keys, "__place"]).drop("__place", count)
