"""The relational store: table shapes, saved tables, and a JDBC sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.schema import ARENA_BATTLE, MODEL_STATISTICS, TOPIC_STATISTICS

BATCH_ROWS = 1000
#: Bucket column and sort order of the saved tables that have a model.
BUCKET_KEYS = {"arena_battle": ("model_a", "battle_date"), "model_statistics": ("model_name",)}
#: Texts come back in many battles: a column of a file keeps a dictionary of up to 32 MB where that saved space in the first
#: 8 MB, its first page.
SAVED_OPTIONS = {"compression": "zstd", "parquet.dictionary.page.size": str(32 << 20), "parquet.page.size": str(8 << 20)}
#: Bytes of a saved table that one task sorts and writes.
TASK_BYTES = 256 << 20
SHAPES = {"arena_battle": ARENA_BATTLE, "model_statistics": MODEL_STATISTICS, "topic_statistics": TOPIC_STATISTICS}


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a stored table in order and type; absent ones are null."""
    have = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    return df.select(*columns)


def arena_tables(cleaned: DataFrame, statistics: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    battles = cleaned.withColumn("record_id", F.col("source_row_index"))
    frames = {"arena_battle": battles, "model_statistics": statistics, "topic_statistics": topics}
    return {name: shaped(frame, SHAPES[name]) for name, frame in frames.items()}


def dealt_out(rows: DataFrame, name: str, buckets: int, size: int, *ties: str) -> DataFrame:
    """Rows of the saved table ``name`` dealt out so that a task has few of its buckets and TASK_BYTES of its ``size``.

    For narrow rows that get their wide columns by a broadcast afterwards. The writer sorts whole rows, and would spill
    all of them in the few tasks in which narrow ones are read. ``ties`` divide what has one model and date.
    """
    key = BUCKET_KEYS[name]
    return rows.repartitionByRange(max(buckets, -(-size // TASK_BYTES)), F.pmod(F.hash(key[0]), F.lit(buckets)), *key, *ties)


def save_tables(tables: Mapping[str, DataFrame], *, prefix: str = "", buckets: int = 0, folder: str | None = None) -> None:
    """Saved tables, as external ones below ``folder`` where it is given. What an index would serve is served by
    bucketing and sorting on the model: tables of one number of buckets join on it without a shuffle."""
    for name, frame in tables.items():
        writer = frame.write.mode("overwrite").format("parquet").options(**SAVED_OPTIONS)
        key = BUCKET_KEYS.get(name)
        if buckets and key:
            writer = writer.bucketBy(buckets, key[0]).sortBy(*key)
        if folder:
            writer = writer.option("path", f"{folder}/{name}")
        writer.saveAsTable(f"{prefix}{name}")


def export_jdbc(tables: Mapping[str, DataFrame], url: str, properties: Mapping[str, str]) -> None:
    """Replace the tables of a relational database, each written in parallel batches."""
    for name, frame in tables.items():
        frame.write.option("batchsize", BATCH_ROWS).option("truncate", "true").jdbc(
            url, name, mode="overwrite", properties=dict(properties)
        )
