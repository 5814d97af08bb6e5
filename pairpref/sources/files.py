"""Scans, file inventories and their closed-world comparison."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes hashed at once, and tasks at most that files are dealt to.
CHUNK, TASKS = 8 << 20, 100_000

def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; quoted fields may span lines. A missing path is an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _root(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(qualified form of ``path`` as file listings show it, whether it is a directory)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    qualified = store.makeQualified(hadoop)
    return qualified.toString().rstrip("/"), store.getFileStatus(qualified).isDirectory()


def _uri(path: str) -> str:
    """A URI that Arrow's file systems take: Hadoop writes local files as file:/x, and names as they are."""
    return quote(re.sub(r"^file:/+", "file:///", path), safe="/:@")


def _readable_in_chunks(root: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("full").to_pylist():
            store, name = fs.FileSystem.from_uri(_uri(path))
            digest = hashlib.sha256()
            with store.open_input_stream(name, compression=None) as source:
                while chunk := source.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), pa.array(found, pa.string())], ["path", "size_bytes", "sha256"])


def inventory(spark: SparkSession, path: str, *, pattern: str = "*", keep: str | None = None) -> DataFrame:
    """(path, size_bytes, sha256) of every file below ``path``, or of the file ``path``; ``keep`` is a condition on the path.

    Files are listed without their content, dealt to tasks and hashed there CHUNK bytes at a time, so that a file of
    any size takes the memory of one chunk. A store that only Spark's readers know (no Arrow file system opens its URIs) is
    read by them instead, each file whole, up to their bound of 2 GiB. Files without a byte are not listed, since Spark's
    reader leaves them out.
    """
    root, folder = _root(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    below = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    name = F.when(F.startswith("path", F.lit(root + "/")), below).otherwise(F.substring_index("path", "/", -1)) if folder else F.substring_index("path", "/", -1)
    named = lambda *more: files.select(name.alias("path"), F.col("length").alias("size_bytes"), *more).where(keep or "true")
    if not _readable_in_chunks(root):
        return named(F.sha2("content", 256).alias("sha256"))
    listed = named(F.col("path").alias("full"))
    tasks = max(1, min(listed.count(), TASKS))
    return listed.repartition(tasks, "full").mapInArrow(_hashed, "path string, size_bytes long, sha256 string")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row over sorted lines: how many, and the SHA-256 of the JSON array they make."""
    count, digest = 0, hashlib.sha256(b"[")
    for batch in batches:
        for line in batch.column("line").to_pylist():
            digest.update((b"," if count else b"") + line.encode())
            count += 1
    digest.update(b"]")
    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([digest.hexdigest()])], ["files", "digest"])


def inventory_digest(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the inventory as canonical JSON, its entries in order of their paths.

    The entries are sorted, which may spill, and streamed through one running hash; no list of them is made.
    """
    lines = files.select("path", F.to_json(F.struct("path", "sha256", "size_bytes")).alias("line"))
    found = lines.repartition(1).sortWithinPartitions("path").mapInArrow(_running, "files long, digest string")
    return found.agg(
        F.coalesce(F.max("files"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.max("digest"), F.sha2(F.lit("[]").cast("binary"), 256)).alias("digest"),
    )


def compare_inventories(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Every path of either side with ok / missing / extra / size_mismatch / hash_mismatch."""
    d, a = declared.alias("d"), actual.alias("a")
    status = (
        F.when(F.col("a.path").isNull(), "missing")
        .when(F.col("d.path").isNull(), "extra")
        .when(F.col("d.size_bytes") != F.col("a.size_bytes"), "size_mismatch")
        .when(F.col("d.sha256") != F.col("a.sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    joined = d.join(a, F.col("d.path") == F.col("a.path"), "full_outer")
    return joined.select(F.coalesce("d.path", "a.path").alias("path"), status.alias("status"))


def source_hash(spark: SparkSession, path: str) -> str:
    """The identity of a snapshot: the hash of a single file, or the digest of a folder's inventory."""
    files = inventory(spark, path)
    if _root(spark, path)[1]:
        return files.transform(inventory_digest).first()["digest"]
    return files.first()["sha256"]


def check_source(spark: SparkSession, path: str, declared_sha256: str) -> None:
    """Refuse a snapshot, a file or a folder of any number of files, whose hash is not the declared one."""
    if source_hash(spark, path) != declared_sha256:
        raise ValueError(f"{path} does not have its declared SHA-256")
