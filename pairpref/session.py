"""Session settings, reliable checkpoints and bounded-size checks shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of at most this many rows is small enough to broadcast: callers count before they hint.
BROADCAST_ROWS = 2_000_000
# And so is one whose texts have at most this many bytes as well.
BROADCAST_BYTES = 100_000_000
#: The folder in which stored() writes just now; unset: the checkpoint folder.
FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pairpref") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: all calendar columns are UTC.

    The other one is for speed: Java interprets methods of more than 8000 bytes of code, so where a whole stage would become
    one, as canonicalization does, Spark shall compile its operators one by one.
    """
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.codegen.hugeMethodLimit", "8000")):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a private one only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pairpref-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Like :func:`cut`, but later steps still read only the columns and row groups they need. For wide tables
    with many readers, such as canonical battles. ``options`` are the writer's.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{FOLDER.get() or spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def table_folder(spark: SparkSession) -> Iterator[str]:
    """Tables stored within lie in one new folder, which is left in place."""
    ensure_checkpoint_dir(spark)
    folder = f"{FOLDER.get() or spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
    token = FOLDER.set(folder)
    try:
        yield folder
    finally:
        FOLDER.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Working tables of one operator: what is stored within is deleted at the end, but for results passed to the
    function it yields, which stores them outside. Nothing else that reads the working tables may leave."""
    outside = FOLDER.get()

    def keep(df: DataFrame) -> DataFrame:
        token = FOLDER.set(outside)
        try:
            return stored(df)
        finally:
            FOLDER.reset(token)

    with table_folder(spark) as folder:
        try:
            yield keep
        finally:
            remove(spark, folder)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; beyond the bound the join shuffles as usual.

    ``df`` should already be materialised (see :func:`cut`) so that the count is not a second run.
    """
    return F.broadcast(df) if df.count() <= limit else df


def text_bytes(df: DataFrame, *names: str) -> tuple[int, int]:
    """Rows of ``df`` and bytes of the texts in the columns ``names``."""
    size = sum((F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint") for name in names), F.lit(0).cast("bigint"))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first())


def texts_fit(df: DataFrame, *names: str) -> bool:
    """Whether ``df``, materialised, may be broadcast with the texts in ``names``."""
    rows, size = text_bytes(df, *names)
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
