"""The training-text pipeline over ``documents``: five stages, each a thin call of one operator.

Every stage but the last returns the columns of documents; the driver of the pipeline may write and reread what is in
between. What a stage has stored for itself is deleted when the next one begins, unless that reads it still.
Rows the quality rules reject, later occurrences of three-line windows (and documents nothing else is
left of), all but one document of each group of near duplicates, and documents the mixture does not take are gone;
a document the mixture takes several times comes several times. The last stage adds token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm import byte_bpe, jaccard_join, line_dedup, quality_rules, source_mixing
from pairpref.llm.catalog import free_name, table
from pairpref.session import remove, stored, table_folder

BLANK = r"^[\x20\x09-\x0D]*$"
#: Near duplicates of the pipeline: word shingles and similarity in percent. (The op8 query has a contract of its own.)
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name("lines", docs.columns)
    done, removed = line_dedup.remove_lines(docs, result=found), F.col(found)["n_removed"] > 0
    emptied = removed & F.col("text").rlike(BLANK)
    sized = F.when(removed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", sized).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, NEAR_WIDTH, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name("mix", docs.columns)
    uses = F.explode(F.array_repeat(F.lit(0), F.col(found)["times"]))
    return source_mixing.mix_by_source(docs, found).select(*[F.col(f"`{c}`") for c in docs.columns], uses.alias(free_name("use", docs.columns))).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name("encoded", docs.columns)
    encoded = byte_bpe.encode(docs, *byte_bpe.tokenizer(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), found)
    return encoded.select("doc_id", "lang", "source", f"{found}.*")


#: Folder of the tables that the last stage of an application stored.
LEFT: dict[str, str] = {}


def staged(stage: Callable) -> Callable:
    """The stage with its stored tables in a folder of their own, after the folder of the stage before is deleted."""

    @wraps(stage)
    def in_folder(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = LEFT.pop(app, None)
        if before is not None and not any(before.rsplit("/", 1)[1] in file for file in docs.inputFiles()):
            remove(spark, before)
        with table_folder(spark) as folder:
            LEFT[app] = folder
            return stage(spark, docs, sf_dir)

    return in_folder


STAGES = [
    ("quality_rules", staged(quality)),
    ("line_dedup", staged(lines)),
    ("jaccard_join", staged(near_duplicates)),
    ("source_mixing", staged(mixture)),
    ("byte_bpe", staged(tokens)),
]

#: Robust estimates, the mixture and the recursive encoder have no SQL over these tables alone; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
