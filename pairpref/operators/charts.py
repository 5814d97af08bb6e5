"""The data behind the charts; drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTOGRAM_BINS = 30


def top_by_battles(statistics: DataFrame, limit: int = 10) -> DataFrame:
    return statistics.orderBy(F.desc("battle_count"), "model_name").limit(limit)


def top_by_score_rate(statistics: DataFrame, limit: int = 10) -> DataFrame:
    """Best score rates among models with at least max(10, half the median number of battles)."""
    median = statistics.agg(F.percentile("battle_count", 0.5).alias("m"))
    least = median.select(F.greatest(F.lit(10), (F.col("m") * 0.5).cast("int"))).scalar()
    kept = statistics.withColumn("threshold", least).where(F.col("battle_count") >= F.col("threshold"))
    return kept.orderBy(F.desc("score_rate"), F.desc("battle_count"), "model_name").limit(limit)


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(limit)


def length_difference_box(df: DataFrame) -> DataFrame:
    """Quartiles per vote after trimming to the 1 % - 99 % range, both ends kept.

    Quantiles are exact. They are taken from a table of value counts, so their size follows the number of
    different values, not the number of battles.
    """
    counts = df.where(F.col("len_diff").isNotNull()).groupBy("winner", "len_diff").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.percentile("len_diff", [0.01, 0.99], F.col("n")).alias("b"))
    low, high = bounds.select(F.col("b")[0]).scalar(), bounds.select(F.col("b")[1]).scalar()
    kept = counts.where(F.col("len_diff").between(low, high))
    quartiles = F.percentile("len_diff", [0.25, 0.5, 0.75], F.col("n"))
    return kept.groupBy("winner").agg(
        F.sum("n").alias("rows"),
        F.min("len_diff").alias("lowest"),
        quartiles[0].alias("q1"),
        quartiles[1].alias("median"),
        quartiles[2].alias("q3"),
        F.max("len_diff").alias("highest"),
    )


def length_histogram(df: DataFrame, column: str = "prompt_len", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the last bin is closed. Empty bins show 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    # A single value has no width; it is put in the middle of a unit-wide range.
    width = F.when(high > low, (high - low) / bins).otherwise(1.0 / bins)
    start = F.when(high > low, low.cast("double")).otherwise(low - 0.5)
    slot = F.least(F.floor((F.col("v") - start) / width), F.lit(bins - 1)).cast("int")
    filled = counts.groupBy(slot.alias("bin")).agg(F.sum("n").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("bin_start"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def score_bars(statistics: DataFrame) -> DataFrame:
    top = statistics.orderBy(F.desc("score_rate"), F.desc("battle_count"), "model_name").limit(10)
    return top.select("model_name", F.round("score_rate", 3).alias("score_rate"))


def battles_against_score(statistics: DataFrame, limit: int = 30) -> DataFrame:
    return top_by_battles(statistics, limit).select("model_name", "battle_count", "score_rate")
