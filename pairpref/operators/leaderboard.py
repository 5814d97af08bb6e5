"""Descriptive aggregates: model statistics, vote / language / topic / time summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.functions.text import present
from pairpref.schema import A_WIN, B_WIN, OUTCOMES, TIE


def _rows() -> Column:
    return F.count(F.lit(1))


def model_statistics(battles: DataFrame) -> DataFrame:
    """Battles, wins, losses, ties and score rate per model.

    Each battle counts for both of its models; rows without two named models or with another outcome are
    passed over.
    """
    outcome_name = "canonical_outcome" if "canonical_outcome" in battles.columns else "winner"
    outcome = F.col(outcome_name)
    named = present(F.col("model_a")) & present(F.col("model_b"))
    side = lambda model, win, loss: F.struct(
        F.col(model).alias("model_name"),
        (outcome == win).cast("int").alias("win"),
        (outcome == loss).cast("int").alias("lose"),
        (outcome == TIE).cast("int").alias("tie"),
    )
    sides = battles.where(named & outcome.isin(A_WIN, B_WIN, TIE)).select(
        F.inline(F.array(side("model_a", A_WIN, B_WIN), side("model_b", B_WIN, A_WIN)))
    )
    counts = sides.groupBy("model_name").agg(
        _rows().alias("battle_count"),
        F.sum("win").alias("win_count"),
        F.sum("lose").alias("lose_count"),
        F.sum("tie").alias("tie_count"),
    )
    score = F.col("win_count") + 0.5 * F.col("tie_count")
    return counts.withColumns(
        {
            "win_rate": F.col("win_count") / F.col("battle_count"),
            "tie_rate": F.col("tie_count") / F.col("battle_count"),
            "score": score,
            "score_rate": score / F.col("battle_count"),
        }
    )


def ranked(statistics: DataFrame) -> DataFrame:
    """Best first; the name settles what the rates leave open."""
    return statistics.orderBy(F.desc("score_rate"), F.desc("battle_count"), "model_name")


def proportions(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value, missing values included."""
    counts = df.groupBy(column).agg(_rows().alias("count"))
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.withColumn("proportion", F.col("count") / total)


def value_counts(df: DataFrame, column: str, *, keep_missing: bool = True) -> DataFrame:
    df = df if keep_missing else df.where(F.col(column).isNotNull())
    return df.groupBy(column).agg(_rows().alias("count"))


def topic_by_vote(df: DataFrame, topic: str = "topic_name", winner: str = "winner") -> DataFrame:
    """Cross table with one column per outcome of the closed set; absent cells are zero."""
    counts = df.where(F.col(topic).isNotNull() & F.col(winner).isNotNull())
    return counts.groupBy(topic).pivot(winner, list(OUTCOMES)).agg(_rows()).na.fill(0)


def summary_tables(cleaned: DataFrame) -> dict[str, DataFrame]:
    """The summary tables of the descriptive report, over all cleaned rows."""
    return {
        "vote_statistics": proportions(cleaned, "winner"),
        "language_statistics": proportions(cleaned, "language"),
        "topic_statistics": proportions(cleaned, "topic_name"),
        "daily_statistics": value_counts(cleaned, "battle_date", keep_missing=False),
        "hourly_statistics": value_counts(cleaned, "battle_hour", keep_missing=False),
        "topic_vote_crosstab": topic_by_vote(cleaned),
    }


def top_by_score(statistics: DataFrame, *, min_battles: int, limit: int) -> DataFrame:
    """Leaderboard of models with enough battles."""
    return ranked(statistics.where(F.col("battle_count") >= min_battles)).limit(limit)


def overview(cleaned: DataFrame) -> DataFrame:
    """One row of headline numbers. Each distinct count is taken over a pre-aggregated list."""
    models = (
        cleaned.groupBy("model_a", "model_b")
        .agg(F.lit(1).alias("one"))
        .select(F.explode(F.array("model_a", "model_b")).alias("model"))
    )
    distinct = lambda df, name: df.agg(F.count_distinct(name).alias("n")).scalar()
    return cleaned.agg(_rows().alias("rows")).select(
        "rows",
        distinct(models, "model").alias("models"),
        distinct(cleaned, "language").alias("languages"),
        distinct(cleaned, "topic_name").alias("topics"),
    )


def outcome_counts(eligible: DataFrame, likelihood: tuple[str, ...]) -> DataFrame:
    """Per outcome: population rows, rows in the likelihood, rows the outcome policy leaves out."""
    counts = eligible.groupBy("canonical_outcome").agg(_rows().alias("n"))
    used = F.col("canonical_outcome").isin(*likelihood)
    return counts.select(
        "canonical_outcome",
        F.col("n").alias("population_rows"),
        F.when(used, F.col("n")).otherwise(0).alias("likelihood_rows"),
        F.when(used, 0).otherwise(F.col("n")).alias("excluded_rows"),
    )
