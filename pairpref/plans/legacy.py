"""The descriptive report: cleaned battles, topics, summaries, leaderboard, and optional extras."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairpref.operators.canonical import Provenance, canonicalize, cleaning_report, legacy_columns
from pairpref.operators.classify import PreferenceModel, train_preference_model
from pairpref.operators.leaderboard import model_statistics, ranked, summary_tables
from pairpref.operators.population import LEGACY_SCORE, apply_population
from pairpref.operators.topics import add_kmeans_topics, add_rule_topics
from pairpref.session import stored
from pairpref.sources.files import write_csv


@dataclass(frozen=True)
class Report:
    cleaned: DataFrame
    cleaning: DataFrame
    statistics: DataFrame
    summaries: dict[str, DataFrame]
    topic_keywords: DataFrame | None = None
    model: PreferenceModel | None = None


def descriptive_report(
    raw: DataFrame, provenance: Provenance, *, clustering: bool = False, classifier: bool = False
) -> Report:
    """Only the leaderboard uses the filtered population; summaries and classifier see every cleaned row."""
    canonical = stored(canonicalize(raw, provenance, measured=True).drop("conversation_a", "conversation_b"))
    cleaned = add_rule_topics(legacy_columns(canonical))
    keywords = None
    if clustering:
        cleaned, keywords = add_kmeans_topics(cleaned)
    eligible = apply_population(canonical, LEGACY_SCORE).eligible
    named = eligible.withColumns({"model_a": F.col("model_a_id"), "model_b": F.col("model_b_id")})
    return Report(
        cleaned,
        cleaning_report(raw, cleaned),
        ranked(model_statistics(named)),
        summary_tables(cleaned),
        keywords,
        train_preference_model(cleaned) if classifier else None,
    )


def write_report(report: Report, directory: str) -> None:
    """CSV tables with a header, one folder each."""
    write_csv(report.cleaned.drop("exclusion_reasons"), f"{directory}/cleaned")
    write_csv(report.statistics, f"{directory}/model_statistics")
    for name, table in report.summaries.items():
        write_csv(table, f"{directory}/{name}")
    if report.topic_keywords is not None:
        write_csv(report.topic_keywords, f"{directory}/topic_keywords")
