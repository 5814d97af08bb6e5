"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The bootstrap runs the formal 2000 replicates, so its seconds compare with the published primary run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from pairpref.catalog import tables  # noqa: E402
from pairpref.catalog.descriptive import statistics  # noqa: E402
from pairpref.operators import leaderboard as boards  # noqa: E402
from pairpref.operators.bootstrap import BootstrapConfig, rank_summary, run_bootstrap, score_intervals  # noqa: E402
from pairpref.operators.estimate import EstimatorConfig, fit  # noqa: E402
from pairpref.operators.population import BASE_RESEARCH, JUDGE_CLUSTER_RESEARCH  # noqa: E402
from pairpref.operators.robustness import pairwise_ordering, rank_distribution, top_k_inclusion  # noqa: E402
from pairpref.operators.views import NO_REPEATED_QUESTIONS, apply_view, pair_support_view  # noqa: E402
from pairpref.schema import FORMAL_REPLICATES  # noqa: E402
from pairpref.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    replicates = int(os.environ.get("BENCH_REPLICATES", FORMAL_REPLICATES))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    seconds: dict[str, float] = {}

    def timed(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        start = time.time()
        frame = build()
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        return frame

    # The study starts from a Parquet snapshot of battles; deriving one from the star schema is set-up.
    start = time.time()
    tables.raw_table(spark, sf_dir)
    setup = round(time.time() - start, 3)
    start = time.time()
    rows = tables.canonical_table(spark, sf_dir).count()
    seconds["canonical_battles"] = round(time.time() - start, 3)
    base = tables.population(spark, sf_dir, BASE_RESEARCH)
    judged = tables.population(spark, sf_dir, JUDGE_CLUSTER_RESEARCH)
    timed("population_audit", lambda: base.audit)
    timed("population_summary", lambda: base.summary)
    timed("view_no_repeated_questions", lambda: apply_view(base, NO_REPEATED_QUESTIONS).summary)
    timed("view_pair_support", lambda: apply_view(base, pair_support_view(50)).summary)
    timed("leaderboard", lambda: boards.ranked(statistics(spark, sf_dir)))
    timed("topic_shares", lambda: boards.proportions(tables.cleaned(spark, sf_dir), "topic_name"))
    timed("point_fit", lambda: fit(base.eligible, EstimatorConfig("davidson")))
    by = ("language_canonical",)
    timed("fit_by_language", lambda: fit(base.eligible, EstimatorConfig("davidson"), by))
    start = time.time()
    boot = run_bootstrap(judged.eligible, BootstrapConfig(replicates, 42))
    seconds["bootstrap"] = round(time.time() - start, 3)
    summary = boot.summary.first()
    scores = boot.scores.selectExpr("'run' as run_id", "*")
    timed("score_intervals", lambda: score_intervals(boot.scores))
    timed("rank_summary", lambda: rank_summary(boot.scores))
    timed("rank_distribution", lambda: rank_distribution(scores))
    timed("top_k", lambda: top_k_inclusion(scores))
    timed("pairwise_ordering", lambda: pairwise_ordering(scores))
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "setup_seconds": setup,
        "battles": rows,
        "battles_per_second": round(rows / seconds["canonical_battles"]),
        "replicates": summary["attempted"],
        "failed_replicates": summary["failed"],
        "seconds_per_replicate": round(seconds["bootstrap"] / replicates, 5),
    }))


if __name__ == "__main__":
    main()
