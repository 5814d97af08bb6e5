"""Result tables for readers, their display form, and the lineage of every printed cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.operators.compare import against_primary

# --- fixed values: ids, columns (id, heading, type, display form) and claims of the published tables ------------
INTEGER, DECIMAL, DIGEST, LABEL, TEXT = "integer.v1", "decimal6_half_even.v1", "sha256.v1", "label.v1", "markdown_text.v1"
TABLES: dict[str, tuple[tuple[str, str, str, str], ...]] = {
    "primary-results": (
        ("point_rank", "Point rank", "integer", INTEGER),
        ("model_id", "Model", "string", LABEL),
        ("point_score", "Point score", "number", DECIMAL),
        ("score_ci_low", "Score CI low", "number", DECIMAL),
        ("score_ci_high", "Score CI high", "number", DECIMAL),
        ("rank_median", "Rank median", "number", DECIMAL),
        ("rank_ci_low", "Rank CI low", "number", DECIMAL),
        ("rank_ci_high", "Rank CI high", "number", DECIMAL),
        ("probability_rank_1", "P(rank=1)", "number", DECIMAL),
    ),
    "robustness-ranks": (
        ("analysis_label", "Analysis", "string", LABEL),
        ("primary_rank", "Primary rank", "integer", INTEGER),
        ("model_id", "Model", "string", LABEL),
        ("point_rank", "Point rank", "integer", INTEGER),
    ),
    "english-subgroup-ranks": (
        ("primary_rank", "Primary rank", "integer", INTEGER),
        ("model_id", "Model", "string", LABEL),
        ("s6_rank", "English rank", "integer", INTEGER),
    ),
    "provenance": (("field", "Field", "string", LABEL), ("value", "Value", "string", TEXT)),
}
# Fields of the provenance table, by the claim that binds them.
PROVENANCE_FIELDS: dict[str, tuple[str, ...]] = {
    "provenance.e0_identity": ("source_dataset", "source_revision", "source_snapshot_id", "source_file_sha256"),
    "provenance.e1_identity": ("bundle_name", "e1_payload_inventory_sha256", "primary_run_id", "s6_run_id"),
    "provenance.e2_identity": ("artifact_instance_id", "derivation_spec_id", "e2_payload_inventory_sha256"),
}
# Which columns of which table a claim rests on; None keeps every row.
CLAIMS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    **{claim: ("provenance", ("field", "value"), f"field in {fields}") for claim, fields in PROVENANCE_FIELDS.items()},
    "primary.top_three": ("primary-results", ("point_rank", "model_id"), "point_rank <= 3"),
    "primary.score_uncertainty": (
        "primary-results", ("model_id", "point_score", "score_ci_low", "score_ci_high"), None,
    ),
    "primary.rank_uncertainty": (
        "primary-results",
        ("model_id", "point_rank", "rank_median", "rank_ci_low", "rank_ci_high", "probability_rank_1"),
        None,
    ),
    "robustness.point_ranks": (
        "robustness-ranks", ("analysis_label", "primary_rank", "model_id", "point_rank"), None,
    ),
    "s6.rank_comparison": ("english-subgroup-ranks", ("primary_rank", "model_id", "s6_rank"), None),
}
# --- end of fixed values ---

TYPES = {"integer": "bigint", "number": "double", "string": "string"}


def model_results(points: DataFrame, intervals: DataFrame, ranks: DataFrame) -> DataFrame:
    """Point estimate, score interval and rank summary per run and model."""
    keys = ["run_id", "model_id"]
    joined = points.join(intervals, keys).join(ranks, keys)
    return joined.select(
        *keys,
        F.col("rank").alias("point_rank"),
        F.col("score").alias("point_score"),
        "score_ci_low",
        "score_ci_high",
        F.col("median_rank").alias("rank_median"),
        F.col("lower_rank_quantile").alias("rank_ci_low"),
        F.col("upper_rank_quantile").alias("rank_ci_high"),
        "probability_rank_1",
    )


def result_violations(results: DataFrame) -> DataFrame:
    """Results with crossed bounds, or runs whose point ranks are not 1 .. M."""
    sizes = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("m"), F.count_distinct("point_rank").alias("d"), F.max("point_rank").alias("h")
    )
    c = F.col
    fine = (
        (c("score_ci_low") <= c("score_ci_high"))
        & (c("rank_ci_low") >= 1)
        & (c("rank_ci_low") <= c("rank_median"))
        & (c("rank_median") <= c("rank_ci_high"))
        & (c("rank_ci_high") <= c("m"))
        & c("probability_rank_1").between(0, 1)
        & (c("d") == c("m"))
        & (c("h") == c("m"))
    )
    checked = results.join(F.broadcast(sizes), "run_id")  # one row per run
    return checked.where(~F.coalesce(fine, F.lit(False))).select("run_id", "model_id")


def robustness_rows(points: DataFrame, primary: str) -> DataFrame:
    """(run_id, primary_rank, model_id, point_rank, rank_delta) for every run, the primary included."""
    base = points.where(F.col("run_id") == primary).select("model_id", F.col("rank").alias("primary_rank"))
    rows = points.join(base, "model_id")
    return rows.select(
        "run_id", "primary_rank", "model_id", F.col("rank").alias("point_rank"),
        (F.col("rank") - F.col("primary_rank")).alias("rank_delta_vs_primary"),
    )


def universe_differences(points: DataFrame, primary: str) -> DataFrame:
    """Models that a run lacks or has beyond the primary run."""
    base = points.where(F.col("run_id") == primary).select("model_id")
    runs = points.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id")
    run_list = runs.agg(F.collect_set("run_id").alias("r"))  # run ids of one study
    wanted = base.withColumn("run_id", F.explode(run_list.scalar()))
    have = points.select("run_id", "model_id")
    missing = wanted.select("run_id", "model_id").exceptAll(have).withColumn("difference", F.lit("missing"))
    return missing.unionByName(have.exceptAll(wanted.select("run_id", "model_id")).withColumn("difference", F.lit("extra")))


def subgroup_rows(points: DataFrame, primary: str, subgroup: str) -> DataFrame:
    rows = against_primary(points.where(F.col("run_id").isin(primary, subgroup)), primary)
    return rows.select(
        "primary_rank", "model_id", F.col("rank").alias("s6_rank"),
        (F.col("rank") - F.col("primary_rank")).alias("rank_delta"),
    )


def provenance_rows(runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value) pairs of a one-row selection of the runs table."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return runs.select(F.inline(F.array(*pairs)))


def delta_matrix(rows: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """Models by runs: rank displacement against the primary run."""
    return rows.groupBy("model_id", "primary_rank").pivot("run_id", list(run_ids)).agg(F.first("rank_delta_vs_primary"))


def table_violations(rows: DataFrame) -> DataFrame:
    """Runs whose robustness rows are not a whole ranking or whose deltas do not add up."""
    broken = F.count_if(F.col("rank_delta_vs_primary") != F.col("point_rank") - F.col("primary_rank"))
    facts = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("primary_rank").alias("d"),
        F.min("primary_rank").alias("lo"),
        F.max("primary_rank").alias("hi"),
        F.count_distinct("model_id").alias("m"),
        broken.alias("broken"),
    )
    whole = (F.col("d") == F.col("n")) & (F.col("m") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    return facts.where(~whole | (F.col("broken") > 0)).select("run_id")


def publication_tables(
    results: DataFrame, rows: DataFrame, subgroup: DataFrame, provenance: DataFrame, labels: DataFrame, primary: str
) -> dict[str, DataFrame]:
    """The four published tables in reading order; ``labels`` is (run_id, analysis_no, analysis_label)."""
    main = results.where(F.col("run_id") == primary).orderBy("point_rank")
    cross = rows.join(F.broadcast(labels), "run_id").orderBy("analysis_no", "primary_rank")
    typed = lambda table: [F.col(name).cast(TYPES[kind]).alias(name) for name, _, kind, _ in TABLES[table]]
    return {
        "primary-results": main.select(*typed("primary-results")),
        "robustness-ranks": cross.select(*typed("robustness-ranks")),
        "english-subgroup-ranks": subgroup.orderBy("primary_rank").select(*typed("english-subgroup-ranks")),
        "provenance": provenance.select(*typed("provenance")),
    }


def display(value: Column, format_id: str) -> Column:
    """Printed form: integers as they are, numbers with six decimals rounded half to even, digests whole or null, text escaped."""
    if format_id == DECIMAL:
        exact = value.cast("double").cast("string").cast(T.DecimalType(38, 18))
        return F.bround(exact, 6).cast(T.DecimalType(38, 6)).cast("string")
    if format_id == INTEGER:
        return value.cast("bigint").cast("string")
    if format_id == DIGEST:
        digest = value.cast("string")
        return F.when(digest.rlike("^[0-9a-f]{64}$"), digest)
    return F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))


def displayed(table_id: str, table: DataFrame) -> DataFrame:
    return table.select(*[display(F.col(name), kind).alias(name) for name, *_, kind in TABLES[table_id]])


def markdown_lines(table_id: str, table: DataFrame) -> DataFrame:
    """One line per row; header lines belong to the caller."""
    cells = [display(F.col(name), kind) for name, *_, kind in TABLES[table_id]]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def row_id(table_id: str) -> Column:
    if table_id == "provenance":
        return F.concat(F.lit("field:"), F.col("field"))
    model = F.concat(F.lit("model:"), F.col("model_id"))
    return F.concat(F.col("analysis_label"), F.lit(":"), model) if table_id == "robustness-ranks" else model


def table_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_id, row_id, column_id, value) of every cell of the published tables."""
    frames = []
    for table_id, table in tables.items():
        pairs = [
            F.struct(F.lit(name).alias("column_id"), F.col(name).cast("string").alias("value"))
            for name, *_ in TABLES[table_id]
        ]
        frames.append(table.select(F.lit(table_id).alias("table_id"), row_id(table_id).alias("row_id"), F.inline(F.array(*pairs))))
    return _union(frames)


def cell_lineage(tables: dict[str, DataFrame]) -> DataFrame:
    """(claim_id, table_id, row_id, column_id, expected_value): each cell a claim binds."""
    frames = []
    for claim, (table_id, columns, rows) in CLAIMS.items():
        table = tables[table_id] if rows is None else tables[table_id].where(rows)
        pairs = [
            F.struct(F.lit(name).alias("column_id"), F.col(name).cast("string").alias("expected_value")) for name in columns
        ]
        frames.append(table.select(
            F.lit(claim).alias("claim_id"), F.lit(table_id).alias("table_id"), row_id(table_id).alias("row_id"),
            F.inline(F.array(*pairs)),
        ))
    return _union(frames)


def lineage_mismatches(lineage: DataFrame, cells: DataFrame) -> DataFrame:
    """Bound cells that the tables lack or show differently."""
    joined = lineage.join(cells, ["table_id", "row_id", "column_id"], "left")
    return joined.where(~F.col("expected_value").eqNullSafe(F.col("value")))


def row_claims(lineage: DataFrame) -> DataFrame:
    """(table_id, row_id, claims): which claims each row belongs to."""
    claims = F.array_join(F.array_sort(F.collect_set("claim_id")), ",")
    return lineage.groupBy("table_id", "row_id").agg(claims.alias("claims"))


def select_primary_rows(results: DataFrame, *, top_n: int | None = None, model_id: str | None = None) -> DataFrame:
    """Reader's selection from the primary table: the first n ranks, one model, or both."""
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be positive")
    rows = results if top_n is None else results.where(F.col("point_rank") <= top_n)
    return rows if model_id is None else rows.where(F.col("model_id") == model_id)


def select_robustness_rows(rows: DataFrame, *, run_id: str | None = None, model_id: str | None = None) -> DataFrame:
    rows = rows if run_id is None else rows.where(F.col("run_id") == run_id)
    return rows if model_id is None else rows.where(F.col("model_id") == model_id)


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
