"""Sources, sinks and run identity."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.descriptive import statistics
from pairpref.catalog.populations import summary_sql
from pairpref.catalog.tables import (
    CLEANED,
    LEADERBOARD,
    canonical_table,
    cleaned_references,
    cleaned_texts,
    facts_table,
    population_sql,
)
from pairpref.catalog.uncertainty import SCORES, points, scores
from pairpref.fixtures import PROVENANCE, table
from pairpref.functions.identity import canonical_json, label_seed
from pairpref.operators.bootstrap import BootstrapConfig
from pairpref.operators.canonical import TEXTS, with_texts
from pairpref.operators.estimate import EstimatorConfig
from pairpref.operators.leaderboard import proportions
from pairpref.operators.population import JUDGE_CLUSTER_RESEARCH, POPULATIONS, apply_population
from pairpref.plans.formal import RunConfig, run_analysis
from pairpref.schema import ARENA_BATTLE
from pairpref.session import ensure_checkpoint_dir, text_bytes, texts_fit
from pairpref.sources import files
from pairpref.sources.relational import arena_tables, dealt_out, save_tables, shaped
from pairpref.sources.runs import (
    Manifest,
    RunError,
    consistency_violations,
    load_runs,
    manifest_violations,
    registry_differences,
    run_id_for,
    verify_runs,
    write_run,
)


def scratch(spark) -> str:
    """A new folder in the shared place, for round trips of sinks."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/trip-{uuid.uuid4().hex}"


@query("s01_csv", """
select page_id, url, length(html)::bigint html_chars, md5(html) html_md5 from pages""")
def csv_round_trip(spark, sf):
    """Whole pages with quotes and line breaks, out to CSV and back."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    path = scratch(spark)
    files.write_csv(pages, path)
    back = files.read_csv(spark, path, pages.schema)
    return back.select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"), F.md5("html").alias("html_md5"))


BUCKETS = 40
_FILES = f"""
with f as (select 'bucket=' || page_id % {BUCKETS} path, string_agg(replace(coalesce(html, ''), chr(10), ' '), chr(10) order by page_id) || chr(10) text
  from pages group by page_id % {BUCKETS}),
files as (select path, octet_length(encode(text))::bigint size_bytes, sha256(text) sha256 from f)
"""


def page_files(spark, sf):
    """A folder with one text file per bucket of pages, each page a line, in shared storage."""
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") % BUCKETS).alias("bucket"), "page_id", F.translate(F.coalesce("html", F.lit("")), "\n", " ").alias("line"))
    lines = pages.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "page_id").select("bucket", "line")
    path = scratch(spark)
    lines.write.partitionBy("bucket").text(path)
    return path


def _by_folder(found):
    """File names are the writer's own; the folder of each file is known."""
    return found.withColumn("path", F.substring_index("path", "/", 1))


@query("s03_source_hash", _FILES + """
select path, sha256, true accepted, true other_refused from files where path in ('bucket=0', 'bucket=1')
union all select 'folder', null, true, true from (select count(*) n from files) where n > 0""")
def source_hash(spark, sf):
    """The hash gate accepts a file by its own hash and a folder of files by its digest, and refuses another hash."""
    path = page_files(spark, sf)
    rows = []
    for name, place in (("bucket=0", f"{path}/bucket=0"), ("bucket=1", f"{path}/bucket=1"), ("folder", path)):
        if name != "folder":  # the one file in it
            place = spark.read.format("binaryFile").load(f"{place}/*.txt").select("path").first()["path"]
        declared, accepted = files.source_hash(spark, place), True
        files.check_source(spark, place, declared)
        try:
            files.check_source(spark, place, "0" * 64)
            refused = False
        except ValueError:
            refused = True
        rows.append((name, declared if name != "folder" else None, accepted, refused))
    return spark.createDataFrame(rows, "path string, sha256 string, accepted boolean, other_refused boolean")


@query("s04_csv_sink", LEADERBOARD + "select model_name, battle_count, win_count, lose_count, tie_count from leaderboard")
def csv_sink(spark, sf):
    path = scratch(spark)
    rows = statistics(spark, sf)
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema).select("model_name", "battle_count", "win_count", "lose_count", "tie_count")


def _tables(spark, sf, rows=None):
    rows = cleaned_texts(spark, sf) if rows is None else rows
    return arena_tables(rows, statistics(spark, sf), proportions(rows, "topic_name"))


@query("s05_relational_tables", f"""
select 'model_statistics' "table", * from ({LEADERBOARD} select model_name "name", battle_count::bigint "rows", round(score::double, 6) "value" from leaderboard)
union all select 'topic_statistics', * from ({CLEANED} select topic_name, count(*)::bigint, round(count(*) / (select count(*) from cleaned), 6) from cleaned group by 1)
union all select 'arena_battle', * from ({CLEANED} select winner, count(*)::bigint, null::double from cleaned group by 1)""")
def relational_tables(spark, sf):
    """The three frames handed to the relational sink, each by what names its rows."""
    tables = _tables(spark, sf)
    battles, models, topics = (tables[name] for name in ("arena_battle", "model_statistics", "topic_statistics"))
    rows = lambda name, df: df.withColumn("table", F.lit(name))
    return (
        rows("model_statistics", models.select(F.col("model_name").alias("name"), F.col("battle_count").cast("bigint").alias("rows"), F.round(F.col("score").cast("double"), 6).alias("value")))
        .unionByName(rows("topic_statistics", topics.select(F.col("topic_name").alias("name"), F.col("count").alias("rows"), F.round("proportion", 6).alias("value"))))
        .unionByName(rows("arena_battle", battles.groupBy(F.col("winner").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("value"))))
    )


@query("s07_saved_tables", f"""
select model_name, battle_count, coalesce(as_model_a, 0)::bigint as_model_a
from ({LEADERBOARD} select model_name, battle_count::bigint battle_count from leaderboard)
left join ({CLEANED} select model_a, count(*) as_model_a from cleaned group by 1) on model_a = model_name""")
def saved_tables(spark, sf):
    """Bucketed saved tables, joined on the model they are bucketed by."""
    prefix, buckets = f"t_{uuid.uuid4().hex}_", 8
    rows, facts = cleaned_references(spark, sf), facts_table(spark, sf)
    if texts_fit(facts, *TEXTS):
        facts = F.broadcast(facts)
        _, size = text_bytes(with_texts(rows, facts), *TEXTS)
        rows = dealt_out(rows, "arena_battle", buckets, size, "source_row_index")
    found = _tables(spark, sf, with_texts(rows, facts))
    tables = {name: frame for name, frame in found.items() if name != "topic_statistics"}
    save_tables(tables, prefix=prefix, buckets=buckets, folder=scratch(spark))
    battles, models = spark.table(f"{prefix}arena_battle"), spark.table(f"{prefix}model_statistics")
    joined = models.join(battles, F.col("model_a") == F.col("model_name"), "left")
    return joined.groupBy("model_name", F.col("battle_count").cast("bigint").alias("battle_count")).agg(F.count("model_a").alias("as_model_a"))


_STORED_VALUES = {f.name: f"count({f.name})" for f in ARENA_BATTLE} | {
    "record_id": "count(*)", "topic_cluster": "count(*) * 0", "language": 'count("language")',
    "response_a_text": "count(*)", "response_b_text": "count(*)",
}


@query("s07_table_shapes", CLEANED + " union all ".join(
    f"select {i}::int \"position\", '{f.name}' \"column\", '{f.dataType.simpleString()}' \"type\","
    f" ({_STORED_VALUES[f.name]})::bigint \"values\" from cleaned"
    for i, f in enumerate(ARENA_BATTLE)
))
def table_shapes(spark, sf):
    """Stored battles per column: how many values each has, in the declared order."""
    battles = shaped(cleaned_texts(spark, sf).withColumn("record_id", F.col("source_row_index")), ARENA_BATTLE)
    assert battles.columns == ARENA_BATTLE.fieldNames()
    entry = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.count(f.name).alias("values"))
        for i, f in enumerate(ARENA_BATTLE)
    ]
    return battles.agg(F.array(*entry).alias("c")).select(F.inline("c"))


@query("s08_registry", SCORES + """
select 's9' run_id, 'missing' difference union all select 's2', 'extra' from (select distinct run_id from points where run_id = 's2')""")
def registry(spark, sf):
    found = points(spark, sf).select("run_id").distinct()
    registered = found.where(F.col("run_id") != "s2").unionByName(spark.range(1).select(F.lit("s9").alias("run_id")))
    return registry_differences(registered, found)


@query("s08_load_runs", population_sql(judge=True) + """,
m as (select count(*) k from (select model_a_id from eligible union select model_b_id from eligible))
select unnest(['as registered', 'one missing', 'one extra', 'one altered']) "case",
  unnest(['OK', 'RUN_SET_MISMATCH', 'RUN_SET_MISMATCH', 'ARTIFACT_CONSISTENCY_ERROR']) "code", unnest([6 * k, null, null, null])::bigint score_rows from m""")
def loaded_runs(spark, sf):
    """Two stored runs of three replicates loaded as registered, with one missing, one extra and one altered."""
    root, battles = scratch(spark), canonical_table(spark, sf)
    runs = []
    for seed in (7, 8):
        config = RunConfig(f"seed-{seed}", BootstrapConfig(3, seed, estimator=EstimatorConfig("davidson")), JUDGE_CLUSTER_RESEARCH)
        run = run_analysis(battles, PROVENANCE, config, commit="c" * 40, branch="main")
        write_run(spark, root, run.run_id, run.tables)
        runs.append(run.run_id)
    rows = []
    for case, ids in (("as registered", runs), ("one missing", [*runs, "f" * 64]), ("one extra", runs[:1]), ("one altered", runs)):
        if case == "one altered":
            spark.range(1).write.mode("append").parquet(f"{root}/scores/run_id={runs[0]}")
        try:
            rows.append((case, "OK", load_runs(spark, root, ids)["scores"].count()))
        except RunError as error:
            rows.append((case, error.code, None))
    return spark.createDataFrame(rows, "case string, code string, score_rows long")


@query("s09_inventory", _FILES + "select path, size_bytes, sha256 from files")
def file_inventory(spark, sf):
    return _by_folder(files.inventory(spark, page_files(spark, sf), pattern="*.txt")).select("path", "size_bytes", "sha256")


FILES_DIGEST = _FILES + """,
digests as (select count(*) files, sha256('[' || string_agg('{"path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}', ',' order by path) || ']') digest
  from files)
"""


def digest_of_page_files(spark, sf):
    return files.inventory_digest(_by_folder(files.inventory(spark, page_files(spark, sf), pattern="*.txt")))


@query("s10_inventory_digest", FILES_DIGEST + "select files, digest from digests")
def inventory_digest(spark, sf):
    return digest_of_page_files(spark, sf)


@query("s11_closed_world", """
with t as (select o_orderkey k, o_custkey s from orders),
d as (select 'f' || k path, s size, md5(s::varchar) h from t where k % 7 <> 0),
a as (select 'f' || k path, s + case when k % 11 = 0 then 1 else 0 end size,
  case when k % 5 = 0 then 'x' else md5(s::varchar) end h from t where k % 13 <> 0)
select coalesce(d.path, a.path) path, case when a.path is null then 'missing' when d.path is null then 'extra'
  when d.size <> a.size then 'size_mismatch' when d.h <> a.h then 'hash_mismatch' else 'ok' end status
from d full outer join a on d.path = a.path""")
def closed_world(spark, sf):
    """Inventories of one entry per order, with every kind of difference."""
    orders = table(spark, sf, "orders")
    k, s = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    digest = F.md5(s.cast("string"))
    declared = orders.where(k % 7 != 0).select(path, s.alias("size_bytes"), digest.alias("sha256"))
    actual = orders.where(k % 13 != 0).select(
        path, (s + F.when(k % 11 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 5 == 0, "x").otherwise(digest).alias("sha256")
    )
    return files.compare_inventories(declared, actual)


RUN = RunConfig("primary", BootstrapConfig(8, 7, estimator=EstimatorConfig("davidson")), JUDGE_CLUSTER_RESEARCH)


@query("s06_run_store", """
select unnest(['manifest', 'point', 'fits', 'scores', 'statuses', 'score_intervals', 'rank_summary', 'pairwise']) "table", 'ok' status, true present
from (select count(*) n from orders) where n > 0""")
def run_store(spark, sf):
    """A run written, published and verified: the status of each of its files by table."""
    run = run_analysis(canonical_table(spark, sf), PROVENANCE, RUN, commit="c" * 40, branch="main")
    root = scratch(spark)
    write_run(spark, root, run.run_id, run.tables)
    names = verify_runs(spark, root, [run.run_id]).select(F.substring_index("path", "/", 1).alias("table"), "status")
    return names.groupBy("table", "status").agg((F.count(F.lit(1)) > 0).alias("present"))


def _run_id(spec):
    return run_id_for(
        snapshot=PROVENANCE.snapshot_id, population_id=spec.population_id,
        population_spec_version=spec.population_spec_version, git_commit="c" * 40, analysis_config={"seed": 42},
    )


def _identity_sql(name: str) -> str:
    """The identity of a run definition written out as its canonical JSON."""
    snapshot = f"sha256('{canonical_json(asdict(PROVENANCE))}')"
    head = '{"analysis_config":{"seed":42},"canonical_schema_version":2,"git_commit":"' + "c" * 40 + '","population_id":"'
    tail = '","population_spec_version":2,"source_snapshot_id":"'
    return f"sha256('{head}{name}{tail}' || {snapshot} || '\"}}')"


_RUN_IDS = " union all ".join(
    f"select population_id, eligible_rows, {_identity_sql(name)} run_id from ({summary_sql(name, **options)})"
    for name, options in (
        ("base_research", {}),
        ("legacy_score", {"legacy": True}),
        ("judge_cluster_research", {"judge": True}),
        ("language_research", {"language": True}),
    )
)


@query("i01_run_ids", _RUN_IDS)
def run_ids(spark, sf):
    """Run ids of the four populations with their sizes; any change of definition changes the id."""
    frames = []
    for spec in POPULATIONS.values():
        size = apply_population(canonical_table(spark, sf), spec).summary.select("population_id", "eligible_rows")
        frames.append(size.withColumn("run_id", F.lit(_run_id(spec))))
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query("i02_manifests", """
select case n_nationkey % 3 when 1 then 'SNAPSHOT_MISMATCH' else 'RUN_ID_MISMATCH' end violation, count(*) manifests
from nation where n_nationkey % 3 <> 0 group by 1""")
def manifests(spark, sf):
    """One manifest per nation: a third is intact, a third has another source, a third another commit."""
    manifest = Manifest.of(PROVENANCE, JUDGE_CLUSTER_RESEARCH, "c" * 40, "main", RUN.to_dict()).frame(spark)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    fields = {name: F.lit(value) for name, value in manifest.first().asDict().items()}
    many = nations.withColumns(fields).withColumns({
        "source_revision": F.when(F.col("k") % 3 == 1, "altered").otherwise(F.col("source_revision")),
        "git_commit": F.when(F.col("k") % 3 == 2, "d" * 40).otherwise(F.col("git_commit")),
    })
    return manifest_violations(many.drop("k")).groupBy("violation").agg(F.count(F.lit(1)).alias("manifests"))


@query("i03_formal_run", population_sql(judge=True) + """,
m as (select count(*) k from (select model_a_id from eligible union select model_b_id from eligible))
select t.name "table", t.n "rows" from m, lateral (
  select unnest(['manifest', 'point', 'fits', 'scores', 'statuses', 'score_intervals', 'rank_summary', 'pairwise']) name,
    unnest([1, 1, 8, 8 * k, 8, k, k, k * (k - 1) // 2]) n) t""")
def formal_run(spark, sf):
    """One run from canonical battles to result tables: rows per table."""
    run = run_analysis(canonical_table(spark, sf), PROVENANCE, RUN, commit="c" * 40, branch="main")
    frames = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, frame in run.tables.items()
    ]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query("i04_seeds", """
select n_name, ('0x' || substr(sha256('study|' || n_name || '|v1'), 1, 16))::ubigint::varchar seed from nation""")
def seeds(spark, sf):
    """A preregistered seed per subgroup, by the library's own rule."""
    names = [row["n_name"] for row in table(spark, sf, "nation").select("n_name").distinct().collect()]
    return spark.createDataFrame([(name, str(label_seed(f"study|{name}|v1"))) for name in names], "n_name string, seed string")


@query("i05_consistency", SCORES + """
select run_id, case run_id when 's1' then 'ATTEMPT_COUNT' else 'MODEL_UNIVERSE' end violation
from (select distinct run_id from points) where run_id <> 'primary'""")
def consistency(spark, sf):
    """Three stored runs, one with a lost replicate and one with a model less in some replicate."""
    rows = scores(spark, sf)
    drawn = rows.where((F.col("run_id") != "s1") | (F.col("replicate") != 5))
    drawn = drawn.where((F.col("run_id") != "s2") | (F.col("replicate") != 6) | (F.col("rank") != 1))
    fits = drawn.groupBy("run_id", "replicate").agg(F.count(F.lit(1)).alias("models"))
    point = points(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("models")).withColumn("replicate", F.lit(0))
    fits = fits.unionByName(point.select(*fits.columns)).withColumn("status", F.lit("SUCCESS"))
    wanted = rows.groupBy("run_id").agg(F.count_distinct("replicate").alias("n"))
    config = F.concat(F.lit('{"bootstrap":{"replicate_count":'), F.col("n"), F.lit("}}"))
    return consistency_violations(
        wanted.select("run_id", config.alias("analysis_config")), fits, fits.where(F.col("replicate") > 0)
    )
