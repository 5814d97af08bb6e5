"""Research runs: identities, manifests, result tables partitioned by run, and their verification."""

from __future__ import annotations

import platform
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.functions.identity import canonical_json, sha256_of
from pairpref.operators.canonical import Provenance
from pairpref.operators.population import PopulationSpec
from pairpref.schema import ARTIFACT_VERSION, CANONICAL_SCHEMA_VERSION, MANIFEST_VERSION, PROVENANCE_COLUMNS
from pairpref.sources.files import compare_inventories, inventory

RUN_TABLES = ("manifest", "point", "fits", "scores", "statuses", "score_intervals", "rank_summary", "pairwise")
MANIFEST = T.StructType(
    [
        T.StructField("manifest_schema_version", T.IntegerType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in PROVENANCE_COLUMNS],
        T.StructField("source_snapshot_id", T.StringType()),
        T.StructField("canonical_schema_version", T.IntegerType()),
        T.StructField("population_id", T.StringType()),
        T.StructField("population_spec_version", T.IntegerType()),
        T.StructField("analysis_config", T.StringType()),
        T.StructField("python_version", T.StringType()),
        T.StructField("package_versions", T.StringType()),
    ]
)


class RunError(ValueError):
    def __init__(self, code: str, message: str = "") -> None:
        self.code = code
        super().__init__(f"{code}: {message}")


def run_id_for(
    *, snapshot: str, population_id: str, population_spec_version: int, git_commit: str,
    analysis_config: Mapping[str, Any], canonical_schema_version: int = CANONICAL_SCHEMA_VERSION,
) -> str:
    """The identity of a run definition: equal definitions have equal ids on any machine."""
    return sha256_of(
        {
            "analysis_config": analysis_config,
            "canonical_schema_version": canonical_schema_version,
            "git_commit": git_commit,
            "population_id": population_id,
            "population_spec_version": population_spec_version,
            "source_snapshot_id": snapshot,
        }
    )


@dataclass(frozen=True)
class Manifest:
    provenance: Provenance
    population_id: str
    population_spec_version: int
    git_commit: str
    git_branch: str
    analysis_config: Mapping[str, Any]
    created_by: str = "research-runner"

    @classmethod
    def of(cls, provenance: Provenance, spec: PopulationSpec, commit: str, branch: str, config: Mapping[str, Any]):
        return cls(provenance, spec.population_id, spec.population_spec_version, commit, branch, config)

    @property
    def run_id(self) -> str:
        return run_id_for(
            snapshot=self.provenance.snapshot_id,
            population_id=self.population_id,
            population_spec_version=self.population_spec_version,
            git_commit=self.git_commit,
            analysis_config=self.analysis_config,
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        values = asdict(self.provenance) | {
            "manifest_schema_version": MANIFEST_VERSION,
            "run_id": self.run_id,
            "created_by": self.created_by,
            "git_commit": self.git_commit,
            "git_branch": self.git_branch,
            "source_snapshot_id": self.provenance.snapshot_id,
            "canonical_schema_version": CANONICAL_SCHEMA_VERSION,
            "population_id": self.population_id,
            "population_spec_version": self.population_spec_version,
            "analysis_config": canonical_json(self.analysis_config),
            "python_version": platform.python_version(),
            "package_versions": canonical_json({"pyspark": pyspark.__version__}),
        }
        return spark.createDataFrame([tuple(values[f.name] for f in MANIFEST)], MANIFEST)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Manifests whose snapshot id or run id does not follow from their fields, or of another version.

    Ids are recomputed in one pass over all manifests; the configuration is stored as canonical text, so it is
    spliced into the identity as it is.
    """
    member = lambda name: F.concat(
        F.lit(f'"{name}":'),
        F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("")),
    )
    absent = lambda name: F.when(F.col(name).isNull(), f'"{name}":null').otherwise(member(name))
    snapshot = F.concat(F.lit("{"), F.concat_ws(",", *[absent(name) for name in sorted(PROVENANCE_COLUMNS)]), F.lit("}"))
    identity = F.concat(
        F.lit('{"analysis_config":'), F.col("analysis_config"), F.lit(","),
        F.concat_ws(
            ",",
            *[member(name) for name in (
                "canonical_schema_version", "git_commit", "population_id", "population_spec_version", "source_snapshot_id",
            )],
        ),
        F.lit("}"),
    )
    violation = (
        F.when(F.sha2(snapshot, 256) != F.col("source_snapshot_id"), "SNAPSHOT_MISMATCH")
        .when(F.col("manifest_schema_version") != MANIFEST_VERSION, "UNSUPPORTED_VERSION")
        .when(F.sha2(identity, 256) != F.col("run_id"), "RUN_ID_MISMATCH")
    )
    return manifests.select("run_id", violation.alias("violation")).where(F.col("violation").isNotNull())


def consistency_violations(manifests: DataFrame, fits: DataFrame, statuses: DataFrame) -> DataFrame:
    """Runs whose results do not belong to their manifest: estimator, attempts, or model lists differ.

    ``fits`` is (run_id, replicate, status, models) with replicate 0 for the point fit.
    """
    config = F.col("analysis_config")
    wanted = manifests.select(
        "run_id",
        F.get_json_object(config, "$.bootstrap.replicate_count").cast("bigint").alias("wanted"),
    )
    attempts = statuses.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_distinct("replicate").alias("distinct_replicates")
    )
    models = fits.where(F.col("status") == "SUCCESS").groupBy("run_id").agg(
        F.min("models").alias("fewest"), F.max("models").alias("most"), F.count_if(F.col("replicate") == 0).alias("points")
    )
    joined = wanted.join(attempts, "run_id", "left").join(models, "run_id", "left")
    violation = (
        F.when(F.coalesce("attempted", F.lit(0)) != F.col("wanted"), "ATTEMPT_COUNT")
        .when(F.col("attempted") != F.col("distinct_replicates"), "REPEATED_REPLICATE")
        .when(F.coalesce("points", F.lit(0)) != 1, "POINT_FIT_MISSING")
        .when(F.col("fewest") != F.col("most"), "MODEL_UNIVERSE")
    )
    return joined.select("run_id", violation.alias("violation")).where(F.col("violation").isNotNull())


# --- storage -----------------------------------------------------------------------------------
#
# <root>/<table>/run_id=<id>/..., one folder a table, so that one scan reads any set of runs and skips the others. A run is
# there once its inventory is: that is the last thing published, by one rename.


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object: the same calls serve local disks, HDFS and object stores."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def stored_runs(spark: SparkSession, root: str) -> set[str]:
    """Ids of the published runs."""
    fs, hadoop = _file_system(spark, f"{root}/inventory")
    names = [status.getPath().getName() for status in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return {name.removeprefix("run_id=") for name in names if name.startswith("run_id=")}


def write_run(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame]) -> str:
    """Write the tables of one run to a staging place, verify them, then publish them, the inventory last.

    A published run is never overwritten, and no reader sees one without its inventory. What a writer that died while
    publishing has left is replaced by the next attempt.
    """
    staging = f"{root}/.staging/run_id={run_id}"
    if run_id in stored_runs(spark, root):
        raise RunError("RUN_ALREADY_EXISTS", run_id)
    if _exists(spark, staging):
        raise RunError("TEMP_RUN_ALREADY_EXISTS", run_id)
    missing = set(tables) ^ set(RUN_TABLES)
    if missing:
        raise RunError("ARTIFACT_CONSISTENCY_ERROR", f"table set differs by {sorted(missing)}")
    fs, staged = _file_system(spark, staging)
    try:
        for name, table in tables.items():
            table.drop("run_id").write.mode("errorifexists").parquet(f"{staging}/{name}")
        files = inventory(spark, staging, pattern="*.parquet").withColumn("artifact_schema_version", F.lit(ARTIFACT_VERSION))
        files.coalesce(1).write.parquet(f"{staging}/inventory")
        _require_ok(compare_inventories(spark.read.parquet(f"{staging}/inventory"), inventory(spark, staging, pattern="*.parquet", keep=TABLE_FILES)))
        for name in (*RUN_TABLES, "inventory"):
            target = _file_system(spark, f"{root}/{name}/run_id={run_id}")[1]
            fs.mkdirs(target.getParent())
            fs.delete(target, True)
            if not fs.rename(_file_system(spark, f"{staging}/{name}")[1], target):
                raise RunError("ARTIFACT_WRITE_FAILED", f"{run_id}: {name}")
        fs.delete(staged, True)
    except RunError:
        fs.delete(staged, True)
        raise
    except Py4JJavaError as error:
        fs.delete(staged, True)
        raise RunError("ARTIFACT_WRITE_FAILED", str(error.java_exception)) from error
    return f"{root}/inventory/run_id={run_id}"


TABLE_FILES = "path not like 'inventory/%'"


def read_runs(spark: SparkSession, root: str, run_ids: Sequence[str], table: str) -> DataFrame:
    """One table of the named runs in one scan; the folders of others are pruned."""
    one = spark.read.parquet(f"{root}/{table}/run_id={run_ids[0]}").schema
    schema = T.StructType([*one.fields, T.StructField("run_id", T.StringType())])  # ids are text, whatever they look like
    return spark.read.schema(schema).parquet(f"{root}/{table}").where(F.col("run_id").isin(*run_ids))


def verify_runs(spark: SparkSession, root: str, run_ids: Sequence[str]) -> DataFrame:
    """(run_id, path, status) of every file of the named runs: one listing and one join for all of them."""
    listed = ", ".join(f"'{run_id}'" for run_id in run_ids)
    keep = rf"{TABLE_FILES} and regexp_extract(path, '^[^/]+/run_id=([^/]+)/', 1) in ({listed})"
    found = inventory(spark, root, pattern="*.parquet", keep=keep)
    declared = read_runs(spark, root, run_ids, "inventory")
    placed = declared.withColumn("path", F.concat(F.substring_index("path", "/", 1), F.lit("/run_id="), "run_id", F.lit("/"), F.expr("substring(path, instr(path, '/') + 1)")))
    report = compare_inventories(placed, found)
    return report.select(F.regexp_extract("path", "/run_id=([^/]+)/", 1).alias("run_id"), "path", "status")


def _require_ok(report: DataFrame) -> None:
    try:
        wrong = report.where(F.col("status") != "ok").orderBy("path").take(1)
    except Py4JJavaError as error:  # the file system's own checksums may refuse an altered file first
        raise RunError("ARTIFACT_CONSISTENCY_ERROR", "a file can not be read back") from error
    if wrong:
        raise RunError("ARTIFACT_CONSISTENCY_ERROR", f"{wrong[0]['path']} is {wrong[0]['status']}")


def registry_differences(registered: DataFrame, found: DataFrame) -> DataFrame:
    """Runs that are registered but absent, or present but unregistered."""
    missing = registered.select("run_id").join(found, "run_id", "left_anti").withColumn("difference", F.lit("missing"))
    extra = found.select("run_id").join(registered, "run_id", "left_anti").withColumn("difference", F.lit("extra"))
    return missing.select("run_id", "difference").unionByName(extra.select("run_id", "difference"))


def load_runs(spark: SparkSession, root: str, run_ids: Sequence[str]) -> dict[str, DataFrame]:
    """All tables of a closed set of runs. A missing, extra or altered run, or one with other models, is refused."""
    present = stored_runs(spark, root)
    if present != set(run_ids):
        raise RunError("RUN_SET_MISMATCH", f"missing {sorted(set(run_ids) - present)}, extra {sorted(present - set(run_ids))}")
    _require_ok(verify_runs(spark, root, run_ids))
    tables = {name: read_runs(spark, root, run_ids, name) for name in RUN_TABLES}
    if not manifest_violations(tables["manifest"]).isEmpty():
        raise RunError("MANIFEST_INVALID", "a run id does not follow from its manifest")
    universes = tables["point"].select(F.array_sort("model_ids").alias("m")).distinct().limit(2).count()
    if universes != 1:
        raise RunError("MODEL_UNIVERSE", "runs were fitted on different models")
    return tables
