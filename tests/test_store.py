"""Hashes of files and folders, and saved tables that join without a shuffle."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from pairpref import session
from pairpref.catalog import storage
from pairpref.catalog.tables import cleaned, cleaned_texts
from pairpref.sources import files, relational
from pairpref.sources.relational import TASK_BYTES, dealt_out, save_tables


def folder(content):
    root = tempfile.mkdtemp(prefix="pairpref-hash-")
    for name, data in content.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as handle:
            handle.write(data)
    return root


@pytest.mark.parametrize("chunk", [3, 8 << 20])
def test_files_are_hashed_in_chunks_below_names_that_repeat(spark, monkeypatch, chunk):
    monkeypatch.setattr(files, "CHUNK", chunk)
    content = {"a.bin": b"one", "x/a.bin": b"two", "x/žluť b.bin": os.urandom(10_000)}
    root = folder(content)
    inner = f"{os.path.basename(root)}/deep.bin"  # a folder of the root's own name
    os.makedirs(f"{root}/{os.path.basename(root)}")
    with open(f"{root}/{inner}", "wb") as handle:
        handle.write(b"deep")
    content[inner] = b"deep"
    found = {r.path: (r.size_bytes, r.sha256) for r in files.inventory(spark, root).collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}
    entries = [{"path": p, "sha256": h, "size_bytes": n} for p, (n, h) in sorted(found.items(), key=lambda x: x[0].encode())]
    text = json.dumps(entries, separators=(",", ":"), ensure_ascii=False)
    digest = files.inventory_digest(files.inventory(spark, root)).first()
    assert (digest.files, digest.digest) == (4, hashlib.sha256(text.encode()).hexdigest())
    assert files.source_hash(spark, root) == digest.digest and files.source_hash(spark, f"{root}/a.bin") == hashlib.sha256(b"one").hexdigest()
    files.check_source(spark, root, digest.digest)
    with open(f"{root}/x/a.bin", "wb") as handle:
        handle.write(b"!")
    with pytest.raises(ValueError):
        files.check_source(spark, root, digest.digest)


def test_a_store_that_only_spark_reads(spark, monkeypatch):
    root = folder({"a": b"one", "b/c": b"two"})
    expected = sorted(files.inventory(spark, root).collect())
    monkeypatch.setattr(files, "_readable_in_chunks", lambda root: False)
    assert sorted(files.inventory(spark, root).collect()) == expected


def test_an_inventory_without_files(spark):
    nothing = spark.createDataFrame([], "path string, size_bytes long, sha256 string")
    assert tuple(files.inventory_digest(nothing).first()) == (0, hashlib.sha256(b"[]").hexdigest())


def test_saved_tables_join_without_a_shuffle(spark):
    battles = spark.range(3000).select((F.col("id") % 17).cast("string").alias("model_a"), F.current_date().alias("battle_date"))
    models = spark.range(20).select(F.col("id").cast("string").alias("model_name"), F.col("id").alias("battle_count"))
    prefix = f"t_{uuid.uuid4().hex}_"
    save_tables({"arena_battle": battles, "model_statistics": models}, prefix=prefix, buckets=4, folder=tempfile.mkdtemp(prefix="pairpref-saved-"))
    left, right = spark.table(f"{prefix}model_statistics"), spark.table(f"{prefix}arena_battle")
    joined = left.hint("merge").join(right, F.col("model_a") == F.col("model_name")).groupBy("model_name").count()
    assert joined.count() == 17
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_saved_text_costs_little_when_it_comes_back(spark):
    noise = F.concat(*[F.sha2(F.concat_ws("-", F.col("id") % 500, F.lit(i)), 512) for i in range(47)])
    battles = spark.range(0, 10_000, 1, 1).select(
        F.lit("m").alias("model_a"), F.current_date().alias("battle_date"), F.lit(None).cast("string").alias("other"), noise.alias("response_a_text"))
    prefix, place = f"t_{uuid.uuid4().hex}_", tempfile.mkdtemp(prefix="pairpref-saved-")
    save_tables({"arena_battle": battles}, prefix=prefix, buckets=2, folder=place)
    size = sum(os.path.getsize(f"{place}/arena_battle/{name}") for name in os.listdir(f"{place}/arena_battle"))
    assert size < 2 * 500 * 6016  # the different texts are 3 MB, all of them 60 MB
    saved = spark.table(f"{prefix}arena_battle")
    assert saved.exceptAll(battles).isEmpty() and saved.count() == 10_000


def test_narrow_battles_are_dealt_out_by_the_size_of_whole_ones(spark):
    model = F.when(F.col("id") < 16_000, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 7).cast("string"))
    battles = spark.range(0, 20_000, 1, 2).select(F.col("id").alias("source_row_index"), model.alias("model_a"), F.lit(None).cast("date").alias("battle_date"))
    dealt = dealt_out(battles, "arena_battle", 8, 12 * TASK_BYTES - 5, "source_row_index")
    rows = dealt.withColumns({"task": F.spark_partition_id(), "bucket": F.pmod(F.hash("model_a"), F.lit(8))}).collect()
    tasks = [r.task for r in rows]
    assert len(rows) == 20_000 and len(set(tasks)) == 12 == dealt.rdd.getNumPartitions()
    assert max(tasks.count(t) for t in set(tasks)) < 2 * 20_000 / 12
    assert len({(r.task, r.bucket) for r in rows}) <= 12 + 8


@pytest.mark.parametrize("limit", [session.BROADCAST_BYTES, 0])
def test_saved_battles_are_whole(spark, sf, monkeypatch, limit):
    """Every battle with its texts, in its bucket in order, whether texts are broadcast or not; small tasks where they are."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(relational, "TASK_BYTES", 50_000)
    place = tempfile.mkdtemp(prefix="pairpref-saved-")
    monkeypatch.setattr(storage, "scratch", lambda spark: place)
    counts = {r.model_name: r.as_model_a for r in storage.saved_tables(spark, sf).collect()}
    expected = {r.model_a: r["count"] for r in cleaned(spark, sf).groupBy("model_a").count().collect()}
    assert counts and counts == {name: expected.get(name, 0) for name in counts}
    saved = spark.read.parquet(f"{place}/arena_battle")
    battles = storage._tables(spark, sf)["arena_battle"]
    assert saved.columns == battles.columns and saved.count() == cleaned_texts(spark, sf).count()
    assert saved.exceptAll(battles).isEmpty() and battles.exceptAll(saved).isEmpty()
    files = {}
    for r in saved.select(F.input_file_name().alias("f"), "model_a", F.col("battle_date").cast("string").alias("d"), F.pmod(F.hash("model_a"), F.lit(8)).alias("b")).collect():
        files.setdefault(r.f, []).append((r.b, r.model_a or "", r.d or ""))
    assert all(rows == sorted(rows) and len({b for b, _, _ in rows}) == 1 for rows in files.values())
    assert limit == 0 or len(files) > 8
