"""Bootstrap resamples as weighted counts: whole judge clusters, or single battles, drawn with replacement.

Battles are never copied. A replicate is a set of multiplicities, and what a fit needs of it is
sum(count * multiplicity) per (model_a, model_b, outcome).

Two exact ways to draw:

* ``hashed``: draw d of replicate r is a hash of (seed, r, d). Anyone can recompute it, in SQL too.
* ``blocked``: the units are split into a fixed number of blocks, the leaves of a binary tree. A node passes a binomial
  share of its draws to its left half, so a block learns its own share from the log2(blocks) splits above it, and
  spends it on its own units. Every split and every leaf has a counter-based random stream named by (seed, r, node):
  no draw is shuffled, no block draws for another, and the result depends on nothing but the units and the
  configuration. Per-cell sums leave a task a slice of replicates at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.functions.text import present
from pairpref.operators.estimate import CELL
from pairpref.session import broadcast_if_small, cut, stored

UNITS = {"judge_cluster": "judge_cluster_id", "battle_row": "battle_id"}
BLOCKS, SLICE = 64, 50  # blocks unless the configuration says otherwise; replicates whose sums leave a task together
LOOKUP_BUCKETS = 4096  # stretches of positions that row draws are matched in


class BootstrapError(ValueError):
    def __init__(self, code: str, message: str = "") -> None:
        self.code = code
        super().__init__(f"{code}: {message}")


def cluster_violations(battles: DataFrame) -> DataFrame:
    """One row: battles without a usable judge cluster. There is no fallback to single rows."""
    return battles.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~present(F.col("judge_cluster_id"))).alias("invalid_judges")
    )


def require_clusters(battles: DataFrame) -> None:
    if "judge_cluster_id" not in battles.columns:
        raise BootstrapError("MISSING_JUDGE_CLUSTER", "judge_cluster_id is required for cluster bootstrap")
    if cluster_violations(battles).first()["invalid_judges"]:
        raise BootstrapError("INVALID_JUDGE_CLUSTER", "every eligible row needs a non-empty judge cluster")


def unit_cells(battles: DataFrame, unit: str) -> DataFrame:
    """(unit, model_a, model_b, outcome, n). A judge with any number of battles has a bounded number of cells."""
    key = F.col(UNITS[unit]).cast("string").alias("unit")
    return battles.groupBy(key, *CELL).agg(F.count(F.lit(1)).alias("n"))


def numbered_units(cells: DataFrame) -> DataFrame:
    """(unit, unit_no): positions 0 .. G-1 in sorted order, without sorting everything in one task.

    Units are range-partitioned and numbered inside their partition; partition sizes give the offsets. The
    numbered slices are materialised before the offsets are taken, so both see the same partitions.
    """
    sliced = cells.select("unit").distinct().repartitionByRange("unit").sortWithinPartitions("unit")
    local = F.monotonically_increasing_id()
    sliced = cut(
        sliced.select(
            "unit", F.shiftright(local, 33).alias("slice"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
        )
    )
    sizes = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))  # one row per partition
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return sliced.join(F.broadcast(offsets), "slice").select("unit", (F.col("offset") + F.col("place")).alias("unit_no"))


def _hash_position(seed: int, replicate: Column, draw: Column, units: int) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % units


def hashed_draws(spark: SparkSession, units: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, unit_no), one row per draw; replicates count from 1."""
    grid = spark.range(units * replicates)
    grid = grid.select(F.expr(f"id div {units} + 1").alias("replicate"), F.expr(f"id % {units}").alias("draw"))
    return grid.select("replicate", _hash_position(seed, F.col("replicate"), F.col("draw"), units).alias("unit_no"))


def multiplicities(draws: DataFrame) -> DataFrame:
    return draws.groupBy("replicate", "unit_no").agg(F.count(F.lit(1)).alias("multiplicity"))


def resampled_cells(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """(replicate, cell, n) from numbered unit cells and draws.

    While the unit cells are few they are broadcast and a draw becomes counts on the spot; otherwise draws are
    first reduced to multiplicities and both sides meet on the unit.
    """
    small = broadcast_if_small(cells)
    if small is not cells:
        joined = draws.join(small, "unit_no").withColumn("multiplicity", F.lit(1))
    else:
        joined = multiplicities(draws).join(cells, "unit_no")
    weight = F.sum(F.col("n") * F.col("multiplicity")).alias("n")
    return joined.groupBy("replicate", *CELL).agg(weight)


@dataclass(frozen=True)
class ShareTree:
    """Weights (units, or battles) below each node of a binary tree over the blocks; node 1 is the root, block b the
    leaf ``leaves + b``, and node k has children 2k and 2k + 1."""

    weights: tuple[int, ...]

    @classmethod
    def over(cls, sizes: list[int]) -> ShareTree:
        leaves = 1 << max(0, len(sizes) - 1).bit_length()
        weights = [0] * leaves + list(sizes) + [0] * (leaves - len(sizes))
        for node in range(leaves - 1, 0, -1):
            weights[node] = weights[2 * node] + weights[2 * node + 1]
        return cls(tuple(weights))

    @property
    def leaves(self) -> int:
        return len(self.weights) // 2

    def leaf(self, block: int) -> int:
        return self.leaves + block

    def share(self, streams: Streams, replicate: int, block: int) -> int:
        """Draws of ``block`` when as many draws as there are weights go down from the root."""
        draws, node, leaf = self.weights[1], 1, self.leaf(block)
        for below in reversed(range(self.leaves.bit_length() - 1)):
            left = self.weights[2 * node]
            went = int(streams.at(replicate, node).binomial(draws, left / self.weights[node])) if self.weights[node] else 0
            node = leaf >> below
            draws = draws - went if node % 2 else went
        return draws


class Streams:
    """Counter-based generators: the seed and the replicate are the key, the node is the high word of the counter."""

    def __init__(self, seed: int) -> None:
        self.word = np.random.SeedSequence(seed).generate_state(1, np.uint64)[0]

    def at(self, replicate: int, node: int) -> np.random.Generator:
        key = np.array([self.word, replicate], np.uint64)
        return np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, 0, node], np.uint64)))


def _in_blocks(cells: DataFrame, name: str, blocks: int) -> DataFrame:
    return cells.withColumn("block", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))


def _tree(sizes: DataFrame, blocks: int) -> ShareTree:
    """From (block, size), one row a block."""
    size = {row["block"]: row["size"] for row in sizes.collect()}
    return ShareTree.over([size.get(block, 0) for block in range(blocks)])


def _sliced(replicates: int, codes: np.ndarray, sums_of) -> Iterator[pd.DataFrame]:
    """(replicate, code, n) frames of at most SLICE replicates each; ``sums_of(replicate)`` has a sum for each code."""
    for begin in range(1, replicates + 1, SLICE):
        numbers = range(begin, min(begin + SLICE, replicates + 1))
        sums = [sums_of(replicate) for replicate in numbers]
        found = [np.flatnonzero(x) for x in sums]
        yield pd.DataFrame({
            "replicate": np.repeat(np.array(numbers), [len(x) for x in found]),
            "code": codes[np.concatenate(found)],
            "n": np.concatenate([x[at] for x, at in zip(sums, found)]).astype("int64"),
        })


def unit_times(tree: ShareTree, streams: Streams, replicate: int, block: int, units: int) -> np.ndarray:
    """How often each of the ``units`` of a block, in sorted order, is drawn in a replicate."""
    draws = tree.share(streams, replicate, block)
    return np.bincount(streams.at(replicate, tree.leaf(block)).integers(0, units, size=draws), minlength=units)


def blocked_cells(cells: DataFrame, replicates: int, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """(replicate, code, n) for replicates 1 .. B from (unit, code, n); ``code`` is an integer name of a cell."""
    cells = _in_blocks(cells, "unit", blocks)
    tree = _tree(cells.select("block", "unit").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("size")), blocks)

    def draw(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, pdf, streams = int(key[0]), pd.concat(list(frames)), Streams(seed)
        names, unit = np.unique(pdf["unit"].to_numpy(str), return_inverse=True)
        codes, cell = np.unique(pdf["code"].to_numpy(), return_inverse=True)
        n = pdf["n"].to_numpy(float)
        times = lambda replicate: unit_times(tree, streams, replicate, block, len(names))
        yield from _sliced(replicates, codes, lambda replicate: np.bincount(cell, n * times(replicate)[unit], len(codes)))

    drawn = cells.groupBy("block").applyInPandas(draw, "replicate bigint, code bigint, n bigint")
    return drawn.groupBy("replicate", "code").agg(F.sum("n").alias("n"))


def blocked_multiplicities(cells: DataFrame, replicates: int, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """(replicate, unit, multiplicity) of the very draws of :func:`blocked_cells`, for those who want the units."""
    units = _in_blocks(cells.select("unit").distinct(), "unit", blocks)
    tree = _tree(units.groupBy("block").agg(F.count(F.lit(1)).alias("size")), blocks)

    def draw(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, streams = int(key[0]), Streams(seed)
        names = np.unique(pd.concat(list(frames))["unit"].to_numpy(str))
        for replicate in range(1, replicates + 1):
            times = unit_times(tree, streams, replicate, block, len(names))
            drawn = np.flatnonzero(times)
            yield pd.DataFrame({"replicate": replicate, "unit": names[drawn], "multiplicity": times[drawn]})

    return units.groupBy("block").applyInPandas(draw, "replicate bigint, unit string, multiplicity bigint")


def row_resample_cells(cells: DataFrame, replicates: int, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """Row bootstrap without rows: battles of one cell are interchangeable, so N draws with replacement are a
    multinomial over the cells (code, n). The tree shares the draws out over blocks of cells by their battles, and each
    block splits its own; no list of cells leaves its tasks."""
    cells = _in_blocks(cells, "code", blocks)
    tree = _tree(cells.groupBy("block").agg(F.sum("n").alias("size")), blocks)

    def draw(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, streams = int(key[0]), Streams(seed)
        pdf = pd.concat(list(frames)).sort_values("code")
        codes, counts = pdf["code"].to_numpy(), pdf["n"].to_numpy("int64")
        shares = counts / counts.sum()
        times = lambda r: streams.at(r, tree.leaf(block)).multinomial(tree.share(streams, r, block), shares)
        yield from _sliced(replicates, codes, times)

    return cells.groupBy("block").applyInPandas(draw, "replicate bigint, code bigint, n bigint")


def prefix_sums(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``cells`` (keys, n; one row a key) with ``begin``: the sum of n over all smaller keys, range by range."""
    dealt = cells.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__slice", F.spark_partition_id())
    dealt = stored(dealt)
    order = Window.partitionBy("__slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__slice").agg(F.sum("n").alias("__size"))  # one row per partition
    offsets = sizes.select("__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = F.coalesce(F.sum("n").over(order), F.lit(0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(offsets), "__slice").select(
        *cells.columns, (F.col("__offset") + F.col("__inside")).alias("begin")
    )


def hashed_row_cells(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, cell, n) of hashed draws of single battles, numbered cell by cell in sorted order of :data:`CELL`.

    A draw is a position among all battles; the cell that holds it is looked up among the cells' prefix sums, both
    sides dealt to stretches of positions, of which a cell takes as many as it covers.
    """
    placed = stored(prefix_sums(cells.select(*CELL, "n"), CELL))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = max(1, -(-total // LOOKUP_BUCKETS))
    stretch = lambda position: F.expr(f"({position}) div {width}")
    spans = placed.withColumn("__s", F.explode(F.sequence(stretch("begin"), stretch("begin + n - 1"))))
    draws = multiplicities(hashed_draws(cells.sparkSession, total, replicates, seed)).withColumn("__s", stretch("unit_no"))
    spans = broadcast_if_small(stored(spans))
    found = draws.join(spans, "__s").where((F.col("unit_no") >= F.col("begin")) & (F.col("unit_no") < F.col("begin") + F.col("n")))
    return found.groupBy("replicate", *CELL).agg(F.sum("multiplicity").alias("n"))
