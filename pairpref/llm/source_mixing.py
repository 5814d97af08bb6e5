"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern; a small network then
routes each pattern's words to its sources' targets. Using a pattern's words a second and third time costs more than
the first (convex costs 1, 4, 9), so repetition is spread before it is deepened. The flow says how many words a
pattern gives: so many whole passes over its documents, and a rest that documents in seeded hash order fill.

Targets: sources in code-point order, null last, have the weights in turn and share all words by weight; no target
exceeds ``REPEATS`` times its source's words, and what is above is shared again among the others.

The network has one node for each pattern and source; its size is checked (``MAX_PATTERNS``) before the driver solves
it. Documents are never collected: hash ranges are narrowed by grouped sums. Null text and empty text have size 0 and
are taken 0 times. Documents without sources (empty membership) are not taken. Rows equal in id and size share
their hash and are taken together or not at all. Reruns agree. Extra columns are carried along.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.llm.catalog import query, table
from pairpref.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 20240
MAX_PATTERNS = 200_000
HASH_BITS, PARTS, FILLS = 36, 4096, 3
Pattern = tuple[str | None, ...]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Target of each source: shares of the total by weight, capped at ``repeats`` times its size, excess shared again."""
    left, open_, targets = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        above = sorted(
            (s for s in open_ if left * weights[s] / total > repeats * sizes[s]), key=lambda s: (s is None, s or "")
        )
        if not above:
            return targets | {s: left * weights[s] / total for s in open_}
        for s in above:
            targets[s] = float(repeats * sizes[s])
        left -= sum(targets[s] for s in above)
        open_ -= set(above)
    return targets


class Network:
    """Min-cost flow by cheapest augmenting paths (Dijkstra with potentials; all costs start non-negative)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: defaultdict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _cheapest(self, source: int, height: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
        best, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in self.out[u]:
                v = self.to[e]
                reach = d + self.cost[e] + height.get(u, 0) - height.get(v, 0)
                if self.room[e] > 0 and reach < best.get(v, reach + 1):
                    best[v], via[v] = reach, e
                    heapq.heappush(heap, (reach, v))
        return best, via

    def run(self, source: int, sink: int) -> None:
        height: dict[int, int] = {}
        while True:
            best, via = self._cheapest(source, height)
            if sink not in best:
                return
            far = max(best.values())
            for v in set(self.to) | {source}:
                height[v] = height.get(v, 0) + best.get(v, far)
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            flow = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= flow
                self.room[e ^ 1] += flow


def route(patterns: dict[Pattern, int], targets: dict, repeats: int = REPEATS) -> dict[tuple[Pattern, str | None], int]:
    """(pattern, source) -> words: each connected part of the pattern-source graph is a network of its own."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pattern in patterns:
        for s in pattern:
            parent[root(("source", s))] = root(("pattern", pattern))
    parts = defaultdict(list)
    for pattern in patterns:
        parts[root(("pattern", pattern))].append(pattern)
    flows: dict[tuple[Pattern, str | None], int] = {}
    for members in parts.values():
        members.sort(key=lambda p: [(s is None, s or "") for s in p])
        sources = sorted({s for p in members for s in p}, key=lambda s: (s is None, s or ""))
        at = {s: 2 + i for i, s in enumerate(sources)}
        net, arcs = Network(), {}
        for i, pattern in enumerate(members):
            node = 2 + len(sources) + i
            for use in range(1, repeats + 1):
                net.arc(0, node, patterns[pattern], use * use)
            for s in pattern:
                arcs[pattern, s] = net.arc(node, at[s], repeats * patterns[pattern], 0)
        for s in sources:
            net.arc(at[s], 1, round(targets[s]), 0)
        net.run(0, 1)
        flows |= {key: net.room[e ^ 1] for key, e in arcs.items()}
    return flows


def _narrowed(sized: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """(__key, lo, need): the part of each pattern's hash range in which the words it needs run out."""
    inside = sized.join(F.broadcast(state), "__key").where(
        (F.col("need") > 0) & (F.col("__hash") >= F.col("lo")) & (F.col("__hash") < F.col("lo") + step * PARTS)
    )
    part = F.floor((F.col("__hash") - F.col("lo")) / step).cast("long").alias("part")
    sums = inside.groupBy("__key", part).agg(F.sum("__size").alias("words"), F.first("lo").alias("lo"), F.first("need").alias("need"))
    before = F.sum("words").over(Window.partitionBy("__key").orderBy("part")) - F.col("words")
    crossing = sums.withColumn("before", before).where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need")))
    return crossing.select("__key", (F.col("lo") + F.col("part") * step).alias("lo"), (F.col("need") - F.col("before")).alias("need"))


def _filled(sized: DataFrame, state: DataFrame) -> dict:
    """The document (all rows equal to it) beyond the range that brings each pattern's rest closest to zero."""
    left = sized.join(F.broadcast(state), "__key").where((F.col("__hash") >= F.col("lo")) & (F.col("__size") > 0) & ~F.array_contains("picked", F.col("__hash")))
    rows = left.groupBy("__key", "__hash").agg(F.sum("__size").alias("words"), F.first("need").alias("need"))
    best = rows.groupBy("__key").agg(F.min(F.struct(F.abs(F.col("words") - F.col("need")).alias("off"), "__hash", "words", "need")).alias("b"))
    return {r["__key"]: (r["b"]["__hash"], r["b"]["words"]) for r in best.where("b.off < abs(b.need)").collect()}


def mix(docs: DataFrame, members: Column, size: Column, order_by: Sequence[Column], weights: Sequence[float] = WEIGHTS, seed: int = SEED, result: str = "mix") -> DataFrame:
    """``docs`` with ``result`` (a name they do not have): struct of size, source_size and target (maps by source), times (whole uses) and taken."""
    spark = docs.sparkSession
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("__row")).alias("__rest"), members.alias("__members"), size.alias("__size"), F.pmod(F.xxhash64(*order_by, size, F.lit(seed)), F.lit(2**HASH_BITS)).alias("__hash"))
    key = F.to_json(F.struct(F.transform("__members", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit(""))).alias("m")))
    return _mixed(spark, packed.withColumn("__key", key), columns, weights, result)


def _mixed(spark: SparkSession, packed: DataFrame, columns: list[str], weights: Sequence[float], result: str) -> DataFrame:
    sized = stored(packed)
    narrow = sized.select("__key", "__hash", "__size")
    found = sized.groupBy("__key").agg(F.first("__members").alias("m"), F.sum("__size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns do not fit one network")
    patterns = {tuple(dict.fromkeys(r["m"] or ())): r["n"] for r in found}
    of = {r["__key"]: tuple(dict.fromkeys(r["m"] or ())) for r in found}
    sizes: dict = defaultdict(int)
    for pattern, n in patterns.items():
        for s in pattern:
            sizes[s] += n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(ordered)})
    flows = route(patterns, targets)
    words = {key: sum(flows.get((p, s), 0) for s in p) for key, p in of.items()}
    base = {key: words[key] // patterns[p] if patterns[p] else 0 for key, p in of.items()}
    need = {key: words[key] - base[key] * patterns[p] for key, p in of.items()}
    lo, picked = dict.fromkeys(of, 0), {key: [] for key in of}
    schema = "__key string, lo long, need long, picked array<long>"
    state = lambda: spark.createDataFrame([(k, lo[k], need[k], picked[k]) for k in of] or [("", 0, 0, [])], schema)
    step = 2**HASH_BITS
    while step > 1:
        step //= PARTS
        for r in _narrowed(narrow, state(), step).collect():
            lo[r["__key"]], need[r["__key"]] = r["lo"], r["need"]
    for _ in range(FILLS):
        if not (more := _filled(narrow, state())):
            break
        for k, (h, n) in more.items():
            picked[k].append(h)
            need[k] -= n
    source = lambda k, values: {("=" + s if s is not None else ""): float(values[s]) for s in of[k]}
    plan = spark.createDataFrame(
        [(k, lo[k], base[k], picked[k], source(k, sizes), source(k, targets)) for k in of] or [("", 0, 0, [], {}, {})],
        "__key string, lo long, base long, picked array<long>, source_size map<string,double>, target map<string,double>",
    )
    times = F.col("base") + F.when((F.col("__hash") < F.col("lo")) | F.array_contains("picked", F.col("__hash")), 1).otherwise(0)
    done = sized.join(F.broadcast(plan), "__key", "left").withColumn("__times", F.when(F.col("__size") > 0, times).otherwise(0).cast("int"))
    mixed = F.struct(
        F.col("__size").alias("size"), "source_size", "target", F.col("__times").alias("times"), (F.col("__times") * F.col("__size")).alias("taken")
    )
    return done.select(*[F.col("__rest").getField(c).alias(c) for c in columns], mixed.alias(result))


def mix_by_source(docs: DataFrame, result: str = "mix") -> DataFrame:
    """:func:`mix` of documents that each belong to the one source they name (null is a source of its own)."""
    return mix(docs, F.array("source"), word_count(F.col("text")), [F.col("doc_id")], result=result)


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(docs, F.array("source"), F.col("size"), [F.col("doc_id")])
    own = lambda name: F.map_values(F.col("mix").getField(name))[0].alias(name)
    return mixed.select("doc_id", "size", own("source_size").cast("long").alias("source_size"), own("target"), F.col("mix.taken").alias("taken"), F.col("mix.times").alias("times"))
