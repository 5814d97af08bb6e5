"""The comparison graph: edges, components and strong connectivity, for many strata at once.

Nodes are models and edges are model pairs, so the graph has been aggregated from battles before any of the
loops below begins. Each round is a join and a grouping; rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.schema import A_WIN, B_WIN, TIE
from pairpref.session import cut


def undirected_edges(cells: DataFrame, by: list[str]) -> DataFrame:
    """Distinct unordered pairs (u < v) per stratum."""
    low, high = F.least("model_a_id", "model_b_id"), F.greatest("model_a_id", "model_b_id")
    return cells.where(low != high).select(*by, low.alias("u"), high.alias("v")).distinct()


def arcs(cells: DataFrame, by: list[str], *, ties: bool) -> DataFrame:
    """Winner to loser; with ``ties`` a tie points both ways."""
    outcome = F.col("canonical_outcome")
    arc = lambda source, target: F.struct(F.col(source).alias("u"), F.col(target).alias("v"))
    forth, back = arc("model_a_id", "model_b_id"), arc("model_b_id", "model_a_id")
    listed = F.when(outcome == A_WIN, F.array(forth)).when(outcome == B_WIN, F.array(back))
    if ties:
        listed = listed.when(outcome == TIE, F.array(forth, back))
    return cells.select(*by, F.inline(listed)).where(F.col("u") != F.col("v")).distinct()


def nodes(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.select(*by, F.explode(F.array("model_a_id", "model_b_id")).alias("node")).distinct()


def components(edges: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component): every node takes the smallest label in reach.

    A round takes the smallest label among the neighbours and then the label of that label, so a chain of n
    nodes needs about log n rounds rather than n.
    """
    both = cut(edges.select(*by, F.col("u").alias("node"), F.col("v").alias("other")).union(
        edges.select(*by, F.col("v"), F.col("u"))
    ))
    labels = cut(vertices.select(*by, "node", F.col("node").alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), [*by, "other"]).groupBy(*by, "node").agg(
            F.min("component").alias("near")
        )
        near = labels.join(around, [*by, "node"], "left").select(
            *by, "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        # Hook the old label onto the new one, then follow two steps of labels.
        hooks = near.where(F.col("component") < F.col("before")).groupBy(
            *by, F.col("before").alias("component")
        ).agg(F.min("component").alias("hook"))
        hooked = near.join(hooks, [*by, "component"], "left").select(
            *by, "node", "before", F.least("component", "hook").alias("component")
        )
        jump = hooked.select(*by, F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = cut(
            hooked.join(jump, [*by, "component"], "left").select(
                *by, "node", "before", F.least("component", "jump").alias("component")
            )
        )
        if moved.where(F.col("component") != F.col("before")).isEmpty():
            return moved.drop("before")
        labels = moved.drop("before")


def graph_facts(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_count, edge_count, component_count)."""
    edges = cut(undirected_edges(cells, by))
    vertices = cut(nodes(cells, by))
    found = components(edges, vertices, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("node_count"), F.count_distinct("component").alias("component_count")
    )
    counted = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edge_count"))
    if not by:
        return found.withColumn("edge_count", counted.select("edge_count").scalar())
    return found.join(counted, by, "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def reachable(directed: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """(by, node) that can be reached from ``start`` along the arcs; one round per step of distance."""
    seen = cut(start.select(*by, "node"))
    frontier = seen
    while True:
        step = directed.join(frontier.withColumnRenamed("node", "u"), [*by, "u"]).select(*by, F.col("v").alias("node"))
        frontier = cut(step.distinct().join(seen, [*by, "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


GRAPH = "__stratum string, u string, v string, w long, start boolean"
#: Arcs that one task may hold.
ARCS_A_TASK = 500_000


def _reach_counts(unit: pa.Table) -> pa.Table:
    """(stratum, forward_count, backward_count) of whole graphs: weights of the nodes that the start reaches, and that reach it."""
    rows = unit.to_pandas()
    out: dict[str, list] = {"__stratum": [], "forward_count": [], "backward_count": []}
    for stratum, graph in rows.groupby("__stratum", sort=False):
        own = graph["v"].isna()
        names, weight, begin = graph.loc[own, "u"].to_numpy(), graph.loc[own, "w"].to_numpy(), graph.loc[own, "start"].to_numpy(bool)
        order = np.argsort(names)
        at = lambda column: order[np.searchsorted(names[order], graph.loc[~own, column].to_numpy())]
        u, v = (at("u"), at("v")) if (~own).any() else (np.empty(0, np.int64), np.empty(0, np.int64))
        out["__stratum"].append(stratum)
        for name, x, y in (("forward_count", u, v), ("backward_count", v, u)):
            out[name].append(int(weight[_reached(len(names), x, y, begin)].sum()))
    return pa.table(out, pa.schema([("__stratum", pa.string()), ("forward_count", pa.int64()), ("backward_count", pa.int64())]))


def _reached(count: int, u: np.ndarray, v: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Nodes that those in ``seen`` reach, frontier by frontier over arcs in order of their source."""
    v = v[np.argsort(u, kind="stable")]
    edge = np.searchsorted(np.sort(u), np.arange(count + 1))
    seen, front = seen.copy(), np.flatnonzero(seen)
    while len(front):
        size = edge[front + 1] - edge[front]
        ends = np.cumsum(size)
        met = v[np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(edge[front], size)]
        front = np.unique(met[~seen[met]])
        seen[front] = True
    return seen


def _cycles(part: pa.Table) -> pa.Table:
    """(stratum, u, v): each node of a strongly connected part of these arcs with the smallest node of it."""
    names, place = np.unique(np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]), return_inverse=True)
    u, v = place[: len(part)], place[len(part) :]
    order = np.argsort(u, kind="stable")
    edge, v = np.searchsorted(u[order], np.arange(len(names) + 1)).tolist(), v[order].tolist()
    index, low, label = [-1] * len(names), [0] * len(names), list(range(len(names)))
    on, stack, counter = [False] * len(names), [], 0
    for root in range(len(names)):
        if index[root] >= 0:
            continue
        path = [(root, edge[root])]
        while path:
            node, at = path.pop()
            if index[node] < 0:
                index[node] = low[node] = counter
                counter += 1
                stack.append(node)
                on[node] = True
            elif at > edge[node]:  # back from the child before
                low[node] = min(low[node], low[v[at - 1]]) if on[v[at - 1]] else low[node]
            while at < edge[node + 1] and index[v[at]] >= 0:
                if on[v[at]]:
                    low[node] = min(low[node], index[v[at]])
                at += 1
            if at < edge[node + 1]:
                path += [(node, at + 1), (v[at], edge[v[at]])]
            elif low[node] == index[node]:
                members = []
                while not members or members[-1] != node:
                    members.append(stack.pop())
                    on[members[-1]] = False
                for x in members:
                    label[x] = min(members)
    moved = [x for x in range(len(names)) if label[x] != x]
    stratum = part.column("__stratum")[0].as_py()
    return pa.table({
        "__stratum": pa.array([stratum] * len(moved), pa.string()), "u": pa.array(names[moved].tolist(), pa.string()),
        "v": pa.array([names[label[x]] for x in moved], pa.string()),
    })


def _contracted(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(GRAPH rows, strata that stay too large for a task).

    Arcs of a large stratum are dealt to tasks; what is strongly connected within a task is so in the whole and becomes
    one node. A component of the model graph shrinks by whole stretches a round, so the rounds do not follow its diameter.
    """
    while True:
        arcs_ = graph.where("v is not null")
        sizes = cut(arcs_.groupBy("__stratum").agg(F.count(F.lit(1)).alias("arcs")).where(F.col("arcs") > ARCS_A_TASK))
        before = sizes.agg(F.sum("arcs")).first()[0]
        if before is None:
            return graph, sizes.select("__stratum")
        parts = F.ceil(F.col("arcs") / ARCS_A_TASK) + 1
        # Both arcs of a pair go to one task, whatever their direction.
        part = F.pmod(F.xxhash64(F.least("u", "v"), F.lit(before)), parts).alias("part")
        dealt = arcs_.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "__stratum").select("__stratum", part, "u", "v")
        merged = cut(dealt.groupBy("__stratum", "part").applyInArrow(_cycles, "__stratum string, u string, v string"))
        if merged.isEmpty():
            return graph, sizes.select("__stratum")
        touched = merged.select("__stratum", F.explode(F.array("u", "v")).alias("node")).distinct()
        label = components(merged, touched, ["__stratum"])
        named = lambda c: label.select("__stratum", F.col("node").alias(c), F.col("component").alias(f"__{c}"))
        both = graph.join(named("u"), ["__stratum", "u"], "left").join(named("v"), ["__stratum", "v"], "left")
        both = both.select("__stratum", F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v"), "w", "start")
        left = both.where("v is null or u <> v").groupBy("__stratum", "u", "v").agg(F.sum("w").alias("w"), F.max("start").alias("start"))
        graph = cut(left.select("__stratum", "u", "v", "w", "start"))


def strongly_connected(cells: DataFrame, by: list[str], *, ties: bool) -> DataFrame:
    """(by, node_count, forward_count, backward_count, strongly_connected) from the smallest model id.

    A stratum of up to ARCS_A_TASK arcs is walked in one task, whatever its diameter; larger ones are contracted first. Only
    one that is still larger when nothing contracts any more, a graph without cycles in reach of a task, is walked hop by hop.
    """
    name = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("all")
    vertices = nodes(cells, by).withColumn("__stratum", name)
    first = cut(vertices.groupBy("__stratum", *by).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("node_count")))
    own = vertices.join(first.select("__stratum", "first"), "__stratum").select(
        "__stratum", F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(1).cast("long").alias("w"), (F.col("node") == F.col("first")).alias("start")
    )
    pairs = arcs(cells, by, ties=ties).select(name.alias("__stratum"), "u", "v", F.lit(0).cast("long").alias("w"), F.lit(False).alias("start"))
    graph, large = _contracted(cut(own.unionByName(pairs)))
    strata = first.count()
    units = F.pmod(F.xxhash64("__stratum"), F.lit(min(strata, 10_000) or 1)).alias("unit")
    small = graph.join(large, "__stratum", "left_anti").select("*", units)
    counts = small.groupBy("unit").applyInArrow(_reach_counts, "__stratum string, forward_count long, backward_count long")
    if not large.isEmpty():
        counts = counts.unionByName(_hop_counts(graph.join(large, "__stratum", "left_semi")))
    whole = (F.col("forward_count") == F.col("node_count")) & (F.col("backward_count") == F.col("node_count"))
    return first.join(counts, "__stratum").select(*by, "node_count", "forward_count", "backward_count", whole.alias("strongly_connected"))


def _hop_counts(graph: DataFrame) -> DataFrame:
    graph = cut(graph)
    forward = graph.where("v is not null").select("__stratum", "u", "v")
    backward = forward.select("__stratum", F.col("v").alias("u"), F.col("u").alias("v"))
    start = graph.where("start").select("__stratum", F.col("u").alias("node"))
    weights = graph.where("v is null").select("__stratum", F.col("u").alias("node"), "w")
    count = lambda arcs_, into: reachable(arcs_, start, ["__stratum"]).join(weights, ["__stratum", "node"]).groupBy("__stratum").agg(F.sum("w").alias(into))
    return count(forward, "forward_count").join(count(backward, "backward_count"), "__stratum")


def language_support(eligible: DataFrame) -> DataFrame:
    """Per language: rows, models, pairs, connectivity, judges and outcome counts.

    Everything but the judge count is derived from the (language, pair, outcome) counts of a single grouping.
    """
    by = ["language_canonical"]
    rows = eligible.where(F.col("language_canonical").isNotNull())
    cells = cut(
        rows.groupBy(*by, "model_a_id", "model_b_id", "canonical_outcome").agg(F.count(F.lit(1)).alias("n"))
    )
    of = lambda name: F.coalesce(F.sum(F.when(F.col("canonical_outcome") == name, F.col("n"))), F.lit(0)).alias(name)
    outcomes = cells.groupBy(*by).agg(
        F.sum("n").alias("rows"), of(A_WIN), of(B_WIN), of(TIE), of("tie_bothbad")
    )
    judge: Column = F.trim("judge_cluster_id")
    judges = rows.where(judge != "").groupBy(*by, judge.alias("j")).agg(F.lit(1).alias("one"))
    judges = judges.groupBy(*by).agg(F.count(F.lit(1)).alias("judges"))
    graph = graph_facts(cells, by).select(
        *by,
        F.col("node_count").alias("models"),
        F.col("edge_count").alias("pairs"),
        (F.col("component_count") == 1).alias("connected"),
    )
    joined = outcomes.join(graph, by).join(judges, by, "left")
    return joined.withColumn("judges", F.coalesce("judges", F.lit(0)))
