"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards.

Equal vectors of a label are one class first. Classes spread over shards around pivots that lie apart, each class in the
shards of its three nearest pivots; shards still too large split again, each for itself. A shard that pivots do not make
smaller (a dense group) stays whole: its classes are dealt to pieces, and all its pairs are compared exactly, a task
for every two pieces. In every other shard each class gets neighbours by robust
pruning of its nearest and some random ones. The lists of a class are united over its shards, and a search runs for
every class in each of its shards: greedy from the shard's medoid and the class's own list, then expanding whatever
is in range. Links
are verified by cosine in double precision. A pair that meets in two shards counts in the first of them, so links are
counted without a pair ever becoming a row; components come from star edges to local roots.

A sample of classes (``AUDIT``, chosen by hash) is compared with all vectors. Where less than ``RECALL`` of their
links were found, all together or as the mean over the classes that have any, the whole is searched again with more
shards per class and a wider beam, at most ``TRIES`` times; after that all pairs of a label are compared in exact blocks.

Null vectors, null labels, null or non-finite components and zero vectors link with nothing; so do vectors of
different length. Repeated rows are links of one another. Rows come back one for one; null ids link but name nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.llm.catalog import query, table
from pairpref.llm.components import Forest, components
from pairpref.session import stored

COSINE = 0.98
SHARD, PIVOTS, HOMES, APART, DEALT = 500, 256, 3, 0.9, 1000
#: A split is taken back where a shard of it keeps more than this share; classes on a side of an exact block.
SHRINK, PIECE = 0.8, 1000
POOL, RANDOM, DEGREE, ALPHA, BEAM, STEP, SLACK = 48, 16, 20, 1.2, 16, 16, 0.04
AUDIT, RECALL, TRIES = 256, 0.95, 3
MEMBER = "shard long, rep long, n long, vector array<float>"


def _unit(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # Scale first: squares of very large or very small components leave the range of doubles.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class key, one row per class with its smallest id and size)."""
    good = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    keyed = rows.withColumns({
        "good": F.coalesce(good, F.lit(False)), "k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "embedding", "label"),
    })
    same = keyed.where("good").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("vector")
    )
    return keyed, same.where("rep is not null")


def spread(pivots: np.ndarray) -> np.ndarray:
    """Pivots no two of which are close, so that a dense group keeps a shard; all of them where only one would be left."""
    close, kept = pivots @ pivots.T, []
    for i in range(len(pivots)):
        if not kept or close[i, kept].max() < APART:
            kept.append(i)
    return pivots[kept] if len(kept) > 1 else pivots


def _nearest_pivots(homes: int):
    def assign(rows: pa.Table, named: pa.Table) -> pa.Table:
        if not len(rows) or not len(named):
            return rows.select(["shard", "shard", "rep", "n", "vector"]).rename_columns(["parent", "shard", "rep", "n", "vector"])
        shard = named.column("shard")[0].as_py()
        centre = spread(_unit(pa.array(named.column("pivots")[0].as_py(), pa.list_(pa.float32()))))
        near = np.argsort(-(_unit(rows.column("vector")) @ centre.T), axis=1, kind="stable")[:, :homes]
        names = np.array([hash((shard, k)) for k in range(len(centre))], np.int64)
        taken = rows.take(pa.array(np.repeat(np.arange(len(rows)), near.shape[1])))
        parent = np.full(len(taken), shard)
        return pa.table({"parent": parent, "shard": names[near.ravel()], **{c: taken.column(c) for c in ("rep", "n", "vector")}})

    return assign


def shards(found: DataFrame, homes: int) -> DataFrame:
    """MEMBER rows: each class in the shards of its nearest pivots, until no shard holds more than SHARD classes or cannot split."""
    members = stored(found.select(F.xxhash64("label", F.size("vector")).alias("shard"), "rep", "n", "vector"))
    whole = stored(found.sparkSession.createDataFrame([], "shard long"))
    while True:
        large = members.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD)
        sizes = stored(large.join(whole, "shard", "left_anti"))
        if sizes.isEmpty():
            return members
        order = Window.partitionBy("shard").orderBy(F.xxhash64("rep"), "rep")
        # Enough pivots for shards half full, copies included.
        wanted = F.least(F.lit(PIVOTS), F.ceil(2 * homes * F.col("size") / SHARD) + 1)
        few = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).join(sizes, "shard").where(F.col("r") <= wanted)
        pivots = stored(few.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vector"))), lambda x: x.vector).alias("pivots")))
        # A shard is dealt out in pieces of about DEALT classes, each of which gets the pivots once.
        pieces = F.ceil(F.col("size") / DEALT)
        rows = members.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("rep"), pieces)).drop("size")
        named = pivots.join(sizes, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("size")
        split = rows.groupBy("shard", "piece").cogroup(named.groupBy("shard", "piece")).applyInArrow(_nearest_pivots(homes), f"parent long, {MEMBER}")
        split = stored(split)
        most = split.groupBy("parent", "shard").count().groupBy(F.col("parent").alias("shard")).agg(F.max("count").alias("most"))
        stuck = stored(most.join(sizes, "shard").where(F.col("most") > SHRINK * F.col("size")).select("shard"))
        whole = stored(whole.union(stuck))
        taken = split.join(stuck.select(F.col("shard").alias("parent")), "parent", "left_anti").drop("parent")
        members = stored(taken.unionByName(members.join(sizes.join(stuck, "shard", "left_anti"), "shard", "left_anti")))


def robust_pruned(unit: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each vector: the closest candidate stays and drops those ALPHA times closer to it than to the vector."""
    n = len(unit)
    random = np.random.default_rng(seed & 0x7FFFFFFF)
    lists: list[np.ndarray] = []
    for at in range(0, n, 256):
        block = np.arange(at, min(n, at + 256))
        close = unit[block] @ unit.T
        close[np.arange(len(block)), block] = -2
        k = min(POOL, n - 1)
        pool = np.argpartition(-close, k - 1, axis=1)[:, :k]
        pool = np.concatenate([pool, random.integers(0, n, (len(block), RANDOM))], axis=1)
        near = np.take_along_axis(close, pool, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
        between = np.einsum("bid,bjd->bij", unit[pool], unit[pool])
        open_ = pool != block[:, None]
        chosen = np.zeros(pool.shape, bool)
        rows = np.arange(len(block))
        for _ in range(DEGREE):
            first = open_.argmax(1)
            some = open_[rows, first]
            chosen[rows[some], first[some]] = True
            open_ &= ALPHA * (1 - between[rows, first]) > (1 - near)
            open_[rows, first] = False
            if not open_.any():
                break
        lists += [np.unique(pool[i, chosen[i]]) for i in rows]
    return lists


def reachable(lists: list[np.ndarray], start: int) -> np.ndarray:
    seen = np.zeros(len(lists), bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        front = np.unique(np.concatenate([lists[i] for i in front]))
        front = front[~seen[front]]
        seen[front] = True
    return seen


def medoid(unit: np.ndarray) -> int:
    return int(np.argmax(unit @ unit.sum(0)))


def _build(shard: pa.Table) -> pa.Table:
    reps = shard.column("rep").to_numpy()
    order = np.argsort(reps)
    reps, unit = reps[order], _unit(shard.column("vector"))[order]
    lists: list[np.ndarray] = [np.empty(0, np.int64)]
    if len(reps) > 1:
        lists = robust_pruned(unit, int(shard.column("shard")[0].as_py()))
        back = [[] for _ in reps]
        for i, own in enumerate(lists):
            for j in own:
                back[j].append(i)
        # Every edge is also walked backwards; in dense groups many lists name the same few central classes.
        lists = [np.union1d(own, np.array(b, np.int64)) for own, b in zip(lists, back)]
        start = medoid(unit)
        while not (seen := reachable(lists, start)).all():
            lost, known = np.flatnonzero(~seen)[0], np.flatnonzero(seen)
            nearest = known[np.argmax(unit[known] @ unit[lost])]
            lists[nearest] = np.append(lists[nearest], lost)
    return pa.table({"rep": pa.array(reps), "out": pa.array([reps[x.astype(np.int64)] for x in lists], pa.list_(pa.int64()))})


def _search(beam: int, cosine: float):
    def run(shard: pa.Table) -> pa.Table:
        name = shard.column("shard")[0].as_py()
        reps = shard.column("rep").to_numpy()
        order = np.argsort(reps)
        shard = shard.take(pa.array(order))
        reps, n, unit = reps[order], shard.column("n").to_numpy(), _unit(shard.column("vector"))
        homes = [set(h) for h in shard.column("homes").to_pylist()]
        lists = []
        for out in shard.column("out").to_pylist():
            known = np.searchsorted(reps, out).clip(0, len(reps) - 1)
            lists.append(known[reps[known] == np.array(out, np.int64)])
        links, forest = np.zeros(len(reps), np.int64), Forest()
        start = medoid(unit)
        for q in range(len(reps)):
            close = unit @ unit[q] if len(reps) <= 64 else None
            hits = np.flatnonzero(close >= cosine) if close is not None else range_search(unit, lists, q, start, beam, cosine)
            for x in hits[hits != q]:
                forest.union(q, int(x))
                if min(homes[q] & homes[x]) == name:
                    links[q] += n[x]
        roots = np.array([reps[forest.root(q)] for q in range(len(reps))], np.int64)
        return pa.table({"rep": pa.array(reps), "links": pa.array(links), "root": pa.array(roots)})

    return run


def range_search(unit: np.ndarray, lists: list[np.ndarray], q: int, start: int, beam: int, cosine: float) -> np.ndarray:
    """Greedy search with a beam from ``start`` and the query's own list; every node near the range is expanded until none is left."""
    seen = np.zeros(len(unit), bool)
    nodes = np.unique([start, q])
    seen[nodes] = True
    close, done = unit[nodes] @ unit[q], np.zeros(len(nodes), bool)
    while True:
        todo = np.flatnonzero(~done & (close >= cosine - SLACK))
        if not len(todo):
            kept = np.argsort(-close, kind="stable")[:beam]
            todo = kept[~done[kept]][:STEP]
            if not len(todo):
                return nodes[close >= cosine]
        done[todo] = True
        new = np.concatenate([lists[i] for i in nodes[todo]])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        nodes, done = np.concatenate([nodes, new]), np.concatenate([done, np.zeros(len(new), bool)])
        close = np.concatenate([close, unit[new] @ unit[q]])


def _block(cosine: float):
    """All pairs between two pieces of a shard, or within one."""

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pa.array(np.argsort(block.column("rep").to_numpy())))
        name, reps, n, piece = block.column("shard")[0].as_py(), *(block.column(c).to_numpy() for c in ("rep", "n", "piece"))
        one, two = np.flatnonzero(piece == block.column("a")[0].as_py()), np.flatnonzero(piece == block.column("b")[0].as_py())
        within, unit = np.array_equal(one, two), _unit(block.column("vector"))
        links, forest, label = np.zeros(len(reps), np.int64), Forest(), np.arange(len(reps))
        earlier: dict = {}
        for i, homes in enumerate(block.column("homes").to_pylist()):
            for home in homes:
                if home < name:
                    earlier.setdefault(home, []).append(i)
        elsewhere = np.zeros((len(one), len(two)), bool)
        for both in earlier.values():
            elsewhere[np.ix_(np.isin(one, both), np.isin(two, both))] = True
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            close = unit[rows] @ unit[two].T >= cosine
            if within:
                close[np.arange(len(rows)), at + np.arange(len(rows))] = False
            for q, hits in zip(rows, close):
                near = np.append(two[hits], q)
                first, *others = np.unique(label[near]).tolist()
                for x in others:
                    forest.union(first, x)
                label[near] = forest.root(first)
            counts = close & ~elsewhere[at : at + 256]
            links[rows] += counts @ n[two]
            if not within:
                links[two] += counts.T @ n[rows]
        roots = np.array([reps[forest.root(x)] for x in label.tolist()], np.int64)
        return pa.table({"rep": pa.array(reps), "links": pa.array(links), "root": pa.array(roots)})

    return run


def compared(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) of MEMBER rows with ``homes``: every pair of a shard, in blocks of at most two pieces."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    dealt = members.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    blocks = dealt.select("shard", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), "piece", "rep", "n", "vector", "homes")
    return blocks.groupBy("shard", "a", "b").applyInArrow(_block(cosine), "rep long, links long, root long")


def searched(found: DataFrame, homes: int, beam: int, cosine: float) -> DataFrame:
    """(rep, links, root): per class and shard, links that count there and the smallest class linked there."""
    members = shards(found, homes)
    dense = stored(members.groupBy("shard").count().where(F.col("count") > SHARD).select("shard"))
    small = members.join(dense, "shard", "left_anti")
    lists = small.groupBy("shard").applyInArrow(_build, "rep long, out array<long>")
    united = stored(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")))
    at = members.groupBy("rep").agg(F.collect_set("shard").alias("homes"))
    full = small.join(united.join(at, "rep"), "rep")
    parts = full.groupBy("shard").applyInArrow(_search(beam, cosine), "rep long, links long, root long")
    return stored(parts.union(compared(members.join(dense, "shard", "left_semi").join(at, "rep"), cosine)))


def audit(found: DataFrame, links: DataFrame, cosine: float) -> float:
    """Share of the sampled classes' true links (to all classes, by brute force in blocks) that were found.

    The lesser of the share of all links and the mean share of the classes, so that neither large nor small groups hide a loss.
    """
    sample = found.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT).select("rep", "label", "vector")
    chosen = sample.collect()
    if not chosen:
        return 1.0
    names = found.sparkSession.sparkContext.broadcast([(r["rep"], r["label"], len(r["vector"]), np.array(r["vector"], np.float32)) for r in chosen])

    def count(batches):
        for batch in batches:
            groups: dict = {}
            for i, (label, v) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vector"))):
                groups.setdefault((label, len(v)), []).append(i)
            reps, total = [], []
            for key, rows in groups.items():
                asked = [(rep, v) for rep, label, size, v in names.value if (label, size) == key]
                if asked:
                    unit, n = _unit(batch.column("vector").take(pa.array(rows))), batch.column("n").to_numpy()[rows]
                    wanted = _unit(pa.array([v for _, v in asked], pa.list_(pa.float32())))
                    reps += [rep for rep, _ in asked]
                    total += ((wanted @ unit.T >= cosine) @ n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(total, pa.int64())], ["rep", "true"])

    true = found.select("label", "n", "vector").mapInArrow(count, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    own = found.select("rep", "n")
    both = true.join(own, "rep").join(links, "rep", "left").select((F.col("true") - F.col("n")).alias("true"), F.coalesce("links", F.lit(0)).alias("links"))
    pooled, mean = both.where(F.col("true") > 0).agg(F.sum("links") / F.sum("true"), F.avg(F.col("links") / F.col("true"))).first()
    return 1.0 if pooled is None else min(pooled, mean)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept and the audited recall."""
    keyed, same = classes(vectors)
    keyed, found = stored(keyed.drop("embedding", "label")), stored(same)
    for attempt in range(TRIES + 1):
        if attempt < TRIES:
            parts = searched(found, HOMES + attempt, BEAM << attempt, cosine)
        else:
            label = F.xxhash64("label", F.size("vector"))
            parts = stored(compared(found.select(label.alias("shard"), "rep", "n", "vector", F.array(label).alias("homes")), cosine))
        links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = audit(found, links, cosine)
        if recall >= RECALL:
            break
    reached = components(parts.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    judged = found.select("k1", "k2", "rep", "n").join(links, "rep").join(reached, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", (F.col("links") + F.col("n") - 1).alias("found"), F.coalesce("component", "rep").alias("component")
    )
    rows = keyed.where("good").join(judged, ["k1", "k2"], "left").select("vec_id", "found", "component")
    rows = rows.unionByName(keyed.where("not good").select("vec_id", F.lit(None).cast("long").alias("found"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("found", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(float(recall)).alias("audit_recall"),
    )


SQL = """
with recursive ok as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as low from reach group by a)
select v.vec_id, (select count(*) from links where a = v.vec_id) as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id,
  v.vec_id <= coalesce(low, v.vec_id) as kept, 1.0::double as audit_recall
from embeddings v left join least on a = v.vec_id
"""


@query("op9_embedding_dedup", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
