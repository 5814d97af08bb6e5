"""Prefix trie of conversations by truncation peeling.

A conversation is the chain of the names of its prefixes: the name of d turns is 128 bits of a SHA-256 over the name of
d - 1 turns and the next turn. Texts are hashed where they are read; only names and lengths move on. Equal conversations
are one path first.

Paths sorted by their chains of names hold every subtree together, so a range of them is peeled in one task: from the
greatest depth down, conversations that end here are merged with the nodes that survive from below, the last turn is
stripped, and what is left is grouped again. A node is complete once its depth is peeled, and its sums go to its parent.
Only nodes on the first or the last path of a range may go on in another range. They stay open: what a range knows of
them travels with these two paths to the next level, where ranges are peeled again, until one task holds all that is
left. So no depth costs a job, and a first turn that a third of all conversations share is peeled in many tasks.

Turns come in order of ``turn`` (nulls first), then role, then a fingerprint of the text. Null role or text is empty.
Rows of a null conv_id are one conversation, which is last in any order, borrows nothing and adds nothing to a digest of
ids; a node of which it is the only member has a null conv_id. Repeated rows are turns of their own. An empty table has
no nodes. Other columns are ignored. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.llm.catalog import query, table
from pairpref.session import broadcast_if_small, stored

BORROWED, FAMILY = 6, 100
#: Stands for a null conv_id, as the greatest.
NOBODY = 2**63 - 1
#: Entries a task peels, and the least number of paths in it (all but two of them are done with there).
ENTRIES_A_TASK, PATHS_A_TASK = 400_000, 64
NAME = np.dtype([("hi", "<u8"), ("lo", "<u8")])
#: What is known of one node of a path: sums over conversations that end in it and over its finished children.
ENTRY = np.dtype(
    [("depth", "<i8"), ("n", "<i8"), ("low", "<i8"), ("kids", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("ended", "?"), ("ends", "V32")]
)
PATH = "path binary, chars binary, entries binary"
FOUND = (
    "name binary, parent binary, conv_id long, depth long, parent_conv_id long, settled boolean, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, " + PATH
)


def positioned(turns: DataFrame) -> DataFrame:
    """(conv, pos, mark, chars) per row of ``turns``: its place in its conversation, 128 bits of its content, code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), content.alias("content"), F.length(text).alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    mark = F.unhex(F.substring("content", 1, 32)).alias("mark")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("conv", "pos", mark, "chars")


def with_borrowed(own: DataFrame) -> DataFrame:
    """Rows of rebuilt conversations, and one of position -1 for each: the first turns come from the family's first."""
    borrows = F.when(F.col("conv") == NOBODY, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED)
    first = own.where("pos = 0").select("conv", borrows.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    lent = own.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < BORROWED - 1)).withColumnRenamed("conv", "base")
    lent = first.join(lent, "base").where("pos < h").select("conv", "pos", "mark", "chars")
    marks = first.selectExpr("conv", "-1 as pos", "cast(null as binary) as mark", "0 as chars")
    return own.where(F.col("pos") >= borrows).unionByName(lent).unionByName(marks)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, chars = [], []
        for turns in batch.column("turns").to_pylist():
            name, chain = b"", []
            for turn in turns[1:]:
                name = hashlib.sha256(name + turn["mark"]).digest()[:16]
                chain.append(name)
            paths.append(b"".join(chain))
            chars.append(np.array([0] + [t["chars"] for t in turns[1:]], np.int32).tobytes())
        ends = [x[-16:] for x in paths]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(ends, pa.binary()), pa.array(paths, pa.binary()), pa.array(chars, pa.binary())],
            ["conv", "end", "path", "chars"],
        )


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, entry) of each run of equal ends in rows sorted by end and conv; a run may go on over batches."""
    end, low, n, sha = None, 0, 0, None

    def row() -> pa.RecordBatch:
        entry = np.zeros(1, ENTRY)
        entry["n"], entry["low"], entry["ended"], entry["ends"] = n, low, True, np.void(sha.digest())
        return pa.RecordBatch.from_arrays([pa.array([low]), pa.array([entry.tobytes()], pa.binary())], ["low", "entry"])

    for batch in batches:
        convs = batch.column("conv").to_numpy()
        coded = batch.column("end").dictionary_encode()
        runs = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1, append=-2)) if len(convs) else []
        done = []
        for a, b in zip(runs[:-1], runs[1:]):
            value = coded.dictionary[int(coded.indices[int(a)].as_py())].as_py()
            if value != end:
                if sha is not None:
                    done.append(row())
                end, low, n, sha = value, int(convs[a]), 0, hashlib.sha256()
            said = ",".join(str(c) for c in convs[a:b].tolist() if c != NOBODY)
            sha.update((("," if n and said else "") + said).encode())
            n += int(b - a)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if sha is not None:
        yield row()


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets the depth of each path's only entry."""
    for batch in batches:
        made = []
        for path, entry in zip(batch.column("path").to_pylist(), batch.column("entry").to_pylist()):
            entry = np.frombuffer(entry, ENTRY).copy()
            entry["depth"] = len(path) // 16
            made.append(entry.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("chars"), pa.array(made, pa.binary())], ["path", "chars", "entries"])


def distinct_paths(rebuilt: DataFrame) -> DataFrame:
    """PATH rows: one per distinct conversation, with what is known of its end."""
    turns = F.sort_array(F.collect_list(F.struct("pos", "mark", "chars"))).alias("turns")
    paths = stored(rebuilt.groupBy("conv").agg(turns).mapInArrow(_paths, "conv long, end binary, path binary, chars binary"))
    members = paths.select("end", "conv").repartition("end").sortWithinPartitions("end", "conv")
    classes = members.mapInArrow(_classes, "low long, entry binary")
    return paths.join(classes, F.col("conv") == F.col("low")).select("path", "chars", "entry").mapInArrow(_entered, PATH)


class Paths:
    """Sorted paths of a task; row r has the names of depths 1 to ``length[r]``."""

    def __init__(self, rows: pa.Table):
        path, chars, entries = (rows.column(c).to_pylist() for c in ("path", "chars", "entries"))
        self.path, self.chars = path, chars
        self.length = np.array([len(x) // 16 for x in path])
        self.begin = np.cumsum(self.length) - self.length
        self.names = np.frombuffer(b"".join(path), NAME)
        self.sizes = np.frombuffer(b"".join(chars), "<i4")
        self.entries = np.frombuffer(b"".join(entries), ENTRY)
        self.rows = np.repeat(np.arange(len(path)), [len(x) // ENTRY.itemsize for x in entries])

    def names_at(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.names[self.begin[rows] + depth - 1] if depth else np.zeros(len(rows), NAME)

    def sizes_at(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.sizes[self.begin[rows] + rows + depth].astype(np.int64)

    def on_path(self, names: np.ndarray, row: int, depth: int) -> np.ndarray:
        if self.length[row] < depth:
            return np.zeros(len(names), bool)
        return names == self.names_at(np.array([row]), depth)[0]


def _binary(names: np.ndarray, depth: int) -> list[bytes]:
    return [x.tobytes() for x in names] if depth > 0 else [b""] * len(names)


def _peel(last: bool) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if len(b)]
        if not every:
            return
        paths = Paths(pa.Table.from_batches(every))
        final_row = len(paths.path) - 1
        by_depth = np.argsort(-paths.entries["depth"], kind="stable")
        deep = -paths.entries["depth"][by_depth]
        up, up_rows = np.zeros(0, ENTRY), np.zeros(0, np.int64)
        kept: dict[int, list[np.ndarray]] = {0: [], final_row: []}
        below = None
        for depth in range(int(-deep[0]), -1, -1):
            here = by_depth[np.searchsorted(deep, -depth) : np.searchsorted(deep, -depth, "right")]
            some, rows = np.concatenate([up, paths.entries[here]]), np.concatenate([up_rows, paths.rows[here]])
            if len(rows) == 0:  # all that came so far stays open
                continue
            order = np.argsort(rows, kind="stable")
            names = paths.names_at(rows[order], depth)
            new = np.concatenate([[True], names[1:] != names[:-1]])
            head = np.flatnonzero(new)
            some, rows = some[order], rows[order]
            nodes, first, names = np.zeros(len(head), ENTRY), rows[head], names[head]
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            nodes["depth"] = depth
            for field in ("n", "kids", "leaves", "saved"):
                nodes[field] = np.add.reduceat(some[field], head)
            nodes["low"] = np.minimum.reduceat(some["low"], head)
            ended = np.flatnonzero(some["ended"])
            nodes["ended"][np.cumsum(new)[ended] - 1] = True
            nodes["ends"][np.cumsum(new)[ended] - 1] = some["ends"][ended]
            at_first, at_last = (paths.on_path(names, r, depth) for r in (0, final_row))
            is_open = np.zeros(len(head), bool) if last else at_first | at_last
            if below is not None:
                yield _finished(*below, names, nodes, is_open, group[: len(up)], depth)
            for row, on in ((0, is_open & at_first), (final_row, is_open & at_last & ~at_first)):
                kept[row].append(nodes[on])
            closed = ~is_open
            nodes["leaves"][closed] += nodes["kids"][closed] == 0
            nodes["saved"][closed] += (nodes["n"][closed] - 1) * paths.sizes_at(first[closed], depth)
            below = names[closed], nodes[closed]
            up, up_rows = nodes[closed], first[closed]
            up["kids"], up["ended"] = 1, False
        if last:
            yield _finished(*below, None, None, None, None, -1)
            return
        for row in sorted({0, final_row}):
            entries = np.concatenate(kept[row])
            yield _rows({"path": [paths.path[row]], "chars": [paths.chars[row]], "entries": [entries.tobytes()]}, 1)

    return apply


SCHEMA = pa.schema(
    [("name", pa.binary()), ("parent", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")]
    + [("settled", pa.bool_())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("path", pa.binary()), ("chars", pa.binary()), ("entries", pa.binary())]
)


def _rows(columns: dict, count: int) -> pa.RecordBatch:
    made = [columns.get(f.name, [None] * count) for f in SCHEMA]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, SCHEMA)], schema=SCHEMA)


def _finished(names, nodes, parents, above, is_open, parent, depth) -> pa.RecordBatch:
    """Rows of finished nodes; ``parent`` are their places among the nodes ``above`` at ``depth`` (-1: they are the root)."""
    nothing = hashlib.sha256().hexdigest()
    ends = [bytes(e).hex() if x else nothing for x, e in zip(nodes["ended"], nodes["ends"])]
    columns = {
        "name": _binary(names, depth + 1),
        "conv_id": nodes["low"], "depth": nodes["depth"], "n_convs": nodes["n"], "n_children": nodes["kids"],
        "n_leaves": nodes["leaves"], "saved_tokens": nodes["saved"], "ends_sha256": ends,
        "settled": np.ones(len(nodes), bool) if above is None else ~is_open[parent],
    }
    if above is not None:
        columns["parent"] = _binary(parents[parent], depth)
        columns["parent_conv_id"] = pa.array(above["low"][parent], pa.int64(), mask=is_open[parent])
    return _rows(columns, len(nodes))


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (PATH): name, conv_id, depth, parent_conv_id, counts, ends_sha256."""
    levels = []
    while True:
        paths = stored(paths)
        size = paths.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("entries") / ENTRY.itemsize), F.lit(0)).alias("entries")).first()
        parts = min(-(-int(size.entries) // ENTRIES_A_TASK), -(-size.rows // PATHS_A_TASK))
        dealt = paths.repartitionByRange(parts, "path") if parts > 1 else paths.repartition(1)
        found = stored(dealt.sortWithinPartitions("path").mapInArrow(_peel(parts <= 1), FOUND))
        levels.append(found.where("path is null").drop("path", "chars", "entries"))
        if parts <= 1:
            break
        paths = found.where("path is not null").select("path", "chars", "entries")
    done = levels[-1]
    for found in reversed(levels[:-1]):
        later = done.select(F.col("name").alias("__name"), F.col("conv_id").alias("__conv"))
        loose = found.where("not settled").join(broadcast_if_small(later), F.col("parent") == F.col("__name"))
        loose = loose.withColumn("parent_conv_id", F.col("__conv")).drop("__name", "__conv")
        done = done.unionByName(found.where("settled")).unionByName(loose)
    shown = lambda c: F.when(F.col(c) != NOBODY, F.col(c)).alias(c)
    return done.select(
        "name", shown("conv_id"), "depth", shown("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def trie(turns: DataFrame, rebuild: bool = False) -> DataFrame:
    """Nodes of the conversations in ``turns`` (conv_id, turn, role, text); with ``rebuild`` families share first turns."""
    own = stored(positioned(turns))
    if rebuild:
        return nodes_of(distinct_paths(with_borrowed(own)))
    return nodes_of(distinct_paths(own.unionByName(own.where("pos = 0").selectExpr("conv", "-1 as pos", "cast(null as binary) as mark", "0 as chars"))))


SQL = r"""
with table_of as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) as t),
own as (
  select conv_id, length(coalesce(text, '')) as chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as mark,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations),
convs as (
  select conv_id, xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: unicode(x)::bigint),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) % 6 as h
  from (select distinct conv_id from own), table_of),
rebuilt as (
  select o.conv_id, pos, mark, chars from own o join convs c on o.conv_id = c.conv_id where pos >= h
  union all select c.conv_id, pos, mark, chars from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 100 where pos < h),
prefixes as (
  select conv_id, string_agg(mark, '') over w as path, count(*) over w as depth, chars,
    count(*) over w = count(*) over (partition by conv_id) as ends
  from rebuilt window w as (partition by conv_id order by pos rows unbounded preceding)
  union all select conv_id, '', 0, 0, conv_id not in (select conv_id from rebuilt) from convs),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by path, depth),
families as (
  select n.*, p.conv_id as parent_conv_id, coalesce(k.n_children, 0) as n_children
  from nodes n left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.path = n.path[:64 * (n.depth - 1)]
  left join (select depth - 1 as depth, path[:64 * (depth - 1)] as path, count(*) as n_children from nodes where depth > 0 group by all) k
    on k.depth = n.depth and k.path = n.path),
steps as (select path, depth, unnest(range(0, depth + 1)) as d, n_children, (n_convs - 1) * chars as saved from families),
subtrees as (
  select d as depth, path[:64 * d] as path, count(*) filter (n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from steps group by all)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from families join subtrees using (depth, path)
"""


@query("op12_prefix_trie", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"), rebuild=True).drop("name")
