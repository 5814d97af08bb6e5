"""N-gram Jaccard join by T-occurrence search (DivideSkip), as components of linked documents.

A document's set holds its distinct four-word shingles (A-Z lower-cased). Sets with Jaccard similarity of at least
``PERCENT`` link. Equal sets are one node from the start. Two linking sets share at least one of each other's first
n - T + 1 shingles in any fixed order (T: overlap a set of n needs). The order here is by length of the shingle, since
long ones are rare; a first pass over these heads finds the frequent shingles among them, which the order of the
second pass puts last (at most ``DEMOTED`` of them, the most frequent; any order gives the same links). Only heads are
shuffled: 8 bytes a shingle in the first pass, 16 in the second, whatever the number of buckets. No set is stored whole:
of each, ``LEAD`` heads in the first order are kept. A set whose head in the second order reaches further is made from its text
again, and so are candidates. The few sets of a rare shingle are candidates of each other where their
sizes allow a link and their parity bitmaps (about one bit a shingle; the differing bits of two sets are at most the
shingles that differ) do not rule it out. The sets of a frequent shingle are only chained in order of size, a linear
number of edges that connects all candidates.

The components of these edges are the blocks. A block's inverted lists are searched: short lists are merged by a heap and give
the sets that occur often enough there, long lists are only probed by binary search, and a set that reaches the
required overlap links. Only what connects components is wanted, so sets known to be connected are not probed, and
every set outside the largest component of its block is a query. A block of more than ``TILE`` shingles is divided
into tiles: each is searched on its own, then a few sets of each tile visit all tiles, then every set still outside
the block's largest component does. Two sets that are not connected in the end have met in a search.

Null, empty and blank texts have the empty set and link with nothing; fewer than four words are one shingle. Rows
come back one for one; repeated rows link. A null doc_id names no component: its own is the smallest id linked to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import query, table
from pairpref.llm.components import Forest, components
from pairpref.llm.tokens import as_texts, fingerprints, mixed, ranges, rolling, small_batches, words_of
from pairpref.llm.windows import BUCKET_CHARS, NO_ID, pieces
from pairpref.session import broadcast_if_small, scratch, stored

WIDTH, PERCENT = 4, 85
TILE, MU, HEAPED = 500_000, 0.01, 2_000
#: Bytes of text whose sets are made at once, of a row group and of a page of the table that keeps them.
SET_BYTES, ROW_GROUP, PAGE = 1_000_000, 8 << 20, 1 << 18
#: A shingle in more sets than this is frequent.
RARE, DEMOTED = 8, 1 << 20
#: Shingles of each set that are stored, in lengths of its head.
LEAD = 2
#: A shingle of a head: its mark (48 bits) and the code of the set's size (16 bits) in one number, and the set.
ENTRY = np.dtype([("key", "<u8"), ("name", "<i8")])
MARK, LOW = np.uint64(16), np.uint64(0xFFFF)
#: A double keeps 41 bits of fraction below its exponent and the 11 bits of fraction that a size code holds.
FRACTION, ONE = np.uint64(41), np.uint64(0x3FF << 52 >> 41)
SECOND, THIRD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def needed(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Overlap without which a set of ``n`` shingles links with nothing."""
    return -(-n * percent // 100)


def head_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - needed(n, percent) + 1


def size_codes(n: np.ndarray) -> np.ndarray:
    """16 bits that order sizes of 1 to 2**32 - 1: exponent and 11 bits of fraction; exact below 4096."""
    return (n.astype(np.float64).view(np.uint64) >> FRACTION) - ONE


def least_size(codes: np.ndarray) -> np.ndarray:
    """The least size of a code; every size of a code is below the least one of the next."""
    return ((codes + ONE) << FRACTION).view(np.float64)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, shingles): the distinct shingles of each text, longest first, then by hash (56 bits and the length)."""
    offsets, words = words_of(pc.ascii_lower(texts))
    prints, chars = fingerprints(words), pc.binary_length(words).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashes, sums = rolling(prints, width), np.concatenate([[0], np.cumsum(chars)])
    inside = np.flatnonzero(text[: len(hashes)] == text[width - 1 :]) if len(hashes) else np.empty(0, np.int64)
    owner, value, length = text[inside], hashes[inside], sums[inside + width] - sums[inside]
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = [int(mixed(np.array([sum(int(p) * pow(3, i + 1, 1 << 64) for i, p in enumerate(prints[offsets[s] : offsets[s + 1]])) % (1 << 64)], np.uint64) + np.uint64(count[s]))[0]) for s in short]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(whole, np.uint64)])
        length = np.concatenate([length, sums[offsets[short + 1]] - sums[offsets[short]]])
    # The rank by length takes the first byte, so that one sort orders and brings equal shingles together.
    value = (np.uint64(255) - np.minimum(length, 255).astype(np.uint64) << np.uint64(56)) | (value >> np.uint64(8))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
        owner, value = owner[new], value[new]
    return np.searchsorted(owner, np.arange(len(offsets))), value


def set_names(offsets: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from the sum over its scrambled shingles and its size."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(shingles ^ SECOND), dtype=np.uint64)])[offsets]
    return mixed(np.diff(sums) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that are the bytes of ``data`` between two offsets, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def parity_bits(offsets: np.ndarray, shingles: np.ndarray) -> pa.Array:
    """A bitmap of each set: bit h is the parity of its shingles that fall there; a power of two of at least n bits."""
    n = np.diff(offsets)
    width = np.maximum(128, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    place = (mixed(shingles ^ THIRD) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1], n)
    odd = np.zeros(begin[-1], np.uint8)
    np.bitwise_xor.at(odd, place, 1)
    return binaries(begin // 8, np.packbits(odd))


def bits_apart(a: bytes, b: bytes) -> int:
    """Differing bits; the wider bitmap is folded to the width of the other, which keeps parities."""
    short, long = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(long) > len(short):
        long = np.bitwise_xor.reduce(long.reshape(2, -1), axis=0)
    return int(np.bitwise_count(short ^ long).sum())


def _sizes(width: int, percent: int) -> Callable:
    """Size, name and bitmap of each row's set, and the first ``LEAD`` heads of its shingles."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, SET_BYTES)):
            offsets, shingles = shingle_sets(as_texts(batch.column("text")), width)
            n = np.diff(offsets)
            held = np.minimum(n, LEAD * head_size(n, percent))
            lead = binaries(8 * np.concatenate([[0], np.cumsum(held)]), shingles[ranges(offsets[:-1], held)])
            made = [pa.array(n), pa.array(set_names(offsets, shingles)), parity_bits(offsets, shingles), lead]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_key"), batch.column("print"), *made], ["doc_key", "print", "n_shingles", "name", "bits", "shingles"]
            )

    return apply


def _whole(width: int) -> Callable:
    """All shingles of each row's set in place of its text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, SET_BYTES)):
            offsets, shingles = shingle_sets(as_texts(batch.column("text")), width)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], binaries(8 * offsets, shingles)], [*kept, "shingles"])

    return apply


def _loaded(keyed: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The columns of ``rows`` (stored; doc_key and print name rows of ``keyed``) and the whole sets, made from the texts."""
    rest = [c for c in rows.columns if c not in ("doc_key", "print")]
    some = keyed.join(broadcast_if_small(rows), ["doc_key", "print"]).select(*rest, "text")
    return some.mapInArrow(_whole(width), ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest) + ", shingles binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``TILE`` shingles."""
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column("shingles")).to_numpy()) // 8
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TILE, "right")))
            yield whole.slice(begin, end - begin)
            begin = end


def _marks(batch: pa.RecordBatch, late: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(rows of the distinct sets, offsets, marks, head sizes, ready): scrambled shingles, those in ``late`` after all others.

    A set is ready where its head is among the shingles that are there.
    """
    _, first = np.unique(batch.column("name").to_numpy(), return_index=True)
    n, column = batch.column("n_shingles").to_numpy()[first], batch.column("shingles")
    held = pc.binary_length(column).to_numpy()[first].astype(np.int64) // 8
    marks = mixed(np.frombuffer(b"".join(column[int(i)].as_buffer() for i in first), np.uint64))
    take = head_size(n, percent)
    ready = np.ones(len(n), bool)
    if len(late):
        short = marks >> MARK
        demoted = late[np.searchsorted(late, short).clip(0, len(late) - 1)] == short
        owner = np.repeat(np.arange(len(n)), held)
        marks = marks[np.lexsort((demoted, owner))]  # stable: within a set only the demoted move
        ready = (held == n) | (held - np.bincount(owner[demoted], minlength=len(n)) >= take)
    return first, np.concatenate([[0], np.cumsum(held)]), marks, take, ready


def _heads(percent: int, buckets: int, last=None) -> Callable:
    """Heads of the sets that are ready, the shingles in ``last`` (a broadcast sorted array of marks) put after all others.

    Without ``last`` an entry is a mark and 16 bits of the set's name, enough to count sets.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield part(batch, np.empty(0, np.uint64) if last is None else last.value)

    def part(batch: pa.RecordBatch, late: np.ndarray) -> pa.RecordBatch:
        first, offsets, marks, take, ready = _marks(batch, late, percent)
        name, n = (batch.column(c).to_numpy()[first[ready]] for c in ("name", "n_shingles"))
        take = take[ready]
        mark = marks[ranges(offsets[:-1][ready], take)]
        low = name.view(np.uint64) & LOW if last is None else size_codes(n)
        key = mark >> MARK << MARK | np.repeat(low, take)
        if last is None:
            entry = key
        else:
            entry = np.empty(len(key), ENTRY)
            entry["key"], entry["name"] = key, np.repeat(name, take)
        bucket = (mark % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entry, bucket = entry[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        parts = [entry[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(parts, pa.binary())], ["bucket", "entries"])

    return apply


def _unready(percent: int, last) -> Callable:
    """Rows of the sets whose head in the second order reaches beyond what is stored."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            first, *_, ready = _marks(batch, last.value, percent)
            yield batch.drop_columns(["shingles"]).take(pa.array(first[~ready]))

    return apply


def _frequent(bucket: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in bucket.column("entries")]))
    mark, sets = np.unique(keys >> MARK, return_counts=True)
    return pa.table({"mark": pa.array(mark[sets > RARE].view(np.int64)), "sets": pa.array(sets[sets > RARE].astype(np.int64))})


def _chains(percent: int) -> Callable:
    def apply(bucket: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in bucket.column("entries")])
        entry = entry[np.lexsort((entry["name"], entry["key"]))]
        entry = entry[np.concatenate([[True], (entry["key"][1:] != entry["key"][:-1]) | (entry["name"][1:] != entry["name"][:-1])])]
        mark, code, name = entry["key"] >> MARK, entry["key"] & LOW, entry["name"]
        below, least = least_size(code + np.uint64(1)), least_size(code)
        edges = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1], [True]]))
        group = np.repeat(np.diff(edges), np.diff(edges))
        found, rare = [np.empty((2, 0), np.int64)], [np.empty(0, bool)]
        for gap in range(1, RARE):
            a, b, few = slice(None, -gap), slice(gap, None), group[:-gap] <= RARE
            fit = (mark[a] == mark[b]) & (name[a] != name[b]) & (100 * below[a] >= percent * least[b])
            fit &= few if gap > 1 else True
            found.append(np.stack([np.minimum(name[a][fit], name[b][fit]), np.maximum(name[a][fit], name[b][fit])]))
            rare.append(few[fit])
        pairs, rare = np.concatenate(found, axis=1), np.concatenate(rare)
        pairs, first = np.unique(np.concatenate([pairs, rare[None].astype(np.int64)]), axis=1, return_index=True)
        return pa.table({"u": pa.array(pairs[0]), "v": pa.array(pairs[1]), "rare": pa.array(rare[first])})

    return apply


def _possible(percent: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            most = sizes - 2 * -(-percent * sizes // (100 + percent))
            apart = [bits_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column("bits_u"), batch.column("bits_v"))]
            yield batch.select(["u", "v"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return apply


class Index:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        edges = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.empty(0, np.int64)
        self.keys, self.begin, self.end, self.owner = shingles[edges], edges, np.append(edges[1:], len(shingles)), owner

    def lists(self, query: np.ndarray, least: int) -> list[np.ndarray]:
        """The inverted lists of a query's shingles that have at least ``least`` sets, shortest first."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, query).clip(0, len(self.keys) - 1)
        at = at[self.keys[at] == query]
        length = self.end[at] - self.begin[at]
        at = at[length >= least][np.argsort(length[length >= least], kind="stable")]
        return [self.owner[self.begin[i] : self.end[i]] for i in at]

    def linked(self, query: np.ndarray, least: int, skip: Callable[[int], bool], percent: int) -> Iterator[int]:
        """DivideSkip: sets whose similarity with ``query`` is at least ``percent``, except those ``skip`` says no to.

        Up to HEAPED entries of short lists are merged by a heap, more of them (lists of near copies) by one sort; all
        candidates that are still open probe a long list together.
        """
        n = len(query)
        lowest = needed(n, percent)
        lists = self.lists(query, least)
        if len(lists) < lowest:
            return
        long = min(lowest - 1, int(lowest / (MU * np.log2(len(lists[-1]) + 1) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        total = sum(map(len, short))
        if total <= HEAPED:
            merged = np.fromiter(heapq.merge(*[x.tolist() for x in short]), np.int64, total)
        else:
            merged = np.sort(np.concatenate(short))
        head = np.flatnonzero(np.diff(merged, prepend=-1))
        found, overlap = merged[head], np.diff(np.append(head, total))
        often = np.array([t >= lowest - long and not skip(x) for x, t in zip(found.tolist(), overlap.tolist())], bool)
        found, overlap = found[often], overlap[often]
        want = -(-percent * (n + self.sizes[found]) // (100 + percent))
        for rest, members in zip(range(len(probed), 0, -1), probed):
            unsure = np.flatnonzero((overlap < want) & (overlap + rest >= want))
            if not len(unsure):
                break
            at = np.searchsorted(members, found[unsure]).clip(0, len(members) - 1)
            overlap[unsure] += members[at] == found[unsure]
        yield from found[overlap >= want].tolist()


def connect(sets: list[np.ndarray], percent: int) -> Forest:
    """Forest over the sets: at the end, every set outside the largest component has been looked up among all."""
    index, forest = Index(sets), Forest()
    size, largest = dict.fromkeys(range(len(sets)), 1), 0
    asked, more = [False] * len(sets), True
    while more:
        more = False
        for q in range(len(sets)):
            if asked[q] or forest.root(q) == forest.root(largest):
                continue
            asked[q] = more = True
            for x in index.linked(sets[q], 2, lambda x: forest.root(x) == forest.root(q), percent):
                a, b = forest.root(q), forest.root(x)
                if forest.union(a, b):
                    top = forest.root(a)
                    size[top] = size[a] + size[b]
                    if size[top] > size[forest.root(largest)]:
                        largest = top
    return forest


def _search(percent: int) -> Callable:
    """(u, v): links that connect the sets of each tile, and visitors (``own`` false) with the tile's sets."""

    def apply(unit: pa.Table) -> pa.Table:
        blocks, tiles, names = (unit.column(c).to_numpy() for c in ("block", "tile", "name"))
        own = unit.column("own").to_numpy(zero_copy_only=False)
        order = np.lexsort((names, ~own, tiles, blocks))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(blocks[order]) != 0) | (np.diff(tiles[order]) != 0), [True]]))
        column, out = unit.column("shingles"), []
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            members, visitors = rows[own[rows]], rows[~own[rows]]
            _, once = np.unique(names[members], return_index=True)
            members = members[once]
            sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in members]
            if not len(visitors):
                forest = connect(sets, percent)
                out += [(names[members[x]], names[members[r]]) for x in range(len(sets)) if (r := forest.root(x)) != x]
                continue
            index = Index(sets)
            for v in visitors:
                query = np.frombuffer(column[int(v)].as_py(), np.uint64)
                out += [(names[v], names[members[x]]) for x in index.linked(query, 1, lambda x: names[members[x]] == names[v], percent)]
        u, v = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return apply


def _counted(percent: int) -> Callable:
    """(name, links): for each visitor of a tile, rows of the tile's sets that it links with; a set is no link of itself."""

    def apply(unit: pa.Table) -> pa.Table:
        blocks, tiles, names, rows_of = (unit.column(c).to_numpy() for c in ("block", "tile", "name", "rows"))
        own = unit.column("own").to_numpy(zero_copy_only=False)
        order = np.lexsort((names, ~own, tiles, blocks))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(blocks[order]) != 0) | (np.diff(tiles[order]) != 0), [True]]))
        column, found, links = unit.column("shingles"), [], []
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            members, visitors = rows[own[rows]], rows[~own[rows]]
            _, once = np.unique(names[members], return_index=True)
            members = members[once]
            _, once = np.unique(names[visitors], return_index=True)
            index = Index([np.frombuffer(column[int(i)].as_py(), np.uint64) for i in members])
            for v in visitors[once]:
                query = np.frombuffer(column[int(v)].as_py(), np.uint64)
                met = members[list(index.linked(query, 1, lambda x: names[members[x]] == names[v], percent))]
                found.append(names[v])
                links.append(int(rows_of[met].sum()))
        return pa.table({"name": pa.array(found, pa.int64()), "links": pa.array(links, pa.int64())})

    return apply


def _unit(units: int) -> Column:
    return F.pmod(F.xxhash64("block", "tile"), F.lit(units)).alias("unit")


def _searched(rows: DataFrame, units: int, percent: int) -> DataFrame:
    return stored(rows.select(_unit(units), "block", "tile", "name", "own", "shingles").groupBy("unit").applyInArrow(_search(percent), "u long, v long"))


def _visits(members: DataFrame, visitors: DataFrame, tiles: DataFrame) -> DataFrame:
    """Members of divided blocks, and the visitors once for each tile of their block."""
    sent = visitors.join(tiles, "block").select(*["block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")], *[c for c in visitors.columns if c not in ("block", "tile")])
    return members.withColumn("own", F.lit(True)).unionByName(sent.withColumn("own", F.lit(False)))


def _blocks(sets: DataFrame, chains: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_key, print, name, block, rows, tile) of each candidate set once, (block, tiles), and the number of search tasks."""
    edges = stored(chains.groupBy("u", "v").agg(F.min("rare").alias("rare")))
    about = lambda x: stands.select(F.col("name").alias(x), F.col("d.n").alias(f"n_{x}"), F.col("d.bits").alias(f"bits_{x}"))
    first = F.min(F.struct("doc_key", "print", F.col("n_shingles").alias("n"), "bits")).alias("d")
    stands = stored(sets.where("n_shingles > 0").groupBy("name").agg(first, F.count(F.lit(1)).alias("rows")))
    unsure = edges.where("rare").join(about("u"), "u").join(about("v"), "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")
    near = stored(components(edges.where("not rare").select("u", "v").union(unsure.mapInArrow(_possible(percent), "u long, v long"))))
    nodes = near.union(near.select(F.col("component"), "component").distinct())
    placed = stored(stands.join(nodes.select(F.col("node").alias("name"), F.col("component").alias("block")), "name").select("name", "block", "rows", "d.doc_key", "d.print", "d.n"))
    weights = stored(placed.groupBy("block").agg(F.greatest(F.ceil(F.sum("n") / TILE), F.lit(1)).alias("tiles"), F.sum("n").alias("n")))
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    units = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TILE))
    tiled = placed.join(weights.select("block", "tiles"), "block").select(
        "doc_key", "print", "name", "block", "rows", F.pmod(F.xxhash64("name"), F.col("tiles")).alias("tile")
    )
    return stored(tiled), weights.select("block", "tiles"), units


def _link_counts(loaded: DataFrame, tiles: DataFrame, units: int, percent: int) -> DataFrame:
    """(name, links): every candidate set looked up among all sets of its block, tile by tile."""
    visits = _visits(loaded, loaded, tiles).select(_unit(units), "block", "tile", "name", "rows", "own", "shingles")
    found = visits.groupBy("unit").applyInArrow(_counted(percent), "name long, links long")
    return stored(found.groupBy("name").agg(F.sum("links").alias("links")))


def _links(load: Callable[[DataFrame], DataFrame], placed: DataFrame, tiles: DataFrame, units: int, percent: int) -> DataFrame:
    """(u, v): links among candidate sets, enough to connect all that links connect. Only sets of divided blocks are stored."""
    placed = placed.drop("rows")
    divided = stored(tiles.where("tiles > 1"))
    found = _searched(load(placed).withColumn("own", F.lit(True)), units, percent)
    if divided.isEmpty():
        return found
    members = stored(load(stored(placed.join(divided.select("block"), "block"))))
    state = lambda edges: stored(components(edges))
    chosen = lambda names: members.join(broadcast_if_small(stored(names)), "name", "left_semi")
    named = members.join(state(found), F.col("name") == F.col("node"), "left").withColumn("c", F.coalesce("component", "name"))
    leading = named.groupBy("block", "tile", "c").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("low"), F.max("name").alias("high"))
    largest = leading.groupBy("block", "tile").agg(F.max(F.struct("size", "low", "high")).alias("top"))
    leaders = largest.select(F.explode(F.array_distinct(F.array("top.low", "top.high"))).alias("name"))
    found = stored(found.union(_searched(_visits(members, chosen(leaders), divided), units, percent)))
    named = stored(members.select("block", "name").distinct().join(state(found), F.col("name") == F.col("node"), "left").select("block", "name", F.coalesce("component", "name").alias("c")))
    sizes = named.groupBy("block", "c").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("block").agg(F.max(F.struct("size", "c")).alias("top")).select("block", F.col("top.c").alias("c"))
    outside = named.join(main, ["block", "c"], "left_anti").select("name")
    last = _searched(_visits(members, chosen(outside), divided), units, percent)
    return stored(found.union(last))


def document_key(doc_id: Column, text: Column) -> list[Column]:
    """Identity of a row: its id (null as the least number) and a fingerprint of its text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print")]


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_key, print, doc_id, n_shingles, component_id, and whether it is its group's first.

    With ``count`` also n_links, the number of other rows it links with: then every candidate set is looked up, which for a
    large group of near copies is work in the square of its distinct sets, spread over its tiles. Components need less.

    Parts of sets, blocks and rounds of components are working tables: only the rows of the result stay stored. ``docs`` is
    read up to five times, so store what is costly to compute.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_linked(docs, width, percent, count))


def _linked(docs: DataFrame, width: int, percent: int, count: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(*document_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    made = keyed.mapInArrow(_sizes(width, percent), "doc_key long, print long, n_shingles long, name long, bits binary, shingles binary")
    sets = stored(made, **{"parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.enable.dictionary": "false"})
    chars = keyed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    load = lambda rows: _loaded(keyed, rows, width)
    leads = sets.where("n_shingles > 0").select("name", "n_shingles", "shingles")
    heads = lambda some, last=None: some.mapInArrow(_heads(percent, buckets, last), "bucket long, entries binary").groupBy("bucket")
    frequent = heads(leads).applyInArrow(_frequent, "mark long, sets long")
    late = frequent.orderBy(F.desc("sets"), "mark").limit(DEMOTED).select("mark").toPandas()["mark"].to_numpy(np.int64)
    last = spark.sparkContext.broadcast(np.sort(late.view(np.uint64)))
    if len(late):
        deep = sets.where("n_shingles > 0").select("name", "n_shingles", "doc_key", "print", "shingles")
        deep = deep.mapInArrow(_unready(percent, last), "name long, n_shingles long, doc_key long, print long")
        one = F.min(F.struct("doc_key", "print", "n_shingles")).alias("d")
        leads = leads.union(load(stored(deep.groupBy("name").agg(one).select("name", "d.n_shingles", "d.doc_key", "d.print"))))
    chains = heads(leads, last).applyInArrow(_chains(percent), "u long, v long, rare boolean")
    placed, tiles, units = _blocks(sets, chains, percent)
    reached = components(_links(load, placed, tiles, units, percent))
    links = _link_counts(stored(load(placed)), tiles, units, percent) if count else None
    some = sets.where("n_shingles > 0")
    first = F.min(F.struct((F.col("doc_key") == NO_ID).alias("unnamed"), "doc_key", "print")).alias("first")
    named = stored(
        some.groupBy("name").agg(first).join(reached, F.col("name") == F.col("node"), "left").select("name", "first", F.coalesce("component", "name").alias("c"))
    )
    if count:
        rows = some.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("same"))
        total = (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links")
        named = stored(named.join(rows.join(links, "name", "left").select("name", total), "name"))
    best = named.groupBy("c").agg(F.min("first").alias("first"))
    more = ["n_links"] if count else []
    linked = some.join(named.select("name", "c", *more).join(best, "c"), "name").select(
        "doc_key", "print", "n_shingles", *more, F.col("first.doc_key").alias("low"),
        ((F.col("first.doc_key") == F.col("doc_key")) & (F.col("first.print") == F.col("print"))).alias("first"),
    )
    alone = sets.where("n_shingles = 0").select("doc_key", "print", "n_shingles", *[F.lit(0).cast("long").alias(x) for x in more], F.col("doc_key").alias("low"), F.lit(True).alias("first"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(
        "doc_key", "print", shown("doc_key").alias("doc_id"), "n_shingles", shown("low").alias("component_id"), "first", *more
    )


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest doc_id."""
    columns = docs.columns
    found = link_components(docs.select("doc_id", "text"), width, percent)
    kept = found.where("first").select(F.col("doc_key").alias("__doc_key"), F.col("print").alias("__print")).distinct()
    keyed = docs.withColumns(dict(zip(("__doc_key", "__print"), document_key(F.col("doc_id"), F.col("text")))))
    return keyed.join(kept, ["__doc_key", "__print"], "left_semi").dropDuplicates(["__doc_key", "__print"]).select(*[F.col(f"`{c}`") for c in columns])


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
    join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as low from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.a = d.doc_id
"""


@query("op8_jaccard_join", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
