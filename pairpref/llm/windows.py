"""Windows of consecutive words or lines that stand earlier in the corpus, found without shuffling texts or rows of windows.

Every window is hashed where its text is read. Neighbouring windows that share the smallest of their sub-hashes
(their anchor) form a run, and a run goes to the bucket of its anchor: equal windows have equal anchors, so they
meet. A run costs 25 bytes and 6 more for each window; a window counts as repeated when anchor (64 bits),
place of the anchor in the window and window hash (48 bits) agree. One row is one part of a bucket from one
batch of texts; the number of buckets follows the size of the corpus, so a bucket stays bounded. A passage in a
third of all documents is one entry of 6 bytes per document in its bucket, never a pair of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.llm.tokens import as_texts, fingerprints, lines_of, mixed, ranges, rolling, small_batches, words_of

UNITS: dict[str, Callable] = {"words": words_of, "lines": lines_of}
#: Characters of text whose windows share a bucket, on average, and batch of texts hashed at once.
BUCKET_CHARS, BATCH_CHARS = 12_000_000, 4_000_000
NO_ID = -(2**63)
RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("print", "<u4"), ("start", "<i4"), ("count", "u1"), ("lead", "u1")])
REMOVED = "doc_key long, print long, first int, last int"


def document_key(doc_id: Column, text: Column) -> list[Column]:
    """Order and identity of a row: its id (null before all), then a fingerprint of its text among equal ids."""
    return [
        F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("doc_key"),
        F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(2**32 - 1)).alias("print"),
    ]


def pieces(batch: pa.RecordBatch, size: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Pieces of whole texts of about ``size`` bytes; one very long text is a piece of its own."""
    texts = as_texts(batch.column("text"))
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the leftmost among equals."""
    best = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        reach += step
    return best


def runs_of(offsets: np.ndarray, prints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs without document columns, text index of each run, 6-byte window hashes in order of the runs)."""
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashes = rolling(prints, width)
    grams = width // 4 or 1
    parts = rolling(prints, grams)
    if len(hashes) == 0:
        return np.empty(0, RUN), np.empty(0, np.int64), np.empty((0, 6), np.uint8)
    least = _sliding_least(parts, width - grams + 1)[: len(hashes)]
    inside = texts[: len(hashes)] == texts[width - 1 :]
    at = np.flatnonzero(inside)
    if len(at) == 0:
        return np.empty(0, RUN), np.empty(0, np.int64), np.empty((0, 6), np.uint8)
    place = least[at]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (texts[at[1:]] != texts[at[:-1]])])
    first = np.flatnonzero(new)
    runs = np.empty(len(first), RUN)
    runs["anchor"] = parts[place[first]]
    runs["start"] = at[first] - offsets[texts[at[first]]]
    runs["count"] = np.diff(np.append(first, len(at)))
    runs["lead"] = place[first] - at[first]
    return runs, texts[at[first]], hashes[at].view(np.uint8).reshape(-1, 8)[:, :6]


def _to_buckets(unit: str, width: int, buckets: int) -> Callable:
    split = UNITS[unit]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            offsets, elements = split(as_texts(batch.column("text")))
            runs, texts, hashes = runs_of(offsets, fingerprints(elements), width)
            if len(runs) == 0:
                continue
            runs["doc"] = batch.column("doc_key").to_numpy()[texts]
            runs["print"] = batch.column("print").to_numpy()[texts].astype(np.uint32)
            bucket = (mixed(runs["anchor"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            count = runs["count"].astype(np.int64)
            begin = np.cumsum(count) - count
            runs, bucket = runs[order], bucket[order]
            hashes = hashes[ranges(begin[order], count[order])]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            windows = np.concatenate([[0], np.cumsum(runs["count"].astype(np.int64))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[edges[:-1]]),
                    pa.array([runs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                    pa.array([hashes[windows[a] : windows[b]].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                ],
                ["bucket", "runs", "hashes"],
            )

    return parts


def _later(bucket: pa.Table) -> pa.Table:
    """(doc_key, print, first, last): starts of windows, run by run, whose sequence stands earlier."""
    runs = np.concatenate([np.frombuffer(x.as_py(), RUN) for x in bucket.column("runs")])
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6) for x in bucket.column("hashes")])
    order = np.argsort(runs["anchor"], kind="stable")
    same = runs["anchor"][order][1:] == runs["anchor"][order][:-1]
    often = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    count = runs["count"].astype(np.int64)
    begin = np.cumsum(count) - count
    picked, runs, count = ranges(begin[often], count[often]), runs[often], count[often]
    value = np.zeros((len(picked), 8), np.uint8)
    value[:, :6] = hashes[picked]
    value = value.view(np.uint64).ravel()
    del hashes
    owner = np.repeat(np.arange(len(runs)), count)
    shift = picked - np.repeat(begin[often], count)
    lead = runs["lead"][owner].astype(np.int64) - shift
    start = runs["start"][owner] + shift
    by = np.lexsort((start, runs["print"][owner], runs["doc"][owner], value, lead, runs["anchor"][owner]))
    o = owner[by]
    again = (
        (runs["anchor"][o[1:]] == runs["anchor"][o[:-1]]) & (lead[by][1:] == lead[by][:-1]) & (value[by][1:] == value[by][:-1])
    )
    place = lambda x: (runs["doc"][x], runs["print"][x])
    # Repeated rows (same id, same text) stand at the same place: a window is later only than another place.
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), np.arange(len(by)), 0)) if len(by) else by
    f = o[head]
    moved = (start[by] != start[by][head]) | (place(o)[0] != place(f)[0]) | (place(o)[1] != place(f)[1])
    later = np.sort(by[moved])
    if len(later):
        cut = np.flatnonzero((np.diff(owner[later]) != 0) | (np.diff(start[later]) != 1)) + 1
        first, last = later[np.concatenate([[0], cut])], later[np.concatenate([cut, [len(later)]]) - 1]
    else:
        first = last = later
    who = runs[owner[first]]
    return pa.table({
        "doc_key": pa.array(who["doc"]),
        "print": pa.array(who["print"].astype(np.int64)),
        "first": pa.array(start[first].astype(np.int32)),
        "last": pa.array(start[last].astype(np.int32)),
    })


def later_windows(keyed: DataFrame, unit: str, width: int) -> DataFrame:
    """REMOVED rows for ``keyed`` (doc_key, print, text): from ``first`` to ``last`` each start is a later window."""
    spark = keyed.sparkSession
    small_batches(spark)
    chars = keyed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    parts = keyed.mapInArrow(_to_buckets(unit, width, buckets), "bucket long, runs binary, hashes binary")
    return parts.groupBy("bucket").applyInArrow(_later, REMOVED)


def with_removed(docs: DataFrame, unit: str, width: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``__cuts``: array of [first, last] starts of later windows, null if none."""
    keyed = docs.withColumns(dict(zip(("__doc_key", "__print"), document_key(F.col("doc_id"), F.col("text")))))
    found = later_windows(
        keyed.select(F.col("__doc_key").alias("doc_key"), F.col("__print").alias("print"), "text"), unit, width
    )
    cuts = found.groupBy(F.col("doc_key").alias("__doc_key"), F.col("print").alias("__print")).agg(
        F.collect_set(F.struct("first", "last")).alias("__cuts")  # equal rows have the same cuts
    )
    return keyed.join(cuts, ["__doc_key", "__print"], "left").drop("__doc_key", "__print")


def covered(count: int, cuts: list | None, width: int) -> np.ndarray:
    """Which of ``count`` elements some later window covers: the union of [first, last + width)."""
    edges = np.zeros(count + 1, np.int32)
    if cuts is not None and len(cuts):
        first = np.fromiter((c["first"] for c in cuts), np.int64, len(cuts))
        last = np.fromiter((c["last"] for c in cuts), np.int64, len(cuts))
        np.add.at(edges, first, 1)
        np.add.at(edges, last + width, -1)
    return np.cumsum(edges[:-1]) > 0
