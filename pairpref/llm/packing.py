"""Token-id output: documents encoded and packed into fixed-length sequences by best-fit decreasing.

Texts become token ids; a document longer than a sequence is cut into pieces without loss. Documents spread over
shards by hash; in a shard, pieces go longest first into the sequence with the least room that still holds them,
found by a segment tree over room. Each packed sequence is a row: the padded id row of the matrix, cumulative segment
lengths and position ids that restart at every segment. ``write`` lays the rows down as Parquet.

The number of shards follows the characters of the corpus alone, so a shard's ids stay bounded; a shard is rebuilt from its documents alone.
Null or empty text has no tokens and no segment. Equal rows are packed as often as they occur. Order among equals:
doc_id (null first), text fingerprint, piece. An empty table gives no sequences. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.byte_bpe import read_ranks, tokenizer
from pairpref.llm.catalog import query, table
from pairpref.llm.tokens import small_batches

LENGTH, PAD = 2048, 50256
SHARD_CHARS = 8_000_000
#: ids and positions are little-endian unsigned 32-bit; the id matrix has ``LENGTH`` columns.
PACKED = pa.schema([
    ("shard", pa.int64()), ("sequence", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
])
RESULT = "shard long, sequence long, n_tokens long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """How many open sequences have each amount of room; finds the least room of at least n in log(length) steps."""

    def __init__(self, length: int):
        self.half = 1 << length.bit_length()
        self.count = [0] * (2 * self.half)

    def add(self, room: int, n: int) -> None:
        at = room + self.half
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, n: int) -> int | None:
        at = n + self.half
        if self.count[at]:
            return n
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.half
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; no sequence exceeds ``length``. Ties: the sequence opened last."""
    tree, by_room, sequences = RoomTree(length), [[] for _ in range(length + 1)], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        room = tree.least(size)
        if room is None:
            place, room = len(sequences), length
            sequences.append([])
        else:
            place = by_room[room].pop()
            tree.add(room, -1)
        sequences[place].append(piece)
        by_room[room - size].append(place)
        tree.add(room - size, 1)
    return sequences


def _encode(path: str, pattern: str) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ordinary = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        for batch in batches:
            ids = [np.array(ordinary(t), "<u2").tobytes() if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), batch.column("print"), pa.array(ids, pa.binary())],
                ["shard", "doc_id", "print", "ids"],
            )

    shared = SparkSession.getActiveSession().sparkContext.broadcast(read_ranks(path))
    return apply


def _pack(length: int, pad: int) -> Callable:
    def apply(shard: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(packed(shard)), PACKED)

    def packed(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = sorted(
            ((d is not None, d or 0, p, i) for i, (d, p) in enumerate(zip(shard.column("doc_id").to_pylist(), shard.column("print").to_pylist()))),
        )
        column = shard.column("ids")
        pieces = []
        for known, doc_id, _, row in docs:
            ids = np.frombuffer(column[row].as_py(), "<u2")
            pieces += [(doc_id if known else None, k, ids[a : a + length]) for k, a in enumerate(range(0, len(ids), length))]
        sequences = best_fit_decreasing([len(ids) for _, _, ids in pieces], length)
        for at in range(0, len(sequences), 256):
            rows = {name: [] for name in ("n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions")}
            for members in sequences[at : at + 256]:
                own = [pieces[i] for i in members]
                sizes = [len(ids) for _, _, ids in own]
                total = sum(sizes)
                rows["n_tokens"].append(total)
                rows["doc_ids"].append([d for d, _, _ in own])
                rows["pieces"].append([k for _, k, _ in own])
                rows["cu_seqlens"].append(np.concatenate([[0], np.cumsum(sizes)]).tolist())
                row = np.full(length, pad, "<u4")
                row[:total] = np.concatenate([ids for _, _, ids in own])
                rows["ids"].append(row.tobytes())
                rest = [np.arange(length - total)] if total < length else []
                rows["positions"].append(np.concatenate([np.arange(n) for n in sizes] + rest).astype("<u4").tobytes())
            n = len(rows["ids"])
            rows |= {"shard": [shard.column("shard")[0].as_py()] * n, "sequence": range(at, at + n)}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in PACKED], schema=PACKED)

    return apply


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """RESULT rows for ``docs`` (doc_id, text); vocabularies of up to 65,536 tokens."""
    if not 0 < length < 2**31 or len(read_ranks(path)) > 65_536:
        raise ValueError("a positive length and at most 65,536 tokens are supported")
    small_batches(docs.sparkSession)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // SHARD_CHARS))
    fingerprint = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", fingerprint), F.lit(shards)).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"),
        fingerprint.alias("print"), F.col("text").cast("string").alias("text"),
    ).where(F.length("text") > 0)
    encoded = rows.mapInArrow(_encode(path, pattern), "shard long, doc_id long, print long, ids binary")
    return encoded.groupBy("shard").applyInArrow(_pack(length, pad), RESULT)


def write(docs: DataFrame, target: str, path: str, pattern: str, length: int = LENGTH) -> None:
    """Write the packed sequences under ``target``, one file set per shard group."""
    pack(docs, path, pattern, length).write.mode("errorifexists").parquet(target)


@query("op6_token_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer())
    digest = lambda name: F.sha2(name, 256).alias(f"{name}_sha256")
    return packed.select("shard", "sequence", "n_tokens", "doc_ids", "pieces", "cu_seqlens", digest("ids"), digest("positions"))
