"""Words, lines and their fingerprints for whole Arrow batches, and a compact way to shuffle many of them.

A word is a run of characters other than space and U+0009 to U+000D. Fingerprints are 64-bit; a sequence of
them is hashed as a Rabin-Karp polynomial modulo 2**64 over well-mixed element fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows of one Arrow batch: texts are long, so the default of 10,000 makes tasks large.
BATCH_ROWS = 1000
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    # Some Arrow kernels misread offsets that do not begin at zero, so the values are laid down anew.
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.take(pa.array(np.arange(len(column))))


def _without_empty(lists: pa.LargeListArray) -> tuple[np.ndarray, pa.Array]:
    offsets = lists.offsets.to_numpy()
    parts = lists.flatten()
    offsets = offsets - offsets[0]
    some = pc.not_equal(parts, "")
    if pc.all(some).as_py() is False:
        kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        offsets, parts = kept[offsets], parts.filter(some)
    return offsets.astype(np.int64), parts


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are ``words[offsets[i]:offsets[i + 1]]``."""
    return _without_empty(pc.ascii_split_whitespace(texts).cast(pa.large_list(pa.large_string())))


def lines_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, lines) of texts split at each newline; a text always has at least one line."""
    lists = pc.split_pattern(texts, "\n").cast(pa.large_list(pa.large_string()))
    offsets = lists.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), lists.flatten()


def fingerprints(parts: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint for each string; equal strings are hashed once."""
    if len(parts) == 0:
        return np.empty(0, np.uint64)
    coded = parts.dictionary_encode()
    known = coded.dictionary
    slices = (known.slice(at, 20_000).to_pylist() for at in range(0, len(known), 20_000))
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(x) for some in slices for x in some), np.uint64, len(known))
    return distinct[coded.indices.to_numpy()]


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.empty(count + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(base)
    return np.multiply.accumulate(powers)


def rolling(prints: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each ``width`` consecutive elements, at the position of its first (crossing texts too).

    Prefix sums of print x base**i give every window by one subtraction and one multiplication.
    """
    count = len(prints) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(prints) + 1, np.uint64)
    np.cumsum(prints * _powers(BASE, len(prints))[:-1], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _powers(BASE_INVERSE, count)[:-1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)``."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def small_batches(spark) -> None:
    """Let Python tasks of this session take at most BATCH_ROWS rows at once, unless it already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def few_rows_a_batch(spark) -> Iterator[None]:
    """Within it, Python tasks that run take at most BATCH_ROWS rows at once; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)
