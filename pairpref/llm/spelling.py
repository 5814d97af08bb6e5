"""Spelling variants: words one edit apart, found by Gram matrices over blocks of letter counts.

Words are maximal runs of Latin letters, lower-cased A-Z only; ``planted_words`` also deletes one letter of a run where a
checksum of its document and text says so. A word's letter counts are a vector, and a product of two blocks of vectors
gives all squared distances: one replaced letter makes 2, one inserted or deleted letter makes 1, so only pairs at most
two apart in equal or adjacent lengths are left, and those are verified letter by letter.

Blocks stay small because the alphabet is cut into ``GROUPS`` groups of about equal use: an edit touches at most two of
them, so two near words agree in the counts of all others. A word is in one block for every choice of two groups that
may differ; a pair counts in the first block it shares only. A block of more than ``PIECE`` words is dealt to tasks by
pairs of its pieces. No pair becomes a row: each task sums per word how many are near and which of them is the most
frequent. Forms point to words at least twice as frequent, so following them ends after log2(n) steps and pointer
doubling after the logarithm of that.

Null and empty texts have no runs; a null doc_id counts as the empty string; repeated rows count each time; other
columns are ignored; an empty table gives no rows. Words of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import query, table
from pairpref.llm.tokens import mixed
from pairpref.session import broadcast_if_small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every letter is one Latin-1 byte; its column in a count vector.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
COLUMN = np.zeros(256, np.int64)
COLUMN[LETTERS] = np.arange(len(LETTERS))
GROUPS = 5
FREE = list(combinations(range(GROUPS), 2))
#: Words of one Gram matrix, of a piece of a large block, and rows of a task.
TILE, PIECE, UNIT_ROWS = 384, 2_000, 100_000
#: Longer words are verified one pair at a time, so no matrix is wider.
WIDE = 64
MIN_LENGTH, MIN_COUNT, FACTOR, DELETED_OF = 5, 3, 2, 97


def runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id string, run): every lower-cased run of ``docs`` (doc_id, text)."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), 0)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))


def planted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs, one letter less where 97 divides crc32('<doc_id>:<run>')."""
    runs = runs_of(docs)
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % DELETED_OF == 0, shorter).otherwise(F.col("run"))
    return frequent(runs.select(word.alias("word")))


def frequent(words: DataFrame, length: int = MIN_LENGTH, count: int = MIN_COUNT) -> DataFrame:
    counted = words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= count)


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter: by falling use, each to the group used least so far."""
    rows = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    use = {r.letter: r["count"] for r in rows}
    group, load = np.zeros(len(LETTERS), np.int64), [0] * GROUPS
    for letter in sorted(map(chr, LETTERS), key=lambda x: (-use.get(x, 0), x)):
        least = load.index(min(load))
        group[COLUMN[ord(letter)]] = least
        load[least] += use.get(letter, 0)
    return group


def latin(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, letters): the Latin-1 bytes of every word, one after another."""
    coded = [x.encode("latin-1") for x in words.to_pylist()]
    return np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64), np.frombuffer(b"".join(coded), np.uint8)


def letter_counts(offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    words = len(offsets) - 1
    place = np.repeat(np.arange(words), np.diff(offsets)) * len(LETTERS) + COLUMN[letters]
    return np.bincount(place, minlength=words * len(LETTERS)).reshape(words, -1)


WEIGHT, CHOICE = np.split(mixed(np.arange(1, len(LETTERS) + len(FREE) + 1, dtype=np.uint64)), [len(LETTERS)])


def group_sums(offsets: np.ndarray, letters: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each word and group of letters a 64-bit name of how often each letter of the group occurs."""
    weight, of = WEIGHT[COLUMN[letters]], group[COLUMN[letters]]
    out = np.empty((len(offsets) - 1, GROUPS), np.uint64)
    for g in range(GROUPS):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(of == g, weight, np.uint64(0)), dtype=np.uint64)])[offsets]
        out[:, g] = sums[1:] - sums[:-1]
    return out


def _keys(group: np.ndarray) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = group_sums(*latin(batch.column("word")), group)
            for s, free in enumerate(FREE):
                key = mixed(sums[:, [g for g in range(GROUPS) if g not in free]].sum(1, dtype=np.uint64) + CHOICE[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(len(key), s, np.int32)), batch.column("word"), batch.column("n")],
                    ["key", "free", "word", "n"],
                )

    return apply


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :] and len(b) - len(a) <= 1


class Words:
    """The words of a task: letters, counts and what is needed to verify pairs of them."""

    def __init__(self, column: pa.ChunkedArray):
        self.offsets, self.letters = latin(column)
        self.length = np.diff(self.offsets)
        kind = np.float32 if len(self.length) == 0 or self.length.max() < 1000 else np.float64  # sums of squares stay exact
        self.counts = letter_counts(self.offsets, self.letters).astype(kind)
        self.square = (self.counts * self.counts).sum(1)
        short = np.minimum(self.length, WIDE)
        self.padded = np.zeros((len(self.length), WIDE + 1), np.uint8)
        row = np.repeat(np.arange(len(short)), short)
        place = np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)
        self.padded[row, place] = self.letters[np.repeat(self.offsets[:-1], short) + place]

    def apart(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (one of ``a``, one of ``b``, both in order of length) whose counts allow one edit, shorter first."""
        for some in np.split(a, np.flatnonzero(np.diff(self.length[a])) + 1):
            size = self.length[some[0]]
            low, high = np.searchsorted(self.length[b], [size, size + 2])
            other = b[low:high]
            if len(other) == 0:
                continue
            squared = self.square[some][:, None] + self.square[other][None, :] - 2 * (self.counts[some] @ self.counts[other].T)
            x, y = np.nonzero(squared == np.where(self.length[other] == size, 2, 1)[None, :])
            yield some[x], other[y]

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs, a not longer than b, are one edit apart."""
        out = np.zeros(len(a), bool)
        for begin in range(0, len(a), 100_000):
            x, y = a[begin : begin + 100_000], b[begin : begin + 100_000]
            same = self.padded[x] == self.padded[y]
            equal = self.length[x] == self.length[y]
            before = np.arange(WIDE)[None, :] < np.argmin(same, axis=1)[:, None]
            moved = (before | (self.padded[x][:, :-1] == self.padded[y][:, 1:])).all(1)
            out[begin : begin + 100_000] = np.where(equal, (~same).sum(1) == 1, moved & ~equal)
        for i in np.flatnonzero(np.maximum(self.length[a], self.length[b]) > WIDE):
            out[i] = one_edit(*(self.letters[self.offsets[k] : self.offsets[k + 1]].tobytes() for k in (a[i], b[i])))
        return out


def tiles(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """[begin, end) of whole blocks together up to TILE rows, or of one block."""
    begin = 0
    for block, end in enumerate(edges[1:], 1):
        if block + 1 == len(edges) or edges[block + 1] - edges[begin] > TILE:
            yield edges[begin], end
            begin = block


def _near(group: np.ndarray) -> Callable:
    first = np.full(1 << GROUPS, -1)  # of the groups in which a pair differs: the first choice that frees them
    for s, free in reversed(list(enumerate(FREE))):
        for sub in ([], free[:1], free[1:], free):
            first[sum(1 << g for g in sub)] = s

    def apply(unit: pa.Table) -> pa.Table:
        words = Words(unit.column("word"))
        n, free = unit.column("n").to_numpy(), unit.column("free").to_numpy()
        key, one, two, piece = (unit.column(c).to_numpy() for c in ("key", "one", "two", "piece"))
        order = np.lexsort((words.length, two, one, key))
        block = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0), [True]])
        found = [np.empty((2, 0), np.int64)]
        for begin, end in tiles(np.flatnonzero(block)):
            rows = order[begin:end]
            rows = rows[np.argsort(words.length[rows], kind="stable")]
            sides = [(rows, rows)]
            if one[rows[0]] != two[rows[0]] and np.ptp(key[rows]) == 0:  # two pieces of one large block: only pairs across them
                sides = [(rows[piece[rows] == p], rows[piece[rows] != p]) for p in np.unique(piece[rows])]
            for a, b in sides:
                for x, y in words.apart(a, b) if len(a) else ():
                    same = (key[x] == key[y]) & (free[x] == free[y]) & (one[x] == one[y]) & (two[x] == two[y])
                    same &= (one[x] == two[x]) | (piece[x] != piece[y])
                    keep = same & ((words.length[x] < words.length[y]) | (x < y))
                    found.append(np.stack([x[keep], y[keep]]))
        a, b = np.concatenate(found, axis=1)
        sums = group_sums(words.offsets, words.letters, group)
        keep = first[(sums[a] != sums[b]) @ (1 << np.arange(GROUPS))] == free[a]
        a, b = a[keep], b[keep]
        keep = words.verified(a, b)
        a, b = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
        rank = np.empty(len(n), np.int64)
        rank[pc.sort_indices(unit.column("word").cast(pa.binary())).to_numpy()] = np.arange(len(n))
        by = np.lexsort((rank[b], -n[b], a))
        head = by[np.flatnonzero(np.diff(a[by], prepend=-1))]
        column = unit.column("word")
        return pa.table({
            "word": column.take(pa.array(a[head])).cast(pa.string()),
            "n_near": pa.array(np.bincount(a, minlength=len(n))[a[head]]),
            "best_n": pa.array(n[b[head]]),
            "best": column.take(pa.array(b[head])).cast(pa.string()),
        })

    return apply


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of every word of ``words`` (word, n; distinct, of the letters above) with a near one.

    ``form`` is the near word of largest n, the first in code-point order among equals.
    """
    spark = words.sparkSession
    group = letter_groups(words)
    keyed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_keys(group), "key long, free int, word string, n long")
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    large = stored(sizes.where(F.col("rows") > PIECE).select("key", F.ceil(F.col("rows") / PIECE).alias("pieces")))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = keyed.join(broadcast_if_small(large), "key", "left").withColumn("piece", F.pmod(F.xxhash64("word"), pieces))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // UNIT_ROWS))
    placed = dealt.select(
        "key", "free", "word", "n", "piece", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two")
    ).withColumn("unit", F.pmod(F.xxhash64("key", "one", "two"), F.lit(units)))
    found = placed.groupBy("unit").applyInArrow(_near(group), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where following forms ends, by pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n (null unless at least ``factor`` times as frequent) and root."""
    words = stored(words)
    near = stored(near_words(words))
    known = words.join(near, "word", "left").withColumn("counts", F.col("form_n") >= factor * F.col("n"))
    formed = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr("if(counts, form, null)").alias("form"), F.expr("if(counts, form_n, null)").alias("form_n"),
    )
    formed = stored(formed)
    return formed.join(roots(formed.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


SQL = r"""
with recursive table_of as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) as t),
runs as (
  select coalesce(cast(doc_id as varchar), '') as doc_id,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
pairs as (select doc_id, run, count(*) as times from runs group by all),
coded as (
  select run, times, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) as h
  from pairs, table_of),
altered as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from coded),
words as (select word, cast(sum(times) as bigint) as n from altered where length(word) >= 5 group by word having sum(times) >= 3),
less as (
  select distinct word, n, i as pos, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n from less a join less b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form,
    case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join best b on b.word = w.word),
steps as (
  select word, word as root, 0 as step from words
  union all select s.word, f.form, step + 1 from steps s join formed f on f.word = s.root where f.form is not null),
ends as (select word, last(root order by step) as root from steps group by word)
select f.word, n, n_near, form, form_n, root from formed f join ends e on e.word = f.word
"""


@query("op11_spelling_variants", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(planted_words(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")
