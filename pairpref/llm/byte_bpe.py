"""Byte-level BPE by recursive DuckDB queries inside each Spark partition, and decoding by ordered aggregation.

The text splits into stretches (white space, then what follows it), equal stretches are encoded once per task, and
the pattern splits each of them into words. A word's tokens start as its bytes. Each step of the recursion lays the
open words out as rows (word, position, pair), joins them with the merge table and contracts each word's leftmost
pair of least rank; words without a mergeable pair are done. A word that is itself a token is that token.
Nothing is shuffled: the merge table, bounded by the vocabulary, is the only thing every task receives.

Null text is empty: no tokens, decoded to nothing. Special-token strings are ordinary text. Equal rows encode
alike; other columns are carried along. A single word of n bytes takes up to n steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from pairpref.llm.catalog import query, table
from pairpref.llm.tokens import as_texts, ranges, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct stretches a task remembers, characters handled at once, and words of one recursive query.
REMEMBERED, PIECE_CHARS, QUERY_WORDS = 250_000, 2_000_000, 20_000
#: White space other than U+0009 to U+000D and the space; a text with any is split by the pattern as a whole.
OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENCODE = """
with recursive state as (
  select word, list(token order by pos) as tokens, true as open from start group by word
  union all (
  with pairs as (
    select word, pos, merged
    from (select word, unnest(tokens[:-2]) as a, unnest(tokens[2:]) as b, unnest(range(1, len(tokens))) as pos from state where open)
      join merges on a = first and b = second),
  best as (select word, min((cast(merged as bigint) << 32) + pos) as pick from pairs group by word)
  select s.word,
    case when pick is null then tokens
      else tokens[:(pick & 4294967295) - 1] || [cast(pick >> 32 as integer)] || tokens[(pick & 4294967295) + 2:] end,
    pick is not null
  from state s left join best using (word) where s.open))
select word, tokens from state where not open order by word
"""
DECODE = """
select item, unhex(string_agg(hex, '' order by pos)) as text
from (select item, unnest(ids) as id, generate_subscripts(ids, 1) as pos from encoded) join vocabulary using (id)
group by item order by item
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(first, second, merged): each pair of tokens whose joined bytes are a token."""
    found = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return np.array(found, np.int32).reshape(-1, 3)


def stretches(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, parts): each text cut wherever white space follows something else; joined they give the text."""
    size = pc.binary_length(texts).to_numpy()
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.cumsum(size) - size
    cuts = np.zeros(len(data) + 1, bool)
    cuts[1:-1] = space[1:] & ~space[:-1]
    odd = pc.match_substring_regex(texts, OTHER_SPACE).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(odd):
        cuts[begin[i] : begin[i] + size[i]] = False
    cuts[begin[size > 0]] = True
    edges = np.append(np.flatnonzero(cuts), len(data)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return np.searchsorted(edges, np.append(begin, len(data))), parts


class Lists:
    """Growing lists of numbers, kept flat."""

    def __init__(self, kind: type) -> None:
        self.offsets, self.values = np.zeros(1, np.int64), np.empty(0, kind)

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.values = np.concatenate([self.values, values])

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the lists at ``places`` one after the other, and where each list begins and the last ends."""
        sizes = self.offsets[places + 1] - self.offsets[places]
        return self.values[ranges(self.offsets[places], sizes)], np.concatenate([[0], np.cumsum(sizes)])


class Encoder:
    """Encodes and decodes distinct words with a DuckDB connection of its own; one lives in each task."""

    def __init__(self, tokens: list[bytes], ids: np.ndarray, merges: np.ndarray, pattern: str):
        import duckdb

        self.ranks = dict(zip(tokens, ids.tolist()))
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._load("merges", pa.table(dict(zip(("first", "second", "merged"), map(pa.array, merges.T)))))
        self._load("vocabulary", pa.table({"id": ids, "hex": [t.hex() for t in tokens]}))
        self.forget()

    def forget(self) -> None:
        self.stretch: dict[bytes, int] = {}
        self.word: dict[str, int] = {}
        self.words, self.ids, self.decoded = Lists(np.int64), Lists(np.int32), Lists(np.uint8)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace temp table {name} as select * from incoming")
        self.db.unregister("incoming")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of distinct words: whole tokens as they are, all others contracted to the fixpoint."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        open_ = np.flatnonzero(whole < 0)
        found = Lists(np.int32)
        found.add(np.ones(len(words), np.int64), whole.astype(np.int32))
        place = np.arange(len(words))
        place[open_] = len(words) + np.arange(len(open_))
        for at in range(0, len(open_), QUERY_WORDS):
            some = [words[i] for i in open_[at : at + QUERY_WORDS]]
            size = np.fromiter(map(len, some), np.int64, len(some))
            pos = ranges(np.zeros(len(some), np.int64), size)
            token = self.bytes[np.frombuffer(b"".join(some), np.uint8)]
            self._load("start", pa.table({"word": np.repeat(np.arange(len(some)), size), "pos": pos, "token": token}))
            tokens = self.db.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
            found.add(pc.list_value_length(tokens).to_numpy(), tokens.flatten().to_numpy())
        ids, begin = found.at(place)
        return np.diff(begin), ids

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, bytes) of lists of ids: token rows joined with the vocabulary, aggregated in order."""
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids))
        self._load("encoded", pa.table({"item": np.arange(len(sizes)), "ids": lists}))
        texts = self.db.sql(DECODE).to_arrow_table().column("text").combine_chunks()
        return pc.binary_length(texts).to_numpy(), np.frombuffer(b"".join(texts.to_pylist()), np.uint8)

    def learn(self, parts: list[bytes]) -> np.ndarray:
        """The places of distinct stretches among those remembered; the words of new ones are encoded and decoded now."""
        new = [p for p in parts if p not in self.stretch]
        if new:
            split = [self.split(p.decode()) for p in new]
            fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.word))
            if fresh:
                self.word.update(zip(fresh, range(len(self.word), len(self.word) + len(fresh))))
                sizes, ids = self.encode([w.encode() for w in fresh])
                self.ids.add(sizes, ids)
                self.decoded.add(*self.decode(sizes, ids))
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            self.words.add(sizes, np.fromiter((self.word[w] for ws in split for w in ws), np.int64, int(sizes.sum())))
            self.stretch.update(zip(new, range(len(self.stretch), len(self.stretch) + len(new))))
        return np.fromiter((self.stretch[p] for p in parts), np.int64, len(parts))


def _encode(shared, pattern: str, want: tuple[str, ...]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, pattern)
        for batch in batches:
            size = pc.cumulative_sum(pc.binary_length(as_texts(batch.column("text")))).to_numpy()
            begin = 0
            while begin < len(size):
                limit = (size[begin - 1] if begin else 0) + PIECE_CHARS
                end = max(begin + 1, int(np.searchsorted(size, limit, "right")))
                yield _piece(encoder, batch.slice(begin, end - begin), want)
                begin = end

    return apply


def _piece(encoder: Encoder, batch: pa.RecordBatch, want: tuple[str, ...]) -> pa.RecordBatch:
    offsets, parts = stretches(as_texts(batch.column("text")))
    coded = parts.dictionary_encode()
    if len(encoder.stretch) > REMEMBERED:
        encoder.forget()
    places = encoder.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    words, word_at = encoder.words.at(places)
    word_at = word_at[offsets]
    ids, id_at = encoder.ids.at(words)
    ids, id_at = ids.astype("<u4"), id_at[word_at]
    text, text_at = encoder.decoded.at(words)
    text_at = text_at[word_at]
    out = {
        "n_tokens": lambda i: int(id_at[i + 1] - id_at[i]),
        "ids_sha256": lambda i: hashlib.sha256(ids[id_at[i] : id_at[i + 1]]).hexdigest(),
        "decoded": lambda i: text[text_at[i] : text_at[i + 1]].tobytes(),
        "decoded_sha256": lambda i: hashlib.sha256(text[text_at[i] : text_at[i + 1]]).hexdigest(),
    }
    types = {"n_tokens": pa.int64(), "decoded": pa.binary()}
    lists = pa.LargeListArray.from_arrays(pa.array(id_at), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
    made = [lists if name == "ids" else pa.array([out[name](i) for i in range(len(batch))], types.get(name, pa.string())) for name in want]
    return pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), *made], ["rest", "text", *want])


SQL_TYPES = {
    "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string",
}


def encode(docs: DataFrame, path: str, pattern: str, want: tuple[str, ...] = ("n_tokens", "ids"), result: str = "encoded") -> DataFrame:
    """``docs`` with ``result`` (a name they do not have): a struct of the fields of SQL_TYPES that ``want`` names, from the column ``text``."""
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)
    ranks = read_ranks(path)
    ids = np.fromiter(ranks.values(), np.int32, len(ranks))
    shared = docs.sparkSession.sparkContext.broadcast((list(ranks), ids, merge_table(ranks)))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.lit(0).alias("__row")).alias("rest"), F.col("text").cast("string").alias("text"))
    schema = rows
    for name in want:
        schema = schema.withColumn(name, F.lit(None).cast(SQL_TYPES[name]))
    done = rows.mapInArrow(_encode(shared, pattern, want), schema.schema)
    back = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns]
    return done.select(*back, F.struct(*[F.col(w) for w in want]).alias(result))


def tokenizer() -> tuple[str, str]:
    """(path of the rank file, split pattern) of the public tokenizer the queries use."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, *tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "encoded.*")
