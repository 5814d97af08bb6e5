"""Removal of long repeated passages: Rabin-Karp hashes of every window of 20 words, counted over the whole corpus.

Each word that a later occurrence of a window covers is removed; overlapping windows merge into maximal
intervals. Windows are judged on the input, not on what earlier removals leave.

Null text: no words. Fewer words than a window: nothing removed. Rows with equal doc_id and text stand at the
same place, so neither is later than the other; rows with equal doc_id and other text come in order of a text
fingerprint. A null doc_id comes before all others. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairpref.llm.catalog import query, table
from pairpref.llm.tokens import as_texts, words_of
from pairpref.llm.windows import covered, with_removed

WIDTH = 20
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<array<int>>"


def intervals(gone: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return edges.reshape(-1, 2).tolist()


def _kept(width: int, keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, words = words_of(as_texts(batch.column("text")))
            cuts = batch.column("__cuts").to_pylist()
            counts, removed, texts, digests, spans = [], [], [], [], []
            for i, cut in enumerate(cuts):
                own = words.slice(offsets[i], offsets[i + 1] - offsets[i])
                gone = covered(len(own), cut, width)
                kept = " ".join((own.filter(pa.array(~gone)) if cut else own).to_pylist())
                counts.append(len(own))
                removed.append(int(gone.sum()))
                texts.append(kept if keep_text else None)
                digests.append(hashlib.sha256(kept.encode()).hexdigest())
                spans.append(intervals(gone))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "removed"],
            )

    return apply


def remove_repeated(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Per row: RESULT, where ``removed`` lists maximal [begin, end) word intervals and ``kept_text`` the words left."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return with_removed(rows, "words", width).select("doc_id", "text", "__cuts").mapInArrow(_kept(width, keep_text), RESULT)


SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as word,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) as pos
  from documents),
windows as (
  select doc_id, pos, string_agg(word, ' ') over w as content, count(*) over w as n
  from words window w as (partition by doc_id order by pos rows between current row and 19 following)),
ranked as (
  select doc_id, pos, row_number() over (partition by md5(content) order by doc_id, pos) > 1 as later
  from windows where n = 20),
marked as (
  select w.doc_id, w.pos, w.word,
    coalesce(max(r.later) over (partition by w.doc_id order by w.pos rows between 19 preceding and current row), false) as gone
  from words w left join ranked r using (doc_id, pos)),
per_doc as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed,
    coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as kept
  from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join per_doc p on p.doc_id = d.doc_id
"""


@query("op2_substring_dedup", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"), WIDTH, keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
