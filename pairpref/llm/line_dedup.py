"""Line dedup over overlapping windows of three lines: later occurrences of a window leave the text.

Lines are what stands between newlines, compared as they are. Every three consecutive lines of one document are
hashed; a window that also starts earlier (smaller doc_id, or same document, earlier start) is a later
occurrence, and each line it covers is removed. Documents of fewer than three lines stay as they are.

Null text stays null (no lines removed); equal rows stand at the same place and are kept alike; all other
columns of the input are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import query, table
from pairpref.llm.windows import covered, with_removed

WIDTH = 3


def remove_lines(docs: DataFrame, width: int = WIDTH, result: str = "lines") -> DataFrame:
    """``docs`` with ``text`` without later windows, and ``result`` (a name they do not have): struct of n_lines and n_removed."""
    columns = docs.columns
    rows = docs.select(
        F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")], F.lit(0)).alias("__rest")
    )
    marked = with_removed(rows, "lines", width)
    schema = marked.drop("__cuts").withColumns({"__n_lines": F.lit(0).cast("long"), "__n_removed": F.lit(0).cast("long")}).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone_counts = [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("__cuts").to_pylist()):
                lines = text.split("\n") if text is not None else []
                gone = covered(len(lines), cuts if text is not None else None, width)
                texts.append("\n".join(x for x, g in zip(lines, gone) if not g) if text is not None else None)
                counts.append(len(lines))
                gone_counts.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("__rest"), pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64())],
                schema.names,
            )

    done = marked.mapInArrow(apply, schema)
    rest = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c).alias(c)
    counts = F.struct(F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))
    return done.select(*[rest(c) for c in columns], counts.alias(result))


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
windows as (
  select doc_id, pos, string_agg(line, chr(10)) over w as content, count(*) over w as n
  from lines window w as (partition by doc_id order by pos rows between current row and 2 following)),
ranked as (
  select doc_id, pos, row_number() over (partition by content order by doc_id, pos) > 1 as later from windows where n = 3),
marked as (
  select l.doc_id, l.pos, l.line,
    coalesce(max(r.later) over (partition by l.doc_id order by l.pos rows between 2 preceding and current row), false) as gone
  from lines l left join ranked r using (doc_id, pos)),
per_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept
  from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  case when d.text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from documents d left join per_doc p on p.doc_id = d.doc_id
"""


@query("op4_line_dedup", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
