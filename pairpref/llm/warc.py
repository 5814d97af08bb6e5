r"""WARC archives of pages and their capture index by external merge.

Pages are written as gzip members, one WARC record each, into archives of about ``ARCHIVE_BYTES`` in a folder that all
executors share. Of pages with equal payloads the one of largest page_id is a response; the others are revisits that name
it and hold no payload. (Rows with the same payload and the largest id are responses all; a null id is the least.)

The archives are then read back. Each archive gives a run of captures, sorted by URL key and timestamp. A shuffle deals
the runs to ranges of the key; in its range each task merges its k run pieces with a loser tree, so every key change
costs log2(k) comparisons, and the ranges one after another are the index in global order. The captures of one URL are
its history; a range may split it, since timestamp and page take part in the order. ``histories`` numbers them.

Null html is an empty payload, null url an empty one; a payload may be empty. Equal rows are captures each. Other columns
are ignored, an empty table writes no archive. Payloads are equal when their SHA-256 is. A failed task leaves an archive
that no index names; ``write_archives`` returns only what succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.llm.catalog import query, table
from pairpref.llm.tokens import few_rows_a_batch
from pairpref.session import ensure_checkpoint_dir, stored

#: Bytes and records of an archive, captures of a merge task, and the first capture's time (page_id seconds are added to it).
ARCHIVE_BYTES, ARCHIVE_RECORDS, CAPTURES_A_TASK, EPOCH = 64_000_000, 100_000, 200_000, datetime(2020, 1, 1, tzinfo=UTC)
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, offset long, length long"
)
HEAVY, SPREAD = 1024, 4096
SCHEMA = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
     ("length", pa.int64())]
)


def url_key(url: str) -> str:
    """The sort key of a url: host labels reversed, then path and query, without scheme, user, default port or fragment."""
    rest = url.split("://", 1)[1] if "://" in url else url
    rest = rest.split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    host, _, port = host.partition(":")
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}{':' + port if port not in ('', '80', '443') else ''}){tail or '/'}"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def capture_time(page_id: int | None) -> datetime:
    """A time of its own for every page: ids beyond the calendar wrap around 5,000 years."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (5_000 * 365 * 86_400))


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with the WARC record of a page; a revisit of ``refers_to`` if that is set, without payload."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", capture_time(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Page", json.dumps([page_id, url])),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def records(source: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, reading READ_BYTES at a time."""
    at, rest = 0, b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        unpack, content, size = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest:
                rest = source.read(READ_BYTES)
                if not rest:
                    raise ValueError(f"archive ends within the record at {at}")
            content.append(unpack.decompress(rest))
            size += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
        yield at, size, b"".join(content)
        at += size


def capture(content: bytes) -> dict:
    """What a record says of its capture; a response's payload is measured and held against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page_id, url = json.loads(fields["X-Page"])
    if fields["WARC-Type"] == "response" and (digest != base32_sha1(payload) or len(payload) != int(said["content-length"])):
        raise ValueError(f"payload of page {page_id} does not match its digest")
    return {
        "url_key": url_key(url), "timestamp": fields["WARC-Date"].translate(str.maketrans("", "", "-:TZ")), "page_id": page_id, "url": url,
        "payload_bytes": int(said["content-length"]), "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To"]) if "X-Refers-To" in fields else None,
    }


def order(row: dict) -> tuple:
    """Place of a capture in the index; ``_ordered`` says the same of columns."""
    page = row["page_id"]
    return row["url_key"].encode(), row["timestamp"], page is not None, page or 0, row["archive"], row["offset"]


def _ordered() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("url_key", "timestamp", "page_id", "archive", "offset")]


def with_original(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``original``: the largest page_id of its payload where that is another, else null.

    Payload groups are summed up before they are joined back; a payload in more than 1/HEAVY of the rows (of which there
    can be no more than HEAVY) is broadcast, and its rows are spread over the join.
    """
    payload = F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    keyed = pages.withColumn("__payload", payload)
    groups = stored(keyed.groupBy("__payload").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeated = groups.where("n > 1")
    heavy = F.col("n") * HEAVY > total
    hot = repeated.where(heavy).select("__payload", F.col("top").alias("__hot"))
    cold = repeated.where(~heavy).select(F.col("__payload").alias("__key"), F.col("top").alias("__cold"))
    spread = F.concat(F.lit("hot-"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("string")).cast("binary")
    joined = keyed.join(F.broadcast(hot), "__payload", "left")
    joined = joined.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__payload")).otherwise(spread)).join(cold, "__key", "left")
    top = F.coalesce("__hot", "__cold")
    # A null page_id is the least: it revisits any id that is known.
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < top), top).alias("original"))


def _write(folder: str, archive_bytes: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [count]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                made = record(row["page_id"], row["url"] or "", (row["html"] or "").encode(), row["original"])
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= archive_bytes or count >= ARCHIVE_RECORDS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return apply


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder`` (a URI or shared path); (archive, bytes, records) of each archive."""
    wanted = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with few_rows_a_batch(pages.sparkSession):
        return stored(with_original(wanted).mapInArrow(_write(folder, archive_bytes), "archive string, bytes long, records long"))


def _index(folder: str) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                run = []
                with store.open_input_stream(f"{base}/{archive}", compression=None) as source:
                    for offset, length, content in records(source):
                        run.append(capture(content) | {"archive": archive, "offset": offset, "length": length})
                if len(run) != expected:
                    raise ValueError(f"{archive} holds {len(run)} of {expected} records")
                run.sort(key=order)
                for begin in range(0, len(run), 10_000):
                    piece = run[begin : begin + 10_000]
                    made = pa.RecordBatch.from_pylist(piece, schema=SCHEMA)
                    yield made.append_column("place", pa.array(np.arange(begin, begin + len(piece))))

    return apply


def runs(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of every archive, read back; ``place`` is their order within the run of their archive."""
    spark = archives.sparkSession
    number = max(1, archives.count())
    return archives.select("archive", "records").repartition(min(number, 100_000), "archive").mapInArrow(_index(folder), CAPTURE + ", place long")


class LoserTree:
    """Merges k sorted sequences: inner nodes keep the loser of their match, and a new head is played up one path only."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * self.k
        for run in range(self.k):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def _play(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            if self.loser[node] == -1:  # only while the tree is filled: the first of a pair waits here
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place) in merged order."""
        while self.k:
            run = self.loser[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, sorted by archive and place, in order of the index; ``place`` becomes the row's place in the range."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    whole = pa.Table.from_batches(rows).combine_chunks()
    key = whole.select(["url_key", "timestamp", "page_id", "archive", "offset"]).to_pylist()
    archive = whole.column("archive").combine_chunks().dictionary_encode()
    edges = np.flatnonzero(np.diff(archive.indices.to_numpy(), prepend=-1, append=-2)).tolist()
    pieces = [[order(r) for r in key[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    taken = np.fromiter((edges[run] + place for run, place in LoserTree(pieces)), np.int64, len(whole))
    for begin in range(0, len(taken), 10_000):
        piece = whole.take(pa.array(taken[begin : begin + 10_000]))
        place = pa.array(np.arange(begin, begin + len(piece)))
        yield piece.set_column(piece.schema.get_field_index("place"), "place", place).combine_chunks().to_batches()[0]


def merged(captures: DataFrame) -> DataFrame:
    """The index: CAPTURE, ``range`` and ``place``, in the order of which the captures of all runs follow one another."""
    captures = stored(captures)
    parts = max(1, -(-captures.count() // CAPTURES_A_TASK))
    dealt = captures.repartitionByRange(parts, *_ordered()) if parts > 1 else captures.repartition(1)
    sorted_runs = dealt.sortWithinPartitions("archive", "place")
    return sorted_runs.mapInArrow(_merge, CAPTURE + ", place long").withColumn("range", F.spark_partition_id())


def histories(index: DataFrame) -> DataFrame:
    """The index with ``capture_no`` (from 1, per URL key) and ``changed``: whether the payload differs from the capture before.

    Only the first and last key of each range decide how a history goes on in the next, so nothing but one row a range
    and key is shuffled: a URL with very many captures stays in the ranges it has.
    """
    index = stored(index)
    ends = index.groupBy("range", "url_key").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("payload_digest", "place").alias("last")
    )
    by_range = Window.partitionBy("url_key").orderBy("range")
    before = ends.select(
        "range", "url_key", (F.sum("n").over(by_range) - F.col("n")).alias("__before"), F.lag("last").over(by_range).alias("__last")
    ).where("__before > 0")
    here = Window.partitionBy("range", "url_key").orderBy("place")
    numbered = index.withColumns({"__no": F.row_number().over(here), "__previous": F.lag("payload_digest").over(here)})
    joined = numbered.join(before, ["range", "url_key"], "left")
    previous = F.coalesce("__previous", "__last")
    return joined.select(
        *index.columns, (F.col("__no") + F.coalesce("__before", F.lit(0))).alias("capture_no"),
        (previous.isNull() | (previous != F.col("payload_digest"))).alias("changed"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def capture_index(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages``, reads the archives back and merges their runs."""
    return merged(runs(write_archives(pages, folder, archive_bytes), folder))


SQL = r"""
with payloads as (
  select page_id, coalesce(html, '') as payload, max(page_id) over (partition by coalesce(html, '')) as top from pages),
digests as (
  select *, array_to_string(list_transform(string_split(upper(sha1(payload)), ''),
    lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789ABCDEF', x)]), '') as bits
  from payloads)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(1, 6), lambda j: cast(substr(bits, 5 * i + j, 1) as int)), lambda a, b: 2 * a + b), 1)), '') as payload_digest,
  case when page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to
from digests
"""


@query("op13_warc", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(table(spark, sf_dir, "pages"), archive_folder(spark))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
