"""Archives and their index: round trips, revisits, damaged files, runs merged in order, histories over ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from pairpref.llm import warc

PAGE = "page_id long, url string, html string, archive string, place int, original string, range int"


def pages(count=120):
    r = random.Random(2)
    rows = [(i, f"http{'s' * (i % 2)}://{r.choice(['www.', 'a.', ''])}example.{r.choice(['com', 'org'])}/{r.randrange(6)}?q={i % 3}#x", f"<p>{r.randrange(40)}</p>\r\n\r\n") for i in range(count)]
    rows += [(500, None, None), (501, "no scheme", ""), (502, "http://É.com/\r\nX: y\x00", "žluť \U0001f600" * 30000), (None, "http://a.com", "<p>1</p>\r\n\r\n"), (None, None, "alone")]
    rows += [rows[3], rows[3], (510, "http://one.com/", "hot"), *[(600 + i, "http://one.com/", "hot") for i in range(70)]]
    return rows


def brute(rows):
    top, out = {}, []
    for page, _, html in rows:
        top[html or ""] = max((x for x in (top.get(html or ""), page) if x is not None), default=None)
    for page, _, html in rows:
        data, first = (html or "").encode(), top[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "o", 2) for r in rows], PAGE)


@pytest.fixture
def folder(spark):
    return warc.archive_folder(spark)


@pytest.mark.parametrize("size,captures", [(64_000_000, 200_000), (900, 23)])
def test_index_in_global_order(spark, folder, monkeypatch, size, captures):
    monkeypatch.setattr(warc, "CAPTURES_A_TASK", captures)
    rows = pages()
    index = warc.histories(warc.capture_index(frame(spark, rows), folder, size)).orderBy("range", "place").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=repr) == brute(rows)
    assert sorted(((r.page_id, r.url) for r in index), key=repr) == sorted(((p, u or "") for p, u, _ in rows), key=repr)
    keys = [warc.order(r.asDict()) for r in index]
    assert keys == sorted(keys) and len({r.range for r in index}) == (1 if captures > 1000 else len({r.range for r in index}))
    number, last = {}, {}
    for r in index:
        number[r.url_key] = number.get(r.url_key, 0) + 1
        assert (r.capture_no, r.changed) == (number[r.url_key], last.get(r.url_key) != r.payload_digest)
        last[r.url_key] = r.payload_digest
    assert max(number.values()) >= 71


def test_archives_are_plain_gzip_members(spark, folder):
    archives = warc.write_archives(frame(spark, pages()), folder).collect()
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    assert sum(a.records for a in archives) == len(pages())
    for a in archives:
        with store.open_input_stream(f"{base}/{a.archive}", compression=None) as source:
            data = source.read()
        assert len(data) == a.bytes and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == a.records
        at = [o for o, _, _ in warc.records(io.BytesIO(data))]
        assert all(warc.capture(next(warc.records(io.BytesIO(data[o:])))[2]) for o in at)


def test_damage_is_seen():
    made = warc.record(7, "http://a.com", b"payload", None)
    content = next(warc.records(io.BytesIO(made)))[2]
    assert warc.capture(content)["payload_bytes"] == 7
    for broken in (content.replace(b"payload", b"paxload", 1) if content.count(b"payload") == 1 else content[::-1], content[:-1], content.replace(b"\r\n\r\npayload", b"\r\n\r\npaxload")):
        with pytest.raises((ValueError, KeyError)):
            warc.capture(broken)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(made[:-3])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(9),) for _ in range(r.choice([0, 1, 4, 20]))) for _ in range(k)]
    out = [runs[a][b] for a, b in warc.LoserTree(runs)]
    assert out == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("HTTP://user@WWW.Example.COM:80/A?b=C#d") == "com,example)/A?b=C"
    assert warc.url_key("https://a.b.org:8080") == "org,b,a:8080)/" and warc.url_key("") == ")/"


def test_no_pages(spark, folder):
    assert warc.histories(warc.capture_index(frame(spark, []), folder)).count() == 0
