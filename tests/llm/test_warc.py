import hashlib
import random

import pytest

from graphlake.llm import warc


def test_loser_tree_merges():
    rng = random.Random(16)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.choice([0, 1, 5, 20]))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/A/b?Q=1#x") == "com,example)/a/b?q=1"
    assert warc.url_key("http://m.a.b.org") == "org,b,a,m)/"
    assert warc.url_key(None) == warc.url_key("") == ")/"
    assert warc.url_key("http://[bad") == ")/http://[bad"


def brute(rows):
    first = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        again = data in first and page != first[data]
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a.example.com/x", "<p>" + "é" * 60, "k", 1),
    (1, "http://b.example.com/x", "<p>" + "é" * 60, "k", 1),
    (2, None, "<p>" + "é" * 60, "k", 1),
    (4, "http://a.example.com/x", "short", "k", 1),
    (5, "http://a.example.com/x\r\nWARC-Type: x", "short", "k", 1),
    (6, "http://a.example.com/x", None, "k", 1),
    (7, "", "", "k", 1),
    (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 20, "k", 1),
    (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 20, "k", 1),
    (None, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 20, "k", 1),
    (9, "v", "x" * 300_000 + "\x00\n", "k", 1),
    (10, "v", "y" * 99, "k", 1),
    (11, "v", "y" * 99, "k", 1),
    (12, "v", "y" * 100, "k", 1),
    (13, "v", "y" * 100, "k", 1),
]


@pytest.mark.parametrize("few", [True, False])
def test_archive_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "few_rows", lambda df: few)
    monkeypatch.setattr(warc, "FILE_RECORDS", 4)
    monkeypatch.setattr(warc, "RANGE_ROWS", 4)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string, bytes long").repartition(2)
    got = warc.archive(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    order = [(r.url_key, r.date, r.page_id is not None, r.page_id or 0, r.file, r.offset) for r in sorted(got, key=lambda r: r.place)]
    assert order == sorted(order) and len({r["range"] for r in got}) > 1
    assert sorted(r.place for r in got) == list(range(len(got)))


def test_offsets_and_payloads(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string, bytes long")
    path = warc.write(pages)
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()}
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in warc.index(spark, path).collect():
        (head, _, length, block), *rest = warc.parse(files[r.file][r.offset : r.offset + r.length])
        assert not rest and length == r.length
        if r.record_type == "response" and r.page_id is not None:
            assert block.split(b"\r\n\r\n", 1)[1] == html[r.page_id]
    with pytest.raises(ValueError):
        list(warc.parse(next(iter(files.values()))[:-2]))


def test_files_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    rows = [(i, f"http://a.example.com/{i % 7}", f"{i} " + "x" * (200 if i % 5 else 9000 if i % 3 else 70_000)) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").collect()
    for f in files:
        assert f.length <= 40_000 or len(list(warc.parse(bytes(f.content)))) == 1
    got = warc.merged(warc.stage(warc.index(spark, path), "t")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]


def test_places_split_one_address_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    pages = spark.createDataFrame([(i, "http://one.example.com/" if i % 3 else f"http://{i}.example.com/", "h") for i in range(400)], "page_id long, url string, html string")
    got = sorted(warc.archive(pages).collect(), key=lambda r: r.place)
    assert [r.page_id for r in got] == [i for _, i in sorted((warc.url_key("http://one.example.com/" if i % 3 else f"http://{i}.example.com/"), i) for i in range(400))]
    sizes = {}
    for r in got:
        sizes[r["range"]] = sizes.get(r["range"], 0) + 1
    assert len(sizes) > 10 and max(sizes.values()) < 100


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages).count() == 0
