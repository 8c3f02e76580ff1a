import base64
import gzip
import hashlib
from collections import Counter, defaultdict

from helpers import PAGES, clash, empty

from tidemark.llm import common, warc


def test_url_key():
    assert warc.url_key("http://User@A.b.ORG:80/x y?q#z") == "org,b,a)/x%20y?q"
    assert warc.url_key(None) == warc.url_key("") == ")/"
    assert "\n" not in warc.url_key("http://a/\n") and warc.url_key("http://[bad/") .startswith(")")


def rows():
    pages = [(i, f"http://h{i % 3}.example.org/p{i % 40}", f"<p>{i % 25} é {'x' * (i % 9)}</p>") for i in range(200)]
    return [*pages, (200, None, None), (201, "", ""), (202, "http://a b/\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (5, pages[5][1], pages[5][2]), (203, "u", "z" * 6_000_000), (None, "http://n", "null key")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_CAPTURES", 60)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    df = clash(spark.createDataFrame(rows(), PAGES))
    got = warc.archive(df, payload=True).collect()
    groups = defaultdict(list)
    for i, _, h in rows():
        groups[(h or "").encode()].append(i)
    want = Counter()
    for i, _, h in rows():
        data = (h or "").encode()
        top = max((x for x in groups[data] if x is not None), default=None)
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert {hashlib.sha1(r["payload"]).digest() for r in got if r["payload"] is not None} == {hashlib.sha1(d).digest() for d in groups}
    assert warc.archive(empty(df)).count() == 0


def test_least(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r["page_id"]: r["refers_to"] for r in warc.archive(df, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_archives_are_gzip_members(spark):
    df = spark.createDataFrame(rows()[:20], PAGES)
    address = common.scratch_path(spark, "warc-test")
    store, root = warc.open_store(address)
    store.create_dir(root)
    captures = common.materialize(warc.write_archives(warc.assign_types(df), address), "captures").collect()
    whole = {}
    for r in captures:
        with store.open_input_file(f"{root}/{r['file']}") as f:
            whole.setdefault(r["file"], gzip.decompress(f.read()))
    assert sum(d.count(b"WARC/1.1\r\nWARC-Type: ") for d in whole.values()) == 20
