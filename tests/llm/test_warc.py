from hashlib import sha256

import pytest

from quire.llm import common, warc as W

ROWS = [(1, "http://a.example/x", "p" * 150), (2, "http://a.example/x", "p" * 150), (3, None, None), (4, "http://b.example:80/\r\nX: y", "p" * 150), (5, "not a url", "short"), (6, "http://c.example/", "short"), (7, "https://A.example:8443/é?q#f", "é" * 60), (None, "http://d.example/", "p" * 150), (1, "http://a.example/x", "p" * 150), (9, "http://e.example/", "")]


@pytest.fixture(scope="module")
def built(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string")
    folder = common.fresh_path(spark, "test")
    captures = W.write(pages, folder)
    return pages, captures, W.build_index(captures, folder, block_lines=2)


@pytest.mark.parametrize("url, key", [("http://m.Example.com:80/a?b#c", "com,example,m)/a?b"), ("https://x.example", "example,x)/"), ("https://x.example:8443/", "example,x:8443)/"), (None, ""), ("", ""), ("nothing", "nothing"), ("http://[bad", "http://[bad")])
def test_keys(url, key):
    assert W.url_key(url) == key


def test_every_page_comes_back(spark, built):
    pages, _, directory = built
    got = W.read(W.lookup(directory, W.keyed(pages))).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = min((r[0] for r in ROWS if r[2] == html and r[0] is not None), default=None) if len(data) >= 100 else None
        revisit = first is not None and i != first
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)


def test_single_lookups(spark, built):
    _, captures, directory = built
    for key, n in (("example,a)/x", 3), ("example,c)/", 1), ("", 1), ("zzz", 0), ("aaa", 0)):
        q = spark.createDataFrame([(key,), (key,), (None,)], "key string")
        assert W.lookup(directory, q).count() == n


def test_a_directory_in_slices(spark, built, monkeypatch):
    pages, captures, directory = built
    monkeypatch.setattr(common, "BROADCAST_LIMIT", 1600)
    assert sorted(map(str, W.lookup(directory, W.keyed(pages)).collect())) == sorted(map(str, captures.collect()))


def test_records():
    r = W.record(7, "http://x.example/", b"a\r\n\r\nb", "d", None, False)
    head, payload = W.parse(r)
    assert payload == b"a\r\n\r\nb" and head["warc-target-uri"] == "http://x.example/"
    head, payload = W.parse(W.record(8, None, b"abc", "d", 7, True))
    assert payload == b"" and head["warc-refers-to"] == "<urn:page:7>" and "warc-target-uri" not in head


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.fresh_path(spark, "none")
    directory = W.build_index(W.write(pages, folder), folder)
    assert W.read(W.lookup(directory, W.keyed(pages))).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    out = W._Out(f"{tmp_path}", ".warc.gz")
    data = W.record(1, "u", b"payload", "0" * 64, None, False)
    at = out.write(data)
    out.close()
    c = spark.createDataFrame([("u", 1, out.path, at, len(data))], W._INDEX)
    with pytest.raises(Exception, match="damaged"):
        W.read(c).collect()
