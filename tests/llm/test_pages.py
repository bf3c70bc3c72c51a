import base64
import gzip
import hashlib

import pytest

from glossade.llm import archives, urls

PAGES = "page_id long, url string, html string"


def test_rules(spark):
    rows = [
        ("https://a.EXAMPLE.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
        ("http://other.org/x?a://b/c", "other.org", "/x", "org/", "allow"),
        ("http://other.org", "other.org", "", None, "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com/fr/#y", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://xcom/de/", "xcom", "/de/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://?q", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], PAGES).selectExpr("*", "'c' as node", "'d' as root", "'e' as host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_aliases(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")),
        (2, "http://b.net/2#top", "<meta http-equiv='refresh' content='0; url=http://x.com/de/9'>"),
        (3, "https://b.net/2", None),
        (4, "http://c.net/1", '<link href="/canon" rel="canonical">'),
        (5, "http://c.net/canon", "plain"),
        (6, "http://x.com/fr/1", link("http://x.com/de/9")),
        (7, "http://d.net/1", "canonical refresh"),
    ]
    df = spark.createDataFrame(rows, PAGES)
    v = lambda **k: {r.page_id: r.verdict for r in urls.judge(df, **k).collect()}
    assert v() == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}  # page 6 allows the whole component
    df = df.where("page_id != 6")
    assert v() == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 7: "allow"}
    more = spark.createDataFrame([("http://d.net/1", "http://a.net/1"), (None, "x")], "source string, target string")
    assert v(redirects=more)[7] == "block"
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_zip_ranges(large):
    parts = [(i, archives.record(i, f"http://x/{i}", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None)) for i in range(50)]
    raw = archives.zipped(parts, zip64=large)
    z = archives.ZipReader(lambda n, at: raw[at : at + n], len(raw))
    start, size = z.stored(archives.DATA)
    assert raw[start : start + size] == b"".join(r for _, r in parts)
    assert archives.parse(raw[start : start + len(parts[0][1])])["size"] == 0


def test_zip64_fields():
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 5_000_000_000, 4_999_999_999, 6_000_000_000)
    assert archives.ZipReader._large(extra, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (4_999_999_999, 5_000_000_000, 6_000_000_000)
    # an archive whose end record only points to a ZIP64 one
    body = archives.zipped([(1, b"r" * 40)])
    end = body.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", body, end + 10)
    large = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    raw = body[:end] + large + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    z = archives.ZipReader(lambda n, at: raw[at : at + n], len(raw))
    assert raw[z.stored(archives.DATA)[0]] == ord("r")
    with pytest.raises(ValueError):
        archives.ZipReader(lambda n, at: b"x" * n, 100)


def test_round_trip(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "http://a/é\n", big), (2, None, big), (3, "u", big), (3, "u", big), (None, "v", big), (4, "w", small), (5, "w", small), (6, "x", None), (7, "y", ""), (8, "z", "only " * 300)]
    got = archives.round_trip(spark.createDataFrame(rows, PAGES).selectExpr("*", "'q' as digest", "'r' as top")).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        twice = len(raw) >= 1000 and html == big
        want.append((page or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if twice and page != 3 else "response", 3 if twice and page != 3 else None))
    assert sorted(map(repr, ((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    assert archives.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_seen():
    r = gzip.decompress(archives.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None))
    assert base64.b32encode(hashlib.sha1(b"payload").digest()) in r
    with pytest.raises(ValueError):
        archives.parse(gzip.compress(r.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf")))


def test_clashing_columns_and_long_urls(spark):
    rows = [(1, "https://a.org/x", "<p>"), (None, None, None), (2, "http://www.x.com/de/" + "d" * 200_000, "y" * 300_000), (2, "http://www.x.com/de/" + "d" * 200_000, "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.selectExpr("*", *(f"'q' as {c}" for c in ("host", "path", "rule", "verdict", "node", "root", "own", "digest", "refers_to", "top", "n", "payload_digest", "record_type")))
    got = sorted(((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in urls.judge(df).collect()))
    assert got == [(0, "", 0, None, "allow"), (1, "a.org", 2, "org/", "allow"), (2, "www.x.com", 200_004, "com/de/", "block"), (2, "www.x.com", 200_004, "com/de/", "block")]
    back = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in archives.round_trip(df).collect())
    assert back == [(0, 0, "response", None), (1, 3, "response", None), (2, 300_000, "response", None), (2, 300_000, "response", None)]
