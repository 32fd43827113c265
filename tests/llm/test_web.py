import hashlib
import itertools
import random
import zlib

import pytest

from lodestone.llm import url_filter, warc

PAGES = [
    (4, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (9, None, "x" * 100), (3, "http://a\r\nX: y/%", "é" * 60),
    (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "é" * 60), (10, "u", "y\r\n\r\n" * 40000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "digest?") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    archives = warc.write_archives(frame(spark, PAGES))
    got = sorted(warc.read_archives(archives).collect(), key=lambda r: (r.page_id is None, r.page_id))
    first = {}
    for i, _, html in sorted(PAGES, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        r = next(r for r in got if r.page_id == i)
        owner = first.setdefault(data, i) if len(data) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if owner == i else ("revisit", owner))
        assert r.payload == (data if owner == i else None)
    assert {r.page_id: r.url for r in got} == {r[0]: r[1] for r in PAGES}
    assert warc.read_archives(warc.write_archives(frame(spark, []))).count() == 0


def test_broken_archives():
    one, two = (warc.record(i, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None) for i in (1, 2))
    assert [r["page_id"] for r in warc.read_archive(one + two)] == [1, 2]
    false_digest = warc.record(1, "u", b"payload", "0" * 64, None)
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    ill = z.compress(zlib.decompress(one, 31)[:-1]) + z.flush()
    for bad in (one[:-9], one + two[:30], false_digest, ill, b"plain"):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_archive(bad))


def plain(rules, host, path):
    fit = [((len(h) + len(p), len(h), v == "block"), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def test_trie_against_scan():
    rng = random.Random(7)
    hosts = [".".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "ab"], repeat=n)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/ab/a", "/a//b", "//"]
    for _ in range(30):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(12)]
        trie = url_filter.UrlTrie(rules)
        for host, path in itertools.product(hosts + [""], paths):
            assert trie.match(host, path) == plain(rules, host, path), (rules, host, path)


def test_filter_urls(spark):
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/x?y#z", "https://m.example.org/en/12", "https://x.com/fr/", "http://x.com/de/?a",
            "http://x.net/", "http://example.org", "http://example.org?x=/es/", "http://notexample.org/es/", "ftp://É.COM/fr/", "://", "a://b://c"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(None, "http://a.org/", "v")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[8] == ("example.org", "", None, "allow") == got[9]
    assert got[10][2:] == ("org/", "allow") and got[11][0] == "É.com" and got[None][2] == "org/"
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        assert (got[i][2], got[i][3]) == (plain(url_filter.RULES, host, path) or (None, "allow"))


def test_filter_urls_empty_repeated_and_very_long(spark):
    schema = "page_id long, url string, host int"
    assert url_filter.filter_urls(spark.createDataFrame([], schema)).count() == 0
    long = "http://" + "a." * 50_000 + "example.org/en/1" + "/x" * 200_000
    deep = "http://x.com/" + "de/" * 100_000
    rows = [(1, long, 0), (1, long, 0), (2, deep, 0), (2, "http://x.com/de/", 0), (3, None, None), (3, None, None)]
    got = sorted((r.page_id, r.host or "", r.path or "", r.rule or "", r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, schema)).collect())
    want = []
    for i, url, _ in rows:
        host, path = url_filter.split_url(url)
        rule, verdict = plain(url_filter.RULES, host, path) or (None, "allow")
        want.append((i, host, path, rule or "", verdict))
    assert got == sorted(want)
    assert {(i, v) for i, _, _, _, v in got} == {(1, "block"), (2, "block"), (3, "allow")}
