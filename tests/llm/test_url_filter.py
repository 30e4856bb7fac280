import numpy as np
import pytest

from lodestone.llm.url_filter import DigestArray, UrlParams, filter_urls, listed, normal

SCHEMA = "page_id long, url string"
ENTRIES = ("Bad.Example.com", "https://ok.example.com/ads/", "evil.org", "", None, "evil.org", "a.b.co/x/y")
URLS = [
    "http://bad.example.com/a", "https://www.bad.example.com:8080/?q", "http://notbad.example.com/", "http://ok.example.com/ads/1", "http://ok.example.com/adsense", "http://ok.example.com/ads?x=1", "HTTP://user@EVIL.org./p", "evil.org/p", "", None, "http://", "http://[bad", "http://a.b.co/x/y/z#f", "http://a.b.co/x", "http://c.a.b.co/x/y", "x" * 100000, "http://evil.org/" + "p/" * 3000,
]
WANT = ["bad.example.com", "bad.example.com", None, "ok.example.com/ads", None, "ok.example.com/ads", "evil.org", None, None, None, None, None, "a.b.co/x/y", None, None, None, "evil.org"]


@pytest.mark.parametrize("params", [UrlParams(), UrlParams(shard_entries=1)])
@pytest.mark.parametrize("table", [False, True])
def test_entries(spark, params, table):
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "e string") if table else ENTRIES
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], SCHEMA).selectExpr("*", "'x' as entry", "1 as blocked", "2 as row")
    got = filter_urls(df, entries, params).collect()
    assert len(got) == len(URLS) + 2
    assert [r["entry"] for r in sorted((r for r in got if r["page_id"]), key=lambda r: r["page_id"])] == WANT[1:]
    assert sum(r["blocked"] for r in got) == sum(w is not None for w in WANT) + 2


def test_collisions_are_told_apart():
    arrays = DigestArray.arrays(["one.example", "two.example", "three.example"])
    arrays["digests"][:] = 7
    a = DigestArray(arrays)
    assert a.holds(["one.example", "two.example", "three.example", "four.example"], np.full(4, 7, np.uint64)).tolist() == [True, True, True, False]


def test_single_labels_and_addresses(spark):
    urls = ["http://a.internal/x", "http://internal/", "http://10.1.2.3/", "http://2.3/", "http://[::1]/", "http://x.10.1.2.3.example/"]
    got = {r["url"]: r["entry"] for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), ("internal", "2.3", "3", "::1")).collect()}
    assert got == dict(zip(urls, ["internal", "internal", None, "2.3", None, None], strict=True))


def test_many_shards(spark):
    entries = spark.range(3000).selectExpr("concat('site', id, '.example') as e")
    urls = [(i, f"https://w.site{i}.example/p") for i in range(2900, 3100)]
    got = filter_urls(spark.createDataFrame(urls, SCHEMA), entries, UrlParams(shard_entries=100)).collect()
    assert sorted(r["page_id"] for r in got if r["blocked"]) == list(range(2900, 3000))


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    assert filter_urls(spark.createDataFrame([(1, "http://a.b/")], SCHEMA), ()).collect()[0]["blocked"] is False
    assert normal("  HTTP://A.b/c/?q#f ") == "a.b/c"


def test_shipped_list(spark):
    sites = [f"{s}.example.{d}" for s in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for d in ("com", "net", "org")]
    fine = ["http://ththre.example.com/fr/825?page=2", "http://cheap-pills.example.edu/", "http://mycheap-pills.example.com/"]
    urls = [f"https://{w}{s}/en/1" for s in sites for w in ("", "m.", "www.")] + fine
    got = {r["url"]: r["entry"] for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA)).collect()}
    assert got == {f"https://{w}{s}/en/1": s for s in sites for w in ("", "m.", "www.")} | dict.fromkeys(fine)


def test_list_file():
    assert listed("# a list\n\n  bad.org \nok.com/ads\n#bad.net\n") == ("bad.org", "ok.com/ads")
