import re
import time

import pytest
from pyspark.sql import functions as F

from namesmith.llm import urlfilter
from namesmith.llm.queries import LISTED, RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "http://example.com/en/8", "http://a.example.com/en/70", "http://bexample.com/en/7", "https://x.net/de/", "https://example.net/de/8", "https://example.net/DE/8",
    "ftp://q.org?es/", "http://q.org/es/1", "http://q.org#/es/", "http://bad.host.org/", "http://m.bad.host.org/x://y", "http://good.host.org", "http://ÄÖ.org/es/", "x://a://b/c", "http://bad.host.org/",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(r), r, a) for a, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("bits", [10, 1])
def test_verdicts(spark, bits, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS", bits)
    hosts = [f"h{i}.host.org" for i in range(400)]
    listed = ["bad.host.org", *hosts[::7], "absent.host.org"]
    urls = [*URLS, *(f"http://w.{h}/p" for h in hosts)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, spark.createDataFrame([(x,) for x in [*listed, listed[0], None]], "key string"), RULES).collect()}
    for i, u in enumerate(urls):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert got[i] == (host, path, name, verdict or ("block" if ".".join(host.split(".")[-3:]) in listed else "allow")), u


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SHARD", 20)
    monkeypatch.setattr(urlfilter, "BROADCAST", 0)
    hosts = [f"h{i}.host.org" for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://{h}") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host for r in urlfilter.judge(pages, spark.createDataFrame([(x,) for x in hosts[::3]], "key string"), []).where("verdict = 'block'").collect()}
    assert got == set(hosts[::3])


def test_domains_of_any_depth(spark):
    listed = ["bad.org", "worse.site.co.uk", "com", "x"]
    hosts = {"bad.org": 1, "www.bad.org": 1, "notbad.org": 0, "worse.site.co.uk": 1, "a.b.worse.site.co.uk": 1, "site.co.uk": 0, "shop.com": 1, "org": 0, "x": 1, "": 0}
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r.verdict == "block" for r in urlfilter.judge(pages, spark.createDataFrame([(x,) for x in listed], "key string"), []).collect()}
    assert got == {h: bool(v) for h, v in hosts.items()}


def test_a_million_keys(spark):
    """A filter's bits are put together in time that follows the list; every page of the corpus is told right."""
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), (F.col("id") * 3).cast("string"), F.lit(".host.org")).alias("key"))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), (F.col("id") * 50).cast("string"), F.lit(".host.org/")).alias("url"))
    began = time.time()
    got = urlfilter.judge(pages, listed, []).select(F.sum(((F.col("page_id") * 50 % 3 == 0) == (F.col("verdict") == "block")).cast("int")).alias("right")).first()
    assert got.right == 60_000
    assert time.time() - began < 90


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/"), (1, "http://a.b.c/")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert [r.verdict for r in urlfilter.judge(pages, none, RULES).collect()] == ["allow", "allow"]
    assert urlfilter.judge(pages.limit(0), none, RULES).count() == 0


def test_rules_of_the_contract(spark):
    """The query's verdicts on listed and unlisted hosts, by rules written out here."""
    wanted = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"),
        "http://a.net/de/1": ("net/de/", "allow"), "http://spam-farm.example.net/de/1": ("net/de/", "allow"), "http://w.example.net/de/8": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"), "http://spam-farm.example.net/fr/": (None, "block"), "http://a.net/fr/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string")
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, listed, RULES).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())
