import re

import pytest
from srcatlas.llm import urls

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, row long, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(LOWER), path


def plain(url, rules, otherwise="allow"):
    """Every rule tested on the url; length, then the host's length, then block decide."""
    host, path = split(url)
    fits = []
    for verdict, rule in rules:
        if rule is None or verdict is None:
            continue
        r_host, slash, tail = rule.partition("/")
        r_host, r_path = r_host.translate(LOWER), slash + tail
        if r_host and (host == r_host or host.endswith("." + r_host)) and path.startswith(r_path):
            fits.append((len(r_host + r_path), len(r_host), verdict == "block", r_host + r_path, verdict))
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, otherwise)


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, "", "h", "p", "r", 1, 2) for i, u in rows], SCHEMA)


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://x.net?a=/b", "http://x.NET/#t", "http://example.net/en", "http://example.net/en/",
    "http://EXAMPLE.net/en/1", "http://notexample.net/en/1", "http://a.b.example.net/en/x/y", "http://a.example.net/EN/x", "https://example.com/de/1?x", "https://example.com/den",
    "https://m.example.com/de/", "https://org/fr/", "https://a.org/fr/2", "https://a.org/fr", "https://a.org//fr/", "http://u@net:80/", "http://.net/", "http://net./", "http://a..net/x",
    "http://x/http://net/", "http://ÉX.net/é/ü?", "http://a.net/\nb", "http://" + "a." * 5000 + "net/en/", "http://example.net/en/" + "x/" * 20000, "http://example.net" + "/" * 30000,
]


def facts(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_the_contract(pages):
    rows = list(enumerate(URLS)) + [(3, URLS[12])] * 3 + [(None, URLS[6])] * 2
    spark = pages([]).sparkSession
    got = facts(urls.judge(pages(rows), urls.listed_rules(spark)))
    assert got == sorted(repr((i, *plain(u, urls.RULES))) for i, u in rows)
    assert urls.judge(pages([]), urls.listed_rules(spark)).count() == 0


RULES = [
    ("block", "net"), ("allow", "net/e"), ("block", "a.net/en"), ("allow", "b.a.net/e"), ("block", "example.com/de/1"), ("allow", "example.com/de/1"), ("allow", "EXAMPLE.org/"),
    ("block", "org/éa/"), ("allow", "org/éa"), ("block", "c.net/x/y/z/"), ("allow", "/only"), ("block", ""), ("allow", None), (None, "net/null"), ("block", "net/e"),
]
HOSTS = ["net", "a.net", "b.a.net", "c.b.a.net", "c.net", "example.com", "m.example.com", "example.org", "xexample.org", "org", "é.org"]
PATHS = ["", "/", "/e", "/en", "/en/", "/x/y/z", "/x/y/z/", "/x/y/z/w", "/de/1", "/de/12", "/éa/b", "/éa", "/only"]


@pytest.mark.parametrize(("broadcast_rules", "hash_digits"), [(100, 8), (0, 8), (100, 1), (0, 0)])
def test_any_rules_by_broadcast_and_by_shuffle(spark, pages, broadcast_rules, hash_digits):
    """Without hash digits every rule meets every expression, so the digests alone decide."""
    rows = list(enumerate(f"http://{h}{p}" for h in HOSTS for p in PATHS))
    got = urls.judge(pages(rows), urls.listed_rules(spark, RULES), otherwise="block", broadcast_rules=broadcast_rules, hash_digits=hash_digits)
    assert facts(got) == sorted(repr((i, *plain(u, RULES, "block"))) for i, u in rows)


def test_no_rules(spark, pages):
    got = urls.judge(pages([(1, "http://a.net/x")]), urls.listed_rules(spark, []), otherwise="block").collect()
    assert [tuple(r) for r in got] == [(1, "a.net", "/x", None, "block")]


def test_a_hot_url_shuffles_as_single_rows(spark, pages):
    """Copies keep their own rows, and no Python runs on the way."""
    rows = [(5, "http://a.net/en/")] * 3000 + [(i, f"http://h{i}.org/fr/") for i in range(1000)]
    made = urls.judge(pages(rows), urls.listed_rules(spark))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)
    assert made.count() == 4000 and made.where("verdict = 'block'").count() == 3000
