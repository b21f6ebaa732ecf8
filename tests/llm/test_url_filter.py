import re

from heddle.llm.url_filter import RULES, judge_urls

URLS = [
    "http://a.example.net/en/1", "HTTP://A.Example.NET/fr/1", "https://net", "https://net/", "https://x.net?q=/", "http://example.com/de/x#y", "http://example.com/DE/x", "http://wwwexample.com/de/1",
    "http://b.org/fr/1?x=1&y=2", "http://org/fr/", "http://b.org/en/1", "no scheme", None, "", "://", "http://example.net/en/", "http://example.net/en", "http://notexample.net/en/1", "http://h.net:80/x", "ftp://é.org/fr/ü",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + tail
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules_and_parts(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS * 3)]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule int")).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, (rule, verdict) = brute(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), rows[r["page_id"]]
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_one_kind_of_label_and_none(spark):
    make = lambda urls: {r["verdict"] for r in judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()}
    assert make(["http://a.net/1", "http://q.de/"]) == {"block"}
    assert make(["http://q.de/"]) == {"allow"}
    assert make([]) == set()


def test_trees_learn_from_the_urls(spark):
    rows = [(i, f"http://h{i}.example.net/{'fr' if i % 2 else 'en'}/{i}") for i in range(300)]
    other = [(1000 + i, f"http://h{i}.example.org/en/{i}") for i in range(50)]
    out = judge_urls(spark.createDataFrame(rows + other, "page_id long, url string")).toPandas()
    assert out["block_score"].between(0, 1).all() and out["verdict"].isin(["allow", "block"]).all()
