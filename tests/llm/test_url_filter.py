from tallyweave.llm import url_filter as op

URLS = [
    None, "", "nothing", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/a", "http://www.example.com/en/a", "http://example.com", "http://a.net/es/1", "http://a.net/fr/1",
    "http://a.net/de/1", "a://b://c.com/", "http://notexample.com/en/", "http://net/es/", "x://" + "a" * 20_000 + ".org/" + "p" * 20_000, "http://spam-farm.example.org/en/1", "http://quiet.example.org/en/1", "ftp://host.org?q",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    best = None
    for verdict, rule in op.RULES:
        top, _, tail = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_rules_and_model(spark):
    pages = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(URLS)] + [(0, None, "x", 1.0)], "page_id long, url string, html string, score double")
    model = op.train(op.labelled_urls(spark))
    rows = op.filter_urls(pages, model).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= op.THRESHOLD else "allow"))
    by = {URLS[r.page_id]: r for r in rows}
    assert by["http://spam-farm.example.org/en/1"].verdict == "block" and by["http://quiet.example.org/en/1"].verdict == "allow"
    assert by[None].verdict == "allow" and by[None].score == 0


def test_without_labels_or_pages(spark):
    labels = op.labelled_urls(spark).where("false")
    assert op.train(labels) is None
    pages = spark.createDataFrame([(1, "http://casino.example.org/")], "page_id long, url string")
    assert op.filter_urls(pages, None).first().verdict == "allow"
    assert op.filter_urls(pages.where("false"), None).count() == 0
