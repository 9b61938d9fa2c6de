from sluicework.llm import url_filters as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


URLS = [None, "", "nope", "http://", "https://A.Example.com/en/x?y#z", "http://www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "ftp://example.com", "http://example.com#/en/", "http://a.b.c.d.e.f.g.example.com/en/q", "http://ü.com/Ä", "http://x.net/es", "a://b://c.com/"]
RULES = [*U.RULES, ("com", "/", "block"), ("", "", "block"), ("example.com", "/e", "allow"), (None, "/", "block")]


def test_against_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h"), (1, "", "h")], "page_id long, url string, host string")
    for rules in (U.RULES, RULES):
        given = spark.createDataFrame(rules, "host string, path string, action string")
        known = [r for r in rules if None not in r]
        want = sorted(repr((i, *brute(u, known))) for i, u in [*enumerate(URLS), (None, URLS[4]), (1, "")])
        for bound in (U.BROADCAST_RULES, 0):  # both ways of the join
            monkeypatch.setattr(U, "BROADCAST_RULES", bound)
            got = [tuple(r) for r in U.filter_urls(pages, given).collect()]
            assert sorted(map(repr, got)) == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert U.filter_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in U.filter_urls(one, rules).collect()] == [(1, "a.com", "/", None, "allow")]
