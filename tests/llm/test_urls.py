from solvlake.llm import urls

PAGES = "page_id long, url string, html string, host string, rule string"
URLS = [
    "http://m.thernd.example.com/en/702", "https://EXAMPLE.com/en/8?x=/en/7", "https://example.com/en/75/a", "http://a.net/de/1", "http://example.net/de/88#x", "http://xexample.net/de/88", "http://b.org/es/", "http://b.org/es",
    "ftp://org/es/x://y/z", "no url", "", None, "://", "http://", "http://com/en/", "http://com.com/en/x", "http://example.com./en/7", "http://com?/en/", "http://a.net/de/8" + "9" * 5000, "http://" + "a." * 500 + "com/en/1", "HTTP://É.net/de/é",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0] + [len(path)])]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


def test_against_brute_force(spark):
    made = [(i, u, "<p>", "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None), (1, URLS[1], None, None, None)]
    got = urls.judge(spark.createDataFrame(made, PAGES), urls.rule_table(spark)).collect()
    key = lambda i: (i is None, i or 0)
    want = sorted((key(i), str(brute(u, urls.RULES))) for i, u, *_ in made)
    assert sorted((key(r.page_id), str((r.host, r.path, r.rule, r.verdict))) for r in got) == want


def test_precedence_ties_and_odd_rules(spark):
    rules = [("allow", "b.com", "/x"), ("block", "com", "/x/y"), ("block", "a.b.com", ""), ("allow", "a.b.com", ""), ("block", None, "/"), ("block", "com", "/x/y"), ("allow", "q.r.s", "/long/path/here")]
    made = [(1, "http://a.b.com/x/y", "", "", ""), (2, "http://b.com/x/y", "", "", ""), (3, "http://a.b.com/z", "", "", ""), (4, "http://q.r.s/long/path/her", "", "", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(made, PAGES), spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    # seven characters each on the first and third: of equal length, the longer host wins, and block of equal rules
    assert got == {1: ("a.b.com", "block"), 2: ("b.com/x", "allow"), 3: ("a.b.com", "block"), 4: (None, "allow")}


def test_empty_tables(spark):
    pages, rules = spark.createDataFrame([(1, URLS[0], "", "", "")], PAGES), urls.rule_table(spark)
    assert [(r.rule, r.verdict) for r in urls.judge(pages, rules.limit(0)).collect()] == [(None, "allow")]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_very_long_urls(spark):
    path = "/en/" + "a/" * 20_000
    made = [(1, f"http://x.com{path}", "", "", ""), (2, "http://" + "s." * 500 + "example.net/de/8" + path, "", "", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(made, PAGES), urls.rule_table(spark)).collect()}
    assert got[1].path == path and got[1].verdict == "block" and len(got[2].host) == 1_011 and got[2].verdict == "block"
