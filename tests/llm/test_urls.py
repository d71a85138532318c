from terrane.llm import urls as U


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f"), (2, "https://a.example.net/de/1"), (3, "http://x.net"), (4, "http://x.net/"), (5, None), (6, "no scheme/net/"), (7, "http://b.example.com/de/"), (8, "http://b.example.com/en/"),
        (9, "http://é.org/fr/1"), (10, "http://net.org/x"), (11, "://h.org?x://y"), (12, "http://planet/"), (12, "http://planet/"), (13, "http://a.net?b/c"), (14, "a\nb://x.org/p"),
    ]
    pages = spark.createDataFrame([(i, u, "z", "z", "z") for i, u in rows], "page_id long, url string, host string, rule string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, U.rule_table(spark)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][:3] == ("x.net", "", None) and got[4][2:] == ("net/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2] is None and got[9][:3] == ("é.org", "/fr/1", "org/fr/")
    assert got[10][2] is None and got[11][:2] == ("h.org", "") and got[12][2] is None and got[13][:2] == ("a.net", "") and got[14][:2] == ("x.org", "/p")
    assert U.filter_urls(pages, U.rule_table(spark)).count() == len(rows)
    assert U.filter_urls(pages.limit(0), U.rule_table(spark)).count() == 0
    none = U.filter_urls(pages, U.rule_table(spark).limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_hosts_of_thousands_of_labels(spark):
    """Parent domains are built as far as rules go, so a long host costs no more than its length."""
    import time

    long = "a." * 20_000
    rows = [(1, f"http://{long}example.net/en/x"), (2, f"http://{long}net/"), (3, f"http://{long}org/de/"), (4, f"http://x..example.com/de/{long}")]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), U.rule_table(spark)).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, got[3][1]), 4: ("example.com/de/", "block")}
    assert time.time() - began < 30


def strength(children):
    """The prior's strength for (bad, n) around (parent's bad, parent's n), by moments."""
    spread = chance = most = 0.0
    for bad, n, parent_bad, parent_n in children:
        m, free = parent_bad / parent_n, 1 - n / parent_n
        spread += n * (bad / n - m) ** 2
        chance += m * (1 - m) * free
        most += m * (1 - m) * free * max(n - 1, 0)
    return 1000.0 if not most or spread <= chance else min(1000.0, max(1.0, most / (spread - chance) - 1))


def test_reputation_follows_the_chain(spark):
    hosts = {"a.x.com": (90.0, 100.0), "b.x.com": (30.0, 40.0), "x.com": (28.0, 40.0), "y.com": (0.0, 100.0), "w.y.com": (3.0, 60.0), "z.org": (0.0, 50.0), "a.b.co.uk": (5.0, 9.0), "c.co.uk": (0.0, 9.0)}
    parents = {"a.x.com": ("x.com", "com"), "b.x.com": ("x.com", "com"), "x.com": ("x.com", "com"), "y.com": ("y.com", "com"), "w.y.com": ("y.com", "com"), "z.org": ("z.org", "org"), "a.b.co.uk": ("b.co.uk", "co.uk"), "c.co.uk": ("c.co.uk", "co.uk")}
    domains, tops = {}, {}
    for h, (b, n) in hosts.items():
        for level, key in ((domains, parents[h]), (tops, parents[h][1])):
            was = level.get(key, (0.0, 0.0))
            level[key] = (was[0] + b, was[1] + n)
    total = tuple(map(sum, zip(*tops.values())))
    s_top = strength([(*t, *total) for t in tops.values()])
    s_domain = strength([(*d, *tops[k[1]]) for k, d in domains.items()])
    s_host = strength([(*v, *domains[parents[h]]) for h, v in hosts.items()])
    assert 1 < s_host < 1000
    got = {r.host: r for r in U.reputation(spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, bad double, n double")).collect()}
    for h, (b, n) in hosts.items():
        t, d = tops[parents[h][1]], domains[parents[h]]
        rate = (t[0] + s_top * total[0] / total[1]) / (t[1] + s_top)
        rate = (d[0] + s_domain * rate) / (d[1] + s_domain)
        rate = (b + s_host * rate) / (n + s_host)
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].lower - rate + (rate * (1 - rate) / (n + s_host + 1)) ** 0.5) < 1e-9


def test_reputation_decides_where_no_rule_fits(spark):
    rules = U.rule_table(spark, (("spam.com/a/", "block"), ("good.com/", "allow"), ("net/x/", "block")))
    rows = [("http://spam.com/a/1", 60), ("http://spam.com/b/1", 3), ("http://www.spam.com/c", 1), ("http://good.com/1", 80), ("http://fine.org/1", 30), ("http://one.net/x/", 1), ("http://one.net/y/", 9)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(u for u, n in rows for _ in range(n))], "page_id long, url string")
    got = {(r.host, r.path): r for r in U.filter_urls(pages, rules).collect()}
    assert got["spam.com", "/b/1"].rule is None and got["spam.com", "/b/1"].verdict == "block"
    assert got["fine.org", "/1"].verdict == "allow" and got["one.net", "/y/"].verdict == "allow" and got["good.com", "/1"].verdict == "allow"
