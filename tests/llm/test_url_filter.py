import math
from collections import Counter

from wellspring.llm import url_filter as uf


def naive_rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def naive_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host, path


URLS = [None, "", "no scheme", "http://", "https://ORG/", "http://a.org", "http://a.org/x?y=/es/", "HTTP://Www.Example.ORG/es/1#q", "http://example.org/en/1", "http://example.org/en/12/x", "http://example.org/en/2", "http://xexample.org/es/", "http://borg/", "ftp://a.com/fr/x", "http://a.com/de/", "http://a.com/fr", "x://y://z/p", "http://a.net/ü\nq", "http://é.COM/de/?a", "http://u.com/" + "p" * 60_000]


def test_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[7], "x", 1), (7, URLS[7], "x", 1)], "page_id long, url string, host string, n int")
    got = uf.judge_urls(spark, df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[7 if r.page_id is None else r.page_id]
        host, path = naive_parts(url)
        name, verdict = naive_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert uf.judge_urls(spark, df.limit(0)).count() == 0


def test_models_as_by_hand(spark):
    train = {"a": ["abc", "abd", "bcd"], "b": ["abc", "xyz"]}
    grams = {k: Counter(z[i : i + 3] for u in v for z in ["^^" + u + "$"] for i in range(len(z) - 2)) for k, v in train.items()}
    rows = [(g, grams["a"][g], grams["b"][g]) for g in sorted(grams["a"] | grams["b"])]
    got = {r.g: r.llr for r in uf.language_models(spark.createDataFrame(rows, "g string, a long, b long")).collect()}

    def log_p(k, g):
        c = grams[k]
        one, two = Counter(), Counter()
        for x, n in c.items():
            one[x[2]] += n
            two[x[1:]] += n
        p0 = (one[g[2]] + 1) / (sum(one.values()) + uf.SYMBOLS)
        own = {x: n for x, n in two.items() if x[0] == g[1]}
        p1 = (two[g[1:]] + (len(own) + 1) * p0) / (sum(own.values()) + len(own) + 1)
        own = {x: n for x, n in c.items() if x[:2] == g[:2]}
        return math.log((c[g] + (len(own) + 1) * p1) / (sum(own.values()) + len(own) + 1))

    assert got.keys() == {r[0] for r in rows}
    for g in got:
        assert abs(got[g] - (log_p("a", g) - log_p("b", g)) * uf.SCALE) <= 1


def test_unsettled_urls_follow_their_models(spark):
    rows = [(i, f"http://h{i % 7}.org/garden/flowers/{i}") for i in range(120)] + [(200 + i, f"http://h{i % 7}.com/de/casino-win-{i}") for i in range(120)]
    rows += [(900, "http://h.net/garden/flowers/77"), (901, "http://h.net/casino-win-55")]
    got = {r.page_id: r.verdict for r in uf.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[900] == "allow" and got[901] == "block"


def test_thresholds_and_native_plan(spark, small):
    assert uf.threshold({"allow": (1.0, 1.0)}) is None and uf.threshold({"allow": (4.0, 1.0), "block": (0.0, 3.0)}) == 3.0 and uf.threshold({"allow": (1.0, 0.0), "block": (0.0, 0.0)}) == 0.5
    got = uf.query(spark, small)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert got.select("verdict").distinct().count() == 2
