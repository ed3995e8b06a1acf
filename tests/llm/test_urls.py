from itertools import combinations

from corpusloom.llm.urls import LISTED, RULES, judge, mine, op6_url_association_rules, tokens, with_parts

PAGES = "page_id long, url string, host string"


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def listed(host, path):
    best = None
    for action, h, p in LISTED:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return best


URLS = [None, "", "no scheme", "http://NET/", "http://a.net", "http://xnet/", "https://example.net/en/1?x#y", "http://b.example.net/en", "http://EXAMPLE.com/de/2", "ftp://a.org/fr/", "http://ÉX.org/fr/é?/", "http://a.org?x=/fr/", "x://y://z/", "http://h/p\n/q#", "://", "http://u@example.com:80/de/"]


def test_parts_and_listed_rules(spark):
    none = spark.createDataFrame([], RULES)
    out = judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], PAGES), none).collect()
    for r in sorted(out, key=lambda r: r.page_id):
        host, path = parts_of(URLS[r.page_id])
        rule = listed(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule[0] if rule else None, rule[1] if rule else "allow"), URLS[r.page_id]
    assert judge(spark.createDataFrame([], PAGES), none).collect() == []


def mined_by_hand(baskets, bad, min_support, min_certainty):
    """baskets: id -> tokens. All rules of both classes that no part of them makes idle: (tokens, class) -> (confidence, certainty, support)."""
    own = {}
    for i, basket in baskets.items():
        for k in range(1, len(basket) + 1):
            for part in combinations(sorted(basket), k):
                own.setdefault(part, []).append(i)
    n, shares = len(baskets), {"block": sum(i in bad for i in baskets) / len(baskets)}
    shares["allow"] = 1 - shares["block"]
    want = {}
    for part, ids in own.items():
        hit = sum(i in bad for i in ids)
        for kind, c in (("block", hit), ("allow", len(ids) - hit)):
            certainty = (c / len(ids) - shares[kind]) / (1 - shares[kind])
            if c / n >= min_support and certainty >= min_certainty:
                want[part, kind] = (c / len(ids), certainty, c / n)
    idle = lambda p, k, c: any(want.get((part, k), (-1,))[0] >= c for m in range(1, len(p)) for part in combinations(p, m))
    return {(p, k): v for (p, k), v in want.items() if not idle(p, k, v[0])}


def test_mined_rules_equal_brute_force(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}{i % 2}.example.org/{'x' if i % 5 else 'ad'}/{i}", "h") for i in range(300)]
    bad = {i for i, u, _ in rows if "spam" in u and "/ad/" in u or "spam0" in u}
    pages = spark.createDataFrame(rows + [(900, None, "h"), (901, "bad", "h")], PAGES)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, *_ in rows] + [(None, 0), (5, None), (900, 0)], "doc_id long, quality int")
    model = mine(pages, labels, min_support=0.02, min_certainty=0.5)
    baskets = {r.page_id: frozenset(r.t) for r in with_parts(pages).select("page_id", tokens().alias("t")).collect()}
    want = mined_by_hand({i: b for i, b in baskets.items() if b}, bad, 0.02, 0.5)
    got = {(tuple(r.tokens), r["class"]): r for r in model.collect()}
    assert {k: tuple(round(x, 9) for x in (r.confidence, r.certainty, r.support)) for k, r in got.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
    order = sorted(got, key=lambda k: (-got[k].certainty, -got[k].support, k))
    for r in judge(pages, model).collect():
        match = next((k for k in order if set(k[0]) <= baskets[r.page_id]), None)
        rule = listed(*parts_of(dict((i, u) for i, u, _ in rows).get(r.page_id)))
        assert r.verdict == (rule[1] if rule else match[1] if match else "allow") and r.mined_rule == (None if rule or not match else " & ".join(match[0]))
    assert {r.page_id for r in judge(pages, model).where("verdict = 'block'").collect()} == bad


def test_every_part_of_a_url_is_read(spark):
    url = "http://a.b.c.d.e.f/1/two/3/four?k=1&l&m=2&n=3&o"
    pages = spark.createDataFrame([(1, url, "")], PAGES)
    got = with_parts(pages).select(tokens().alias("t")).first().t
    assert {"host:a.b.c.d.e.f", "host:f", "path:four", "path:0", "key:o", "key:n", "scheme:http"} <= set(got)


def test_no_labels_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", ""), (1, "http://a.b/c", ""), (None, "http://a.b/c", None)], PAGES)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert mine(pages, empty).collect() == [] and judge(pages, mine(pages, empty)).count() == 3
    model = spark.createDataFrame([(["host:b"], "block", 0.9, 0.8, 0.1), (["host:a.b", "path:c"], "allow", 0.8, 0.3, 0.1)], RULES)
    assert [(r.verdict, r.mined_rule) for r in judge(pages, model).collect()] == [("block", "host:b")] * 3


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()}
    out = op6_url_association_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(urls)
    for r in out:
        rule = listed(*parts_of(urls[r.page_id]))
        assert (r.host, r.path) == parts_of(urls[r.page_id]) and r.rule == (rule[0] if rule else None) and (not rule or r.verdict == rule[1])
