import random

from rillwork.llm import urlfilter


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def judge(url, rules):
    host, path = host_path(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/es/x", "allow")]


def test_against_brute_force(spark):
    rng = random.Random(4)
    urls = [None, "", "nothing", "http://", "http://org", "HTTP://EXAMPLE.org/es/", "http://example.org?x=/es/", "http://notexample.org/es/", "http://a.example.org/es/xy#f", "x://.org/", "http://example.org./es/"]
    hosts = ["example.org", "a.example.org", "b.a.Example.Org", "org", "shop.com", "com", "net", "x.org:80", "org.com"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/x', '/en/1', '/en/12', '/fr/', '/de/z'])}{rng.choice(['', '?q', '#f'])}" for _ in range(500)]
    pages = spark.createDataFrame([(i % 300, u, "x") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge_urls(pages, rules).collect())
    want = sorted((i % 300, *[x or "" for x in judge(u, RULES)]) for i, u in enumerate(urls))
    assert got == want


def test_many_nested_rules_and_ranges(spark):
    rng = random.Random(5)
    rules = list({(rng.choice(["a.b", "b", "c.b", "d"]), "/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 4)))): None for _ in range(80)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{rng.choice(['a.b', 'q.a.b', 'c.b', 'd', 'e'])}/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))) for _ in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        assert got[i] == judge(u, rules)[2:], u


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/")], "page_id int, url string")
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none).collect()] == [(1, "a", "/", None, "allow")]
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
