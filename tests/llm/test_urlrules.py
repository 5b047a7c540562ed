import random

from quirefold.llm import urlrules
from quirefold.llm.queries import URL_RULES

ODD = [None, "", "no scheme/net/x", "http://net/", "HTTP://WWW.Example.NET/en/1?x#y", "http://a.example.net/EN/", "https://notexample.net/en/", "http://example.net", "http://example.net?/en/", "x://y://z.net/fr/", "http://b.org/fr/1", "http://org/fr", "http://b.org/fr/", "http://example.com/de/#", "http://example.com:80/de/", "http:///path", "http://.net/", "http://net./", "http://ÄÖ.example.net/en/", "http://a\x01b.net/", "ftp://user@example.net/en/x"]


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), h, rule, verdict))
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, default)


def judged(spark, urls, rules, parts=5):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = urlrules.judge_urls(pages, urlrules.rules_table(spark, rules), ["page_id"], parts=parts).collect()
    assert len(rows) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


def test_awkward_urls(spark):
    assert judged(spark, ODD, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(ODD)}


def test_many_nested_rules_and_a_hot_url(spark):
    r = random.Random(3)
    label = lambda: r.choice("abc")
    host = lambda: ".".join(label() for _ in range(r.randint(1, 5)))
    path = lambda: "".join(f"{label()}/" for _ in range(r.randint(0, 2)))
    rules = list({rule: (r.choice(["block", "allow"]), rule) for rule in (f"{host()}/{path()}" for _ in range(150))}.values())
    urls = [f"http://{host()}/{path()}x" for _ in range(400)] + ["http://a.b.c/a/"] * 300
    assert judged(spark, urls, rules, 7) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_nothing_to_judge_or_no_rules(spark):
    assert judged(spark, [], URL_RULES) == {}
    assert judged(spark, ODD, []) == {i: brute(u, []) for i, u in enumerate(ODD)}
