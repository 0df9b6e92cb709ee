import random

from slipstone.llm.urls import UrlTrie, judge


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fitting = [
        (rhost.count("."), len(rpath), verdict == "block", rhost + rpath, verdict)
        for verdict, rhost, rpath in rules
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath)
    ]
    best = max(fitting, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_equals_brute_force(spark):
    draw = random.Random(2)
    hosts = ["net", "a.net", "b.a.net", "org", "xnet", "A.Net", "c.org", ""]
    paths = ["", "/", "/en/", "/en", "/english/x", "/en/a/b", "//", "/de/a"]
    rules = [(draw.choice(["allow", "block"]), h.lower(), p) for h in hosts[:4] for p in paths if draw.random() < 0.6]
    urls = [f"http://{draw.choice(['', 'w.'])}{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=://x", "#f", "?a#b")]
    urls += [None, "", "no scheme", "://", "x://y://z/p", "http://net\n/a", "http://net/" + "s/" * 5000]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(frame, rules, carry=("page_id", "host")).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert judge(frame.limit(0), rules).count() == 0


def test_block_goes_before_allow_at_one_place():
    for order in (1, -1):
        rules = [("allow", "x.org", "/a"), ("block", "x.org", "/a")][::order]
        assert UrlTrie(rules).find("x.org", "/ab") == ("x.org/a", "block")
    assert UrlTrie([]).find("x", "/") == (None, None)
