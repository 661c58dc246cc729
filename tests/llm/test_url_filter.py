import random
import re

from lossframe.llm import url_filter


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(h), len(p)) > best[0]):
            best = ((len(h), len(p)), rule, verdict)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def test_matches_brute_force(frame):
    rng = random.Random(2)
    rules = [*url_filter.RULES, ("block", "a.org/x/y"), ("allow", "a.org/x/"), ("block", "b.a.org/"), ("allow", "b.a.org/x/yz"), ("block", "com/")]
    urls = [None, "", "org", "://", "http://", "http://ORG", "http://org/", "HTTP://x.Example.ORG/es/", "http://example.org/en/12?a=/es/", "http://example.org/en/2",
            "http://notexample.org/es/", "ftp://u:p@a.org:80/x", "http://a.org/x/yz", "http://b.a.org/x/yz/1", "http://a.org./x", "http://\n.org/\n", "http://x.com/fr/" + "a/" * 50000,
            "no://a.org/x://b", "http://a.org?x/", "http://a.org#/x/"]
    urls += ["http://" + ".".join(rng.choices(["a", "b", "org", "com", "example", ""], k=rng.randint(1, 4))) + "".join(
        "/" + rng.choice(["x", "y", "yz", "en", "1", "es", "fr", "", "de"]) for _ in range(rng.randint(0, 4))) for _ in range(500)]
    pages = frame([(i, u, "<p>", "h", "v") for i, u in enumerate(urls)] + [(3, urls[6], None, None, None)] * 2, "page_id long, url string, html string, host string, verdict string")
    for r in url_filter.judged(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules)
    assert url_filter.judged(pages.limit(0)).count() == 0
    assert url_filter.allowed(pages, rules, "block").filter("rule is null").count() == 0
