import random
import re

import pytest

from tablewright.llm import url_rules as U

SPECS = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("example.com/en/ab", "allow")]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for spec, verdict in SPECS:
        h, _, p = spec.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(spec) > len(best[0])):
            best = spec, verdict
    if best:
        return host, path, *best
    hit = any(re.search(r.pattern, (host + path).lower()) for r in U.OWN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(3)
    urls = [None, "", "nothing", "://", "http://", "http://COM", "http://com/", "x://Example.COM/en/ABab?x", "a\nb://www.example.com/en/\nx#y",
            "http://example.com/en/abc", "http://example.com/en/ab/c", "http://notexample.com/en/a", "http://a.com:80/en/", "http://É.net/es/", "http://u@x.net/fr/",
            "http://cheap-pills.example.org/", "http://x.org/Free.Bets/1", "http://x.org/freebets", "http://x.org/a?casino-win", "http://win.casino.org", "p://q://r.com/"]
    for _ in range(300):
        urls.append(r.choice(["http", "https", "ftp"]) + "://" + ".".join(r.choice(["www", "example", "m", "casino-win", "x"]) for _ in range(r.randrange(1, 4)))
                    + r.choice([".com", ".net", ".org", ".NET"]) + r.choice(["", "/", "/en/", "/en", "/es/x", "/fr/?a", "/EN/", "/en/ab", "/fr/porn.html"]) + r.choice(["", "?q=1/2", "#z"]))
    pages = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {g.page_id: (g.host, g.path, g.rule, g.verdict) for g in U.judge_urls(pages, [U.site_rule(*s) for s in SPECS]).collect()}
    for i, u in enumerate(urls):
        assert got[i if i else None] == brute(u), u
    assert U.judge_urls(pages.limit(0), [U.site_rule(*s) for s in SPECS]).count() == 0
    assert U.judge_urls(pages, [], []).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_rules_are_filed_under_their_rarest_token():
    filed = U.index([U.site_rule(*s) for s in SPECS])
    assert {t: sorted(r.name for r in some) for t, some in filed.items()} == {
        "com": ["com/"], "example": ["example.com/en/", "example.com/en/ab"], "www": ["www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"],
    }
    with pytest.raises(ValueError):
        U.index([U.Rule("all", "block", ".*", ())])
