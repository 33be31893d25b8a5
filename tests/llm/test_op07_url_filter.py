import random
import re

from tests.llm.conftest import lower
from tidemark.llm.url_filter import Rule, judge_urls, parse_rules, propagate

RULES = parse_rules("block net/, allow example.net/en/, block example.com/de/, allow org/fr/")
URLS = [
    None, "", "nothing", "http://", "http://net", "http://net/", "http://NET/x", "https://a.Example.NET/en/1?x=/de/", "https://example.net/EN/", "https://myexample.net/en/1",
    "http://example.com/de/1", "http://example.com/de", "http://www.example.com/de/?q#f", "http://a.org/fr/1", "http://org/fr/", "http://xorg/fr/", "ftp://u:p@a.org:80/fr/", "x://y://z/w",
    "http://a.net?x=/", "http://a.net#/", "//a.net/", "http://ünet/", "http://A.B.C/p/ath\n/x?y",
]


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = lower(re.match(r"(?s)[^/?#]*", rest)[0])
    path = re.match(r"(?s)[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, verdict string, mass int")


def test_rules_equal_brute_force(spark):
    out = judge_urls(pages(spark, [(u, None) for u in URLS] * 2), RULES)
    rows = sorted(out.collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [brute(u) for u in URLS] * 2
    assert set(out.columns) == {"page_id", "url", "mass", "host", "path", "rule", "verdict", "trust", "distrust"}


def test_propagation_blocks_those_that_link_to_blocked_hosts(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">l</a><a href="/own">o</a>' for h in hosts)
    rows = [("http://spam.net/a", link("farm.com")), ("http://farm.com/a", link("spam.net", "spam.net")), ("http://far.com/a", link("farm.com"))]
    rows += [("http://good.org/fr/a", link("fine.com")), ("http://fine.com/a", link("good.org")), ("http://alone.com/a", link("alone.com")), ("http://fine.com/b", None)]
    got = {r.url: r.verdict for r in judge_urls(pages(spark, rows), RULES).collect()}
    assert got == {
        "http://spam.net/a": "block", "http://farm.com/a": "block", "http://far.com/a": "block",
        "http://good.org/fr/a": "allow", "http://fine.com/a": "allow", "http://alone.com/a": "allow", "http://fine.com/b": "allow",
    }


def test_mass_equals_power_iteration(spark):
    R = random.Random(7)
    hosts = [f"h{i}" for i in range(12)]
    edges = [(a, b, float(R.randint(1, 5))) for a in hosts for b in hosts if a != b and R.random() < 0.3]
    seeds = {"h0": 0.5, "h1": 0.5}
    got = {r.host: r.mass for r in propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), 0.85, 7, 2).collect()}
    rank, out = dict(seeds), {a: sum(w for s, _, w in edges if s == a) for a in hosts}
    for _ in range(7):
        want = {h: 0.85 * sum(rank.get(s, 0) * w / out[s] for s, d, w in edges if d == h) for h in hosts}
        rank = {h: want[h] + 0.15 * seeds.get(h, 0) for h in hosts}
    assert all(abs(got.get(h, 0) - want[h]) < 1e-12 for h in hosts)


def test_longest_rule_and_no_rows(spark):
    out = judge_urls(pages(spark, [("http://a.b.c/x/y", None)]), [Rule("block", "c"), Rule("allow", "b.c", "/x/"), Rule("block", "b.c", "/x")]).first()
    assert (out.rule, out.verdict) == ("b.c/x/", "allow")
    assert judge_urls(pages(spark, []), RULES).collect() == []


def test_mass_reaches_hosts_twenty_links_away(spark):
    rows = [("http://spam.net/a", None)] + [(f"http://h{i}.com/a", f'<a href="http://{f"h{i - 1}.com" if i > 1 else "spam.net"}/a">l</a>') for i in range(1, 21)]
    got = {r.host: r.distrust for r in judge_urls(pages(spark, rows), RULES).collect()}
    assert all(abs(got[f"h{i}.com"] - 0.15 * 0.85**i) < 1e-5 for i in range(1, 21))
