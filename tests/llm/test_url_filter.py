import random

import pytest

from regulith.llm import url_filter
from regulith.llm.queries import URL_RULES, op1_link_graph

from .helpers import rows, save


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    found = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(found, key=len, default=None)


def test_hosts_paths_and_rules(spark, tmp_path):
    urls = [None, "", "nourl", "http://", "http://A.B.net", "http://a.net/", "https://x.Example.NET/en/1?q#f", "https://x.example.net/en", "http://example.com/de/?a", "http://badexample.com/de/", "ftp://É.org/fr/x", "http://net/", "http://u@h:80/p://q", "//x.net/a", "http://a.org?x=/fr/", "http://a.org/fr/\nb", "a://b://c.net/"]
    save(spark, tmp_path, "pages", [(i, u, None, 0) for i, u in enumerate(urls)] + [(1, "http://a.net/", "x", 0)], "page_id long, url string, html string, rule int")
    got = rows(op1_link_graph(spark, str(tmp_path)), "page_id", "host", "path", "rule")
    assert got == sorted([(i, *parts(u), rule_of(*parts(u))) for i, u in enumerate([*urls])] + [(1, "a.net", "/", "net/")], key=repr)


def brute(edges, seeds, damping, rounds):
    """Trust, distrust, and all that can be known along and against links."""
    hosts = {h for e in edges for h in e[:2]} | set(seeds)
    judged = {h for h in seeds if sum(seeds[h])}
    own = [
        {h: seeds.get(h, (0, 0))[0] for h in hosts}, {h: seeds.get(h, (0, 0))[1] for h in hosts},
        {h: float(h in judged or (h in {e[0] for e in edges} and h not in {e[1] for e in edges})) for h in hosts},
        {h: float(h in judged or (h in {e[1] for e in edges} and h not in {e[0] for e in edges})) for h in hosts},
    ]
    out = []
    for kind in range(4):
        arcs = [(a, b, n) if kind % 2 == 0 else (b, a, n) for a, b, n in edges]
        total = {h: sum(n for a, _, n in arcs if a == h) for h in hosts}
        now = dict(own[kind])
        for _ in range(rounds):
            now = {h: own[kind][h] + damping * sum(now[a] * n / total[a] for a, b, n in arcs if b == h) for h in hosts}
        out.append(now)
    return out


def test_flows_are_as_brute_force(spark):
    rng = random.Random(4)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}"): rng.randint(1, 5) for _ in range(40)}
    edges = [(a, b, n) for (a, b), n in edges.items() if a != b] + [("start", "h1", 2), ("h4", "end", 3), ("h2", "end", 1)]
    seeds = {"h1": (1.0, 0.0), "h2": (0.25, 0.5), "h3": (0.0, 1.0), "lone": (0.5, 0.5)}
    df = spark.createDataFrame(edges, "src string, dst string, links long")
    own = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trusted double, blocked double")
    trust, distrust, forth, back = brute(edges, seeds, 0.85, 12)
    shares = lambda a, b: min(1.0, a / b) if b else 0.0
    for r in url_filter.propagate(df, own, rounds=12, tolerance=0).collect():
        assert r.trust == pytest.approx(trust[r.host], abs=1e-8) and r.distrust == pytest.approx(distrust[r.host], abs=1e-8)
        assert r.trust_share == pytest.approx(shares(trust[r.host], forth[r.host]), abs=1e-7) and r.distrust_share == pytest.approx(shares(distrust[r.host], back[r.host]), abs=1e-7)


def test_links_to_blocked_hosts_are_blamed_and_from_trusted_ones_praised(spark, tmp_path):
    link = lambda *hosts: "".join(f'<A class=x HREF="http://{h}/q">t</a> <a href="/own">o</a>' for h in hosts)
    pages = [(i, f"http://bad{i}.net/", "", 0) for i in range(4)]
    pages += [(10, "http://farm.com/x", link("bad0.net", "bad1.net", "bad2.net"), 0), (11, "http://farm.com/y", link("BAD3.net"), 0)]
    pages += [(20, "http://good.org/fr/1", link("fine.com"), 0), (21, "http://fine.com/", link("bad0.net", *["good.org"] * 9), 0), (22, "http://else.com/", None, 0)]
    save(spark, tmp_path, "pages", pages, "page_id long, url string, html string, trust int")
    got = {r.page_id: r.verdict for r in op1_link_graph(spark, str(tmp_path)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 10: "block", 11: "block", 20: "allow", 21: "allow", 22: "allow"}


def test_blame_does_not_shrink_with_the_number_of_linking_hosts(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">t</a>' for h in hosts)
    pages = [(0, "http://bad.net/", link("worse.net")), (1, "http://worse.net/", link("bad.net"))]
    pages += [(10 + i, f"http://farm{i}.com/", link("bad.net")) for i in range(10)]
    pages += [(30 + i, f"http://second{i}.com/", link(f"farm{i}.com")) for i in range(2)]
    pages += [(40, "http://news.com/", link("bad.net", *(f"site{i}.com" for i in range(9)))), (41, "http://half.com/", link("bad.net", "news.com"))]
    save(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in op1_link_graph(spark, str(tmp_path)).collect()}
    assert got == {p: "allow" if p in (40, 41) else "block" for p, *_ in pages}


def test_null_ids_and_very_long_html(spark, tmp_path):
    long = "<p>" + "x " * 1_000_000 + '<form method=post ACTION="https://bad.net/go"><area shape=rect href=//bad.net><iframe src=http://bad.net/>'
    pages = [(None, "http://bad.net/", None), (None, "http://site.com/", long), (3, "http://other.com/", "<p data-href='http://bad.net/'> href=http://bad.net/"), (4, None, '<a href="http://bad.net/">')]
    save(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    assert rows(op1_link_graph(spark, str(tmp_path)), "page_id", "host", "verdict") == sorted([(None, "bad.net", "block"), (None, "site.com", "block"), (3, "other.com", "allow"), (4, "", "allow")], key=repr)


def test_flows_go_on_until_they_stand_still(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trusted double, blocked double")
    got = {r.host: r.trust for r in url_filter.propagate(edges, seeds).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2), abs=1e-3) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2), abs=1e-3)


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "pages", [], "page_id long, url string, html string")
    assert op1_link_graph(spark, str(tmp_path)).collect() == []


def test_praise_and_distrust_are_on_one_scale(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">t</a>' for h in hosts)
    pages = [(0, "http://bad.net/", ""), (1, "http://one.org/fr/", link("praised.com", *(f"x{i}.com" for i in range(9)))), (2, "http://praised.com/", link("bad.net"))]
    pages += [(3, "http://two.org/fr/", link("both.com")), (4, "http://three.org/fr/", link("both.com")), (5, "http://both.com/", link("bad.net")), (6, "http://alone.com/", link("bad.net"))]
    save(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, round(r.trust_share, 6), round(r.distrust_share, 6)) for r in op1_link_graph(spark, str(tmp_path)).collect()}
    assert got[2] == ("allow", 1, 1) and got[5] == ("allow", 1, 1)  # one link of ten or two whole hosts: all that is known of them is trust and distrust
    assert got[6] == ("block", 0, 1)


def test_a_few_judged_pages_do_not_condemn_a_host(spark, tmp_path):
    pages = [(i, "http://www.example.com/" + ("de/x" if i == 0 else "en/x"), "") for i in range(100)]
    save(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    assert sorted(r.page_id for r in op1_link_graph(spark, str(tmp_path)).collect() if r.verdict == "block") == [0]
