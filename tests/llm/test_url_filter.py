import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from brindle.llm.queries import URL_RULES, op8_url_templates
from brindle.llm.url_filter import APART, FANOUT, PRIOR, PRIOR_LABELS, REJECT, STRONG, filter_urls

SCHEMA = "page_id long, url string, host string, verdict long"


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in URL_RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def urls():
    out = [None, "", "no scheme", "http://", "http://com/en/", "x://A.ÉX.COM/en/7?a#b", "http://example.com/en/7", "http://notexample.com/en/75", "http://a.example.net/de/81.html", "http://a.example.net/de/9", "http://a.org#/es/", "http://a.org/es", "http://u:p@a.org:80/es/x://y/de/", "http://a.net/de/1/2/3/4/5/6/7/8"]
    out += [f"https://h{i % 3}.example.com/{lang}/{i}.html" for i in range(60) for lang in ("en", "fr", "de")]
    out += [f"https://wide.example.org/blog/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}/page" for i in range(200)] + ["https://wide.example.org/blog/big/page"] * 40
    return out + out[:4]


def test_hosts_paths_and_rules(spark):
    given = [(i, u, "x", 0) for i, u in enumerate(urls())]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(given, SCHEMA).repartition(3), URL_RULES).collect()}
    assert len(got) == len(given)
    for i, u, *_ in given:
        host, path, best = brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


ID = re.compile(r"([0-9]+(\.[A-Za-z]{1,5})?|[0-9A-Fa-f]{8,}|[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{9,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|.*[0-9]{4,}.*)")


def brute_tree(urls, rules_of, labelled=()):
    """(template, purity, basis) of each url, on nested dictionaries."""
    lexical = lambda path: tuple("*" if ID.fullmatch(x) else x for x in path.split("/") if x)
    pages, labels = Counter(), defaultdict(Counter)
    for u in urls:
        host, path, best = rules_of(u)
        pages[host, lexical(path)] += 1
        if best:
            labels[host, lexical(path)][best[0] == "block"] += 1
    for u, rejected in labelled:
        host, path, _ = rules_of(u)
        pages[host, lexical(path)] += 0
        labels[host, lexical(path)][rejected] += 1
    at = {k: list(k[1]) for k in pages}
    for depth in range(max((len(x) for x in at.values()), default=0)):
        children = defaultdict(Counter)
        for (host, lex), x in at.items():
            if len(x) > depth and x[depth] != "*":
                children[host, tuple(x[:depth])][x[depth]] += pages[host, lex]
        for (host, _), x in at.items():
            of = children.get((host, tuple(x[:depth])), {})
            if len(x) > depth and len(of) > FANOUT and of.get(x[depth], 0) < STRONG * sum(of.values()):
                x[depth] = "*"
    count = defaultdict(Counter)
    for k, x in at.items():
        count[k[0], tuple(x)] += labels[k]
    merged = {k: k[1] for k, c in count.items() if sum(c.values()) and k[1]}
    for depth in reversed(range(max((len(x) for x in merged.values()), default=0))):
        nodes = defaultdict(Counter)
        for k, x in merged.items():
            if len(x) > depth and x[depth] != "*":
                nodes[k[0], x] += count[k]
        siblings = defaultdict(list)
        for (host, x), c in nodes.items():
            siblings[host, x[:depth], x[depth + 1 :]].append((c[True] / sum(c.values()), x[depth], c))
        new = {}
        for (host, before, after), found in siblings.items():
            found.sort(key=lambda f: f[:2])
            sets = [[found[0]]]
            for a, b in zip(found, found[1:], strict=False):
                n, m = sum(a[2].values()), sum(b[2].values())
                pooled = (a[2][True] + b[2][True]) / (n + m)
                near = b[0] - a[0] <= APART * math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
                sets[-1].append(b) if near else sets.append([b])
            for group in sets:
                names = sorted(g[1] for g in group)
                for name in names:
                    new[host, (*before, name, *after)] = (*before, "{" + "|".join(names) + "}" if len(names) > 1 else name, *after)
        merged = {k: new.get((k[0], x), x) for k, x in merged.items()}
    pool, node = defaultdict(Counter), defaultdict(Counter)
    for k, c in count.items():
        pool[k[0], merged.get(k, k[1])] += c
        for i in range(max(1, len(k[1]))):
            node[k[0], k[1][:i]] += c
    smooth = lambda c, p: (c[True] + PRIOR_LABELS * p) / (sum(c.values()) + PRIOR_LABELS)
    out = []
    for u in urls:
        host, path, best = rules_of(u)
        x = tuple(at[host, lexical(path)])
        last, p = merged.get((host, x), x), PRIOR
        for i in range(len(x)):
            p = smooth(node[host, x[:i]], p) if sum(node[host, x[:i]].values()) else p
        own = pool[host, last]
        basis = "rule" if best else "template" if sum(own.values()) else "parent" if any(sum(node[host, x[:i]].values()) for i in range(max(1, len(x)))) else "prior"
        out.append(("/" + "/".join(last), smooth(own, p), basis, best[0] if best else "block" if smooth(own, p) >= REJECT else "allow"))
    return out


def compare(got, want):
    for r, (template, purity, basis, verdict) in zip(got, want, strict=True):
        assert (r.template, r.basis) == (template, basis), (r, template, basis)
        assert r.purity == pytest.approx(purity, abs=1e-9) and r.verdict == verdict


def test_templates(spark):
    many = urls() + [f"http://d.com/{a}/{'x/' * 9}{b}/{c}{i}" for i, (a, b, c) in enumerate((a, b, c) for a in ("en", "en/7", "fr") for b in "pq" for c in "st")] + ["http://l.com/en/" + "deep/" * 3000 + "end"]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame([(i, u, "x", 0) for i, u in enumerate(many)], SCHEMA), URL_RULES).collect()}
    compare([got[i] for i in range(len(many))], brute_tree(many, brute))
    by_url = {u: got[i] for i, u in enumerate(many)}
    assert by_url["https://wide.example.org/blog/slug-aa/page"].template == "/blog/*/page"
    assert by_url["https://wide.example.org/blog/big/page"].template == "/blog/big/page"
    assert by_url["http://a.net/de/1/2/3/4/5/6/7/8"].template == "/de/*/*/*/*/*/*/*/*"


def test_purity_decides_where_no_rule_fits(spark):
    rules = [("block", "a.com/x/1"), ("allow", "a.com/y/1"), ("block", "a.com/z/1")]

    def rules_of(u):
        host, path, _ = brute(u)
        best = [(v, r) for v, r in rules if (host + path).startswith(r)]
        return host, path, best[0] if best else None

    given = [f"http://a.com/{k}/{d}{i}" for k in "xyz" for d in (1, 2) for i in range(100, 140)] + ["http://b.com/x/1", "http://a.com/w/9", "http://a.com"]
    labelled = [("http://b.com/other/7", True)] * 5 + [("http://c.com/", False), (None, True)]
    df = spark.createDataFrame([(i, u, "", 0) for i, u in enumerate(given)], SCHEMA)
    got = filter_urls(df, rules).orderBy("page_id").collect()
    compare(got, brute_tree(given, rules_of))
    assert {(r.template, r.verdict) for r in got if r.basis == "template"} == {("/{x|z}/*", "block"), ("/y/*", "allow")}
    got = filter_urls(df, rules, labelled=spark.createDataFrame(labelled, "url string, rejected boolean")).orderBy("page_id").collect()
    compare(got, brute_tree(given, rules_of, [x for x in labelled if x[0]]))
    assert [(r.basis, r.verdict) for r in got if r.host == "b.com"] == [("parent", "block")]


def test_query_on_table(spark):
    rows = duckdb.sql("SELECT page_id, url FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY 1").fetchall()
    got = op8_url_templates(spark, "/root/testdata/sf0.01").orderBy("page_id").collect()
    assert [r.page_id for r in got] == [i for i, _ in rows]
    compare(got, brute_tree([u for _, u in rows], brute))
    assert {"rule", "parent"} <= {r.basis for r in got}


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0
