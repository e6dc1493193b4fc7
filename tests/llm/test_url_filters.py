import random
import re
from collections import defaultdict

from textloom.llm import url_filters as U
from textloom.llm.queries import RULES


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for says, rule in RULES:
        d, _, p = rule.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = says, rule
    return host, path, best


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM", "http://example.com/en/1", "https://x.example.com/en/1?a=/fr/", "http://www.example.com/en/#x", "ftp://b.NET/es/2", "http://net/fr/", "http://notnet/fr/", "http://é.net/fr/x", "http://a.net?x=/fr/", "a://b://c.com/", "http://x.com", "http://x.com/", "http://x.com:80/", "http://example.com/en", "x\ny://h.com/a\nb?c", "HTTP://İ.COM/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as host")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in U.judge_urls(pages, labels, RULES).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, best = plain_rule(url)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best and best[1], best[0] if best else "allow"), url


def test_templates_are_generalised_merged_and_rejected(spark):
    pages, labels = [], []

    def add(url, good):
        pages.append((len(pages), url))
        if good is not None:
            labels.append((len(pages) - 1, good))

    for k in range(300):
        add(f"http://h.org/tag/name{chr(97 + k % 26)}{chr(97 + k // 26)}x/page{k}", k % 10 != 0)  # many rare names
        add(f"http://h.org/spam/{k}.html", k % 10 == 0)  # its own purity
        add(f"http://h.org/news/{k}", k % 10 != 0)
    for k in range(40):
        add(f"http://h.org/a/b/c/d/e/f/g/h/i/{k}/j", None)
    pages += [(None, "http://h.org/news/5"), (3, pages[3][1])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    known = spark.createDataFrame([(i, int(g)) for i, g in labels], "page_id long, good int")
    got = {r.page_id: r for r in U.judge_urls(df, known).collect()}
    spam = {got[k].template for k in range(1, 900, 3)}
    assert len(spam) == 1 and got[1].verdict == "block" and got[1].template.endswith("#.html")
    rest = {got[k].template for k in range(0, 900, 3)} | {got[k].template for k in range(2, 900, 3)}
    assert len(rest) <= 3 and all(got[k].verdict == "allow" for k in range(0, 900, 3))
    assert all("name" not in t for t in rest)
    deep = {got[k].template for k in range(900, 940)}
    assert deep == {"/a/b/c/d/e/f/g/h/i/#/j"}
    placed, templates = U.path_templates(df, known)
    by = {(r.host, r.template): r for r in templates.collect()}
    assert sum(r.n_pages for r in by.values()) == len(pages) and placed.count() == len(pages)
    own = by["h.org", got[1].template]
    share = 0.5
    total_good = sum(g for _, g in labels) + 0  # the repeated row is unlabelled news or labelled as row 3
    assert own.n_labelled == 300 and own.n_good == 30 and own.purity < share < total_good
    assert U.judge_urls(df.limit(0), known).count() == 0


def plain_alike(a, ga, b, gb, enough, z):
    if a < enough or b < enough:
        return False
    p = (ga + gb) / (a + b)
    return abs(ga / a - gb / b) <= z * (max(p * (1 - p), 0) * (1 / a + 1 / b)) ** 0.5 + 1e-12


def plain_templates(paths, many=8, rare=0.05, enough=5, z=1.96):
    """Template of each (host, segments) with its pages, labelled and good ones, node by node."""
    out = {}

    def walk(host, node, below):
        """below: what is left of each path, the path, and its counts."""
        rests = [rest for rest, *_ in below]
        common = 0
        while all(len(r) > common for r in rests) and len({r[common] for r in rests}) == 1:
            common += 1
        node = "/".join([node, *rests[0][:common]])
        children = defaultdict(list)
        for rest, path, counts in below:
            if len(rest) == common:
                out[host, path] = node
            else:
                children[rest[common]].append((rest[common + 1 :], path, counts))
        size = {c: [sum(x[2][k] for x in own) for k in range(3)] for c, own in children.items()}
        total = [sum(s[k] for s in size.values()) for k in range(3)]
        few = {c for c, s in size.items() if len(size) >= many and s[0] < rare * total[0]}
        like = {c for c, s in size.items() if c not in few and plain_alike(s[1], s[2], total[1] - s[1], total[2] - s[2], enough, z)}
        pool = [sum(size[c][k] for c in few | like) for k in range(3)]
        merged = few | {c for c in like if plain_alike(size[c][1], size[c][2], pool[1] - size[c][1], pool[2] - size[c][2], enough, z)}
        named = defaultdict(list)
        for c, own in children.items():
            named["*" if c in merged else c] += own
        for name, own in named.items():
            walk(host, node + "/" + name, own)

    hosts = defaultdict(list)
    for (host, path), counts in paths.items():
        hosts[host].append((path, path, counts))
    for host, below in hosts.items():
        walk(host, "", below)
    return out


def test_templates_equal_a_plain_tree(spark):
    draw = random.Random(11)
    pages, labels = [], []
    for k in range(3000):
        host = draw.choice(["a.org", "b.org", "b.org", "b.org"])
        parts = [draw.choice(["x", "y", "en", "blog", f"n{draw.choice('abcdefghijklmnop')}", "*", str(draw.randrange(99))]) for _ in range(draw.randrange(0, 6))]
        pages.append((k, f"http://{host}/" + "/".join(parts) + draw.choice(["", "/"])))
        if draw.random() < (0.6 if "x" not in parts else 0.02):
            labels.append((k, float(draw.random() < (0.9 if "y" in parts else 0.4))))
    pages.append((5000, "http://a.org/" + "/".join(f"deep{chr(97 + k % 26)}" for k in range(2000))))
    pages.append((5001, None))
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good double")
    good, paths, of = dict(labels), defaultdict(lambda: [0, 0, 0]), {}
    for k, url in pages:
        host, path, _ = plain_rule(url)
        shaped = tuple("#" if re.fullmatch("[0-9a-fA-F-]{12,}", x) else "%2A" if x == "*" else re.sub("[0-9]+", "#", x) for x in path.split("/") if x)
        of[k] = host, shaped
        for j, x in enumerate((1, k in good, good.get(k, 0))):
            paths[host, shaped][j] += x
    want = plain_templates(paths)
    placed, templates = U.path_templates(df, known)
    assert {r.page_id: r.template for r in placed.collect()} == {k: want[x] for k, x in of.items()}
    assert any("*" in t for t in want.values()) and len(set(want.values())) > 30
    sums = defaultdict(lambda: [0, 0, 0])
    for x, counts in paths.items():
        for j in range(3):
            sums[x[0], want[x]][j] += counts[j]
    share = sum(good.values()) / len(good)
    for r in templates.collect():
        n, labelled, right = sums.pop((r.host, r.template))
        hosts = [c for (h, _), c in paths.items() if h == r.host]
        host_share = (sum(c[2] for c in hosts) + 10 * share) / (sum(c[1] for c in hosts) + 10)
        assert (r.n_pages, r.n_labelled) == (n, labelled) and abs(r.n_good - right) < 1e-9 and abs(r.purity - (right + 10 * host_share) / (labelled + 10)) < 1e-9
    assert not sums
