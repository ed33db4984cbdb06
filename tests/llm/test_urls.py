"""Hosts, rules and templates."""

import random
import re

import duckdb

from ledgerloom.llm import urls as u


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, k) for k, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme/net/", "http://NET/", "http://net", "https://a.Example.NET/en/5?x=1", "http://xnet/", "http://example.com/de/", "http://example.com/de",
    "http://a.b.example.com/de/x#y/de/", "http://example.com/de/?q", "http://x.org/fr/1", "http://org/fr/", "http://x.org?/fr/", "a://b://c/d", "http://É.Ä/ü/1", "http:///x", "://", "http://h/" + "a/" * 5000,
]


def pages():
    r = random.Random(2)
    more = [f"http://{r.choice(['a.org', 'b.example.com', 'c.dev', 'big.io'])}/{r.choice(['en', 'de', 'fr', r.choice('abcdefghijklmnopqrstuvwxyz') + 'x'])}/{r.choice(['item', 'p' + str(r.randint(1, 99))])}/{r.randint(1, 999)}.html" for _ in range(600)]
    return [(url, i, "html") for i, url in enumerate(URLS + more)]


def test_hosts_paths_rules_and_sql(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, "url string, page_id long, host string")
    got = u.judged(frame).collect()
    assert len(got) == len(rows)
    for x in got:
        host, path, rule, kind = plain(rows[x.page_id][0])
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict == (kind or x.verdict)
    with duckdb.connect() as con:
        con.register("pages", frame.toPandas())
        assert sorted(map(str, con.execute(u.OP2_SQL).fetchall())) == sorted(str(tuple(x)) for x in got)


def test_labels_reject_templates_and_merge_branches(spark):
    rows, labels = [], []
    for branch, bad in (("spam", 1), ("scam", 1), ("news", 0)):
        for i in range(40):
            rows.append((len(rows), f"http://shop.dev/{branch}/item/{i}.html"))
            if i < 12:
                labels.append((rows[-1][0], bad))
    for i in range(60):  # a fan of names under one node is one template
        rows.append((len(rows), f"http://wide.dev/{''.join(chr(97 + int(d)) for d in str(i * 7919))}x/buy"))
        if i < 20:
            labels.append((rows[-1][0], 1))
    out = u.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    verdict = {x.page_id: x.verdict for x in out}
    assert all(verdict[i] == ("block" if "spam" in url or "scam" in url or "wide" in url else "allow") for i, url in rows if i not in {p for p, _ in labels})


def test_empty_table_and_repeats(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x")] * 3, "page_id long, url string")
    assert [x.verdict for x in u.judged(frame).collect()] == ["block"] * 3
    assert u.judged(frame.limit(0)).count() == 0


def test_a_template_without_labels_is_judged_by_its_like(spark):
    rows, labels = [], []
    for host, path, bad in [(f"h{i}.dev", "spam/item", 1) for i in range(8)] + [(f"h{i}.dev", "news/item", 0) for i in range(8, 16)] + [("free.dev", "spam/item", None), ("good.dev", "spam/item", None), ("lone.dev", "odd/item", None)]:
        for k in range(3):
            rows.append((len(rows), f"http://{host}/{path}/{k}.html"))
            if bad is not None:
                labels.append((rows[-1][0], bad))
    for k in range(12):  # this host's own labels speak for it
        rows.append((len(rows), f"http://good.dev/about/{k}"))
        labels.append((rows[-1][0], 0))
    out = {x.page_id: x.verdict for x in u.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    verdicts = lambda host: {out[i] for i, url in rows if f"//{host}/" in url}
    assert verdicts("free.dev") == {"block"} and verdicts("good.dev") == {"allow"} and verdicts("lone.dev") == {"allow"} and verdicts("h9.dev") == {"allow"}


def plain_verdicts(rows, labels, depth=6, fan=12, merge_from=5, prior=4.0, support=5, purity=0.8):
    """The tree by plain loops: (verdict of each id, templates that merging made one)."""
    leaves = {}
    for i, url in rows:
        host, path, _, kind = plain(url)
        rest = re.sub("[0-9]+", "#", re.sub("^/", "", re.sub("/+", "/", path)))
        parts = (rest.split("/", depth - 1) + [""] * depth)[:depth]
        leaves[i] = (host, parts, {"block": 1, "allow": 0}.get(kind, labels.get(i)), kind)
    names = {i: () for i in leaves}
    for level in range(depth):
        kids = {}
        for i, (host, parts, _, _) in leaves.items():
            one = kids.setdefault((host, names[i]), {})
            one[parts[level]] = one.get(parts[level], 0) + 1
        light = {k: {s for s, n in one.items() if n * fan <= sum(one.values())} for k, one in kids.items()}
        wild = lambda i: len(few := light[leaves[i][0], names[i]]) >= fan and leaves[i][1][level] in few
        names = {i: (*names[i], "*" if wild(i) else leaves[i][1][level]) for i in leaves}
    counts = {}
    for i, (host, _, bad, _) in leaves.items():
        c = counts.setdefault((host, names[i]), [0, 0])
        c[0] += bad is not None
        c[1] += bad or 0
    branch = {k: k[1][-1:] for k in counts}
    for level in range(depth - 1, 0, -1):
        nodes = {}
        for (host, t), (known, bad) in counts.items():
            n = nodes.setdefault((host, t[:level]), [set(), 0, 0])
            n[0].add(branch[host, t])
            n[1] += known
            n[2] += bad
        pool = {}
        for (host, t), (below, known, bad) in nodes.items():
            if known >= merge_from:
                p = pool.setdefault((host, t[:-1], frozenset(below)), [0, 0])
                p[0] += known
                p[1] += bad
        def called(host, t):
            below, known, bad = nodes[host, t]
            pk, pb = pool.get((host, t[:-1], frozenset(below)), (0, 0))
            return frozenset(below) if known >= merge_from and (bad * pk - pb * known) ** 2 <= 4 * known * pb * (pk - pb) else t[-1]
        branch = {(host, t): (called(host, t[:level]), *branch[host, t]) for host, t in counts}
    total = [sum(c[j] for c in counts.values()) for j in (0, 1)]
    refused = set()
    for host, b in {(h, branch[h, t]) for h, t in counts}:
        own = [(t, c) for (h, t), c in counts.items() if h == host and branch[h, t] == b]
        hosts = [sum(c[j] for (h, _), c in counts.items() if h == host) for j in (0, 1)]
        known, bad = (sum(c[j] for _, c in own) for j in (0, 1))
        like = [sum(c[j] for t, _ in own for (h, x), c in counts.items() if x == t and h != host and t[0] != "*") for j in (0, 1)]
        share = (like[1] + prior * (total[1] + 1) / (total[0] + 2)) / (like[0] + prior)
        share = (bad + prior * (hosts[1] + prior * share) / (hosts[0] + prior)) / (known + prior)
        if known + like[0] >= support and share >= purity:
            refused |= {(host, t) for t, _ in own}
    verdicts = {i: leaves[i][3] or ("block" if (leaves[i][0], names[i]) in refused else "allow") for i in leaves}
    return verdicts, len(counts) - len({(h, branch[h, t]) for h, t in counts})


def test_verdicts_by_plain_loops(spark):
    r = random.Random(5)
    rows, labels = [], {}
    for i in range(4000):
        kind = r.choice(["spam", "scam", "news", "blog", "shop"])
        tail = r.choice([f"item/{r.randint(1, 99)}", "".join(r.choice("abcdefgh") for _ in range(5)), "x/y/z/" + r.choice("pq") + "/deep/er"])
        host = r.choice(["a.dev", "b.dev", "c.example.com", "d.net", "www.e.org"])
        rows.append((i, f"http://{host}/{r.choice(['', 'a/b/'])}{r.choice(['', '/'])}{kind}/{tail}"))
        if r.random() < 0.4:
            labels[i] = int((kind in ("spam", "scam")) != (r.random() < 0.03))
    want, merged = plain_verdicts(rows, labels)
    got = u.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, bad int")).collect()
    assert {x.page_id: x.verdict for x in got} == want
    free = [i for i, url in rows if plain(url)[3] is None]
    assert merged > 0 and {"block", "allow"} == {want[i] for i in free}
    deep = {k: {want[i] for i in free if f"/a/b/{k}/item" in rows[i][1] or f"/a/b//{k}/item" in rows[i][1]} for k in ("spam", "news")}
    assert deep == {"spam": {"block"}, "news": {"allow"}}


def test_repeated_urls_leave_the_verdicts(spark):
    rows = [(f"http://wide.dev/{''.join(chr(97 + int(d)) for d in str(i * 7919))}x/buy", i < 20) for i in range(60)]
    rows = [(3 * i + k, url, bad) for i, (url, bad) in enumerate(rows) for k in range(3)]
    out = u.judged(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), spark.createDataFrame([(i, 1) for i, _, bad in rows if bad], "page_id long, bad int")).collect()
    assert {x.verdict for x in out} == {"block"}


def test_a_page_labelled_twice_is_one_page(spark):
    pages = spark.createDataFrame([(i, f"http://h.dev/{'bad' if i % 2 else 'good'}/{i}") for i in range(24)], "page_id long, url string")
    labels = [(i, i % 2) for i in range(24)] + [(i, 0) for i in range(24)] + [(i, 0) for i in range(24)]
    out = u.judged(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert len(out) == 24 and {(x.page_id % 2, x.verdict) for x in out} == {(0, "allow"), (1, "block")}
