"""Redirect equivalence, the source audit and hard negatives against brute-force versions, and on empty tables."""

import random
import re
from collections import Counter, defaultdict
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siltstone.llm import hard_negatives, oracle, source_audit, url_filters

# ---- redirect equivalence

LINK, META = '<link rel="{}" href="{}">', "<meta http-equiv=Refresh content='0; URL={}'>"
PAGES = [
    (1, "https://a.example.org/x", LINK.format("canonical", "https://Blocked.NET/p#f")),  # to a url that is no page
    (2, "http://b.example.org/d/e?x=1", META.format("../x2")),
    (3, "http://b.example.org/x2", LINK.format("alternate CANONICAL", "https://a.example.org/x") + LINK.format("canonical", "//a.example.org/x?")),
    (4, "http://b.example.org/x2#part", "<p>canonical</p>"),
    (5, "https://c.example.org/", "<!-- " + LINK.format("canonical", "https://blocked.net/") + " --><script>var t='" + LINK.format("canonical", "https://blocked.net/") + "'</script>"),
    (6, "https://q.example.org", LINK.format("nofollow", "https://blocked.net/") + LINK.format("canonical", "#top") + LINK.format("canonical", "mailto:x@blocked.net")),
    (7, "https://w.example.org/fr/1", LINK.format("canonical", "https://evil.net/1")),  # allowed explicitly: so are its aliases
    (8, "https://friend.example.com/", LINK.format("canonical", "https://w.example.org/fr/1")),
    (9, "https://evil.net/1", None),
    (10, "https://x.example.net/en/1", ""),
    (11, "https://x.example.net/fr/1", ""),
    (12, "https://example.com/de/", "canonical"),
    (13, "https://notexample.com/de/", LINK.format("canonical", "./a/./b/../../q?u=../z")),
    (14, "https://notexample.com/de/q?u=../z", LINK.format("canonical", "https://example.com/de/?a&amp;b")),
    (15, None, LINK.format("canonical", "https://blocked.net/")),
    (16, "no scheme", LINK.format("canonical", "https://blocked.net/")),
    (17, "", None),
    (None, "HTTPS://A.EXAMPLE.ORG/x", None),
    (18, "http://x.net", "x" * 300_000 + LINK.format("canonical", "/y")),
    (19, "http://self.example.org/s", LINK.format("canonical", "http://self.example.org/s#a")),
    (1, "https://a.example.org/x", LINK.format("canonical", "https://Blocked.NET/p#f")),
    *((100 + i, f"https://hub{i}.example.org/{i}", LINK.format("canonical", "https://hub.example.org/")) for i in range(60)),
    (200, "https://hub.example.org/", META.format("https://blocked.net/hub")),
]


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(u):
    host, path = split_url(u)
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), r.action == "allow", r.text), default=None)


def vertex(u):
    if u is None or "://" not in u:
        return None
    tail = re.match(r"[^/?#]*([^#]*)", u.split("://", 1)[1]).group(1)
    return f"{u.split('://')[0].lower()}://{split_url(u)[0]}{'' if tail.startswith('/') else '/'}{tail}"


def expected_pages(pages, redirects=()):
    near = defaultdict(set)

    def link(a, b):
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)

    for _, u, html in pages:
        if vertex(u) is None:
            continue
        seen = re.sub(r"(?is)<!--.*?-->|<script.*?</script>", " ", html or "")
        refs = [m[2] for m in re.finditer(r'<link rel="([^"]*)" href="([^"]*)">', seen) if "canonical" in m[1].lower().split()]
        refs += re.findall(r"<meta http-equiv=Refresh content='0; URL=([^']*)'>", seen)
        for r in refs:
            link(vertex(u), vertex(urljoin(u, r.replace("&amp;", "&"))))
    for a, b in redirects:
        link(vertex(a), vertex(b))
    out = Counter()
    for i, u, _ in pages:
        host, path = split_url(u)
        rule, verdict = rule_of(u), "allow"
        if rule is None and vertex(u) in near:
            reached, todo = set(), [vertex(u)]
            while todo:
                x = todo.pop()
                if x not in reached:
                    reached.add(x)
                    todo += near[x]
            actions = {r.action for r in map(rule_of, reached) if r}
            verdict = "block" if actions == {"block"} else "allow"
        out[(i, host, path, rule.text if rule else None, rule.action if rule else verdict)] += 1
    return out


SCHEMA = "page_id long, url string, html string"


def judged(df):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


def test_redirect_equivalence(spark):
    pages = spark.createDataFrame([(*r, "k", 1) for r in PAGES], SCHEMA + ", key string, r long").repartition(3)
    want = expected_pages(PAGES)
    assert judged(url_filters.judge_urls(pages)) == want
    assert {k[0]: k[4] for k in want} | {8: "allow", 9: "block", 100: "block", 2: "block", 13: "block"} == {k[0]: k[4] for k in want}
    more = [("https://c.example.org/", "http://blocked.net/r"), (None, "http://blocked.net/"), ("https://c.example.org/", None)]
    recorded = spark.createDataFrame(more, "from_url string, to_url string")
    assert judged(url_filters.judge_urls(pages, redirects=recorded)) == expected_pages(PAGES, more)


def test_redirect_equivalence_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in PAGES])
    r = con.sql(oracle.op11())
    at = [r.columns.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    assert Counter(tuple(row[i] for i in at) for row in r.fetchall()) == expected_pages(PAGES)


@pytest.mark.parametrize("base,reference", [("http://h.org/a/b?c", x) for x in ("../x", "..", ".", "./", "x/..", "?q", "/r/../s", "x?a=/../b", "//k.org/z", "ftp://k.org/", "x#y", "../../../up")] + [("http://h.org", "x"), ("HTTP://H.org", "../y")])
def test_references_resolve_as_browsers_do(spark, base, reference):
    got = spark.range(1).select(url_filters.resource(url_filters.resolved(F.lit(reference), F.lit(base))).alias("u")).head().u
    assert got == vertex(urljoin(base.replace("HTTP", "http"), reference))


def test_pages_of_none(spark):
    assert url_filters.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- source audit


def expected_audit(rows, p):
    terms = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in rows]
    documents, n, groups = Counter(), Counter(), {(lang, source) for lang, source, _ in terms}
    for lang, source, w in terms:
        documents.update((lang, t) for t in set(w))
        n.update((lang, source, t) for t in w)
    out = Counter()
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), k in documents.items() if x == lang and k >= p.min_documents]
        sources = [s for x, s in groups if x == lang]
        counts = {s: {t: n[(lang, s, t)] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + p.scale * (c + p.prior) // (sum(counts[s].values()) + p.prior * len(kept)) for t, c in counts[s].items()} for s in counts}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, share[s][t] - share[None][t]) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", more, p.top_terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[(lang, s, part, item, value, rank)] += 1
    return out


@pytest.mark.parametrize("entries,least,top", [(200_000, 4, 50), (7, 2, 3)])
def test_source_audit(docs, rows, entries, least, top):
    p = source_audit.Audit(min_documents=least, table_entries=entries, top_terms=top)
    got = source_audit.audit_sources(docs, p)
    assert Counter(tuple(r) for r in got.collect()) == expected_audit([(t, lang, s) for _, t, lang, s in rows], p)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_joint_histograms_count_every_term_once(spark):
    rng = random.Random(5)
    data = [("l", s, f"t{i}", n, 0) for i in range(40) for s in "abcd" if (n := rng.choice([0, 0, 1, 2, 5]))]
    kept = spark.createDataFrame(data, "lang string, source string, term string, n long, lang_n long")
    groups = spark.createDataFrame([("l", s, 40) for s in "abcde"], "lang string, source string, n_terms long")
    n = {(s, t): c for _, s, t, c, _ in data}
    want = Counter((a, b, n.get((a, f"t{i}"), 0), n.get((b, f"t{i}"), 0)) for a in "abcde" for b in "abcde" if a < b for i in range(40))
    assert {(r.a, r.b, r.x, r.y): r.terms for r in source_audit.joint_histograms(kept, groups).collect()} == want


def test_terms_of_long_texts(monkeypatch):
    text = ("Ab-cD é日本x \x00" + "q" * 50 + "5") * 20
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(source_audit, "PIECE", piece)
        assert [t.decode() for x in source_audit.terms_of(text.encode()) for t in x] == want


def test_audit_of_nothing(empty):
    assert source_audit.audit_sources(empty).count() == 0


# ---- hard negatives


def expected_negatives(rows, p):
    whole = [(r, i, label, [int(x * p.scale // 1) for x in v]) for r, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and abs(x) < float("inf") for x in v)]
    out = Counter()
    for r, i, label, q in whole:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, l) for s, j, l, v in whole if s != r and len(v) == len(q))
        for score, positive, _ in [x for x in scored if x[2] == label][: p.positives]:
            within = [x for x in scored if x[2] != label and -p.low_percent * score <= -100 * x[0] <= -100 * score]
            for rank, (s, j, _) in enumerate(within[: p.negatives], 1):
                out[(i, positive, rank, j, -score, -s)] += 1
    return out


def vectors(rng, n, size=4.0):
    out = []
    for i in range(n):
        centre = [1.0 if j == i % 5 else 0.1 for j in range(6)]
        v = [size * (c + rng.gauss(0, 0.15)) for c in centre]
        out.append((i, v if i % 9 else [float(round(x)) for x in v][: 6 - i % 2], rng.randrange(3)))
    out += [(i, [size, 0.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(n, n + 60)]  # equal vectors
    out += [(10, [size] * 6, 1), (10, [size] * 6, 1), (20, [size] * 6, 2), (n + 100, None, 1), (n + 110, [None] * 6, 1), (n + 120, [float("nan")] * 6, 1), (n + 130, [float("inf")] * 6, 0), (n + 140, [], 0), (n + 150, [1.0] * 6, None), (None, [1.0] * 6, 1), (n + 160, [-1.0] * 6, 1), (n + 170, [1.0, 2.0], 1)]
    return out


@pytest.mark.parametrize("list_rows,steps,block,size", [(2048, (4, 64), 256, 4.0), (16, (1, 3), 5, 4.0), (16, (2,), 256, 1e12), (8, (1, 2, 4), 3, 0.01)])
def test_hard_negatives(spark, list_rows, steps, block, size):
    rows = vectors(random.Random(list_rows), 300, size)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, list int").repartition(3)
    p = hard_negatives.Mining(list_rows=list_rows, steps=steps, query_block=block, iterations=3)
    got = hard_negatives.mine_negatives(table, F.col("vec_id") % 10 == 0, p=p)
    fit = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    want = Counter()
    for k, n in expected_negatives(rows, p).items():
        want[(*k[:4], fit(k[4]), fit(k[5]))] += n
    assert Counter(tuple(r) for r in got.collect()) == want and want


def test_bounds_skip_lists(spark):
    rng = random.Random(9)
    rows = [(i, [9.0 * (j == i % 8) + rng.gauss(0, 0.05) for j in range(8)], i % 2) for i in range(800)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scratch = hard_negatives.Scratch(spark, "test")
    p = hard_negatives.Mining(list_rows=50)
    vs = scratch.write(hard_negatives.labelled_vectors(table, F.col("vec_id") < 8, F.col("label"), "vec_id", "embedding", p), "rows")
    index = hard_negatives.Index(vs, scratch, p)
    number = lambda x: F.lit(str(x)).cast(hard_negatives.SCORE)
    asked = vs.filter("is_anchor").withColumns({"lows": F.array(number(1_000_000)), "highs": F.array(number(hard_negatives.MOST))})
    whole = asked.withColumn("lows", F.array(number(-hard_negatives.MOST)))
    assert index.most_lists > 8 and index.visits(asked, 0, None).count() * 4 < index.visits(whole, 0, None).count()


def test_negatives_of_none(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_negatives(table, F.col("vec_id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(10, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_negatives(lone, F.col("vec_id") % 10 == 0).count() == 0
