"""Operators 11 to 13 against plain versions, on given and on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import divergence, queries, url_templates, vantage

# -- url filters

URLS = [
    (1, "https://WWW.Example.com/en/12?x=1", "www.example.com", "/en/12", "www.example.com/en/", "allow"),
    (2, "http://m.example.com/en/12", "m.example.com", "/en/12", "example.com/en/", "block"),
    (3, "http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (4, "http://badexample.com/en/1", "badexample.com", "/en/1", "com/", "allow"),
    (5, "http://example.com/english", "example.com", "/english", "com/", "allow"),
    (6, "http://example.com", "example.com", "", None, None),
    (7, "http://example.com#/en/", "example.com", "", None, None),
    (8, "http://x.net/es/?q=/en/", "x.net", "/es/", "net/es/", "block"),
    (9, "http://x.net/ES/", "x.net", "/ES/", None, None),
    (10, "net://net/fr/a://b", "net", "/fr/a://b", "net/fr/", "block"),
    (11, "no scheme /en/", "", "", None, None),
    (12, "", "", "", None, None),
    (13, None, "", "", None, None),
    (None, "http://É.net/de/" + "a/" * 3000, "É.net", "/de/" + "a/" * 3000, None, None),
    (14, "http://x.com:80/en/", "x.com:80", "/en/", None, None),
    (14, "http://x.com:80/en/", "x.com:80", "/en/", None, None),
]


def test_rules_and_parts(spark):
    """Hosts, paths and the longest rule; nulls, repeats and columns named like the operator's own."""
    own = ["k", "host", "path", "shape", "rule", "place", "judged", "row", "node", "purity", "good", "labelled", "pages", "segment", "verdict", "template", "_x"]
    pages = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string").select("*", *(F.lit(j).alias(c) for j, c in enumerate(own)))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = url_templates.filter_urls(pages, labels, queries.URL_RULES)
    assert got.columns[: len(pages.columns)] == pages.columns
    want = Counter((i, u, h, p, r, v) for i, u, h, p, r, v in URLS)
    rows = got.collect()
    assert all(r[c] == j for r in rows for j, c in enumerate(own))
    assert Counter((r["page_id"], r["url"], r["_host"], r["_path"], r["_rule"], r["_verdict"] if r["_rule"] else None) for r in rows) == want
    assert {r["_verdict"] for r in rows} <= {"allow", "block"} and all(0 < r["_purity"] < 1 for r in rows)
    assert url_templates.filter_urls(pages.limit(0), labels, queries.URL_RULES).count() == 0
    assert url_templates.filter_urls(pages, labels.limit(0), {}).count() == len(URLS)


def plain_templates(paths):
    """host -> shape -> (template, purity), one node after the other."""
    out, g, n = {}, sum(p[3] for p in paths), sum(p[4] for p in paths)
    root, smooth = (g + 1.0) / (n + 2.0), lambda good, of, prior: (float(good) + url_templates.PRIOR * prior) / (float(of) + url_templates.PRIOR)

    def grow(node, purity, own, level):
        by = defaultdict(list)
        for p in own:
            if len(p[1]) == level or level == url_templates.DEPTH:
                out[p[0], p[1]] = (node, purity)
            else:
                by[p[1][level] + ("" if len(p[1]) == level + 1 else "/")].append(p)
        pages, joined = sum(p[2] for v in by.values() for p in v), defaultdict(list)
        for seg, v in by.items():
            n = sum(p[2] for p in v)
            joined[seg if n >= url_templates.LEAST_PAGES and n >= url_templates.LEAST_SHARE * pages else "*"] += v
        found = sorted((smooth(sum(p[3] for p in v), sum(p[4] for p in v), purity), s, sum(p[4] for p in v) + url_templates.PRIOR) for s, v in joined.items())
        groups = []
        for i, (p, s, m) in enumerate(found):
            if i:
                p0, _, m0 = found[i - 1]
                b = (p * m + p0 * m0) / (m + m0)
            if i and not (p - p0) * (p - p0) > url_templates.DIFFERENT * (b * (1.0 - b)) * (1.0 / m + 1.0 / m0):
                groups[-1].append(s)
            else:
                groups.append([s])
        for names in groups:
            v = [p for s in names for p in joined[s]]
            grow(node + "/" + ("{" + "|".join(sorted(names)) + "}" if len(names) > 1 else names[0]), smooth(sum(p[3] for p in v), sum(p[4] for p in v), purity), v, level + 1)

    for host in {p[0] for p in paths}:
        own = [p for p in paths if p[0] == host]
        grow(host, smooth(sum(p[3] for p in own), sum(p[4] for p in own), root), own, 0)
    return out


def test_tree_against_plain_version(spark):
    """Branches that labels tell apart stay apart, alike ones merge, rare segments become wildcards."""
    rng = np.random.default_rng(3)
    rows = []
    for host in ("a.org", "b.org", "c.org"):
        for i in range(400):
            top = ["good", "fine", "bad", f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}"][min(3, int(rng.integers(0, 5)))]
            depth = int(rng.integers(0, 9))
            path = [top, *(rng.choice(["x", "y", "<num>"]) for _ in range(depth))][: depth + (host != "c.org")]
            good = rng.random() < (0.1 if top == "bad" else 0.9)
            known = rng.random() < 0.6
            rows.append((host, tuple(map(str, path))[: url_templates.DEPTH], int(good and known), int(known)))
    count = defaultdict(lambda: [0, 0, 0])
    for host, shape, good, known in rows:
        c = count[host, shape]
        c[0], c[1], c[2] = c[0] + 1, c[1] + good, c[2] + known
    paths = [(h, s, *c) for (h, s), c in count.items()]
    got = url_templates.templates(spark.createDataFrame([(h, list(s), *map(int, c)) for h, s, *c in paths], "host string, shape array<string>, pages long, good long, labelled long"))
    found = {(r["host"], tuple(r["shape"])): (r["template"], r["purity"]) for r in got.collect()}
    want = plain_templates(paths)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(found[k][1], want[k][1], abs_tol=1e-12) for k in want)
    names = {t for t, _ in want.values()}
    assert any("bad" in t and "good" not in t for t in names) and any("fine" in t and "good" in t for t in names) and not any("rare" in t for t in names)
    assert min(p for t, p in want.values() if "bad" in t) < url_templates.PURE < max(p for t, p in want.values() if "good" in t)


def test_impure_template_is_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)], "doc_id long, quality int")
    got = {r["page_id"]: r["_verdict"] for r in url_templates.filter_urls(pages, labels, {}).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(200))


# -- source divergence


def plain_audit(rows, least, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", word.findall((text or "").translate(low))
        groups.add((lang, source))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept, own = [t for t, n in held[lang].items() if n >= least], sorted(s for x, s in groups if x == lang)

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + (10**9 * (of[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in own), Counter()))
        by = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pair = [(sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in own if o != s]
            term = [(by[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and by[s][t] > whole[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return Counter(out)


AWKWARD = [
    (1, "The THE the_cat É é ß", "en", "a"), (1, "The THE the_cat É é ß", "en", "a"), (2, None, "en", "b"), (3, "", "en", None), (None, "the cat sat", None, "a"), (4, "the cat sat", None, "b"), (5, "dog " * 20000 + "the", "en", "c"), (6, "1234 !?", "de", "a"),
    (7, "the \U0001d49c x", "en", "d"), (8, "\x00the\x7fcat", "en", "d"), (9, "sat the", "en", "zé"), (10, "a", "fr", "x"), (11, "b", "fr", "y"),
]


@pytest.mark.parametrize(("least", "block"), [(1, 256), (2, 256), (2, 1), (99, 256)])
def test_divergence(spark, monkeypatch, least, block):
    """Exact shares, with one list of postings a term and with many."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(["term", "n", "docs", "p", "q", "b", "v", "total", "part", "item", "value", "rank", "w", "t"])))
    got = divergence.audit(docs, least_docs=least, top=3)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(AWKWARD, least, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_of_many_sources(spark):
    """Sources of very unlike sizes: baselines lie between the shares of others' terms."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{chr(97 + int(k))}" for k in rng.zipf(1.5, int(rng.integers(1, 400))) % 26), "en", f"s{int(rng.zipf(1.6)) % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = divergence.audit(docs, least_docs=3)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, 3, 50)


# -- hard negatives


def plain_negatives(rows, anchors, positives=5, k=10, low=30, high=90):
    """rows (id, label, vector); every pair is scored."""
    kept = [(i, lab, np.floor(256 * np.asarray(v, float)).astype(int)) for i, lab, v in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, _, v in kept), default=0)
    kept = [(i, lab, np.pad(v, (0, width - len(v)))) for i, lab, v in kept]
    named = lambda i: (i is None, i or 0)
    out = []
    for n, (a, lab, q) in enumerate(kept):
        if not anchors(a):
            continue
        scored = sorted(((-int(q @ v), named(i), i, other) for m, (i, other, v) in enumerate(kept) if m != n), key=lambda x: x[:2])
        for s, _, p, other in [x for x in scored if x[3] == lab][:positives]:
            inside = [(i, -t) for t, _, i, x in scored if x != lab and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(inside)]
    return Counter(out)


def mined(spark, rows, part=vantage.PART, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").select("*", *(F.lit(i).alias(c) for i, c in enumerate(["row", "id", "v", "q", "low", "high", "score", "rank", "leaf", "part", "anchor", "whole"])))
    got = vantage.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), part=part)
    return Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize(("part", "near", "leaf"), [(1024, 2, 32), (32, 1, 4), (7, 3, 1)])
def test_negatives(spark, monkeypatch, part, near, leaf):
    """Clusters, equal vectors, a hot one, ties of scores: the same rows whatever the tree."""
    monkeypatch.setattr(vantage, "NEAR", near)
    monkeypatch.setattr(vantage, "LEAF", leaf)
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in (middles[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, int(i % 3), [0.5] * 8) for i in range(120)] + [(500 + i, 1, [float(i % 2), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    assert mined(spark, rows, part) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_awkward(spark):
    """Nulls and components that aren't finite take no part; repeats, null ids, empty, short and zero vectors do."""
    rows = [(10, 1, [1.0, 2.0, 0.5]), (10, 1, [1.0, 2.0, 0.5]), (11, 1, [1.0, 1.0]), (12, 2, [0.5, 0.9, 0.1]), (13, 2, []), (14, 2, None), (15, None, [1.0, 1.0, 1.0]), (16, 2, [1.0, None, 1.0]), (17, 2, [math.nan, 1.0, 1.0]), (18, 2, [math.inf, 1.0, 1.0]),
            (None, 2, [0.5, 0.9, 0.1]), (None, 1, [0.9, 1.0, 0.1]), (20, 3, [0.0, 0.0, 0.0]), (30, 3, [0.0, 0.0, 0.0]), (21, 3, [-1.0, -1.0, -1.0]), (40, 3, [-1.0, 0.2, 0.1])]
    want = plain_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert want and mined(spark, rows) == want and mined(spark, rows, 2, "double") == want
    assert not mined(spark, []) and not mined(spark, [(10, None, None)])
    with pytest.raises(ValueError, match="2\\*\\*51"):
        mined(spark, [(10, 1, [1e9, 1e9])], kind="double")


def test_search_skips_leaves(spark, monkeypatch):
    """A window at the far side of one cluster leaves the others' leaves unopened."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.vstack([rng.normal(size=(500, 6)) * 0.05 + c for c in (np.eye(6)[0] * 4, np.eye(6)[1] * 4)]))
    square, seen = float((x * x).sum(axis=1).max()), []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **a: (seen.append(keys[0].shape[1] - 5), real(keys, **a))[1])
    ids, labels = np.arange(len(x)), np.zeros(len(x), int)
    at, rows, score = vantage.search_part(x, ids, ids, labels, square, x[:1], ids[:1], labels[:1], np.array([-1e15]), np.array([1e15]), True, 5)
    s = x @ x[0]
    want = sorted(range(1, len(x)), key=lambda i: (-s[i], i))[:5]
    assert rows.tolist() == want and score.tolist() == [s[i] for i in want] and sum(seen) < len(x) / 2


def test_sample_sends_no_more_than_it_needs(spark):
    rows = spark.range(0, 100_000, 1, 40).select(F.col("id").alias("row"), F.array("id").alias("v"))
    got = vantage._sample(rows, 100_000, 1000)
    assert 800 < got.count() < 1200 and "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert vantage._sample(rows.limit(50), 50, 1000).count() == 50


def test_nothing_large_is_broadcast(spark, monkeypatch):
    """Equal vectors take next to nothing in files, but a broadcast holds them as rows on the driver."""
    met, plans = vantage._found, []

    def seen(*args):
        plans.append(met(*args))
        return plans[-1]

    monkeypatch.setattr(vantage, "_found", seen)
    rows = [(i, i % 3, [0.5 + (i % 2) * 0.25, 0.5]) for i in range(300)]
    got = mined(spark, rows, part=64)
    plain = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    plans.append(vantage.hard_negatives(plain, F.col("vec_id") % 10 == 0, F.col("label"), part=64))
    assert got and len(plans) == 9
    for df in plans:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
