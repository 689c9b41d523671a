"""Ranked search, filter audit and URL filters against plain versions and SQL."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from flowscope.llm import lexical_search
from flowscope.llm.filter_audit import audit_filters
from flowscope.llm.lexical_search import rank_documents, terms
from flowscope.llm.queries import CHECKS, QUERIES
from flowscope.llm.url_filters import judge_urls, look_up
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op12_filter_interaction_audit", "op13_url_filters"])
def test_queries_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), CHECKS[name]) is None


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def plain_ranks(docs, items, limit=10):
    split = [(i, Counter(plain_terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n_docs, n_terms = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=repr)


def test_terms():
    for text in ["", "Ab-C\x00d1 ÀÉ é_x\x7fy`z{q}~", "İstanbul ſ K 1.5e3", "   ", "漢字👍🏽x"]:
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("block", [1024, 3])
def test_ranks_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, say(rnd.randrange(1, 60))) for i in range(150)]
    docs += [(i, docs[5][1]) for i in range(200, 260)] + [(7, docs[5][1]), (7, docs[5][1]), (None, docs[5][1]), (None, "w1 w2")]
    docs += [(300, None), (301, ""), (302, "- -"), (303, "w1 " * 30000), (-4, "W5 w5 é")]
    items = [(1, docs[5][1]), (2, say(12)), (3, "w1 W1 w1"), (4, None), (5, "!"), (None, say(4)), (2, "é"), (8, "unknown")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as item_id", "3 as rank", "4 as score")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id", "2 as item")
    got = sorted([tuple(r) for r in rank_documents(d.repartition(5), b).collect()], key=repr)
    assert got == plain_ranks(docs, items)
    assert rank_documents(d, b, limit=1).count() == 5
    assert rank_documents(d.limit(0), b).count() == 0 and rank_documents(d, b.limit(0)).count() == 0


def test_bounds_hold_and_save_work(monkeypatch):
    rnd = random.Random(1)
    docs = [(f"t{i % 7} " + " ".join(f"w{int(rnd.paretovariate(0.6))}" for _ in range(200))).encode() for i in range(400)]
    counts = [Counter(terms(t)) for t in docs]
    items = [Counter(terms(docs[i])[:30]) for i in range(0, 400, 20)]
    df = Counter(t for c in counts for t in c)
    corpus = lexical_search.Corpus(len(docs), sum(sum(c.values()) for c in counts), df)
    discounts = [corpus.discount(sum(c.values())) for c in counts]
    block = lexical_search.Block(items, corpus)
    bounds = block.bounds(lexical_search.max_sketches(counts, discounts, lexical_search.Places()))
    exact = [[block.score(q, c, m) for q in range(len(items))] for c, m in zip(counts, discounts, strict=True)]
    assert all(bounds[d, q] >= exact[d][q] for d in range(len(docs)) for q in range(len(items)))
    calls, score = [], block.score
    monkeypatch.setattr(block, "score", lambda *a: calls.append(1) or score(*a))
    best = [lexical_search.Best(10) for _ in items]
    lexical_search.rank_batch(block, list(range(len(docs))), counts, discounts, best, lexical_search.Places())
    assert len(calls) < 0.3 * len(docs) * len(items)
    for q, b in enumerate(best):
        assert sorted(b.heap, reverse=True) == sorted(((exact[d][q], -d) for d in range(len(docs))), reverse=True)[:10]


def plain_audit(docs, labels):
    good, toxic = ({row[0] for row in labels if row[0] is not None and row[k] == 1} for k in (1, 2))
    first = {}
    for i, text, _ in docs:
        key = text or ""
        old = first.get(key, (True, 0))
        first[key] = min(old, (i is None, i or 0)) if key in first else (i is None, i or 0)
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        rows = []
        for i, text, lang in docs:
            if (lang or "") != part:
                continue
            text = text or ""
            w = re.findall("[^\x20\x09-\x0d]+", text)
            rows.append((i, {
                "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search("[#$%&*|]", text)), "E": first[text] < (i is None, i or 0)}))
        made, shares = [], Counter()
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, x in enumerate(order, 1):
                here = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                made.append((part, "".join(order), step, len(left), len(here), sum(r[1][x] for r in gone),
                             sum(r[1][x] and sum(r[1].values()) == 1 for r in rows), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)))
                gone = gone + here
                shares[x] += len(here)
        out += [(*m, shares[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def test_audit_of_odd_rows(spark):
    rnd = random.Random(9)
    texts = ["", "word " * 120, "A B C " * 50, " ".join(f"w{i}" for i in range(130)), " ".join(f"W{i}" for i in range(110)) + " #", "a\u00a0b $",
             "x\x0by\x0cz " * 40, " ".join(f"é{i}" for i in range(9000))]
    docs = [(rnd.randrange(60), rnd.choice(texts), rnd.choice(["en", "de", "", None])) for _ in range(150)]
    docs += [(None, texts[1], "en"), (None, texts[1], "en"), (None, "only here", "de"), (None, "only here", "en"), (900, None, None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as n", "4 as id", "5 as quality")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as text", "2 as good", "3 as lang")
    got = sorted(tuple(r) for r in audit_filters(d.repartition(4), marks).collect())
    assert got == plain_audit(docs, labels)
    assert audit_filters(d.limit(0), marks).count() == 0
    none = audit_filters(d, marks.limit(0)).where("good_lost + toxic_lost > 0").count()
    assert none == 0 and audit_filters(d, marks).columns[:3] == ["part", "filter_order", "step"]


def test_rules_and_parts(spark):
    urls = {
        "https://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.example.com/en": ("b.example.com", "/en", "com/", "allow"),
        "x://example.com?/en/": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.net/es/": ("example.net", "/es/", "net/es/", "block"),
        "http://net/fr/a": ("net", "/fr/a", "net/fr/", "block"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "a http://b.com/c://d": ("b.com", "/c://d", "com/", "allow"),
        "no address": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http:///x": ("", "/x", None, "allow"), "HTTP://U@ÉX.org:80/\nb#": ("u@Éx.org:80", "/\nb", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://example.net/es/"), (3, "http://b.example.com/en")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as rule", "3 as n", "4 as domain", "5 as pages")
    empty = spark.createDataFrame([], "url string, bad boolean")
    got = judge_urls(pages, empty).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://example.net/es/" if r.page_id is None else rows[r.page_id][1]
        assert (r.host, r.path, r.rule, r.verdict) == urls[url]
    assert judge_urls(pages.limit(0), empty).count() == 0
    assert {r.rule for r in judge_urls(pages, empty, rules=()).collect()} == {None}


def test_reputation_shrinks_towards_domains_and_suffixes(spark):
    rnd = random.Random(4)
    pages, outcomes = [], []
    rate = {"spam.org": 0.95, "fine.org": 0.02, "mixed.org": 0.3, "co.uk": 0.1, "fine.co.uk": 0.05}
    for domain, bad in rate.items():
        for h in range(6):
            url = f"http://h{h}.{domain}:8080/"
            pages += [(len(pages), url + str(i)) for i in range(40)]
            outcomes += [(url, rnd.random() < bad) for _ in range(0 if h == 5 else 30)]
    outcomes += [("http://odd.fine.org/", True)] * 2 + [("http://odd.fine.org/", None), (None, True)]
    pages += [(len(pages), "http://odd.fine.org/1"), (len(pages) + 1, "http://10.0.0.1/"), (len(pages) + 2, "http://[::1]/")]
    p, o = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "url string, bad boolean")
    rows = {r.host: r for r in judge_urls(p, o, rules=(), suffixes=["co.uk"]).collect()}
    verdicts = {h: r.verdict for h, r in rows.items()}
    assert {h for h, v in verdicts.items() if v == "block"} == {f"h{i}.spam.org:8080" for i in range(6)}  # h5 by its domain alone
    assert verdicts["odd.fine.org"] == "allow" and 0.02 < rows["odd.fine.org"].bad_rate < 0.9  # two bad pages are no proof
    assert rows["h5.spam.org:8080"].bad_bound < rows["h0.spam.org:8080"].bad_bound


def test_look_up_with_a_hot_key(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "count as w", "length(k) as v")
    met = look_up(rows, table, "k", "w")
    assert met.count() == 6000 and met.where("v = length(k)").count() == 6000
