import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm import jaccard_join
from flowscope.llm.jaccard_join import jaccard_components, join_region
from flowscope.llm.queries import QUERIES
from tests.llm.brute import jaccard_components as plain


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, groups, size, edits):
    rnd, docs = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(60)]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randrange(edits)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
            docs.append(" ".join(words))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("region_sets,repeated", [(256, 3.0), (6, 3.0), (6, 99.0), (6, 0.0)])
def test_components_in_every_way_of_splitting_regions(spark, monkeypatch, region_sets, repeated):
    monkeypatch.setattr(jaccard_join, "REGION_SETS", region_sets)
    monkeypatch.setattr(jaccard_join, "REPEATED", repeated)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    docs = near_copies(1, 2, 30, 6)
    got = result(jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == plain(docs)
    assert len({c for _, c in got.values()}) > 2


def test_odd_rows(spark):
    docs = [
        (5, "a b c d e f g"), (3, "A B C D E F G"), (9, "a b"), (8, "A\tb"), (7, ""), (6, None), (2, "  \n "), (1, "é É"),
        (None, "a b c d e f g"), (4, "a b\xa0c d e f g"), (3, "A B C D E F G"), (10, "b a"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as id", "text as digest")
    rows = jaccard_components(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[None] == (3, None)
    expected = plain([d for d in docs if d[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == expected


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=9))
def test_region_join_connects_all_links(sets):
    import numpy as np

    sets = sorted({frozenset(s) for s in sets}, key=sorted)
    ids = list(range(len(sets)))
    links = join_region(ids, [len(s) for s in sets], [np.array(sorted(s)) for s in sets], [None] * len(ids), 75)
    from tests.llm.brute import smallest_reachable

    wanted = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert smallest_reachable(ids, links) == smallest_reachable(ids, wanted)


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, ""), (8, None), (2, ""), (1, b + " x"), (None, c)]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (7, 1), (8, 8), (9, 8), (2, 2), (None, None)}


def test_long_words_with_equal_polynomials_differ(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(docs)
