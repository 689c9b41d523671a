import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm.line_crf import NAMES, Chain, held_out, line_features, train, with_quality
from flowscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    mine = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(mine) > 50 and sum(p == q for p, q in mine) >= 0.95 * len(mine)
    bad = [p for p, q in mine if q == 0]
    assert bad and sum(p == 0 for p in bad) >= 0.9 * len(bad)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=5), st.integers(0, 10**6))
def test_forward_backward_by_enumeration(sizes, seed):
    rnd = np.random.default_rng(seed)
    first = np.concatenate(([0], np.cumsum(sizes)))
    score, links = rnd.normal(size=first[-1]) * 3, rnd.normal(size=(2, 2)) * 2
    good, expected, log_sum = Chain(first).run(score, links)
    want, pairs, total = np.zeros(first[-1]), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(s for s, v in zip(score[a:b], y) if v) + sum(links[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for u, v in zip(y, y[1:]):
                pairs[u, v] += w / z
    assert np.allclose(good, want) and np.allclose(expected, pairs) and np.isclose(log_sum, total)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n!|3$. "), max_size=30), min_size=1, max_size=5))
def test_line_features_by_counting(texts):
    encoded = [t.encode() for t in texts]
    border = np.concatenate(([0], np.cumsum([len(e) for e in encoded])))
    lines = line_features(np.frombuffer(b"".join(encoded), np.uint8), border)
    plain = [(i, line) for i, e in enumerate(encoded) for line in e.split(b"\n")]
    assert lines.length.tolist() == [len(x) for _, x in plain]
    assert np.diff(lines.first).tolist() == [e.count(b"\n") + 1 for e in encoded]
    for (_, line), row in zip(plain, lines.features):
        value = dict(zip(NAMES, row))
        n, words = max(1, len(line)), line.split()
        assert np.isclose(value["upper"], line.count(b"B") / n) and np.isclose(value["bar"], line.count(b"|") / n)
        assert np.isclose(value["space"], line.count(b" ") / n) and np.isclose(value["digit"], line.count(b"3") / n)
        assert np.isclose(value["word_length"], sum(map(len, words)) / max(1, len(words)))
        assert np.isclose(value["same_as_last_word"], sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))
        assert value["empty"] == (not line)


def test_odd_rows(spark):
    docs = [(1, "Fine words here.\nAnd more."), (2, ""), (3, None), (None, "x"), (4, "\n" * 500), (5, "A" * 300_000), (1, "again")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'s' as score", "null as nothing", "1 as label")
    labels = spark.createDataFrame([(1, 1), (4, None), (5, 0), (None, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        rows = with_quality(df, train(df, known)).collect()
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
        assert [r.score for r in rows if r.doc_id == 2] == [r.score for r in rows if r.doc_id == 3]
    empty = with_quality(df.limit(0), train(df.limit(0), labels))
    assert empty.count() == 0 and set(empty.columns) == {*df.columns}
    assert not df.select(held_out(df.doc_id)).where("held_out is null").count() if "held_out" in df.columns else True
