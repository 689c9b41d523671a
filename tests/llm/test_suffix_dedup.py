import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm import suffix_dedup
from flowscope.llm.queries import QUERIES
from flowscope.llm.suffix_dedup import NO_ID, Runs, buckets, remove_repeats
from tests.llm.brute import kept_bytes

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(2, 60))
def test_buckets_tell_suffixes_apart(data, depth):
    data = bytes(b % 3 for b in data)
    found = buckets(np.frombuffer(data, np.uint8), depth)
    strings = [data[i : i + depth] for i in range(len(data) - depth + 1)]
    assert len(found) == len(strings) and len(set(found.tolist())) == len(set(strings))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(2, 40))
def test_runs_cover_every_window_once(data, window):
    runs = Runs(np.frombuffer(data, np.uint8), window)
    covered = [w for a, b in zip(runs.first, runs.last, strict=True) for w in range(a, b + 1)]
    assert covered == list(range(max(0, len(data) - window + 1)))


def spans(df):
    return {r.doc_id: ([(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in df.collect()}


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_DOCS", 3)
    rnd = random.Random(3)
    base = "".join(rnd.choice("abc de") for _ in range(900))
    docs = []
    for i in range(60):
        a, b = sorted(rnd.randrange(900) for _ in range(2))
        own = "".join(rnd.choice("xyzé ") for _ in range(rnd.randrange(80)))
        docs.append((i, own + base[a:b] + own[:20] + base[b : b + 130]))
    docs += [(70, "ab" * 300), (71, "a" * 99), (72, "a" * 100), (73, "a" * 101), (74, None), (75, ""), (76, base)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    assert spans(remove_repeats(df)) == kept_bytes(docs)
    assert spans(remove_repeats(df, window=31)) == kept_bytes(docs, 31)


def test_odd_rows(spark):
    text = "0123456789" * 9 + "abcdefghijklmnop"
    docs = [(5, text), (5, text), (None, text), (2, "short"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as key", "3 as removed")
    rows = remove_repeats(df).collect()
    assert len(rows) == len(docs)
    assert [bytes(r.kept).decode() for r in rows if r.doc_id == 5] == [text, text]
    assert sorted(bytes(r.kept).decode() for r in rows if r.doc_id is None) == ["", "".join(text[106:])]
    assert NO_ID > 0 and remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = kept_bytes(docs)
    for r in QUERIES["op4_suffix_array_dedup"](spark, SF).collect():
        removed, kept = want[r.doc_id]
        assert r.n_bytes - r.n_removed == len(kept) and r.n_spans == len(removed) and r.kept_sha256 == hashlib.sha256(kept).hexdigest()
