"""The pipeline's stages on a small folder of tables, against plain versions of their rules."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import queries
from flowscope.llm.line_crf import line_features, train
from tests.llm.brute import base_secrets, jaccard_components, shingles
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SF).write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage(spark, stages):
    raw, good, single, clean, masked = (rows(s) for s in stages[:5])
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns
    model = train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    score = {}
    for i, r in raw.items():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        score[i] = model.scores(line_features(data, np.array([0, len(data)])))[0]
    assert set(good) == {i for i, s in score.items() if s >= 0.5} and all(good[i] == raw[i] for i in good)
    groups = jaccard_components([(i, r.text) for i, r in good.items()])
    assert set(single) == {i for i, (_, c) in groups.items() if c == i} and all(single[i] == raw[i] for i in single)
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, r in single.items() for x in items if x and 100 * len(x & shingles(r.text)) >= 75 * len(x)}
    assert set(clean) == set(single) - leaks and leaks
    assert set(masked) == set(clean)
    for i, r in masked.items():
        found = base_secrets(clean[i].text)
        assert not base_secrets(r.text) and (bool(found) <= (r.text != clean[i].text)) and r.n_chars == len(r.text)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import zlib

    pieces = [r.asDict() | {"ids_crc32": zlib.crc32(bytes(r.ids))} for r in stages[5].collect()]
    check_packing(pieces, {i: library.encode(r.text, add_special_tokens=False).ids + [0] for i, r in masked.items()}, 2048)


def test_run_is_registered(spark, stages):
    got = queries()["pipeline"](spark, SF)
    assert {(r.doc_id, r.piece, r.length) for r in got.collect()} == {(r.doc_id, r.piece, r.length) for r in stages[5].collect()}


def test_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5000, "", None, None, 0), (5000, "", None, None, 0), (None, "some words of text.", "en", None, None)],
        docs.schema,
    )
    docs = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count() > 20
    assert sum(r.doc_id == 5000 for r in docs.collect()) <= 1


def test_rows_without_an_id_and_rows_of_one_id_are_judged_singly(spark, tmp_path):
    """One hit or one copy takes away that row, not those that share its id or have none either."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = benchmark.first().text
    say = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, say("a")), (None, f"{say('b')} {item}"), (None, say("c")), (None, say("a")), (7, say("d")), (7, f"{item} {say('e')}"),
            (7, say("f")), (3, say("f") + " end"), (9, say("g")), (9, say("g")), (5, None), (None, None), (None, "")]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns
    short = lambda df: sorted(((r.doc_id or 0), (r.text or "")[:3]) for r in df.collect())
    assert short(single) == sorted([(0, "a"+"w0"), (0, "bw0"), (0, "cw0"), (7, "dw0"), (7, item[:3]), (3, "fw0"), (9, "gw0"), (5, ""), (0, ""), (0, "")])
    path = str(tmp_path / "single")
    single.write.parquet(path)
    clean = corpus_pipeline.decontaminate(spark, spark.read.parquet(path), SF)
    assert short(clean) == sorted([(0, "aw0"), (0, "cw0"), (7, "dw0"), (3, "fw0"), (9, "gw0"), (5, ""), (0, ""), (0, "")])
