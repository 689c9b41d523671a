"""Token counts, packing and chat formatting against the tokenizers library and plain versions."""

import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowscope.llm.chat import chat_digests, escape, format_chats, mask_tokens, masked_text, parse, render, unescape
from flowscope.llm.packing import Encoder, OpenBins, cuts, pack_documents
from flowscope.llm.queries import CONTROL_STRINGS, QUERIES
from flowscope.llm.token_counts import MergeTable, count_tokens

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "A" * 5000, "haha" * 900, " " * 3000 + "x", "ΣΊΣΥΦΟΣ σς", "İstanbul ẛ̣", "ẹ́ 漢字 👍🏽 ​\xa0\x85\x1c\x1fz",
       "<|endoftext|>a<|endoftext|><|startoftext|>", "it's WE'LL I'D'd 12345 ½ ٣", "\r\n\t \n\n x\n", "<|im_start|>", None]
TEXT = st.text(st.sampled_from("aAbBsStT '’ΣσİKſẹ́́ẛ 15٣漢ひ👍🏽\x1c\x85\xa0 ​\n\t.,!?<|endoftx>"), max_size=60)


@pytest.fixture(scope="module")
def merges():
    return MergeTable(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_counts_equal_the_library(merges, text):
    table, library = merges
    assert table.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_counts_of_odd_rows(spark, merges):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as n_tokens")
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, WORDS, 100).collect())
    want = []
    for i, t in rows:
        n = len(merges[1].encode(t or "", add_special_tokens=False).ids)
        want.append((i is None, i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert count_tokens(df.limit(0), WORDS, 1).count() == 0


def test_counts_of_every_character(merges):
    table, library = merges
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}." for c in points[at : at + 100_000]]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        wrong = [hex(points[at + i]) for i, (a, b) in enumerate(zip(table.count(texts), want, strict=True)) if a != b]
        assert not wrong


def test_token_count_query(spark, merges):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    want = {i: (len(t.encode()), len(merges[1].encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert got == {i: (b, n, n > 2048) for i, (b, n) in want.items()}


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_equal_the_library(text):
    encoder = test_ids_equal_the_library.__dict__.setdefault("encoder", Encoder(BYTES))
    assert encoder.ids(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_open_bins_choose_the_tightest_and_close_the_fullest(lengths, limit):
    bins, plain, made = OpenBins(50, limit), [], 0
    for n in lengths:
        number, offset = bins.place(n)
        fitting = [b for b in plain if b[0] >= n]
        if fitting:
            best = min(b[0] for b in fitting)
            mine = next(b for b in plain if b[1] == number)
            assert mine[0] == best and offset == 50 - best
            plain.remove(mine)
            space = best
        else:
            assert (number, offset) == (made, 0)
            made, space = made + 1, 50
        if space > n:
            plain.append([space - n, number])
        if len(plain) > limit:
            fullest = min(b[0] for b in plain)
            # of equally full bins the one that was touched last is closed
            plain.remove([b for b in plain if b[0] == fullest][-1])
    assert bins.open == len(plain)


def test_cuts():
    assert cuts(1, 8) == [0] and cuts(8, 8) == [0] and cuts(9, 8) == [0, 1] and cuts(24, 8) == [0, 8, 16]


def check_packing(pieces, docs, capacity):
    """Whole documents, gapless sequences; ``docs``: {id: ids with the end token}."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(docs)
    for i, ids in docs.items():
        own = sorted(by_doc[i], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own)))
        assert all(p["start"] + p["length"] == q["start"] for p, q in zip(own, own[1:], strict=False))
        assert sum(p["length"] for p in own) == len(ids)
        assert len(own) == 1 if len(ids) <= capacity else all(p["length"] == capacity for p in own[1:])
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing_query(spark):
    library = Tokenizer.from_file(BYTES)
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0]
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = [r.asDict() for r in QUERIES["op8_best_fit_packing"](spark, SF).collect()]
    sequences = check_packing(pieces, docs, 2048)
    total = sum(map(len, docs.values()))
    assert len(sequences) <= 1.1 * total / 2048 + 2


def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as piece").coalesce(1)
    pieces = pack_documents(df, BYTES, capacity=64).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}
    assert [bytes(p.ids) for p in pieces if p.doc_id == 0] == [b"\0\0\0\0"]
    assert pack_documents(df.limit(0), BYTES).count() == 0


@given(st.text(st.sampled_from("<|\\im_startendsep>a\n"), max_size=40))
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|x"]), st.text(st.sampled_from("<|\\im_end>a\né"), max_size=20)), max_size=6))
def test_rendering_is_read_back(turns):
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_mask_by_binary_search():
    starts, ends = np.array([0, 2, 2, 5, 7]), np.array([2, 5, 5, 7, 9])
    assert mask_tokens(starts, ends, [(2, 7), (7, 7)]).tolist() == [False, True, True, True, False]
    assert masked_text("abcdefghi", starts, ends, [False, True, True, True, False]) == "cdefg"


def plain_chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(),
                     sum(len(escape(r)) + len(escape(t)) + 32 for r, t in turns))
    return out


def test_chats(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} é👍🏽\n\n" if i % 3 else None) for i in range(150)]
    rows += [(2, 0, "user", CONTROL_STRINGS), (2, 1, "assistant", CONTROL_STRINGS), (2, 1, "assistant", CONTROL_STRINGS)]
    rows += [(3, None, None, "x"), (3, None, "assistant", "\n<\\|<|"), (None, 0, "assistant", ""), (None, 5, "assistant", "<"), (None, 6, "assistant", "|")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as stretch")
    got = {r.conv_id: tuple(r)[1:] for r in chat_digests(format_chats(df, BYTES)).collect()}
    assert got == plain_chats(rows)
    assert chat_digests(format_chats(df.limit(0), BYTES)).count() == 0


def test_chat_ids_are_those_of_the_whole_text(spark):
    from flowscope.llm.chat import chat_tokenizer

    rows = [(1, i, "assistant" if i % 2 else "user", f"  turn {i}\n") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = sorted(format_chats(df, BYTES).collect(), key=lambda r: r.stretch)
    assert len(parts) == 3
    whole = chat_tokenizer(BYTES).encode("".join(p.formatted for p in parts), add_special_tokens=False)
    assert [i for p in parts for i in p.token_ids] == whole.ids
    assert json.dumps([m for p in parts for m in p.loss_mask]).count("true") > 0
