"""Token counts by rank-synchronous merging of ragged numpy arrays.

The merges of a BPE vocabulary are applied to many pre-tokens at once: all symbols stand in one array with a segment
number, and in every round each segment merges its own lowest-ranked pair.  What is left of a segment is its count.
A document is cut at white space, which no pre-token of these vocabularies spans; counts of words seen lately are kept
in a bounded table, so that only new words are merged.  No document is cut short and none leaves its partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowscope.llm.common import ship_code, text_column

KEEP_WORDS = 1_500_000  # words whose counts a worker remembers
BATCH_WORDS = 50_000  # pre-tokens merged together


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class MergeTable:
    """Vocabulary of one tokenizer file as sorted numpy arrays, and the counting itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        self.end_ids = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.normalizer = Tokenizer.from_file(path).normalizer  # its Unicode tables may be newer than Python's
        self.counts: dict[str, int] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; no merge has the rank of the table's length."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], len(self.keys)), self.made[at]

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols each (non-empty) pre-token has after all merges."""
        size = np.array([len(t) for t in tokens], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        last = np.cumsum(size) - 1
        ids[last] = self.end_ids[np.frombuffer(b"".join(t[-1:] for t in tokens), np.uint8)]
        segment = np.repeat(np.arange(len(tokens)), size)
        out = size.copy()
        none = len(self.keys)
        while len(ids) > 1:
            rank, made = self.ranks_of(ids[:-1], ids[1:])
            rank[segment[:-1] != segment[1:]] = none
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            length = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            hit = (rank == np.repeat(best, length)) & (rank < none)
            # equal symbols in a row (aaa): of overlapping hits, every second one counts, from the left
            start = hit & ~np.append(False, hit[:-1])
            run = np.flatnonzero(hit)
            position = run - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))[run]
            run = run[position % 2 == 0]
            ids[run] = made[run]
            keep = np.ones(len(ids), bool)
            keep[run + 1] = False
            out -= np.bincount(segment[run], minlength=len(out))
            keep &= np.repeat(best < none, length)  # segments that are done leave
            ids, segment = ids[keep], segment[keep]
        return out

    def split(self, word: str) -> list[str]:
        """Pre-tokens of one word; letters, or letters and one full stop or comma, need no pattern."""
        if word.isalpha():
            return [word]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces.findall(word)

    def learn(self, new: set[str]) -> None:
        """Adds the counts of words that contain no white space."""
        owners, pieces, distinct = [], [], {}
        new = list(new)
        for i, word in enumerate(new):
            for piece in self.split(word.lower() if word.isascii() else self.normalizer.normalize_str(word)):
                owners.append(i)
                pieces.append(distinct.setdefault(piece, len(distinct)))
        total = np.zeros(len(new), np.int64)
        if distinct:
            tokens = [p.encode("utf-8", "surrogatepass") for p in distinct]
            n = np.concatenate([self.merge(tokens[i : i + BATCH_WORDS]) for i in range(0, len(tokens), BATCH_WORDS)])
            total = np.bincount(np.array(owners), weights=n[np.array(pieces)], minlength=len(new)).astype(np.int64)
        self.counts.update(zip(new, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the tokenizer's own library counts them."""
        parts, extra = [], []
        for text in texts:
            special = self.cut.findall(text) if any(s in text for s in self.special) else []
            extra.append(len(special))
            parts.append(split_words(self.cut.sub(" ", text) if special else text))
        if len(self.counts) > KEEP_WORDS:
            self.counts.clear()
        known = self.counts.keys()
        new = set().union(*parts) - known if parts else set()
        if new:
            self.learn(new)
        get = self.counts.__getitem__
        return [n + sum(map(get, row)) for n, row in zip(extra, parts, strict=True)]


_UNICODE_SPACE = regex.compile(r"\s+")
_INFO_SEPARATORS = regex.compile("[\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    """Words between Unicode white space; the four ASCII information separators are not white space here."""
    if _INFO_SEPARATORS.search(text):
        return _UNICODE_SPACE.split(text)
    return text.split()


_tables: dict[str, MergeTable] = {}


def table(path: str) -> MergeTable:
    """One table for each worker process and file."""
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``; other columns are not read.

    Null and empty texts have no bytes and no tokens.  A null id stays null, repeated rows are each counted, an empty
    table gives an empty result.  Long texts are counted whole.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = table(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = some.column(1)
                size = pa.compute.binary_length(texts).cast(pa.int64())
                n = pa.array(merges.count(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), size, n], names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
