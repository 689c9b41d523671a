"""Ranked lexical search with hashed max-sketches.

A document's sketch has a fixed number of places; each term is hashed to one, and a place holds the largest impact of
the terms that fall on it.  An item's weighted terms looked up in a sketch give a sum that is never below the document's
score.  Every task reads its documents once, looks up all items of a block in the sketches of a batch by one matrix
product, and rescores documents exactly in descending order of their bounds until the next bound is below the worst of
the item's best documents so far.  Tasks hand on only their best documents of each item.

Items come in blocks of bounded size, and each block is compared with all documents: two passes over the texts, one for
the counts (documents, terms, documents holding a term), one for the ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.llm.common import ship_code, text_column

PLACES = 2048  # of a sketch
BATCH = 512  # documents whose sketches are in memory
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20  # items compared in one pass, and their text
TOP_IMPACT = 1_000_000  # impacts are below this
CACHED_TERMS = 1 << 19  # places remembered by a task
MERGE_WIDTH = 64

# Letters, digits and everything beyond ASCII stay, A-Z become a-z, all other bytes separate terms.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(data: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text with repeats."""
    return (data or b"").translate(_TABLE).split()


class Places(dict):
    """Place of each term, remembered for the first so many."""

    def __missing__(self, term: bytes) -> int:
        place = crc32(term) % PLACES
        if len(self) < CACHED_TERMS:
            self[term] = place
        return place


class Corpus:
    """Counts over all documents, and the weights they give a block's terms."""

    def __init__(self, n_docs: int, n_terms: int, holders: dict[bytes, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in holders.items()}

    def discount(self, length: int) -> int:
        return 25 + 75 * length * self.n_docs // self.n_terms


class Best:
    """The best documents of an item so far: higher scores first, then smaller ids, missing ids last."""

    def __init__(self, limit: int):
        self.limit, self.heap = limit, []

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.limit else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, -math.inf if doc is None else -doc)
        if len(self.heap) < self.limit:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)


class Block:
    """A block of items as rows of (term, weight times repeats), and the same folded onto places."""

    def __init__(self, counts: list[Counter], corpus: Corpus):
        self.corpus = corpus
        self.weighted = [[(t, c * corpus.weight[t]) for t, c in terms.items() if t in corpus.weight] for terms in counts]
        used = sorted({crc32(t) % PLACES for terms in self.weighted for t, _ in terms})
        self.used = np.array(used, np.int64)
        at = {p: i for i, p in enumerate(used)}
        self.matrix = np.zeros((len(used), len(counts)))
        for i, row in enumerate(self.weighted):
            for t, w in row:
                self.matrix[at[crc32(t) % PLACES], i] += w
        # sums of whole numbers are exact in doubles up to 2^53; beyond, bounds are raised by more than the error
        self.exact = self.matrix.sum(axis=0).max(initial=0) * TOP_IMPACT < 2**53

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        sums = sketches[:, self.used].astype(np.float64) @ self.matrix
        return sums if self.exact else sums * (1 + 1e-9)

    def score(self, item: int, counts: Counter, discount: int) -> int:
        total = 0
        for t, w in self.weighted[item]:
            tf = counts.get(t)
            if tf:
                total += w * (1000000000 * tf // (1000 * tf + 8 * discount))
        return total


def max_sketches(counts: list[Counter], discounts: list[int], places: Places) -> np.ndarray:
    """One row per document: the largest impact on each place."""
    sketches = np.zeros(len(counts) * PLACES, np.int64)
    sizes = np.array([len(c) for c in counts], np.int64)
    at = np.fromiter((places[t] for c in counts for t in c), np.int64, sizes.sum())
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(at))
    impact = 1000000000 * tf // (1000 * tf + 8 * np.repeat(np.array(discounts, np.int64), sizes))
    np.maximum.at(sketches, np.repeat(np.arange(len(counts)) * PLACES, sizes) + at, impact)
    return sketches.reshape(len(counts), PLACES)


def rank_batch(block: Block, ids: list, counts: list[Counter], discounts: list[int], best: list[Best], places: Places) -> None:
    """Lets the documents of a batch into the best of each item."""
    bounds = block.bounds(max_sketches(counts, discounts, places))
    least = np.array([b.least for b in best], np.float64)
    for item in np.flatnonzero((bounds >= least).any(axis=0)):
        column, top = bounds[:, item], best[item]
        chosen = np.flatnonzero(column >= top.least)
        for d in chosen[np.argsort(-column[chosen], kind="stable")]:
            if column[d] < top.least:
                break
            score = block.score(item, counts[d], discounts[d])
            if score > 0:
                top.add(score, ids[d])


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[Counter]]]:
    """(ids, term counts) of blocks of items, streamed through the driver one block at a time."""
    ids, counts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.id)
        counts.append(Counter(terms(bytes(row.text))))
        size += len(row.text)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, counts
            ids, counts, size = [], [], 0
    if ids:
        yield ids, counts


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> Corpus:
    """Counts over all ``docs`` (id, text as bytes); for each term of ``vocabulary`` the documents that hold it."""
    known = sorted(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(known)}
        asked, holders, n_docs, n_terms = set(known), np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for value in batch.column(1):
                found = terms(value.as_py())
                n_docs += bool(found)
                n_terms += len(found)
                for t in asked.intersection(found):
                    holders[at[t]] += 1
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1, -2], held)), pa.int64()), pa.array(np.concatenate(([n_docs, n_terms], holders[held])), pa.int64())],
            names=["term", "n"],
        )

    rows = docs.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in rows}  # at most a block's terms and two totals
    return Corpus(n.get(-1, 0), n.get(-2, 0), {known[i]: c for i, c in n.items() if i >= 0})


def _ranked_block(docs: DataFrame, first: int, ids: list, counts: list[Counter], limit: int) -> DataFrame | None:
    corpus = corpus_counts(docs, {t for c in counts for t in c})
    if not corpus.n_terms:
        return None
    block = Block(counts, corpus)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, places = [Best(limit) for _ in ids], Places()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                found = [terms(value.as_py()) for value in some.column(1)]
                rank_batch(block, some.column(0).to_pylist(), [Counter(f) for f in found],
                           [corpus.discount(len(f)) for f in found], best, places)
        rows = [(first + i, ids[i], None if doc == -math.inf else -doc, score) for i, b in enumerate(best) for score, doc in b.heap]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(rank, "item bigint, item_id bigint, doc_id bigint, score bigint")


def _best(rows: DataFrame, limit: int, *keys) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def rank_documents(docs: DataFrame, items: DataFrame, limit: int = 10, id_col: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its ``limit`` best documents with a score above 0.

    Every row of ``docs`` is a document and every row of ``items`` an item, also where ids repeat or are missing; ids
    are whole numbers.  Null texts have no terms: such documents are never returned and count for nothing, such items
    return nothing.  Equal scores are ordered by id, missing ids last.  Without documents or items there are no rows.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_column(docs, text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).cast("bigint").alias("id"), text_column(items, item_text).cast("binary").alias("text"))
    out, first = None, 0
    for ids, counts in _item_blocks(asked):
        ranked = _ranked_block(rows, first, ids, counts, limit)
        first += len(ids)
        if ranked is not None:
            out = ranked if out is None else out.union(ranked)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "item bigint, item_id bigint, doc_id bigint, score bigint")
    # an item's rows grow with the number of tasks: they are merged in two steps
    part = (F.spark_partition_id() % MERGE_WIDTH).alias("part")
    fewer = _best(out.select("*", part), limit, "item", "part").drop("rank", "part")
    return _best(fewer, limit, "item").select("item_id", "rank", "doc_id", "score")
