"""Best-fit packing of token sequences with a fixed number of open bins.

Each partition packs its own documents in the order it reads them: bins that are open are keyed by their free space in
one integer used as a bitset, so the tightest bin that takes a piece is the lowest set bit at or above its length.  When
one bin too many is open, the fullest is closed.  A sequence never mixes partitions, so nothing is shuffled and a lost
task packs its rows again from the same input in the same order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowscope.llm.common import ship_code, text_column
from flowscope.llm.token_counts import byte_symbols

OPEN_BINS = 512
SEQUENCES_PER_PARTITION = 1 << 40

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE tokenizer file.

    The file's vocabulary is ordered by merge rank, so ``tiktoken`` gives the same ids several times faster than the
    file's own library; that library takes over where its regular expression gives up (huge runs of white space).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {token: i for token, i in ranks.items() if i not in special.values()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.whole = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except BaseException as error:  # the Rust side raises panics outside Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


class OpenBins:
    """Bins with room, keyed by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: full ones, after a first one that may be shorter."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS,
                   id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (id, piece, start, length, ids, sequence_id, offset).

    A document is its token ids and ``end_id``; ``ids`` holds a piece's ids as little-endian 32-bit numbers.  Sequences
    hold at most ``capacity`` tokens without gaps.  Null and empty texts are the end token alone; a null id stays null;
    repeated rows are packed each; an empty table gives no pieces.  Only documents over ``capacity`` are cut.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text).alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = encoder(tokenizer_path), OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                owner, piece, start, length, ids, sequence, offset = [], [], [], [], [], [], []
                for i, value in enumerate(some.column(1)):
                    row = np.concatenate((tokens.ids(value.as_py()).astype("<u4", copy=False), end))
                    borders = [*cuts(len(row), capacity), len(row)]
                    for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                        number, place = bins.place(b - a)
                        owner.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(row[a:b].tobytes())
                        sequence.append(base + number)
                        offset.append(place)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()),
                     pa.array(offset, pa.int64())],
                    names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return rows.mapInArrow(pack, schema).withColumnRenamed("id", id_col)
