"""Removal of long repeated strings by bucket-pointer refinement of suffixes.

Suffixes are told apart by buckets: those that share their first q bytes have the same bucket identifier, a hash of
these bytes, which every task computes alike.  A bucket of depth h is refined to depth 2h by the pair of its identifier
and the bucket identifier of the suffix h bytes later; identifiers of one depth are reused for the next, until the
window length is reached.  Sorting by refined identifiers brings equal windows together, first occurrence first.

Refining and sorting every suffix would shuffle a hundred bytes for each byte of text, so buckets that need no more
refinement leave early:

1. Each window is represented by one of its half-length q-grams, the one with the smallest identifier (the leftmost of
   equals).  Equal windows choose alike.  Consecutive windows with the same choice make a run, and runs are sorted by
   their q-gram bucket and their refined identifiers.  Equal runs repeat each other as a whole; a bucket with a single
   kind of run is done.
2. Only runs that share their q-gram with runs of another kind (the ends of repeated strings) are refined window by window.

Before each shuffle a block of documents keeps one entry per kind of run or window; its other entries are repeats that
the block decides by itself.  A string that fills a third of the table so costs one entry per block, and nothing is
gathered by document or by string in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import BYTE_CODES, ODD, materialize, mix, prefix_sums, ship_code, shuffle_width, text_bytes, text_column

BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 60_000
FIRST_DEPTH = 25
LOW = np.uint64((1 << 40) - 1)
NO_ID = (1 << 63) - 1
REMOVED, ASKED = 0, 1
DOC = np.dtype([("id", "<i8"), ("key", "<i4")])

# entries to sort (part set) or decisions on documents (bucket set)
_ROWS = ("part int, bucket int, docs binary, owner binary, low binary, high binary, kind binary, start binary, stop binary, "
         "what binary")
_SPANS = "id bigint, key bigint, removed binary, asked binary"


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _table(rows: list[tuple]) -> pa.Table:
    schema = _schema(_ROWS)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blob(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _join(blobs: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(blobs) if blobs else np.zeros(0, dtype)


# ---- suffix buckets of one text ------------------------------------------------------------------------------------


def refine(bucket: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Bucket identifiers of depth ``to`` (at most twice ``depth``) from those of ``depth`` and of a later offset."""
    later = to - depth
    return mix(mix(bucket[: max(0, len(bucket) - later)] * ODD) + bucket[later:])


def buckets(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifier of every suffix of ``data`` that is at least ``depth`` long."""
    q = min(FIRST_DEPTH, depth)
    if len(data) < depth:
        return np.zeros(0, np.uint64)
    sums, down = prefix_sums(BYTE_CODES[data])
    bucket = mix((sums[q:] - sums[:-q]) * down[: len(sums) - q])
    while q < depth:
        to = min(2 * q, depth)
        bucket, q = refine(bucket, q, to), to
    return bucket


class Runs:
    """Runs of windows of one text: q-gram bucket, refined identifier, first and last window."""

    def __init__(self, data: np.ndarray, window: int):
        half = (window + 1) // 2
        gram = buckets(data, half)
        full = refine(gram, half, window)
        if not len(full):
            self.gram = self.kind = np.zeros(0, np.uint64)
            self.first = self.last = np.zeros(0, np.int64)
            return
        choices = np.lib.stride_tricks.sliding_window_view(gram, window - half + 1)
        chosen = choices.argmin(axis=1) + np.arange(len(full))
        self.first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        self.last = np.append(self.first[1:], len(full)) - 1
        at = chosen[self.first]
        self.gram = mix(gram[at])  # chosen for being small: mixed again, so that parts are even
        shape = ((at - self.first) * window + (self.last - self.first)).astype(np.uint64)
        self.kind = mix(mix(full[self.first] + shape * ODD) + full[self.last])


# ---- blocks and replies --------------------------------------------------------------------------------------------


def _merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each owner."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    base = owner.astype(np.int64) << 33  # running maximum within each owner
    reach = np.maximum.accumulate(stop + base)
    new = np.append(True, start[1:] + base[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return owner[first], start[first], (reach - base)[np.append(first[1:], len(owner)) - 1]


def _decision_rows(docs: np.ndarray, owner, start, stop, what, width: int) -> Iterator[tuple]:
    """Decisions by bucket of documents."""
    mixed = mix(docs["id"].astype(np.uint64) * ODD + docs["key"].astype(np.uint64))
    bucket = (mixed % np.uint64(width)).astype(np.int64)[owner]
    order = np.argsort(bucket, kind="stable")
    owner, start, stop, what = owner[order], start[order], stop[order], what[order]
    border = np.searchsorted(bucket[order], np.arange(width + 1))
    for b in np.flatnonzero(np.diff(border)):
        cut = slice(border[b], border[b + 1])
        here, own = np.unique(owner[cut], return_inverse=True)
        yield (int(b), int(b), docs[here].tobytes(), own.astype(np.uint32).tobytes(), None, None, None,
               start[cut].astype(np.uint32).tobytes(), stop[cut].astype(np.uint32).tobytes(), what[cut].astype(np.uint8).tobytes())


def _entry_rows(docs: np.ndarray, owner, main, kind, start, stop, parts: int) -> Iterator[tuple]:
    """Entries sorted by ``main`` and cut by part."""
    part = ((main >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    border = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    low = main & LOW
    for p in np.flatnonzero(np.diff(border)):
        cut = slice(border[p], border[p + 1])
        here, own = np.unique(owner[cut], return_inverse=True)
        yield (int(p), None, docs[here].tobytes(), own.astype(np.uint16).tobytes(), low[cut].astype(np.uint32).tobytes(),
               (low[cut] >> np.uint64(32)).astype(np.uint8).tobytes(), kind[cut].tobytes(),
               start[cut].astype(np.uint32).tobytes(), (stop[cut] - start[cut]).astype(np.uint16).tobytes(), None)


class Block:
    """Collects the entries of some documents; later copies of an entry are decided here, the first ones are sent on."""

    def __init__(self, window: int, parts: int, width: int):
        self.window, self.parts, self.width = window, parts, width
        self.clear()

    def clear(self) -> None:
        self.docs, self.seen, self.bytes = [], {}, 0
        self.owner, self.main, self.kind, self.start, self.stop = [], [], [], [], []

    def add(self, doc: tuple[int, int], main, kind, start, stop) -> None:
        if doc in self.seen:  # the same row again
            return
        self.seen[doc] = None
        self.owner.append(np.full(len(main), len(self.docs), np.uint32))
        self.docs.append(doc)
        self.main.append(main)
        self.kind.append(kind)
        self.start.append(start)
        self.stop.append(stop)

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.docs) >= BLOCK_DOCS

    def rows(self) -> list[tuple]:
        out = []
        if self.docs:
            docs = np.array(self.docs, DOC)
            place = np.empty(len(docs), np.int64)
            place[np.lexsort((docs["key"], docs["id"]))] = np.arange(len(docs))
            owner, main, kind = np.concatenate(self.owner), np.concatenate(self.main), np.concatenate(self.kind)
            start, stop = np.concatenate(self.start), np.concatenate(self.stop)
            order = np.lexsort((start, place[owner], kind, main))
            owner, main, kind, start, stop = owner[order], main[order], kind[order], start[order], stop[order]
            first = np.append(True, (main[1:] != main[:-1]) | (kind[1:] != kind[:-1]))[: len(main)]
            own, a, b = _merged(owner[~first], start[~first], stop[~first] + self.window)
            out += _decision_rows(docs, own, a, b, np.full(len(own), REMOVED), self.width)
            out += _entry_rows(docs, owner[first], main[first], kind[first], start[first], stop[first], self.parts)
        self.clear()
        return out


def _run_blocks(window: int, parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(window, parts, width)
        for batch in batches:
            data, border = text_bytes(batch.column(2))
            for i, (doc_id, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                runs = Runs(data[border[i] : border[i + 1]], window)
                if len(runs.gram):
                    block.add((doc_id, key), runs.gram, runs.kind, runs.first, runs.last)
                    block.bytes += int(border[i + 1] - border[i])
                if block.full():
                    yield from _table(block.rows()).to_batches()
        yield from _table(block.rows()).to_batches()

    return run


def _window_blocks(window: int, parts: int, width: int):
    """Entries for each single window that was asked for."""
    half = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(window, parts, width)
        for batch in batches:
            data, border = text_bytes(batch.column(2))
            for i, asked in enumerate(batch.column(3)):
                if asked.as_py():
                    runs = np.frombuffer(asked.as_buffer(), np.uint32).reshape(-1, 2).astype(np.int64)
                    length = runs[:, 1] - runs[:, 0] + 1
                    at = np.repeat(runs[:, 0] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
                    gram = buckets(data[border[i] : border[i + 1]], half)
                    left, right = gram[at], gram[at + window - half]
                    main, check = mix(mix(left * ODD) + right), mix(left + mix(right ^ ODD))
                    block.add((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), main, check, at, at)
                    block.bytes += len(at) * 20
                if block.full():
                    yield from _table(block.rows()).to_batches()
        yield from _table(block.rows()).to_batches()

    return run


def _first_occurrences(window: int, width: int, ask: bool):
    """Reducer of a part: copies of an earlier entry are removed; with ``ask``, kinds that share a bucket are asked about."""

    def run(key, rows):
        decided = pa.compute.is_valid(rows["bucket"])
        passed, entries = rows.filter(decided), rows.filter(pa.compute.invert(decided))
        if not len(entries):
            return passed
        tables = _blob(entries["docs"], DOC)
        base = np.cumsum([0, *(len(t) for t in tables)])[:-1]
        owner = np.concatenate([o.astype(np.int64) + b for o, b in zip(_blob(entries["owner"], np.uint16), base, strict=True)])
        docs, at = np.unique(np.concatenate(tables), return_inverse=True)  # ordered by id, then key
        owner = at[owner]
        main = np.concatenate(_blob(entries["low"], np.uint32)).astype(np.uint64)
        main |= np.concatenate(_blob(entries["high"], np.uint8)).astype(np.uint64) << np.uint64(32)
        kind = np.concatenate(_blob(entries["kind"], np.uint64))
        start = np.concatenate(_blob(entries["start"], np.uint32)).astype(np.int64)
        stop = start + np.concatenate(_blob(entries["stop"], np.uint16))
        order = np.lexsort((start, owner, kind, main))
        again = np.append(False, (np.diff(main[order]) == 0) & (np.diff(kind[order]) == 0) & (np.diff(owner[order]) == 0)
                          & (np.diff(start[order]) == 0))  # rows that another block has too
        order = order[~again]
        owner, main, kind, start, stop = owner[order], main[order], kind[order], start[order], stop[order]
        bucket = np.append(True, main[1:] != main[:-1])
        first = bucket | np.append(True, kind[1:] != kind[:-1])
        own, a, b = _merged(owner[~first], start[~first], stop[~first] + window)
        what = np.full(len(own), REMOVED)
        if ask:
            number = np.cumsum(bucket) - 1
            several = first & (np.bincount(number[first])[number] > 1)
            own, a, b = np.append(own, owner[several]), np.append(a, start[several]), np.append(b, stop[several])
            what = np.append(what, np.full(int(several.sum()), ASKED))
        return pa.concat_tables([passed, _table(list(_decision_rows(docs, own, a, b, what, width)))])

    return run


def _by_document(key, rows):
    """Reducer of a bucket of documents: each document's removed spans, merged, and the runs asked about."""
    tables = _blob(rows["docs"], DOC)
    base = np.cumsum([0, *(len(t) for t in tables)])[:-1]
    docs, at = np.unique(np.concatenate(tables), return_inverse=True)
    owner = at[np.concatenate([o.astype(np.int64) + b for o, b in zip(_blob(rows["owner"], np.uint32), base, strict=True)])]
    start, stop = np.concatenate(_blob(rows["start"], np.uint32)), np.concatenate(_blob(rows["stop"], np.uint32))
    what = np.concatenate(_blob(rows["what"], np.uint8))
    spans = {}
    for name in (REMOVED, ASKED):
        mine = what == name
        own, a, b = owner[mine], start[mine], stop[mine]
        if name == REMOVED:
            own, a, b = _merged(own, a, b)
        else:
            order = np.lexsort((a, own))
            own, a, b = own[order], a[order], b[order]
        pairs = np.stack([a, b], axis=1).astype(np.uint32)
        spans[name] = pairs, np.searchsorted(own, np.arange(len(docs) + 1))
    columns = [docs["id"].tolist(), docs["key"].tolist()]
    for pairs, border in spans.values():
        columns.append([pairs[border[i] : border[i + 1]].tobytes() for i in range(len(docs))])
    schema = _schema(_SPANS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        data, border = text_bytes(batch.column(2))
        ids, size, spans, kept = [], [], [], []
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            text = data[border[i] : border[i + 1]]
            blobs = [batch.column(c)[i] for c in (3, 4)]
            runs = np.concatenate([np.frombuffer(b.as_buffer(), np.uint32).reshape(-1, 2) if b.is_valid else
                                   np.zeros((0, 2), np.uint32) for b in blobs])
            _, a, b = _merged(np.zeros(len(runs), np.int64), runs[:, 0], runs[:, 1])
            keep = np.ones(len(text), bool)
            for x, y in zip(a, b, strict=True):
                keep[x:y] = False
            ids.append(None if doc_id == NO_ID else doc_id)
            size.append(len(text))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
            kept.append(text[keep].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, removed spans, kept bytes) for every row of ``docs``, texts taken as UTF-8.

    A byte goes if a ``window``-byte string over it also starts earlier: in a document of a smaller id, or earlier in
    the same one.  Strings never cross documents and are judged on the input.  Null texts are empty; texts shorter than
    the window lose nothing.  Rows equal in id and text are one document and get the same result each; rows that share
    an id only are ordered by 31 hash bits of their text; rows without an id come last.  Windows are compared by 64 hash bits
    of their second refinement and about 47 of the first.
    """
    spark = docs.sparkSession
    ship_code(spark)
    parts = width = shuffle_width(spark)
    body = text_column(docs, text)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).bitwiseAND(0x7FFFFFFF).alias("key"), body.alias("text"))
    runs = rows.mapInArrow(_run_blocks(window, parts, width), _ROWS)
    sorted_runs = runs.groupBy("part").applyInArrow(_first_occurrences(window, width, True), _ROWS)
    spans = materialize(sorted_runs.groupBy("bucket").applyInArrow(_by_document, _SPANS), "repeats-runs")
    asked = rows.join(spans.select("id", "key", "asked", "removed"), ["id", "key"], "left").select("id", "key", "text", "asked")
    windows = asked.mapInArrow(_window_blocks(window, parts, width), _ROWS)
    sorted_windows = windows.groupBy("part").applyInArrow(_first_occurrences(window, width, False), _ROWS)
    more = materialize(sorted_windows.groupBy("bucket").applyInArrow(_by_document, _SPANS), "repeats-windows")
    found = spans.select("id", "key", "removed").join(more.select("id", "key", F.col("removed").alias("more")), ["id", "key"], "full")
    whole = rows.join(found, ["id", "key"], "left").select("id", "key", "text", "removed", "more")
    cut = whole.mapInArrow(_cut, "id bigint, n_bytes bigint, removed array<struct<start: bigint, stop: bigint>>, kept binary")
    return cut.withColumnRenamed("id", id_col)
