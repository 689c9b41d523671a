"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features (its mix of characters, its words, what it repeats) and those of the lines
around it score its label, and neighbouring labels score each other.  Forward-backward gives each line's probability of
being good; a document's score is their mean, weighted by length.  Training gives all lines of a labelled document its
label and maximises the likelihood of the chains on a bounded sample.  Scoring is a map over partitions: nothing is
shuffled, no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import BYTE_CODES, mix, prefix_sums, ship_code, text_bytes, text_column

SAMPLE_DOCS = 6000  # labelled documents a model is fitted on
SAMPLE_CHARS = 40_000  # longer ones are left out of the sample (never out of scoring)
CHUNK_BYTES = 4 << 20

KINDS = ["lower", "upper", "digit", "space", "stop", "exclamation", "bar", "symbol", "other_mark", "not_ascii"]
NAMES = [*KINDS, "log_length", "word_length", "same_as_last_word", "repeated_trigrams", "repeated_line", "empty"]


def _kind_table() -> np.ndarray:
    table = np.full(256, KINDS.index("other_mark"), np.int64)
    for name, characters in [
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [*range(9, 14), 32]),
        ("stop", b".,;:?'\""), ("exclamation", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~=<>{}[]\\_+"), ("not_ascii", range(128, 256)),
    ]:
        table[list(characters)] = KINDS.index(name)
    return table


_KIND = _kind_table()


@dataclass
class Lines:
    """Lines of several texts: features, lengths in bytes, and the first line of each text (and the end)."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands further left."""
    _, first = np.unique(key, return_index=True)
    seen = np.ones(len(key), bool)
    seen[first] = False
    return seen


def line_features(data: np.ndarray, border: np.ndarray) -> Lines:
    """Features of all lines of the texts ``data[border[i]:border[i + 1]]``; every text has at least one line."""
    border = (border - border[0]).astype(np.int64)
    breaks = np.flatnonzero(data == 10)
    doc_of_break = np.searchsorted(border, breaks, side="right") - 1
    start = np.sort(np.concatenate((border[:-1], breaks + 1)), kind="stable")
    # a text's lines: one more than its line breaks
    per_doc = 1 + np.bincount(doc_of_break, minlength=len(border) - 1)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    stop = np.empty(len(start), np.int64)
    stop[:-1] = start[1:] - 1
    stop[first[1:] - 1] = border[1:]
    inner = np.ones(len(start), bool)
    inner[first[1:] - 1] = False
    stop[inner] = start[np.flatnonzero(inner) + 1] - 1
    length = stop - start
    n = len(start)

    # line of every byte; a line break belongs to the line before it and is taken off again
    line = np.repeat(np.arange(n), np.where(inner, length + 1, length))
    kind = _KIND[data]
    counts = np.bincount(line * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, len(KINDS)).astype(np.float64)
    counts[inner, KINDS.index("space")] -= 1
    share = counts / np.maximum(length, 1)[:, None]

    inside = kind != KINDS.index("space")
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    at, end = edges[::2], edges[1::2]
    # texts follow each other without a gap: a word ends where its text ends
    cut = border[1:-1]
    cut = cut[np.searchsorted(at, cut, side="left") != np.searchsorted(end, cut, side="right")]
    at, end = np.sort(np.concatenate((at, cut))), np.sort(np.concatenate((end, cut)))
    keep = end > at
    at, end = at[keep], end[keep]
    sums, down = prefix_sums(BYTE_CODES[data])
    word = mix((sums[end] - sums[at]) * down[at])
    word_line = line[at] if len(at) else np.zeros(0, np.int64)
    words = np.bincount(word_line, minlength=n)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1])
    salt = mix(doc[word_line].astype(np.uint64) + np.uint64(1)) if len(word) else word
    three = np.zeros(len(word), bool)
    if len(word) > 2:
        key = mix(mix(word[:-2] + np.uint64(3) * word[1:-1]) + word[2:]) ^ salt[2:]
        three[2:] = _seen_before(key) & (doc[word_line[2:]] == doc[word_line[:-2]])
    text_key = mix((sums[stop] - sums[start]) * down[start]) ^ mix(doc.astype(np.uint64) + np.uint64(7))
    again = _seen_before(text_key) & (length > 0)
    per_word = 1 / np.maximum(words, 1)
    features = np.column_stack([
        share, np.log1p(length), np.where(words, (length - counts[:, KINDS.index("space")]) * per_word, 0),
        np.bincount(word_line, weights=same, minlength=n) * per_word, np.bincount(word_line, weights=three, minlength=n) * per_word,
        again, length == 0,
    ])
    return Lines(features, length, first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """A line's features, those of the line before and after (zeros beyond the text), and a constant."""
    f = lines.features
    before, after = np.vstack((np.zeros((1, f.shape[1])), f[:-1])), np.vstack((f[1:], np.zeros((1, f.shape[1]))))
    before[lines.first[:-1]] = 0
    after[lines.first[1:] - 1] = 0
    return np.column_stack((f, before, after, np.ones(len(f))))


class Chain:
    """Forward-backward over many two-label chains at once: step t of all chains that are that long."""

    def __init__(self, first: np.ndarray):
        size = np.diff(first)
        self.order = np.argsort(-size, kind="stable")
        self.start, self.size = first[:-1][self.order], size[self.order]
        self.active = np.searchsorted(-self.size, -np.arange(self.size.max() if len(size) else 0), side="left")

    def run(self, score: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of label 1 per line, expected links, log of the normalisers' sum)."""
        n = len(score)
        peak = np.maximum(score, 0)
        emit = np.exp(np.stack((-peak, score - peak), axis=1))
        step = np.exp(links - links.max())
        forward, backward, scale = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
        for t, k in enumerate(self.active):
            at = self.start[:k] + t
            f = emit[at] if t == 0 else (forward[at - 1] @ step) * emit[at]
            scale[at] = f.sum(axis=1)
            forward[at] = f / scale[at, None]
        expected = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            ahead = emit[at] * backward[at] / scale[at, None]
            backward[at - 1] = ahead @ step.T
            expected += (forward[at - 1].T @ ahead) * step
        log_sum = float(np.log(scale).sum() + peak.sum() + links.max() * (n - len(self.start)))
        return forward[:, 1] * backward[:, 1], expected, log_sum


@dataclass
class LineModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    links: np.ndarray

    def scores(self, lines: Lines) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        x = (with_neighbours(lines) - self.mean) / self.spread
        good, _, _ = Chain(lines.first).run(x @ self.weights, self.links)
        weight = lines.length + 1.0
        doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        total = np.bincount(doc, weights=weight)
        return np.clip(np.bincount(doc, weights=good * weight) / total, 0, 1)


def fit(lines: Lines, labels: np.ndarray, rounds: int = 250, ridge: float = 1.0, rate: float = 0.1) -> LineModel:
    """Maximum likelihood of the chains, with a ridge penalty, by gradient steps of adapted length (Adam)."""
    raw = with_neighbours(lines)
    mean, spread = raw.mean(axis=0), raw.std(axis=0)
    mean[-1], spread = 0, np.where(spread > 1e-9, spread, 1)
    x = (raw - mean) / spread
    y = np.repeat(labels, np.diff(lines.first)).astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (np.diff(lines.first) - 1)[labels == label].sum()
    chain, size = Chain(lines.first), x.shape[1]
    value, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for i in range(1, rounds + 1):
        good, expected, _ = chain.run(x @ value[:size], value[size:].reshape(2, 2))
        slope = np.concatenate((x.T @ (good - y), (expected - seen).ravel())) + ridge * value
        slope /= max(1, len(y))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        value -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return LineModel(mean, spread, value[:size], value[size:].reshape(2, 2))


def held_out(id_column: Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, id_col: str = "doc_id", text: str = "text",
          label: str = "quality") -> LineModel:
    """A model from at most ``limit`` labelled documents that are not held out, drawn by a hash of the id.

    Without any labels of both kinds every score is the share of good labels (or one half).
    """
    drawn = labels.select(F.col(id_col).alias("label_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))
    )
    drawn = drawn.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(limit)
    ship_code(docs.sparkSession)
    body = text_column(docs, text)
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    sample = rows.join(F.broadcast(drawn), rows["id"] == drawn["label_id"]).select("id", "label", "text")
    # features are worked out where the texts are; the driver gets numbers for at most ``limit`` texts of SAMPLE_CHARS
    found = sample.mapInArrow(_sample_features, "id string, label int, features binary, length binary")
    found = found.dropDuplicates(["id"]).orderBy("id").toPandas()
    if found["label"].nunique() < 2:
        known = float(found["label"].mean()) if len(found) else 0.5
        odds = np.log((known + 1e-3) / (1 - known + 1e-3))
        size = 3 * len(NAMES) + 1
        return LineModel(np.zeros(size), np.ones(size), np.append(np.zeros(size - 1), odds), np.zeros((2, 2)))
    length = [np.frombuffer(x, np.int64) for x in found["length"]]
    first = np.concatenate(([0], np.cumsum([len(x) for x in length])))
    features = np.frombuffer(b"".join(found["features"]), np.float32).reshape(-1, len(NAMES)).astype(np.float64)
    return fit(Lines(features, np.concatenate(length), first), found["label"].to_numpy())


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, border = text_bytes(batch.column(2))
        features, length = [], []
        for i in range(batch.num_rows):
            lines = line_features(data[border[i] : border[i + 1]], border[i : i + 2])
            features.append(lines.features.astype(np.float32).tobytes())
            length.append(lines.length.astype(np.int64).tobytes())
        ids = batch.column(0).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(1), pa.array(features, pa.binary()), pa.array(length, pa.binary())],
            names=["id", "label", "features", "length"],
        )


def with_quality(docs: DataFrame, model: LineModel, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (double, 0 to 1); a column of that name is replaced.

    Null and empty texts are one empty line.  Rows are scored one by one: repeated rows, null ids and empty tables need
    no rule.  Texts are scored whole.
    """
    ship_code(docs.sparkSession)
    others = [c for c in docs.columns if c != score]
    rows = docs.select(*[docs[c] for c in others], text_column(docs, text).alias("__text"))
    schema = docs.select(*others).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            data, border = text_bytes(batch.column(at))
            scores, i = [], 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(border, border[i] + CHUNK_BYTES, side="right")) - 1)
                scores.append(model.scores(line_features(data[border[i] : border[j]], border[i : j + 1])))
                i = j
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column], names=[*others, score])

    return rows.mapInArrow(run, schema)
