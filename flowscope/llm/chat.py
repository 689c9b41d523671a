"""Chat formatting with a loss mask that is aligned to tokens by character offsets.

A conversation is rendered in one piece, encoded once with offsets, and the spans of its turns are intersected with the
spans of its tokens by binary search: both lists are sorted, so a turn's tokens are a slice.  The marks of the template
are special tokens, which end the tokens before them, so no token belongs to two turns.  Control strings inside texts
are escaped reversibly: ``<|`` becomes ``<\\|``, and every such escape gets one backslash more.

Conversations are formatted in stretches of turns (``turn`` divided by a fixed width); the marks make the encoding of a
stretch the same as that of the whole, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from flowscope.llm.common import materialize, ship_code, text_column

TURNS = 32  # turns of a stretch
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MASKED_ROLE = "assistant"

_ESCAPE, _UNESCAPE = regex.compile(r"<(\\*)\|"), regex.compile(r"<\\(\\*)\|")
_TURN = regex.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", regex.DOTALL)

_FORMATTED = ("conv_id bigint, stretch bigint, formatted string, token_ids array<int>, token_starts array<int>, "
              "token_ends array<int>, loss_mask array<boolean>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of every text that is learned from."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        parts += [head, body, END]
        if role == MASKED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie in a span; tokens and spans are sorted."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        mask[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = a < b
    return mask


def masked_text(text: str, starts, ends, mask) -> str:
    """The text under the mask; tokens that share a character overlap and count once."""
    out, reached = [], 0
    for a, b, m in zip(starts, ends, mask, strict=True):
        if m and b > reached:
            out.append(text[max(a, reached) : b])
            reached = b
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


_tokenizers: dict[str, Tokenizer] = {}


def chat_tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, MIDDLE, END)])
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def format_chats(conversations: DataFrame, tokenizer_path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per stretch of a conversation: formatted text, token ids, their character spans and the loss mask.

    Turns are ordered by ``turn``, then role and text; null turns come first, null roles and texts are empty, a null
    conversation id is a conversation of its own.  Only texts of the role ``assistant`` are learned from.  Repeated
    rows are repeated turns.  An empty table gives no rows.
    """
    ship_code(conversations.sparkSession)
    place = F.col(turn).cast("bigint")
    rows = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.floor(F.coalesce(place, F.lit(0)) / TURNS).cast("bigint").alias("stretch"),
        place.alias("turn"), text_column(conversations, role).alias("role"), text_column(conversations, text).alias("text"),
    )
    together = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, turns = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "stretch", "role", "text")]
            for conv_id, stretch, speaker, said in zip(*columns, strict=True):
                if (conv_id, stretch) != key:
                    if turns:
                        yield *key, turns
                    key, turns = (conv_id, stretch), []
                turns.append((speaker, said))
        if turns:
            yield *key, turns

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, out = chat_tokenizer(tokenizer_path), []
        names = ["conv_id", "stretch", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"]
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]

        def flush():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        size = 0
        for conv_id, stretch, turns in stretches(batches):
            formatted, spans = render(turns)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            out.append((conv_id, stretch, formatted, np.array(encoded.ids, np.int32), starts, ends, mask_tokens(starts, ends, spans)))
            size += len(formatted)
            if size > 1 << 20:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return together.mapInArrow(form, _FORMATTED)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and mask say: turns, digests, lengths.

    Each stretch is read back by itself.  The digest of a conversation runs through its stretches in order, with only
    the state of the hash in memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, learned = [], []
            turns = []
            for row in batch.to_pylist():
                found = parse(row["formatted"])
                turns.append(len(found))
                said.append("".join(f"{r}\n{t}\n" for r, t in found))
                learned.append(unescape_spans(row))
            size = pa.compute.utf8_length(batch.column("formatted")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("stretch"), pa.array(turns, pa.int64()), pa.array(said, pa.string()),
                 pa.array(learned, pa.string()), size],
                names=["conv_id", "stretch", "n_turns", "said", "learned", "size"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, any_row, out = None, None, False, []

        def closed():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "said", "learned", "size")]
            for conv_id, n, said, learned, size in zip(*columns, strict=True):
                if not any_row or conv_id != key:
                    if any_row:
                        out.append(closed())
                    key, any_row = conv_id, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(said.encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += size
            if len(out) > 10_000:
                yield flush()
                out = []
        if any_row:
            out.append(closed())
        if out:
            yield flush()

    kept = formatted.select("conv_id", "stretch", "formatted", "token_starts", "token_ends", "loss_mask")
    parts = kept.mapInArrow(read, "conv_id bigint, stretch bigint, n_turns bigint, said string, learned string, size bigint")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return ordered.mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def unescape_spans(row: dict) -> str:
    """Text under the mask of one stretch, unescaped; texts are cut apart first, so that no escape forms across them."""
    starts, ends, mask = (np.array(row[c]) for c in ("token_starts", "token_ends", "loss_mask"))
    at = np.flatnonzero(mask.astype(bool))
    if not len(at):
        return ""
    groups = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return "".join(unescape(masked_text(row["formatted"], starts[g], ends[g], np.ones(len(g), bool))) for g in groups)


def formatted_table(conversations: DataFrame, tokenizer_path: str, **columns) -> DataFrame:
    """``format_chats`` written to the shared folder and read back."""
    return materialize(format_chats(conversations, tokenizer_path, **columns), "chats")
