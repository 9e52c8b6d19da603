"""Operator 11: tokens of whole texts, by merging all pre-tokens of a batch at once.

Pre-tokens lie one after the other in flat arrays.  In each round every sequence
applies its pair of the lowest rank, wherever it stands, and what is left when no
pair has a rank are its tokens.

A sequence longer than a window is taken by windows of twice the longest token:
a pair whose rank is the lowest of its own window and of both beside it is merged
as well.  Whatever could take one of its symbols away before would be a merge of
a lower rank, made of pairs no further off than the longest token, and there is
none.  So rounds don't grow with a sequence's length.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared, textbatch

#: The rank of a pair that isn't merged.
NONE = np.iinfo(np.int32).max


class Merges:
    """The ranked merges of a byte-level vocabulary as arrays."""

    def __init__(self, path: str):
        if textbatch.shape(path) != textbatch.BYTES:
            raise ValueError(f"{path} is not a byte-level vocabulary whose ids follow its merges")
        tokenizer = textbatch.library_tokenizer(path)
        spec, vocab = json.loads(tokenizer.to_str()), tokenizer.get_vocab()
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take white space or ask for word limits")
        encoding = textbatch.byte_level_encoding(path)._mergeable_ranks
        self.byte_id = np.array([encoding[bytes([b])] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[t] for t in tokens], np.int64) for tokens in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.size = max(vocab.values()) + 1
        born = np.full(self.size, NONE, np.int64)
        np.minimum.at(born, made, np.arange(len(made)))
        born[self.byte_id] = -1
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path} merges tokens before they are made")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        one = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.of_bytes = self.rank(*one)
        self.window = 2 * max(map(len, encoding))
        special = sorted(textbatch.added_tokens(path), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(len(key), NONE, np.int32)


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def _chosen(rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The places of ``hit`` that are merged: of pairs that overlap, which are equal, each second one from the left.

    A row of equal pairs whose first isn't a hit waits: what lies before may still take its first symbol.
    """
    at = np.flatnonzero(hit)
    again = at[(at > 0) & (rank[at - 1] == rank[at])]
    if not len(again):
        return at
    first = np.append(True, (np.diff(at) > 1) | (rank[at[1:]] != rank[at[:-1]]))
    start = at[first][np.cumsum(first) - 1]
    free = (start == 0) | (rank[start - 1] != rank[start])
    return at[free & ((at - start) % 2 == 0)]


def surviving(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Merges) -> np.ndarray:
    """How many tokens each span of the bytes has; empty spans have none."""
    size = ends - starts
    count = size.astype(np.int64)
    raw = textbatch.ragged_spans(data, starts, size)
    if not len(raw):
        return count
    windows = -(-size // table.window)
    begin = np.cumsum(windows) - windows
    sequence = np.repeat(np.arange(len(size)), windows)  # of each window
    offset = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    window = np.repeat(begin, size) + offset // table.window
    symbol = table.byte_id[raw]
    last = np.zeros(len(raw), bool)
    last[(np.cumsum(size) - 1)[size > 0]] = True
    rank = np.full(len(raw), NONE, np.int32)
    rank[:-1] = table.of_bytes[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    rank[last] = NONE
    beside = np.flatnonzero(sequence[1:] == sequence[:-1])  # windows with another of their sequence after them
    while True:
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        least = np.full(len(sequence), NONE, np.int32)
        least[window[first]] = np.minimum.reduceat(rank, first)
        busy = np.zeros(len(size), bool)
        busy[sequence[least < NONE]] = True
        open_ = busy[sequence[window]]
        if not open_.all():  # sequences without a pair are done
            window, symbol, last, rank = window[open_], symbol[open_], last[open_], rank[open_]
        if not len(rank):
            return count
        around = least.copy()
        if len(beside):
            around[beside] = np.minimum(around[beside], least[beside + 1])
            around[beside + 1] = np.minimum(around[beside + 1], least[beside])
        at = _chosen(rank, (rank == around[window]) & (rank < NONE))
        count -= np.bincount(sequence[window[at]], minlength=len(size))
        symbol[at], last[at] = table.made[rank[at]], last[at + 1]
        keep = np.ones(len(rank), bool)
        keep[at + 1] = False
        window, symbol, last, rank = window[keep], symbol[keep], last[keep], rank[keep]
        new = at - np.arange(len(at))
        changed = np.concatenate([new, new[new > 0] - 1])
        ended = last[changed]
        rank[changed[ended]] = NONE
        changed = changed[~ended]
        rank[changed] = table.rank(symbol[changed], symbol[changed + 1])


def special_spans(whole: bytes, offsets: np.ndarray, pattern: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of added tokens stand, each within one document."""
    found, at = [], 0
    while pattern is not None and (m := pattern.search(whole, at)):
        a, b = m.span()
        inside = b <= offsets[np.searchsorted(offsets, a, "right")]
        found += [(a, b)] if inside else []
        at = b if inside else a + 1
    return (np.array(found, np.int64).reshape(-1, 2)).T


def count_chunk(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each document of a chunk."""
    table, docs = merges(path), len(offsets) - 1
    begins, stops = special_spans(data.tobytes(), offsets, table.special)
    cut = np.union1d(offsets, np.concatenate([begins, stops])) if len(begins) else offsets
    starts, ends, _ = textbatch.pattern_tokens(data, cut)
    if len(begins):
        at = np.searchsorted(begins, starts, "right") - 1
        plain = (at < 0) | (starts >= stops[at])
        starts, ends = starts[plain], ends[plain]
    total = np.bincount(np.searchsorted(offsets, begins, "right") - 1, minlength=docs).astype(np.int64)
    if len(starts):
        codes, _, first = textbatch.distinct_spans(data, starts, ends)
        tokens = surviving(data, starts[first], ends[first], table)[codes]
        total += np.bincount(np.searchsorted(offsets, starts, "right") - 1, tokens, docs).astype(np.int64)
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 512, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, as the tokenizers library counts whole texts with the file ``path``.

    Null and empty texts have no bytes and no tokens.  Strings of added tokens in
    a text count as one token, as the library takes them by default.  Rows
    without an id or with a repeated one keep a row each; other columns aren't
    read.  The file must hold byte-level merges in the order of their ids
    (ValueError otherwise).  Equal pre-tokens of a chunk of about ``chunk_bytes``
    are merged once; a longer text is a chunk of its own.
    """
    merges(path)  # a wrong file fails here
    own = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, own.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text", chunk_bytes):
            tokens = count_chunk(data, offsets, path)
            names = batch.column(0)
            out = pa.schema([(id_col, names.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            yield shared.rows(out, names, np.diff(offsets), tokens, tokens > limit)

    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, schema)
