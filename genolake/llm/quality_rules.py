"""Operator 2: quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, for a chunk of documents at
once in numpy, measure the characters inside n-grams and lines that came before
in the same document.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbatch

#: The largest share of a document's word characters inside repeated n-grams, by n.
#: A short text with one repeated line stays below.
NGRAM_LIMITS = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the n-word windows; none crosses documents."""
    if len(word) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k]
    at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
    return at, textbatch._mixed(h[at] + doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Whether each word lies in one of the windows."""
    depth = np.bincount(at, minlength=words + 1)[: words + 1].astype(np.int64)
    depth -= np.bincount(at + n, minlength=words + 1)[: words + 1]
    return np.cumsum(depth)[:words] > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: Mapping[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """The counts of each document in a chunk; cover_n and line_cover are shares of its word characters."""
    docs = len(offsets) - 1
    starts, ends, doc = textbatch.blank_words(data, offsets)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = points[ends] - points[starts]
    word = textbatch.word_hashes(data, starts, ends)
    total = lambda weights=None, of=doc: np.bincount(of, weights, docs).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": total(), "word_chars": total(chars), "n_symbols": total(of=np.searchsorted(offsets, np.flatnonzero(symbol[data]), "right") - 1)}
    at, h = _windows(word, doc, 3)
    codes, values, _ = textbatch.distinct(h)
    out["n_repeat_words"] = total(_covered(at[np.bincount(codes, minlength=len(values))[codes] > 1], 3, len(word)))
    every = np.maximum(out["word_chars"], 1)
    for n in lengths:
        at, h = _windows(word, doc, n)
        codes, _, first = textbatch.distinct(h)
        again = np.ones(len(at), bool)
        again[first] = False
        out[f"cover_{n}"] = total(chars * _covered(at[again], n, len(word))) / every
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    of = np.searchsorted(offsets, begin, "right") - 1
    # a line ends before its line break, or with its document
    end -= (end > begin) & (data[np.maximum(end - 1, 0)] == 0x0A) if len(end) else 0
    words_before = np.append(0, np.cumsum(~textbatch.BLANK[data] & ((data & 0xC0) != 0x80)))
    inside = words_before[end] - words_before[begin]
    has = np.flatnonzero(inside > 0)
    keys = np.array([xxhash.xxh3_64_intdigest(x) for x in textbatch.spans(data, begin[has], end[has])], np.uint64)
    codes, _, first = textbatch.distinct(textbatch._mixed(keys + of[has].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    again = np.ones(len(has), bool)
    again[first] = False
    out["n_dup_lines"] = total(of=of[has][again])
    out["line_cover"] = total(inside[has][again], of[has][again]) / every
    return out


def verdicts(m: Mapping[str, np.ndarray], limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Whether each document fails the base, and whether it is kept."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~failed & (m["line_cover"] <= line_limit)
    for n, most in limits.items():
        kept &= m[f"cover_{n}"] <= most
    return failed, kept


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    return shared.filtered(docs, text_col, lambda data, offsets: verdicts(measure(data, offsets))[1])


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the measured shares.

    Words are [^\\x20\\x09-\\x0D]+.  base_failed: fewer than ``min_words`` words,
    or more than half of them in 3-word windows that the text has twice.  kept:
    the base holds and no share is over its limit.  Null and empty texts have no
    words and fail the base; each row is judged alone, repeated rows alike.
    """
    shares = [f"cover_{n}" for n in limits] + ["line_cover"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COLUMNS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((c, pa.float64()) for c in shares)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            m = measure(data, offsets, limits)
            failed, kept = verdicts(m, limits, line_limit, min_words)
            yield shared.rows(schema, batch.column(0), *(m[c] for c in _COLUMNS), failed, kept, *(m[c] for c in shares))

    kinds = ", ".join([f"{c} long" for c in _COLUMNS] + ["base_failed boolean", "kept boolean"] + [f"{c} double" for c in shares])
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"doc_id long, {kinds}")
