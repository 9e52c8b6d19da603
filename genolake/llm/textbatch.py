"""Vectorised helpers for text in Arrow batches, used inside Spark tasks.

Everything here works on a *chunk*: the UTF-8 bytes of a few megabytes of
documents and the offsets of the documents in them.  Null texts count as empty.
"""

from __future__ import annotations

import array
import ctypes
import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: ASCII white space: blank and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
OTHER, LETTER, NUMBER, SPACE = range(4)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the offsets of its rows, from 0."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text (one row at least), with their bytes and offsets."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
        release()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives freed memory back to the system: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := _libc():
        trim(0)


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words [^\\x20\\x09-\\x0D]+; no word crosses documents."""
    solid = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


@functools.cache
def code_point_classes() -> np.ndarray:
    """For each code point: letter, number, white space or other, by Unicode."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    for base in [*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)]:
        every = "".join(map(chr, range(base, base + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                kinds[base + m.start() : base + m.end()] = kind
    return kinds


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and where each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.flatnonzero((data & 0xC0) != 0x80)


def _runs(points: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class in a document, and whether another run of it follows."""
    n = len(points)
    kind = code_point_classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(at, offsets)] = True
    breaks = fresh[:n].copy()
    breaks[0] = True
    breaks[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(breaks)
    stop = np.append(run[1:], n)
    return run, stop, kind[run], ~fresh[stop]


def _contractions(mark: np.ndarray, points: np.ndarray, run: np.ndarray, size: np.ndarray, what: np.ndarray, free: np.ndarray) -> None:
    """Moves marks so that a lone apostrophe takes s, t, m, d, re, ve or ll from the letters after it."""
    quote = np.flatnonzero(free & (what == OTHER) & (size == 1) & (points[run] == 0x27))
    quote = quote[what[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        begin, length = run[quote + 1], size[quote + 1]
        one = points[begin]
        two = np.where(length > 1, points[np.minimum(begin + 1, len(points) - 1)], 0)
        taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            taken[(one == ord(a)) & (two == ord(b))] = 2
        mark[begin[taken > 0]] = False
        mark[(begin + taken)[(taken > 0) & (length > taken)]] = True


def pattern_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the matches of

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    in each document, in bytes.  The matches cover the text, so that only their
    starts are needed: runs of one class begin a match, a blank before a run
    joins it, and an apostrophe alone takes the letters of a contraction along.
    """
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    points, at = _points(data)
    run, stop, what, followed = _runs(points, at, offsets)
    space, size = what == SPACE, stop - run
    joins = space & followed & (points[stop - 1] == 0x20)  # its last blank goes with the next run
    attached = np.append(False, joins[:-1])
    mark = np.zeros(len(points) + 1, bool)
    mark[run[space & ((size > 1) | ~joins)]] = True
    mark[stop[space & followed] - 1] = True
    mark[run[~space & ~attached]] = True
    _contractions(mark, points, run, size, what, ~attached & followed)
    starts = at[np.flatnonzero(mark[:-1])]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def lower_case_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the matches of

        's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+

    in the lower-case form of documents of code points below U+0300, in bytes of the texts as they are.
    Such code points have two bytes at most, so that classes are those of bytes.
    """
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    classes = code_point_classes()[:0x300]
    kind = np.frombuffer(bytearray(data.tobytes().translate(classes[:256].tobytes())), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = classes[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    fresh = np.zeros(n + 4, bool)
    fresh[offsets] = True
    fresh[n:] = True
    mark = fresh.copy()
    mark[1:n] |= kind[1:] != kind[:-1]
    # a lone apostrophe takes s, t, m, d, re, ve or ll from the letters after it
    quote = np.flatnonzero(data == 0x27)
    quote = quote[mark[quote] & mark[quote + 1] & ~fresh[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    one, two = (data[np.minimum(quote + k, n - 1)] | 0x20 for k in (1, 2))
    single = ~mark[quote + 2]
    pair = single & np.isin(one.astype(np.int64) << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
    alone = np.isin(one, [ord(c) for c in "stmd"])
    longer = quote[pair & ~mark[quote + 3]] + 3, quote[alone & single] + 2
    mark[quote[alone | pair] + 1] = False
    for at in longer:
        mark[at] = True
    mark[:n] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    begins = np.flatnonzero(mark[: n + 1])
    solid = np.flatnonzero(kind[begins[:-1]] != SPACE)
    starts, ends = begins[solid], begins[solid + 1]
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, from its 8-byte blocks, its length and the salt."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    keep = np.append((np.uint64(1) << (8 * np.arange(8, dtype=np.uint64))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    out = _mixed((blocks[starts] & keep[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xA0761D6478BD642F))
    long = np.flatnonzero(length > 1024)
    if len(long):
        import xxhash

        out[long] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes(), salt) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    more = np.flatnonzero((length > 8) & (length <= 1024))
    at = 8
    while len(more):
        part = blocks[starts[more] + at] & keep[np.minimum(length[more] - at, 8)]
        out[more] = _mixed(out[more] + part * np.uint64(0xD6E8FEB86659FD93))
        at += 8
        more = more[length[more] > at]
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the hashes, the distinct hashes, and where each comes first."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, values, first


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the spans, the distinct hashes, and where each comes first.

    The hash tells spans of up to 8 bytes and one length apart.  Longer spans of
    one code are compared by length and last 8 bytes, and those over 16 bytes by a
    second hash: two that only share the first hash get codes of their own.
    """
    codes, values, first = distinct(word_hashes(data, starts, ends))
    long = np.flatnonzero(ends - starts > 8)
    if not len(long):
        return codes, values, first
    blocks = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    end, like = ends[long], first[codes[long]]
    length = end - starts[long]
    same = length == ends[like] - starts[like]
    odd = ~same.all()
    if not odd:
        odd = (blocks[end - 8] != blocks[ends[like] - 8]).any()
        wide = np.flatnonzero(length > 16)
        if not odd and len(wide):
            at = long[wide]
            again = np.zeros(len(values), np.uint64)
            second = word_hashes(data, starts[at], ends[at], 1)
            again[codes[at]] = second
            odd = (again[codes[at]] != second).any()
    if odd:  # a collision: by bytes
        table: dict[bytes, int] = {}
        codes = np.array([table.setdefault(w, len(table)) for w in spans(data, starts, ends)])
        first = np.unique(codes, return_index=True)[1]
        values = word_hashes(data, starts[first], ends[first])
    return codes, values, first


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def ragged_places(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans of an array, one after the other."""
    if (size == 0).any():
        starts, size = starts[size > 0], size[size > 0]
    ends = np.cumsum(size)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(ends):
        steps[0] = starts[0]
        steps[ends[:-1]] = starts[1:] - (starts[:-1] + size[:-1] - 1)
    return np.cumsum(steps)


def ragged_spans(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of an array, one after the other."""
    return values[ragged_places(starts, size)]


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged array, one after the other, and their lengths."""
    size = offsets[pick + 1] - offsets[pick]
    return ragged_spans(values, offsets[pick], size), size


def bounds(counts_by: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Offsets of n groups: what lies before each, from the group of each row (ascending) and the row's weight."""
    return np.append(0, np.cumsum(np.bincount(counts_by, weights, n).astype(np.int64)))


class SpanEncoder:
    """Encodes chunks through their distinct spans; a bounded table by hash keeps what a worker has encoded.

    ``encode`` turns a list of spans into a list of their ids, each as packed 32-bit integers.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.check, self.start, self.size, self.flat = (np.empty(0, kind) for kind in (np.uint64, np.uint64, np.int32, np.int32, np.int32))

    def learn(self, hashes: np.ndarray, check: np.ndarray, words: list[bytes]) -> None:
        packed = self.encode(words)
        size = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        start = (len(self.flat) + np.cumsum(size) - size).astype(np.int32)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(packed), np.int32)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.check, self.start, self.size = (np.insert(old, at, new[order]) for old, new in ((self.hashes, hashes), (self.check, check), (self.start, start), (self.size, size)))

    def place(self, hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where spans are in the table, by two hashes, and whether they are there."""
        order = np.argsort(hashes)  # neighbours are looked up one after the other
        at = np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        if not len(self.hashes):
            return at, np.zeros(len(hashes), bool)
        at = np.minimum(at, len(self.hashes) - 1)
        return at, (self.hashes[at] == hashes) & (self.check[at] == check)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans, one after the other, and how many each has."""
        if not len(starts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        codes, values, first = distinct_spans(data, starts, ends)
        check = word_hashes(data, starts[first], ends[first], 1)
        if len(self.hashes) > self.most:
            self.clear()
        at, known = self.place(values, check)
        new = np.flatnonzero(~known)
        if len(new):
            self.learn(values[new], check[new], spans(data, starts[first[new]], ends[first[new]]))
            at, known = self.place(values, check)
            if not known.all():  # two spans share a hash: without the table
                packed = self.encode(spans(data, starts[first], ends[first]))
                size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                start = np.cumsum(size) - size
                return ragged_spans(np.frombuffer(b"".join(packed), np.int32), start[codes], size[codes]), size[codes]
        size = self.size[at][codes].astype(np.int64)
        return ragged_spans(self.flat, self.start[at][codes].astype(np.int64), size), size


@functools.cache
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def added_tokens(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in library_tokenizer(path).get_added_tokens_decoder().values())


@functools.cache
def byte_level_encoding(path: str):
    """The byte-level vocabulary of a tokenizers file for tiktoken: printable Latin-1 stands for itself, other bytes for U+0100 and up."""
    import tiktoken

    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    special = {t.decode() for t in added_tokens(path)}
    ranks = {bytes(byte[c] for c in token): k for token, k in library_tokenizer(path).get_vocab().items() if token not in special}
    return tiktoken.Encoding("spans", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


@functools.cache
def specification(path: str) -> dict:
    return json.loads(library_tokenizer(path).to_str())


BYTES, WORDS = "bytes", "words"
#: Fixed value: the split of lower-case word vocabularies, as their files write it; see ``lower_case_tokens``.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def shape(path: str) -> str | None:
    """How texts may be cut before a tokenizers file encodes them, as the file itself says.

    BYTES: byte-level pairs merged in the order of their ids, split by
    ``pattern_tokens``.  WORDS: pairs with word ends, split by ``lower_case_tokens``
    after lower-casing.  None: anything else, which only the library itself encodes.
    """
    spec = specification(path)
    model, normal, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or any(model.get(c) for c in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
        return None
    byte_level = lambda p, regex: p.get("type") == "ByteLevel" and not p["add_prefix_space"] and p.get("use_regex", True) == regex
    if normal is None and not model.get("end_of_word_suffix") and byte_level(pre, True):
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        return BYTES if merged == sorted(merged) and -1 not in merged else None
    steps = (normal or {}).get("normalizers", [])
    split, *rest = pre.get("pretokenizers", [{}])
    lowered = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    cut = split.get("pattern") == {"Regex": WORD_SPLIT} and split.get("behavior") == "Removed" and split.get("invert") and len(rest) == 1 and byte_level(rest[0], False)
    return WORDS if lowered and cut and model.get("end_of_word_suffix") == "</w>" else None


@functools.cache
def letter_word_encoding(path: str):
    """A vocabulary of word ends (WORDS) for tiktoken, of words a to z alone: the last letter of a word is written as a capital.

    None, if tiktoken might give other ids than the library.  It merges two pieces
    wherever the vocabulary has them joined, in the order of the ids; the library
    goes by its list of pairs.  Both are the same if the list is in the order of the
    ids and the library encodes each piece as that piece: two pieces that come
    to stand side by side do so in their joined string alone as well.
    """
    import tiktoken

    tokenizer = library_tokenizer(path)
    model = specification(path)["model"]
    kept = {t: k for t, k in model["vocab"].items() if (w := t.removesuffix("</w>")).isascii() and w.isalpha() and w.islower()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    merged = [k for m in model["merges"] if (k := kept.get("".join(m.split(" ") if isinstance(m, str) else m))) is not None]
    if merged != sorted(set(merged)) or len(merged) + 52 != len(kept) or not {*letters, *(f"{c}</w>" for c in letters)} <= kept.keys():
        return None
    after = "\u01bf"  # a letter that no piece of a to z goes on with
    tail = tokenizer.encode(after, add_special_tokens=False).ids
    whole, parts = ([t for t in kept if t.endswith("</w>") == end] for end in (True, False))
    for some, end, rest in ((whole, "\n", []), (parts, after + "\n", tail)):
        got = tokenizer.encode("".join(t.removesuffix("</w>") + end for t in some), add_special_tokens=False).ids
        if got != [k for t in some for k in (kept[t], *rest)]:
            return None
    ranks = {(w[:-1] + w[-1].upper() if (w := t.removesuffix("</w>")) != t else t).encode(): k for t, k in kept.items()}
    return tiktoken.Encoding("words", pat_str="[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})


#: Bytes of a word that tiktoken takes; longer ones go to the library, whose time grows with the length.
LETTER_WORD = 256


@functools.cache
def span_encoder(path: str) -> SpanEncoder:
    """An encoder for spans that a file's pre-tokenizer doesn't cut, by the tokenizers library or with equal ids, without special tokens."""
    tokenizer = library_tokenizer(path)
    word_end = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, k in tokenizer.get_vocab().items():
        word_end[k] = token.endswith("</w>")

    def cut(ids: list[int]) -> list[bytes]:
        """Each span ends in a token with a word end."""
        ids = np.asarray(ids, np.int32)
        ends, packed = ((np.flatnonzero(word_end[ids]) + 1) * 4).tolist(), ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def by_library(words: list[bytes]) -> list[bytes]:
        """White space is dropped: many spans go as one text."""
        return [x for k in range(0, len(words), 200) for x in cut(tokenizer.encode_batch_fast([b"\n".join(words[k : k + 200]).decode("utf-8")], add_special_tokens=False)[0].ids)]

    def of_letters(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            text = np.frombuffer(b"".join(some).lower(), np.uint8).copy()
            text[np.cumsum(np.fromiter(map(len, some), np.int64, len(some))) - 1] -= 32
            out += cut(letter_word_encoding(path).encode_ordinary(text.tobytes().decode()))
        return out

    def joined(words: list[bytes]) -> list[bytes]:
        if letter_word_encoding(path) is None:
            return by_library(words)
        plain = [w.isalpha() and len(w) <= LETTER_WORD for w in words]
        letters, others = (iter(encode([w for w, p in zip(words, plain, strict=True) if p == kind])) for kind, encode in ((True, of_letters), (False, by_library)))
        return [next(letters) if p else next(others) for p in plain]

    def single(words: list[bytes]) -> list[bytes]:
        """A byte-level vocabulary in the order of its merges: tiktoken gives the same ids for a span, in a third of the time."""
        piece = byte_level_encoding(path)._encode_single_piece
        return [array.array("i", piece(w)).tobytes() for w in words]

    return SpanEncoder(joined if shape(path) == WORDS else single)


def encode_chunk(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a chunk, and the offsets of the documents in them, as the tokenizers library gives for whole texts.

    The chunk is cut where the library's own pre-tokenizer cuts as well.
    Documents that hold the string of an added token, or, for a vocabulary with
    normalised text, code points that normalisation may change, go to the library
    whole, and so does every document of a file of no known shape.
    """
    docs = len(offsets) - 1
    how = shape(path)
    normalised = how == WORDS
    odd = np.full(docs, how is None)
    if normalised:
        high = np.flatnonzero(data >= 0xCC)  # U+0300 and above
        dotted = np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0)) if len(data) else high  # its lower case is two code points
        odd[np.searchsorted(offsets, np.append(high, dotted), "right") - 1] = True
    whole = data.tobytes()
    for token in added_tokens(path):
        at = whole.find(token)
        while at >= 0:
            odd[np.searchsorted(offsets, at, "right") - 1] = True
            at = whole.find(token, at + 1)
    size = np.diff(offsets)
    plain = np.append(0, np.cumsum(np.where(odd, 0, size)))
    kept = data[np.repeat(~odd, size)] if odd.any() else data
    starts, ends, doc = (lower_case_tokens if normalised else pattern_tokens)(kept, plain)
    ids, count = span_encoder(path).ids(kept, starts, ends) if len(starts) else (np.empty(0, np.int32), np.empty(0, np.int64))
    place = bounds(doc, count, docs)
    if odd.any():
        parts = np.split(ids, place[1:-1])
        rows = np.flatnonzero(odd).tolist()
        texts = [whole[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") for k in rows]
        for k, e in zip(rows, library_tokenizer(path).encode_batch(texts, add_special_tokens=False), strict=True):
            parts[k] = np.asarray(e.ids, np.int32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return ids, place
