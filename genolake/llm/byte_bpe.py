"""Operator 1: byte-level BPE by ranks.

The distinct words of the corpus are counted; the frequent ones, and of each
batch the words that aren't among them, are encoded by Spark higher-order
functions: a fold that merges the adjacent pair of lowest rank, first place
first, over the word's bytes, with the ranks in a literal map that the plan
holds once.  Decoding concatenates the binary pieces of ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textbatch

#: Ids and ranks have fewer bits, and NO_RANK stands for a pair that doesn't merge.
ID_BITS = 20
NO_RANK = 1 << ID_BITS
#: Slots of the rank map, and groups of pairs that are moved together until all have a slot of their own.
SLOTS, GROUPS = 98317, 16381
#: Most frequent words that are encoded once and sent to every executor; the others are encoded in each batch.
FREQUENT = 1 << 19
#: Text of a chunk: a task has two workers with a copy of the frequent words each, so that what else they hold is kept small.
CHUNK = 1 << 20
#: Longer words (in bytes) are merged with a heap in Python: the fold takes the square of the length.
LONG_WORD = 256


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def merges(path: str) -> dict[tuple[int, int], int]:
    """The pair of ids that merges into each id.

    A piece is only ever made by the last of the merges of its own bytes: merges
    inside it come in the same order in any word, until one crosses its ends.
    """
    ranks, out = read_ranks(path), {}
    for piece, rank in ranks.items():
        parts = [bytes([b]) for b in piece]
        while len(parts) > 2:
            low, k = min((ranks.get(x + y, NO_RANK), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if low == NO_RANK:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


def rank_map(path: str) -> tuple[Column, int, int]:
    """The ranks as one literal, and its numbers of slots and groups: the ids of bytes, and a map from pairs of ids to ranks.

    A pair's key is its two ids in one number; the map is two arrays, so that a
    key is found without a search: ``moves`` by key modulo GROUPS, and ``slots`` by
    key and move modulo SLOTS, with key and rank in one number.
    """
    pairs = merges(path)
    if not pairs or max(pairs.values()) >= NO_RANK or len(pairs) + 256 != len(read_ranks(path)):
        raise ValueError("a vocabulary of fewer than 2^20 ids is needed, each a byte or reached by merges")
    slots_, groups = max(SLOTS, 2 * len(pairs) | 1), max(GROUPS, len(pairs) // 3 | 1)
    keys = np.array([a << ID_BITS | b for a, b in pairs])
    full = keys << ID_BITS | np.array(list(pairs.values()))
    group = keys % groups
    order = np.argsort(group, kind="stable")
    slots, moves = np.full(slots_, 1 << 3 * ID_BITS), np.zeros(groups, np.int64)
    for part in sorted(np.split(order, np.flatnonzero(np.diff(group[order])) + 1), key=len, reverse=True):
        move = 0
        while (slots[at := (keys[part] + move) % slots_] != 1 << 3 * ID_BITS).any() or len(set(at.tolist())) < len(at):
            move += 1
        slots[at], moves[group[part[0]]] = full[part], move
    ranks = read_ranks(path)
    table = {"bytes": [ranks[bytes([k])] for k in range(256)], "moves": moves.tolist(), "slots": slots.tolist()}
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "bytes array<bigint>, moves array<bigint>, slots array<bigint>"), slots_, groups


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def folded(word: Column, table: tuple[Column, int, int]) -> Column:
    """The ids of a word, by merges over its bytes; see ``folds`` for many words of a row."""
    literal, slots, groups = table
    return _let(literal, lambda t: _fold(word, t, slots, groups))


def folds(words: Column, table: tuple[Column, int, int]) -> Column:
    """The ids of each word of an array."""
    literal, slots, groups = table
    return _let(literal, lambda t: F.transform(words, lambda word: _fold(word, t, slots, groups)))


def _fold(word: Column, table: Column, slots: int, groups: int) -> Column:
    """A piece is one number: the rank of the piece joined with its successor
    (NO_RANK if they don't merge), its place among the pieces and its id.  The
    smallest number is the pair of lowest rank, the first of them; a step merges
    that pair and ranks the new piece with its neighbours.
    """
    low_bits = F.lit(NO_RANK - 1)
    of = lambda piece: piece.bitwiseAND(low_bits)
    place = lambda piece: F.shiftright(piece, ID_BITS).bitwiseAND(low_bits).cast("int")
    packed = lambda rank, at, i: F.shiftleft(rank, 2 * ID_BITS) + F.shiftleft(at.cast("bigint"), ID_BITS) + i

    def ranked(left: Column, right: Column) -> Column:
        """The rank of a pair: what else the slot holds is larger than NO_RANK, and no successor (null) is skipped."""
        key = F.shiftleft(left, ID_BITS) + right
        move = F.get(table["moves"], (key % groups).cast("int"))
        return F.least(F.get(table["slots"], ((key + move) % slots).cast("int")).bitwiseXOR(F.shiftleft(key, ID_BITS)), F.lit(NO_RANK).cast("bigint"))

    def merged(pieces: Column, low: Column, k: Column) -> Column:
        new, before, after = F.shiftright(low, 2 * ID_BITS), F.get(pieces, k - 1), F.get(pieces, k + 2)
        here = packed(ranked(new, of(after)), k, new)
        left = packed(ranked(of(before), new), k - 1, of(before))
        rest = F.transform(F.slice(pieces, k + 3, F.size(pieces)), lambda x: x - F.lit(NO_RANK))  # one place to the left
        return F.when(k > 0, F.concat(F.slice(pieces, 1, k - 1), F.array(left, here), rest)).otherwise(F.concat(F.array(here), rest))

    def step(pieces: Column, _: Column) -> Column:
        return _let(F.array_min(pieces), lambda low: F.when(low >= F.lit(NO_RANK << 2 * ID_BITS), pieces).otherwise(_let(place(low), lambda k: merged(pieces, low, k))))

    latin = F.decode(word, "ISO-8859-1")  # a code point for each byte
    ids = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.get(table["bytes"], F.ascii(F.substring(s, k, F.lit(1)))))
    start = _let(_let(latin, ids), lambda i: F.transform(i, lambda x, k: packed(ranked(x, F.get(i, k + 1)), k, x)))
    end = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), start, step, lambda pieces: F.transform(pieces, lambda x: of(x).cast("int")))
    return F.when(F.length(word) > 0, end).otherwise(F.array().cast("array<int>"))


def merged_by_heap(word: bytes, path: str) -> list[int]:
    """The ids of a long word: the same merges, with the pairs in a heap by rank and place."""
    pairs, ranks, n = merges(path), read_ranks(path), len(word)
    ids: list[int | None] = [ranks[bytes([b])] for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, k, k + 1) for k in range(n - 1) if (rank := pairs.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, m = heapq.heappop(heap)
        if ids[k] is None or m >= n or ids[m] is None or after[k] != m or pairs.get((ids[k], ids[m])) != rank:
            continue  # one of the two has merged with another
        ids[k], ids[m], after[k] = rank, None, after[m]
        if after[k] < n:
            before[after[k]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y < n and (new := pairs.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (new, x, y))
    return [x for x in ids if x is not None]


def _words(docs: DataFrame) -> DataFrame:
    """(word, n) of the corpus, counted in chunks before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in textbatch.chunks(batches, "_text"):
            starts, ends, _ = textbatch.pattern_tokens(data, offsets)
            codes, _, first = textbatch.distinct_spans(data, starts, ends)
            count = np.bincount(codes, minlength=len(first))
            short = (ends - starts)[first] <= LONG_WORD
            yield shared.rows(schema, textbatch.spans(data, starts[first][short], ends[first][short]), count[short])

    return docs.select("_text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, table: tuple[Column, int, int], most: int) -> tuple[np.ndarray, ...]:
    """At most ``most`` words, those above a count that so many reach: two hashes, ordered by the first; where their ids begin, how many they are, and the ids.

    Tasks send what they have found packed, a row for each batch.
    """
    words = shared.written(_words(docs), "words")
    tiers = words.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("tier")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("tier")).collect()  # a few hundred rows
    total, least = 0, None
    for tier in tiers:
        total += tier["words"]
        if total > most:
            break
        least = tier["least"]
    kinds = (("hash", "<u8"), ("check", "<u8"), ("size", "<u2"), ("ids", "<i4"))
    schema = pa.schema([(c, pa.binary()) for c, _ in kinds])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textbatch.text_buffers(batch.column(0))
            ids = batch.column(1)
            size = ids.value_lengths().to_numpy(zero_copy_only=False).astype("<u2")
            hashes = [textbatch.word_hashes(data, at[:-1], at[1:], k) for k in (0, 1)]
            yield shared.rows(schema, *([x.tobytes()] for x in (*hashes, size, ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"))))

    found = None
    if least is not None:
        found = words.where(F.col("n") >= least).select("word", folded(F.col("word"), table).alias("ids")).mapInArrow(packed, "hash binary, check binary, size binary, ids binary").toArrow()
    hashes, check, size, flat = (np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in (found.column(c) if found else ()))]) for c, kind in kinds)
    start = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
    order = np.argsort(hashes)
    shared.drop(words)
    return hashes[order], check[order], start[order], size[order], flat


_CHUNK = "doc_ids array<long>, doc_words binary, codes binary, known binary, rare array<binary>, long array<binary>"
_CHUNK_SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("doc_words", "codes", "known")), ("rare", pa.list_(pa.binary())), ("long", pa.list_(pa.binary()))])
IDS = "doc_id long, n_tokens long, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
RARE, LONG = -1, -2


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", *, frequent: int = FREQUENT, then: Callable | None = None, schema: str = IDS) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids as little-endian 32-bit integers, equal to tiktoken's encode_ordinary.

    Null and empty texts have no ids; each row is encoded alone, repeated rows
    alike.  ``frequent`` bounds what is broadcast, not what is encoded.  ``then``
    turns the batches of these rows into others, of ``schema``, in the same worker.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    table = rank_map(rank_path)
    sent = own.sparkSession.sparkContext.broadcast(frequent_words(own, table, frequent))  # bounded by ``frequent``

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, check = sent.value[:2]
        for batch, data, offsets in textbatch.chunks(batches, "_text", CHUNK):
            starts, ends, doc = textbatch.pattern_tokens(data, offsets)
            codes, values, first = textbatch.distinct_spans(data, starts, ends)
            begin, end = starts[first], ends[first]
            known = np.full(len(values), RARE, "<i4")
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                same = np.flatnonzero(hashes[at] == values)
                same = same[check[at[same]] == textbatch.word_hashes(data, begin[same], end[same], 1)]
                known[same] = at[same]
            known[(known == RARE) & (end - begin > LONG_WORD)] = LONG
            rare, long = known == RARE, known == LONG
            names = pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0))
            merged = [np.array(merged_by_heap(w, rank_path), "<i4").tobytes() for w in textbatch.spans(data, begin[long], end[long])]
            yield shared.rows(_CHUNK_SCHEMA, names, [textbatch.bounds(doc, None, batch.num_rows).astype("<i8").tobytes()], [codes.astype("<i4").tobytes()], [known.tobytes()], [textbatch.spans(data, begin[rare], end[rare])], [merged])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, known_start, known_size, known_ids = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column(0)[k].values
                place, codes, known = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, "<i8"), (2, "<i4"), (3, "<i4")))
                rare = batch.column(4)[k].values
                long = [np.frombuffer(x, "<i4") for x in batch.column(5)[k].as_py()]
                start, size = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
                old = known >= 0
                start[old], size[old] = known_start[known[old]], known_size[known[old]]
                size[known == RARE], size[known == LONG] = rare.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in long]
                new = np.concatenate([np.flatnonzero(known == RARE), np.flatnonzero(known == LONG)])
                start[new] = len(known_ids) + np.cumsum(size[new]) - size[new]
                own_ids = np.concatenate([rare.flatten().to_numpy(zero_copy_only=False).astype("<i4"), *long])
                count = size[codes]
                at = textbatch.ragged_places(start[codes], count)
                mine = at >= len(known_ids)
                ids = np.empty(len(at), "<i4")
                ids[~mine], ids[mine] = known_ids[at[~mine]], own_ids[at[mine] - len(known_ids)]
                ends = np.append(0, np.cumsum(count))[place]
                yield shared.rows(_IDS, names, np.diff(ends), shared.binary_rows(ids, 4 * ends))
            textbatch.release()

    chunked = own.mapInArrow(split, _CHUNK).select("doc_ids", "doc_words", "codes", "known", folds(F.col("rare"), table).alias("rare_ids"), "long")
    return chunked.mapInArrow(lambda batches: then(assembled(batches)) if then else assembled(batches), schema)


TEXT = IDS + ", text binary"
_TEXT = _IDS.append(pa.field("text", pa.binary()))


def decoder(rank_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``text`` to batches of (doc_id, n_tokens, ids): the pieces of the ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [piece for piece, _ in sorted(read_ranks(rank_path).items(), key=lambda x: x[1])]
        flat, offsets = np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(p) for p in pieces]))
        for batch, data, at in textbatch.chunks(batches, "ids"):
            text, size = textbatch.ragged(flat, offsets, data.view("<i4").astype(np.int64))
            yield shared.rows(_TEXT, *batch.columns, shared.binary_rows(text, np.append(0, np.cumsum(size))[at // 4]))

    return run


def decode(ids: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of rows of ``encode``: the pieces of the ids, concatenated, as binary."""
    return ids.select("doc_id", "n_tokens", "ids").mapInArrow(decoder(rank_path), TEXT)
