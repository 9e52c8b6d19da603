"""Operator 3: packing by lexical retrieval.

Documents are dealt to shards of a few million ids, similar ones together: by
clusters of projected term vectors and a tree over the clusters, both fitted on
a sample.  A shard
is one task: it holds a BM25 inverted index of its documents, by token id, with
the corpus's document frequencies.  A seed document queries the index; its unused neighbours,
best first, fill the window, and the document that crosses the window's end is
the next seed.  A shard's documents so form one stream, cut every ``window`` ids;
its last, partial window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread
from . import shared, textbatch

WINDOW = 2048
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
_IDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text, then ``end_id``, as little-endian 16-bit or 32-bit integers."""
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            ids, place = textbatch.encode_chunk(data, offsets, tokenizer)
            ids = np.insert(ids, place[1:], end_id).astype(kind)
            place = place + np.arange(len(place))
            yield shared.rows(_IDS, batch.column(0), np.diff(place), shared.binary_rows(ids, place * ids.itemsize))

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, n long, ids binary")


def id_type(tokenizer: str) -> str:
    return "<u2" if textbatch.library_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def flat_ids(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's documents and how many each has, from its bytes."""
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def distinct(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of documents that lie one after the other, ascending in each, how often each is, and how many a document has: by one sort."""
    kind, shift = (np.uint32, 16) if ids.itemsize == 2 and len(size) <= 1 << 16 else (np.uint64, 32)
    key = np.repeat(np.arange(len(size), dtype=kind), size) << kind(shift) | ids.astype(kind)
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    key = key[at]
    return (key & kind((1 << shift) - 1)).astype(np.int64), np.diff(np.append(at, len(ids))), np.bincount((key >> kind(shift)).astype(np.int64), minlength=len(size))


def document_frequencies(ids: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """In how many documents each id is; a row for each id of the vocabulary at most comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for _, data, offsets in textbatch.chunks(batches, "ids"):
            seen += np.bincount(distinct(*flat_ids(data, offsets, kind))[0], minlength=vocabulary)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[found["id"]] = found["n"]
    return out


DIMENSIONS, DIRECTIONS, SAMPLE, LEAF_SAMPLE, SALTS = 128, 8, 20_000, 32, 1 << 20


def projection(idf: np.ndarray) -> np.ndarray:
    """A row of random signs times its weight for each id of the vocabulary."""
    signs = np.random.default_rng(7).integers(0, 2, (len(idf), DIMENSIONS), np.int8)
    return (2 * signs.astype(np.float32) - 1) * idf.astype(np.float32)[:, None]


def term_vectors(ids: np.ndarray, size: np.ndarray, projected: np.ndarray) -> np.ndarray:
    """The projected term vector of each document, of length 256, in whole numbers: products of them are exact in any order."""
    out = np.zeros((len(size), DIMENSIONS), np.float32)
    terms, counts, length = distinct(ids, size)
    weights, ends = (counts / (counts + K1)).astype(np.float32), np.cumsum(length)
    for k, (a, b) in enumerate(zip((ends - length).tolist(), ends.tolist(), strict=True)):
        out[k] = weights[a:b] @ projected[terms[a:b]]
    return np.rint(256 * out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def clustered(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Cluster centres by spherical k-means, in whole numbers as the vectors."""
    centres = vectors[np.random.default_rng(11).choice(len(vectors), count, replace=False)]
    for _ in range(rounds):
        near = nearest(vectors, centres)
        sums = np.zeros((count, DIMENSIONS))
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, np.rint(256 * sums / np.maximum(size, 1e-9)), centres).astype(np.float32)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((vectors[k : k + 1024] @ centres.T).argmax(axis=1) for k in range(0, len(vectors), 1024))])


def halves(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Directions between two means, from several starts."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(DIRECTIONS):
        way = vectors[rng.integers(len(vectors))] - vectors[rng.integers(len(vectors))]
        for _ in range(4):
            place = vectors @ way
            high = place > np.median(place)
            if high.any() and not high.all():
                way = vectors[high].mean(axis=0) - vectors[~high].mean(axis=0)
        out.append(way / max(1e-9, float(np.linalg.norm(way))))
    return np.array(out)


def grown(vectors: np.ndarray, salt: np.ndarray, weight: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree with a leaf for each shard: directions, bounds (projection, salt) and children; a child below 0 is leaf -1 - child.

    A node cuts its sample across one of the widest directions, where the gap
    near the middle is largest.  Equal vectors are told apart by their salt, so that a
    large group of copies spreads over as many leaves as its ids need.
    """
    direction, bound, child = np.zeros((shards - 1, DIMENSIONS), np.float32), np.zeros((shards - 1, 2)), np.zeros((shards - 1, 2), np.int64)
    todo, nodes, leaves = [(np.arange(len(salt)), shards, -1, 0)], 0, 0
    while todo:
        at, k, parent, side = todo.pop()
        if k == 1:
            child[parent, side] = -1 - leaves
            leaves += 1
            continue
        node, nodes = nodes, nodes + 1
        if parent >= 0:
            child[parent, side] = node
        first = k // 2
        bound[node] = 0, SALTS * first / k
        left = salt[at] < bound[node, 1]
        if len(at) >= 8:
            options = np.concatenate([np.linalg.eigh(np.cov(vectors[at].T.astype(float)))[1][:, : -DIRECTIONS - 1 : -1].T, halves(vectors[at], node)])
            gap, cut, sums = -1.0, 0, np.zeros(0)
            for option in np.rint(256 * options).astype(np.float32):
                place = vectors[at] @ option
                order = np.lexsort((salt[at], place))
                total = np.cumsum(weight[at][order]) / weight[at].sum()
                cuts = np.flatnonzero((total[:-1] >= 0.35) & (total[:-1] <= 0.65)) + 1
                if not len(cuts):
                    cuts = np.array([min(max(1, int(np.searchsorted(total, 0.5))), len(at) - 1)])
                near = max(1, len(at) // 200)
                gaps = place[order][np.minimum(cuts + near - 1, len(at) - 1)] - place[order][np.maximum(cuts - near, 0)]
                best = cuts[gaps == gaps.max()]
                if gaps.max() > gap:
                    gap, cut, sums = gaps.max(), int(best[np.argmin(np.abs(total[best - 1] - 0.5))]), total
                    direction[node], bound[node] = option, (place[order[cut]], salt[at][order[cut]])
            place = vectors[at] @ direction[node]
            left = (place < bound[node, 0]) | ((place == bound[node, 0]) & (salt[at] < bound[node, 1]))
            first = min(max(1, round(k * float(sums[cut - 1]))), k - 1)
        todo += [(at[~left], k - first, node, 1), (at[left], first, node, 0)]
    return direction, bound, child


def leaf_of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    direction, bound, child = tree
    node = np.zeros(len(vectors), np.int64)
    while len(go := np.flatnonzero(node >= 0)):
        at = node[go]
        place = np.einsum("ij,ij->i", vectors[go], direction[at])
        left = (place < bound[at, 0]) | ((place == bound[at, 0]) & (salt[go] < bound[at, 1]))
        node[go] = child[at, np.where(left, 0, 1)]
    return -1 - node


def dealt(ids: DataFrame, kind: str, idf: np.ndarray, rows: int, shards: int) -> DataFrame:
    """Adds the shard of each document: its cluster's leaf.

    Clusters, four or more for a shard, and tree are fitted on a hashed sample
    of some 20,000 documents or 32 a shard.  Rows are told apart by where they are
    stored as well, so that rows that repeat an id and a text can be dealt over shards.
    """
    if shards == 1:
        return ids.withColumn("shard", F.lit(0).cast("long"))
    projected = ids.sparkSession.sparkContext.broadcast(projection(idf))
    salted = ids.withColumn("_row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "doc_id", "_row"), F.lit(SALTS)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch, data, offsets in textbatch.chunks(batches, "ids"):
            found = term_vectors(*flat_ids(data, offsets, kind), projected.value).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column("salt"), batch.column("n"), pa.array([v.tobytes() for v in found], pa.binary())], ["salt", "n", "vector"])

    share = max(SAMPLE, LEAF_SAMPLE * shards) / max(1, rows)
    sample = salted.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "_row"), F.lit(SALTS)) < share * SALTS).mapInArrow(vectors, "salt long, n long, vector binary").toPandas().sort_values(["salt", "n", "vector"])
    fitted = np.frombuffer(b"".join(sample["vector"]), "<i2").reshape(-1, DIMENSIONS).astype(np.float32)
    centres = clustered(fitted, max(1, min(max(256, 4 * shards), len(fitted) // 8))) if len(fitted) else np.zeros((1, DIMENSIONS), np.float32)
    tree = grown(centres[nearest(fitted, centres)], sample["salt"].to_numpy(np.int64), sample["n"].to_numpy(float), shards)
    model = ids.sparkSession.sparkContext.broadcast((centres, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch, data, offsets in textbatch.chunks(batches, "ids"):
            found = term_vectors(*flat_ids(data, offsets, kind), projected.value)
            centres, tree = model.value
            leaf = leaf_of(tree, centres[nearest(found, centres)], batch.column("salt").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n", "ids")] + [pa.array(leaf)], ["doc_id", "n", "ids", "shard"])

    return salted.mapInArrow(run, "doc_id long, n long, ids binary, shard long")


def ordered(lists: list[np.ndarray], idf: np.ndarray, window: int, query_terms: int | None = None) -> list[int]:
    """The order in which a shard's documents enter its stream; a seed asks with all its terms, or the strongest ``query_terms``.

    Documents of the end id alone have no term to ask with or to be found by: they come last, as they stand.
    """
    bare = [k for k, x in enumerate(lists) if len(x) <= 1]
    if bare:
        other = [k for k, x in enumerate(lists) if len(x) > 1]
        found = ordered([lists[k] for k in other], idf, window, query_terms) if other else []
        return [other[k] for k in found] + bare
    docs = len(lists)
    size = np.array([len(x) for x in lists])
    mean = max(1.0, size.mean())
    term_of, counts, length = distinct(np.concatenate(lists), size)
    doc_of = np.repeat(np.arange(docs), length)
    tf = counts.astype(np.float64)
    impact = idf[term_of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc_of] / mean))
    by_term = np.argsort(term_of.astype(lists[0].dtype), kind="stable")  # 16-bit numbers are sorted by their digits
    post_doc, post_impact = doc_of[by_term], impact[by_term]
    values, begins = np.unique(term_of[by_term], return_index=True)
    stops = np.append(begins[1:], len(by_term))
    own = np.append(0, np.cumsum(length))
    # ids that many documents have get a row with a place for each document: at most 8 numbers for each posting
    common = np.flatnonzero(stops - begins >= max(8, docs / 8))
    dense = np.zeros((len(common), docs), np.float32)
    for k, c in enumerate(common.tolist()):
        dense[k, post_doc[begins[c] : stops[c]]] = post_impact[begins[c] : stops[c]]
    row_of = np.full(len(values), -1)
    row_of[common] = np.arange(len(common))
    unused = np.ones(docs, bool)
    order: list[int] = []
    fill, seed, free = 0, None, 0
    while len(order) < docs:
        if seed is None:  # a window begins at its start: the next document that is left
            while not unused[free]:
                free += 1
            seed = free
            unused[seed] = False
            order.append(seed)
            fill = int(size[seed])
        room = -fill % window
        if room == 0:
            seed = None
            continue
        a, b = own[seed], own[seed + 1]
        best = a + (np.argpartition(-impact[a:b], query_terms)[:query_terms] if query_terms and b - a > query_terms else np.arange(b - a))
        at = np.searchsorted(values, term_of[best])
        asked = np.zeros(len(common), np.float32)
        asked[row_of[at[row_of[at] >= 0]]] = 1
        score = (asked @ dense).astype(np.float64)
        at = at[(row_of[at] < 0) & (stops[at] - begins[at] > 1)]  # an id of the seed alone adds to no other document
        if len(at):
            spans = [slice(x, y) for x, y in zip(begins[at].tolist(), stops[at].tolist(), strict=True)]
            score += np.bincount(np.concatenate([post_doc[s] for s in spans]), np.concatenate([post_impact[s] for s in spans]), docs)
        score[~unused] = -1
        near = 16  # neighbours are sorted so many at a time, more each time: short documents need many
        chosen: list[int] = []
        left = int(unused.sum())
        while room > 0 and left:
            if not chosen:
                k, near = min(near, docs), near * 4
                top = np.argpartition(-score, k - 1)[:k]
                chosen = [int(d) for d in top[np.lexsort((top, -score[top]))] if unused[d]][::-1]
            d = chosen.pop()
            unused[d], score[d] = False, -1
            left -= 1
            order.append(d)
            room -= int(size[d])
            seed = d
        fill = -room
        if room == 0:
            seed = None
    return order


def stream_pieces(size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts documents of the given sizes, one after the other: document, start, length, sequence and offset of each piece."""
    ends = np.cumsum(size)
    total = int(ends[-1])
    cuts = list(range(0, total - total % window + 1, window))
    rest = total % window
    while rest:
        part = 1 << (rest.bit_length() - 1)
        cuts.append(cuts[-1] + part)
        rest -= part
    cuts = np.array(cuts)
    begin = np.union1d(ends - size, cuts[:-1])
    stop = np.append(begin[1:], total)
    doc = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right") - 1
    return doc, begin - (ends - size)[doc], stop - begin, sequence, begin - cuts[sequence]


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, window: int = WINDOW, shard_ids: int = 1 << 21, query_terms: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  Each row of the input is a
    document of its own, repeated rows too; ties between neighbours go to the
    smaller place by id.  Every id lies in one piece; sequences are whole
    windows, but for one of each power of two in a shard at most.
    """
    kind, vocabulary = id_type(tokenizer), max(textbatch.library_tokenizer(tokenizer).get_vocab_size(), end_id + 1)
    spark = docs.sparkSession
    ids = shared.written(encoded(docs, tokenizer, end_id, id_col, text_col), "packing")
    total, rows = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    seen = document_frequencies(ids, kind, vocabulary)
    weights = np.log1p((rows - seen + 0.5) / (seen + 0.5))
    idf = spark.sparkContext.broadcast(weights)  # a number for each id of the vocabulary
    shards = max(1, round(total / shard_ids))

    def shard(table: pa.Table) -> pa.Table:
        one_thread()
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        number = int(table.column("shard")[0].as_py())
        names = table.column("doc_id").to_pandas(integer_object_nulls=True).tolist()
        lists = [np.frombuffer(x, kind) for x in table.column("ids").to_pylist()]
        order = ordered(lists, idf.value, window, query_terms)
        size = np.array([len(lists[k]) for k in order])
        doc, start, length, sequence, offset = stream_pieces(size, window)
        crc = [zlib.crc32(lists[order[d]][a : a + n].astype("<u4").tobytes()) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        return pa.table([pa.array([names[order[d]] for d in doc.tolist()], pa.int64()), *(pa.array(c, pa.int64()) for c in (start, length, crc, size[doc], sequence + (number << 32), offset))], schema=_PIECE)

    return dealt(ids, kind, weights, rows, shards).repartition(shards, "shard").groupBy("shard").applyInArrow(shard, PIECE)
