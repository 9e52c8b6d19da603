"""Operator 7: exact top-k by a bit-sliced index.

Vectors are quantised to floor(scale * x) and dealt into blocks of rows, queries
into parts; a task has one block and one part, so that a block's rows are sent
once for each part.  A block's index is bitmaps: bit b of attribute d of all its
rows, complemented for negative query components.  An integer inner product is the sum
of bitmaps with weights of powers of two; carry-save adders reduce the bitmaps
of each weight, which leaves the scores as slices.  The best rows are selected
from the most significant slice downward; the rows at the boundary all have
one score, and the smallest ids among them complete the result exactly.

Components may be of any size: rows whose products might not fit a long have an
index of their own, of as many slices as their integers need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

BLOCK_ROWS, BLOCK_QUERIES = 1 << 15, 1 << 10


def slices(q: np.ndarray) -> np.ndarray:
    """Bitmaps [attribute, bit, word] of integer rows [row, attribute], raised by their lowest value; Python integers of any size as well."""
    low = int(q.min()) if q.size else 0
    bits = max(1, (int(q.max()) - low).bit_length()) if q.size else 1
    size = -(-bits // 8)
    if q.dtype == object:
        octets = np.frombuffer(b"".join(int(v - low).to_bytes(size, "little") for v in q.ravel()), np.uint8).reshape(*q.shape, size)
    else:
        octets = (q.astype(np.int64) - low).astype("<u8")[..., None].view(np.uint8)
    rows, dims = q.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((octets[:, :, b // 8] >> (b % 8)) & 1).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def score_slices(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """The scores, raised by a constant of the query, as slices from the least significant."""
    dims, bits, words = index.shape
    flat = index.reshape(dims * bits, words)
    size, turned = np.abs(query), np.repeat(np.where(query < 0, ~np.uint64(0), np.uint64(0)), bits)
    columns: list[list[np.ndarray]] = []
    for j in range(int(size.max()).bit_length() if len(size) else 0):
        row = np.flatnonzero((size >> j) & 1) * bits
        for b in range(bits):
            while len(columns) <= j + b:
                columns.append([])
            columns[j + b].append(row + b)
    out, carried, w = [], np.empty((0, words), np.uint64), 0
    while w < len(columns) or len(carried):
        own = np.empty((0, words), np.uint64)
        if w < len(columns) and columns[w]:
            at = np.concatenate(columns[w])
            own = flat[at] ^ turned[at, None]
        stack, carries = np.concatenate([carried, own]), []
        while len(stack) > 2:
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, stack[3 * n :]])
        if len(stack) == 2:
            carries.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        carried = np.concatenate(carries) if carries else np.empty((0, words), np.uint64)
        w += 1
    return out


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select(scores: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores among the live ones, ties to the first rows."""
    sure, equal, missing = np.zeros_like(live), live, k
    for s in reversed(scores):
        upper = equal & s
        n = int(np.bitwise_count(upper).sum())
        if n > missing:
            equal = upper
        else:
            sure, equal, missing = sure | upper, equal & ~s, missing - n
            if missing == 0:
                return _rows_of(sure)
    return np.concatenate([_rows_of(sure), _rows_of(equal)[:missing]])


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_TURN = str.maketrans("0123456789abcdef", "fedcba9876543210")


def beyond(score: int) -> str:
    """A text that puts scores with the same nearest long in order."""
    if LOW <= score <= HIGH:
        return "1"
    text = f"{abs(score).bit_length():06x}{abs(score):x}"
    return f"2{text}" if score > 0 else f"0{text.translate(_TURN)}"


class Block:
    """The rows of a table by id: those of narrow integers, and those whose integers need more room."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.sort_by("_id")
        self.ids, n = table.column("_id").to_numpy(), table.column("_n")[0].as_py()
        wide = table.column("_q").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.parts = []
        if not wide.all():
            values = table.column("_q").combine_chunks().drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int((~wide).sum()), n)
            self.parts.append((np.flatnonzero(~wide), values))
        if wide.any():
            rows = [[int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x] for x in table.column("_x").combine_chunks().drop_null().to_pylist()]
            self.parts.append((np.flatnonzero(wide), np.array(rows, object).reshape(len(rows), n)))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", *, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of the highest integer inner product, its own id apart.

    Ties go to the smaller vec_id.  Vectors that are null, that hold a null or a
    component that isn't finite, or that have no id, take no part, as queries
    neither.  Scores are exact, whatever the components' size, and so is the order;
    a score that doesn't fit a long is given as the nearest long.  Vectors are compared
    with queries of the same length; empty ones score 0.  Rows that repeat an id are
    each a candidate; queries that repeat an id count once, with the smallest vector.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
        narrow = F.forall(v, lambda x: F.abs(x.cast("double")) * scale < F.sqrt(F.lit(2.0**62) / F.size(v)) - 1)  # their products fit a long
        q = F.when(narrow, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))
        return df.where(fine).select(F.col(id_col).cast("long").alias("_id"), F.size(v).alias("_n"), q.alias("_q"), F.when(~narrow, F.transform(v, lambda x: x.cast("double"))).alias("_x"))

    # of equal rows with one id no more than k can be among the best
    own = shared.written(whole(vectors).groupBy("_n", "_id", "_q", "_x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_copies")), "vectors")
    asked = whole(queries).groupBy("_id").agg(F.min(F.struct("_q", "_x", "_n")).alias("_m")).select("_m._n", "_id", "_m._q", "_m._x")
    asked = shared.written(asked, "queries")
    blocks = lambda c, size: F.ceil(F.sum(c) / size).cast("int")
    sizes = shared.written(own.groupBy("_n").agg(blocks("_copies", block_rows).alias("_blocks")).join(asked.groupBy("_n").agg(blocks(F.lit(1), block_queries).alias("_parts")), "_n"), "sizes")
    tasks = sizes.agg(F.sum(F.col("_blocks") * F.col("_parts"))).first()[0] or 1
    largest = max(df.agg(F.max(F.array_max(F.transform("_q", F.abs)))).first()[0] or 0 for df in (own, asked))
    narrow = next(kind for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if largest < 1 << bits)
    key = ["_n", "_b", "_p"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("_id", "_q", "_x"), F.col(n)).cast("int")
    rows = own.join(sizes, "_n").select("_n", place("_blocks").alias("_b"), "_parts", "_id", "_q", "_x", F.explode(F.sequence(F.lit(1), "_copies"))).select("_n", "_b", each("_parts").alias("_p"), "_id", F.col("_q").cast(f"array<{narrow}>").alias("_q"), "_x")
    dealt = asked.join(sizes, "_n").select("_n", each("_blocks").alias("_b"), place("_parts").alias("_p"), "_id", F.col("_q").cast(f"array<{narrow}>").alias("_q"), "_x")

    def compare(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return _BEST.empty_table()
        own, asking, best = Block(block, scale), Block(part, scale), []
        indexes = []
        for rows, values in own.parts:
            bitmaps, live = slices(values), np.packbits(np.ones(len(rows), bool), bitorder="little")
            indexes.append((own.ids[rows], values, bitmaps, np.pad(live, (0, bitmaps.shape[2] * 8 - len(live))).view(np.uint64)))
        for places, wanted in asking.parts:
            for name, query in zip(asking.ids[places].tolist(), wanted if wanted.dtype == object else wanted.astype(np.int64), strict=True):
                for ids, values, bitmaps, everyone in indexes:
                    live = everyone.copy()
                    for at in range(int(np.searchsorted(ids, name)), int(np.searchsorted(ids, name, "right"))):
                        live[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
                    at = select(score_slices(bitmaps, query), live, k)
                    if values.dtype == object or query.dtype == object:
                        exact = [sum(x * y for x, y in zip(values[i].tolist(), query.tolist(), strict=True)) for i in at.tolist()]
                        score, order = np.array([min(HIGH, max(LOW, v)) for v in exact], np.int64), list(map(beyond, exact))
                    else:
                        score, order = values[at].astype(np.int64) @ query, ["1"] * len(at)
                    best.append((np.full(len(at), name), ids[at], score, order))
        return pa.table([np.concatenate(c) for c in zip(*best, strict=True)], schema=_BEST)

    spread = min(4 * tasks, tasks + 2000)  # groups are hashed: with few of them, more partitions than groups
    best = rows.repartition(spread, *key).groupBy(*key).cogroup(dealt.repartition(spread, *key).groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
