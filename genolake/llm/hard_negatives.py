"""Operator 12: hard negatives by product quantisation with stored residual norms.

Vectors are cut in pairs of components; each pair is stored as the number of the
nearest of 256 centroids, and each row with the norm of what its centroids leave
over.  For an anchor, sums of table entries give a row's score to within
(norm of the anchor) x (residual norm), by Cauchy and Schwarz.  Only rows whose
interval can reach an anchor's best positives, or the best of a window, are scored
exactly, in integers.

The index is a table with a row for each block of vectors.  Anchors, in parts,
meet all blocks; a block gives a few rows for each anchor, whatever it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

CENTROIDS, WIDTH = 256, 2
#: Components of a block of the index, of a part of the anchors, and, about, of the sample that centroids are fitted on.
BLOCK, PART, SAMPLE = 1 << 19, 1 << 14, 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1
PACKED = "_n int, _b int, ids binary, labels binary, vectors binary, scores binary, codes binary, residuals binary"
_PACKED = pa.schema([("_n", pa.int32()), ("_b", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "scores", "codes", "residuals"))])
_FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _pieces(x: np.ndarray) -> np.ndarray:
    """Rows of components as (row, piece, WIDTH), filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def fit(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """(piece, CENTROIDS, WIDTH): centroids of each piece by Lloyd's rounds, from rows spread over the sample."""
    pieces = _pieces(x)
    centroids = pieces[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)].transpose(1, 0, 2).copy()
    for c, y in zip(centroids, pieces.transpose(1, 0, 2), strict=True):
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
            n = np.bincount(near, minlength=CENTROIDS)
            for k in range(WIDTH):
                c[:, k] = np.where(n, np.bincount(near, y[:, k], CENTROIDS) / np.maximum(n, 1), c[:, k])
    return centroids


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows, and the norm of what they leave over, rounded up by more than floating point can err."""
    pieces = _pieces(x)
    codes = np.empty(pieces.shape[:2], np.uint8)
    left = np.zeros(len(x))
    for k, c in enumerate(centroids):
        y = pieces[:, k]
        codes[:, k] = ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
        left += ((y - c[codes[:, k]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9) + np.sqrt((x * x).sum(1)) * 1e-9 + 1e-6


def estimates(anchors: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Scores (anchor, row) of the rows' centroids, from tables of each anchor's products with them."""
    out = np.zeros((len(anchors), len(codes)))
    for k, (a, c) in enumerate(zip(_pieces(anchors).transpose(1, 0, 2), centroids, strict=True)):
        out += (a @ c.T)[:, codes[:, k]]
    return out


class Rows:
    """Vectors as integers floor(scale * x).

    ``values`` holds those whose products fit a long; a row that is ``wide`` has
    Python integers instead, and 0 in ``values``.
    """

    def __init__(self, packed: dict, scale: int):
        n = packed["_n"]
        self.ids, self.labels = (np.frombuffer(packed[c], np.int64) for c in ("ids", "labels"))
        self.scores = np.frombuffer(packed["scores"], np.int64).reshape(len(self.ids), -1) if packed["scores"] else None
        x = np.frombuffer(packed["vectors"], np.float64).reshape(len(self.ids), n)
        with np.errstate(over="ignore"):
            q = np.floor(x * scale)
        self.wide = (np.abs(q) > math.sqrt(2.0**62 / max(n, 1)) - 1).any(1)
        self.values = np.where(self.wide[:, None], 0, q).astype(np.int64)
        self.large = {k: [int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x[k].tolist()] for k in np.flatnonzero(self.wide).tolist()}
        self.real = self.values.astype(np.float64)
        self.codes = np.frombuffer(packed["codes"], np.uint8).reshape(len(self.ids), -1) if packed["codes"] else None
        self.residuals = np.frombuffer(packed["residuals"], np.float64) if packed["residuals"] else None

    def integers(self, k: int) -> list[int]:
        return self.large.get(k) or self.values[k].tolist()


def scores(a: Rows, k: int, b: Rows, at: np.ndarray) -> np.ndarray:
    """Exact products of row k of a with rows of b; what doesn't fit a long is the nearest long."""
    out = b.values[at] @ a.values[k]
    exact = np.arange(len(at)) if a.wide[k] else np.flatnonzero(b.wide[at])
    if len(exact):
        own = a.integers(k)
        for i in exact.tolist():
            out[i] = min(HIGH, max(LOW, sum(x * y for x, y in zip(own, b.integers(int(at[i])), strict=True))))
    return out


def intervals(a: Rows, b: Rows, centroids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Between which numbers the score of each (anchor, row) lies."""
    if centroids is None or b.codes is None:
        open_ = np.full((len(a.ids), len(b.ids)), np.inf)
        return -open_, open_
    middle, reach = estimates(a.real, b.codes, centroids), np.sqrt((a.real * a.real).sum(1))[:, None] * b.residuals[None]
    reach += 1e-9 * np.abs(middle) + 1e-6
    reach[a.wide] = np.inf
    reach[:, b.wide] = np.inf
    return middle - reach, middle + reach


def best(a: Rows, k: int, b: Rows, at: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, least: int = LOW, top: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``most`` rows of ``at`` of the highest scores in [least, top], ties by id."""
    at = at[(high[at] >= least) & (low[at] <= top)]
    sure = at[(low[at] >= least) & (high[at] <= top)]
    if len(sure) > most:
        at = at[high[at] >= np.partition(low[sure], -most)[-most]]
    score = scores(a, k, b, at)
    inside = (score >= least) & (score <= top)
    at, score = at[inside], score[inside]
    order = np.lexsort((b.ids[at], ~score))[:most]
    return at[order], score[order]


def positives_of(a: Rows, b: Rows, bounds: tuple[np.ndarray, np.ndarray], most: int) -> Iterable[tuple]:
    for k in range(len(a.ids)):
        at = np.flatnonzero((b.labels == a.labels[k]) & (b.ids != a.ids[k]))
        at, score = best(a, k, b, at, bounds[0][k], bounds[1][k], most)
        yield np.full(len(at), a.ids[k]), np.zeros(len(at), np.int32), b.ids[at], score


def negatives_of(a: Rows, b: Rows, bounds: tuple[np.ndarray, np.ndarray], most: int, low: int, high: int) -> Iterable[tuple]:
    """For each anchor and each of its positives' scores s the best rows of other labels with low s <= 100 score <= high s."""
    for k in range(len(a.ids)):
        other = np.flatnonzero((b.labels != a.labels[k]) & (b.ids != a.ids[k]))
        for window, s in enumerate(a.scores[k].tolist()):
            at, score = best(a, k, b, other, bounds[0][k], bounds[1][k], most, max(LOW, -(-low * s // 100)), min(HIGH, high * s // 100))
            yield np.full(len(at), a.ids[k]), np.full(len(at), window, np.int32), b.ids[at], score


def _packed(table: pa.Table, books: dict[int, np.ndarray] | None, scale: int) -> pa.Table:
    """One row of a group's rows; with codes and residual norms if there are centroids for the vectors' length."""
    table = table.sort_by("_id")
    n = table.column("_n")[0].as_py()
    x = np.ascontiguousarray(table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    s = table.column("_s").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if "_s" in table.column_names else np.empty(0, np.int64)
    row = {"_n": n, "_b": table.column("_b")[0].as_py(), "ids": table.column("_id").to_numpy().tobytes(), "labels": table.column("_label").to_numpy().tobytes(), "vectors": x.tobytes(), "scores": s.tobytes(), "codes": b"", "residuals": b""}
    if books and n in books:
        codes, residuals = encode(Rows(row, scale).real, books[n])
        row |= {"codes": codes.tobytes(), "residuals": residuals.tobytes()}
    return pa.Table.from_pylist([row], _PACKED)


def centroids(rows: DataFrame, scale: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids by length of vector, fitted on the driver on a hashed sample of about ``sample`` components."""
    share = min(1.0, sample / max(1, rows.agg(F.sum("_n")).first()[0] or 0))
    picked = rows.where((F.col("_n") > 0) & (F.pmod(F.xxhash64(F.lit(1), "_id", "_x"), F.lit(1 << 20)) < share * (1 << 20))).select("_n", "_id", "_x").toPandas()
    books = {}
    for n, part in picked.sort_values(["_n", "_id"]).groupby("_n"):
        q = np.floor(np.array(part["_x"].tolist(), np.float64) * scale)
        q = q[(np.abs(q) < math.sqrt(2.0**62 / n) - 1).all(1)]
        if len(q):
            books[int(n)] = fit(q)
    return books


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", sample: int = SAMPLE, block: int = BLOCK, part: int = PART,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    A score is the inner product of two rows' floor(scale * component); higher
    scores come first, ties by smaller id.  For each anchor and each of its first
    ``positives`` other rows of its label (all, if fewer): the first ``negatives``
    rows (all, if fewer) of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.  An anchor
    without a positive, and a positive without such a row, give none.

    Rows without an id, label or vector, or with a null or non-finite component,
    take no part.  Rows of an anchor's own id are neither its positives nor its
    negatives; rows that repeat an id are a candidate each (equal ones only as
    often as they can be among the first), anchors that repeat one count once, with
    the smallest label and vector.  Vectors meet those of their own length.  A
    score that doesn't fit a long is computed exactly and counts as the nearest
    long.  Labels and ids are whole numbers.  The centroids are fitted on a hashed
    sample of about ``sample`` components; they decide what is scored, not the result.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        label = F.col(label_col) if isinstance(label_col, str) else label_col
        fine = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
        return df.where(fine).select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"), F.size(v).alias("_n"), F.transform(v, lambda x: x.cast("double")).alias("_x"))

    most = max(positives, negatives)
    own = whole(vectors).groupBy("_n", "_id", "_label", "_x").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("_copies"))
    own = shared.written(own, "vectors")
    asked = shared.written(whole(anchors).groupBy("_id").agg(F.min(F.struct("_label", "_x", "_n")).alias("_m")).select("_id", "_m.*"), "anchors")
    books = centroids(own, scale, sample)
    groups = lambda total, size: F.ceil(total * F.greatest("_n", F.lit(1)) / size).cast("int")
    blocks = own.groupBy("_n").agg(F.sum("_copies").alias("_c")).select("_n", groups(F.col("_c"), block).alias("_blocks"))
    parts = asked.groupBy("_n").agg(F.count("*").alias("_c")).select("_n", groups(F.col("_c"), part).alias("_parts"))
    sizes = shared.written(blocks.join(parts, "_n"), "sizes")
    counts = sizes.agg(F.sum("_blocks"), F.sum("_parts"), F.sum(F.col("_blocks") * F.col("_parts"))).first()
    n_blocks, n_parts, tasks = (int(c or 1) for c in counts)
    place = lambda n: F.pmod(F.xxhash64("_id", "_x"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n: min(4 * n, n + 2000)  # noqa: E731  groups are hashed: with few of them, more partitions than groups

    def grouped(df: DataFrame, n: str, groups: int, with_codes: bool) -> DataFrame:
        keyed = df.join(sizes, "_n").withColumn("_b", place(n)).drop("_blocks", "_parts")
        return keyed.repartition(spread(groups), "_n", "_b").groupBy("_n", "_b").applyInArrow(lambda t: _packed(t, books if with_codes else None, scale), PACKED)

    copies = own.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")
    index = shared.written(grouped(copies, "_blocks", n_blocks, True), "index")
    key = ["_n", "_block", "_part"]
    left = index.join(sizes.select("_n", "_parts"), "_n").withColumn("_block", F.col("_b")).select("*", each("_parts").alias("_part")).drop("_parts").repartition(spread(tasks), *key)

    def searched(packed: DataFrame, search) -> DataFrame:
        right = packed.join(sizes.select("_n", "_blocks"), "_n").withColumn("_part", F.col("_b")).select("*", each("_blocks").alias("_block")).drop("_blocks").repartition(spread(tasks), *key)

        def compare(blocks: pa.Table, parts: pa.Table) -> pa.Table:
            out = [_FOUND.empty_table()]
            for p in parts.to_pylist():
                a = Rows(p, scale)
                for b in (Rows(r, scale) for r in blocks.to_pylist()):
                    found = list(search(a, b, intervals(a, b, books.get(p["_n"]))))
                    out.append(pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=_FOUND))
            return pa.concat_tables(out)

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "anchor_id long, window int, id long, score long")

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    one = searched(grouped(asked, "_parts", n_parts, False), lambda a, b, bounds: positives_of(a, b, bounds, positives))
    pairs = shared.written(first(one, ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # scores in the order of the windows, as many for each anchor of a part: a window that isn't there asks for nothing
    told = pairs.groupBy(F.col("anchor_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("_w"))
    told = told.select("_id", F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get("_w", k)["positive_score"], F.lit(-1).cast("long"))).alias("_s"))
    two = searched(grouped(asked.join(told, "_id"), "_parts", n_parts, False), lambda a, b, bounds: negatives_of(a, b, bounds, negatives, low, high))
    ranked = first(two, ["anchor_id", "window"], negatives).join(pairs, ["anchor_id", "window"])
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("window") + 1).alias("positive_rank"))
