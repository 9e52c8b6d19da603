"""Operator 9: near-duplicate classes by ProbMinHash.

Each shingle of five words is an element with weight 1 + ln(count); its arrivals
are a Poisson process of that rate, seeded by its hash, and each arrival falls on
one register.  A register keeps its first arrival, so that two documents agree in
a register with the probability Jaccard similarity of their weighted shingles.
An element ends once its next arrival comes after all registers of its document.
Registers form bands; documents that share a band are candidates.  A link is
then a matter of the shingles as sets, whose Jaccard similarity (of 64-bit hashes)
has to reach the threshold: weights only say which documents are compared, so that
a text that repeats itself finds others that do, and no link rests on an estimate.

Exact copies (the same words) are one representative from the start.  In a band's
bucket the member that shares most buckets leads, and all others are verified
against it.  Buckets that hold more than the leader's class are joined by the
rarest shingles of their members, across classes: of a bucket's members no link
between classes is lost, and pairs inside a class are never made.  Buckets and
shingles with many members are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbatch

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
#: Members verified against one copy of their leader's shingles.
SPLIT = 128
#: Size of the table of shingle frequencies.
COUNTERS = 1 << 20
#: Bits of a document's shingle parities.
PARITY = 512
#: Bits of the filter of candidates' ids.
FILTER = 1 << 24


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashes and counts of the distinct shingles of a chunk: n words in a row, or all words of a shorter document."""
    capital = (data >= 0x41) & (data <= 0x5A)
    lower = data + np.uint8(32) * capital
    starts, ends, doc = textbatch.blank_words(lower, offsets)
    word = textbatch.word_hashes(lower, starts, ends)
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    short = (count > 0) & (count < n)
    h = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k] if len(h) else h
    at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :]) if len(h) else np.empty(0, np.int64)
    of, h = doc[at], textbatch._mixed(h[at])
    if short.any():
        mine = short[doc]
        begin = np.flatnonzero(mine & np.append(True, doc[1:] != doc[:-1]))
        whole = np.zeros(len(begin), np.uint64)
        for k in range(n - 1):
            here = k < count[doc[begin]]
            whole[here] = whole[here] * np.uint64(0xD6E8FEB86659FD93) + word[begin[here] + k]
        of, h = np.append(of, doc[begin]), np.append(h, textbatch._mixed(whole + np.uint64(1)))
    codes, values, first = textbatch.distinct(textbatch._mixed(h + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return of[first], h[first], np.bincount(codes, minlength=len(values))


def signatures(of: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The element that arrives first in each register of each document; 0 in documents without elements."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    base, time, k = of * registers, np.zeros(len(of)), 0
    latest = np.full(docs, np.inf)
    while len(of):
        draw = textbatch._mixed(h + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        place = base + (textbatch._mixed(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[place])
        np.minimum.at(first, place[early], time[early])
        won = early[first[place[early]] == time[early]]
        winner[place[won]] = h[won]
        k += 1
        if k <= 4 or k % 8 == 0:
            latest = first.reshape(docs, registers).max(axis=1)
        alive = np.flatnonzero(time < latest[of])
        if len(alive) < len(of):
            of, h, weight, base, time = of[alive], h[alive], weight[alive], base[alive], time[alive]
    return winner.reshape(docs, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = textbatch._mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows])
    return textbatch._mixed(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(_id, f1, f2, bands) of (_id, _text): 128 bits of the words and the band hashes, null without words."""
    schema = pa.schema([("_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            n = batch.num_rows
            of, h, count = shingles(data, offsets)
            hashes = band_hashes(signatures(of, h, 1 + np.log(count), n, bands * rows), bands, rows)
            empty = np.bincount(of, minlength=n) == 0
            whole = data.tobytes().lower()
            f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(whole[a:b].split())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)
            listed = pa.ListArray.from_arrays(pa.array([None if e else k * bands for k, e in enumerate(empty.tolist())] + [n * bands], pa.int32()), pa.array(hashes.ravel()))
            yield shared.rows(schema, batch.column(0), pa.array(f[:, 0], mask=empty), pa.array(f[:, 1], mask=empty), listed)

    return docs.mapInArrow(run, "_id long, f1 long, f2 long, bands array<long>")


def _bits(ids: np.ndarray) -> list[np.ndarray]:
    """Three places of each id in a filter of FILTER bits."""
    return [(textbatch._mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(FILTER)).astype(np.int64) for k in (1, 2, 3)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of (_id), of fixed size however many ids there are: with too many it lets all rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FILTER, bool)
        for batch in batches:
            for places in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
                flags[places] = True
        words = np.packbits(flags, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["place", "word"])

    found = ids.select("_id").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER / 64 rows at most
    words = np.zeros(FILTER // 64, "<i8")
    words[found.column("place").to_numpy()] = found.column("word").to_numpy()
    return words.view(np.uint8)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_id, s) of those of (_id, _text) whose _id is wanted: the sorted 64-bit hashes of the shingles.

    Texts are not moved: a filter of fixed size leaves few of the other rows, and the sets are joined with the ids.
    """
    schema = pa.schema([("_id", pa.int64()), ("s", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.ones(batch.num_rows, bool)
            for places in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
                fine &= (sent.value[places >> 3] >> (places & 7)) & 1 == 1
            yield batch.filter(pa.array(fine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(passed(batches), "_text"):
            of, h, _ = shingles(data, offsets)
            order = np.lexsort((h, of))
            place = np.append(0, np.cumsum(np.bincount(of, minlength=batch.num_rows)))
            yield shared.rows(schema, batch.column(0), shared.binary_rows(h[order].astype("<u8"), 8 * place))

    sets = docs.select("_id", "_text").where("_id is not null").mapInArrow(run, "_id long, s binary")
    return sets.join(wanted, "_id", "left_semi").dropDuplicates(["_id"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of the threshold or more.

    The sets go to their leader a, the leader's own first; a leader with many
    members is dealt out in parts, each with a row for a copy of its set.
    """
    pairs = pairs.select("a", "b").distinct()
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    dealt = pairs.join(size, "a")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = dealt.select(F.col("b").alias("_id"), "a", part.alias("part"), F.lit(1).alias("rank"))
    leaders = size.select(F.col("a").alias("_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("rank"))
    sent = members.unionByName(leaders).join(sets, "_id").select("a", "part", "rank", F.col("_id").alias("b"), "s")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, rank, b, s = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "rank", "b", "s"))
            out = []
            for x, r, y, packed in zip(a.to_pylist(), rank.to_pylist(), b.to_pylist(), s, strict=True):
                mine = np.frombuffer(packed.as_buffer(), "<u8")
                if r == 0:
                    leader, own = x, mine
                    continue
                if x != leader:
                    raise ValueError("a leader's shingles are missing")
                low, high = sorted((len(own), len(mine)))
                if low >= threshold * high - 1e-9:
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both >= threshold * (len(own) + len(mine) - both) - 1e-9:
                        out.append((x, y))
            yield shared.rows(schema, [o[0] for o in out], [o[1] for o in out])

    return sent.repartition("a", "part").sortWithinPartitions("a", "part", "rank").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(_id, label) of the nodes of links (a, b): the smallest id that they reach.

    Labels spread to neighbours and jump to their labels' labels; each round is a
    written table, and the number of rounds follows the logarithm of the longest chain.
    """
    both = shared.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = shared.written(both.groupBy(F.col("a").alias("_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels._id).groupBy(F.col("a").alias("_id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "_id").select("_id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("_id").alias("next"), F.col("label").alias("far"))
        step = shared.written(spread.join(jump, "next").select("_id", F.least("next", "far").alias("label"), "old"), "labels")
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("_id", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of each row: the smallest id among the documents that links reach.

    Documents link if the same words stand in them, or if the sets of their
    shingles (five words [^\\x20\\x09-\\x0D]+, A-Z in lower case; all words of a
    shorter text) have a Jaccard similarity of ``threshold`` or more.  Null,
    empty and blank texts link to none; rows without an id have no class; rows
    that repeat an id must repeat the text.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketch = shared.written(sketches(own, bands, rows), "sketch")
    full = sketch.where("f1 is not null and _id is not null")
    copies = shared.written(full.groupBy("f1", "f2").agg(F.min("_id").alias("rep"), F.first("bands").alias("bands")), "copies")
    exploded = copies.select("rep", F.explode("bands").alias("bucket"))
    crowded = shared.written(exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    labels = None
    if crowded.limit(1).count():
        members = shared.written(shared.spread_join(exploded, crowded, ["bucket"], crowded, ["rep"]), "members")
        labels = _linked(own, members, crowded, threshold)
    # exact copies of one text may be a third of all rows: only (hash, id) moves, and skewed joins are split
    named = copies.select("f1", "f2", "rep")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("_id", "rep"), "rep", "left").select("f1", "f2", F.coalesce("label", "rep").alias("class_id"))
    else:
        named = named.withColumnRenamed("rep", "class_id")
    return sketch.select("_id", "f1", "f2").join(named, ["f1", "f2"], "left").select(F.col("_id").alias("doc_id"), F.when(F.col("_id").isNotNull(), F.coalesce("class_id", "_id")).alias("class_id"))


def _linked(own: DataFrame, members: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """Labels of the representatives that links join, from (rep, bucket, n) and the sizes (bucket, n); a large bucket is dealt over tasks."""
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = shared.written(members.join(degree, "rep").select("bucket", "rep", F.struct("degree", (-F.col("rep")).alias("o")).alias("order")), "ranked")
    sets = shared.written(shingle_sets(own, ranked.select(F.col("rep").alias("_id")).distinct()), "shingles")
    lead = ranked.groupBy("bucket").agg(F.max_by("rep", "order").alias("leader"))
    pairs = shared.spread_join(ranked, lead, ["bucket"], crowded, ["rep"]).where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    links = shared.written(verified(pairs, sets, threshold), "found")
    labels = components(links)
    # what a bucket holds besides its leader's class is joined exactly, by the rarest shingles
    known = ranked.join(labels.withColumnRenamed("_id", "rep"), "rep", "left").select("bucket", "rep", "order", F.coalesce("label", "rep").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", "order").alias("led")).where("low <> high").select("bucket", "led")
    family = shared.spread_join(known, mixed, ["bucket"], crowded, ["rep"]).groupBy(F.col("rep").alias("_id")).agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("led")).alias("rest"))
    family = shared.written(family.join(sets, "_id"), "family")
    if not family.limit(1).count():
        return labels
    rare = shared.written(prefixes(family, threshold), "prefixes")
    uses = rare.groupBy("h").agg(F.count("*").alias("n"))
    left = rare.where("rest").select("h", F.col("_id").alias("a"), F.col("label").alias("a_label"), F.col("n").alias("a_n"), F.col("left").alias("a_left"), F.col("parity").alias("a_parity"))
    # what two sets have in common is at most what is left of each from their first common shingle on
    least = (F.col("n") + F.col("a_n")) * (threshold / (1 + threshold)) - 1e-6
    close = (F.col("label") != F.col("a_label")) & (F.least("left", "a_left") >= least) & (F.least("n", "a_n") >= F.greatest("n", "a_n") * threshold - 1e-6)
    # each shingle that one of two sets lacks turns one bit of their parities
    apart = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("a_parity")[k])) for k in range(PARITY // 64)), F.lit(0))
    close &= (apart <= (F.col("n") + F.col("a_n")) * ((1 - threshold) / (1 + threshold)) + 1e-6) & (~F.col("rest") | (F.col("_id") < F.col("a")))
    pairs = shared.spread_join(rare, left, ["h"], uses, ["_id"]).where(close).select("a", F.col("_id").alias("b"))
    found = shared.written(verified(pairs, sets, threshold), "found")
    return components(links.unionByName(found)) if found.limit(1).count() else labels


def _slots(s: np.ndarray) -> np.ndarray:
    return (textbatch._mixed(s) % np.uint64(COUNTERS)).astype(np.int64)


def prefixes(family: DataFrame, threshold: float) -> DataFrame:
    """(_id, label, rest, h, n, left): each document's rarest shingles, of which two documents with the similarity share one,
    with the number of its shingles and of those from here on in the order, and the parities of its shingles over PARITY bits.

    For any order of all shingles, sets of n with a Jaccard similarity t share
    one of their first n - ceil(t n) + 1.  The order is by frequency in the
    family, counted in a table of fixed size, so that copies meet by their
    common edits and not by the text that the whole family shares.
    """
    schema = pa.schema([("_id", pa.int64()), ("label", pa.int64()), ("rest", pa.bool_()), *((c, pa.int64()) for c in ("h", "n", "left")), ("parity", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                np.add.at(seen, _slots(np.frombuffer(packed, "<u8")), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    counted = family.select("s").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").cast("int").alias("n")).toArrow()  # COUNTERS rows at most
    table = np.zeros(COUNTERS, np.int32)
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    sent = family.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, sizes, parities = [], [], []
            for packed in batch.column(3).to_pylist():
                s = np.frombuffer(packed, "<u8")
                parities.append(np.packbits((np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8), bitorder="little").view("<i8"))
                s = s[np.lexsort((s, sent.value[_slots(s)]))]
                picked.append(s[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1])
                sizes.append(len(s))
            if not picked:
                continue
            length = np.array([len(x) for x in picked])
            at, n = np.repeat(np.arange(batch.num_rows), length), np.repeat(sizes, length)
            place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
            yield shared.rows(schema, *(batch.column(k).take(pa.array(at)) for k in range(3)), np.concatenate(picked).view(np.int64), n, n - place, pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * (PARITY // 64), pa.array(np.stack(parities)[at].ravel())))

    return family.select("_id", "label", "rest", "s").mapInArrow(first, "_id long, label long, rest boolean, h long, n long, left long, parity array<long>")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those that have a smaller id in their class; all columns.  Rows without an id stay."""
    other = shared.unused(docs, "_other")
    others = classes(docs, id_col, text_col, **how).where("doc_id <> class_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(others, F.col(id_col).cast("long") == F.col(other), "left_anti")
