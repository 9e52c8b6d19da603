"""The training-data operators against brute force, round trips and planted cases, with nulls, empties, ties and clashing names."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genolake.llm import byte_bpe, host_reputation, line_dedup, near_dedup, packing, quality_qda, quality_rules, queries, quote_links, textbatch, token_files, topk

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, _id int, n long"
ODD = [None, "", " ", "\n", "\n\n a", "é" * 30, "don't 'so' we'll  \t x\u3000y", "中文 text 123²", "<|endoftext|> inside<|startoftext|>", "word " * 3000, "x" * 700, "a  b\r\n\x0b c\x1cd", "e\u0301tude İstanbul", "same line that is long enough\nother"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", 7, 1) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*ODD, *ODD])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def random_texts(n, seed, alphabet=("a", "b", "é", "\n", " ", " ", "\t", "#", "longword", "'s", "1", "²", "!", "\u3000", "中", "'ll", "😀")):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_pattern_split():
    import regex

    texts = random_texts(1500, 1) + [t or "" for t in ODD]
    data, offsets = textbatch.text_buffers(pa.array(texts))
    starts, ends, of = textbatch.pattern_tokens(data, offsets)
    got = [[] for _ in texts]
    for a, b, k in zip(starts, ends, of, strict=True):
        got[k].append(data[a:b].tobytes().decode())
    assert got == [regex.findall(P.PATTERN, t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encode_chunk_equals_library(name):
    texts = random_texts(800, 2) + [t or "" for t in ODD]
    data, offsets = textbatch.text_buffers(pa.array(texts))
    ids, place = textbatch.encode_chunk(data, offsets, P.path(name))
    expected = textbatch.library_tokenizer(P.path(name)).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, place[1:-1])] == [e.ids for e in expected]


def test_unknown_tokenizers_go_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    assert textbatch.shape(P.path("byte_bpe_50k.json")) == textbatch.BYTES and textbatch.shape(P.path("word_bpe_49k.json")) == textbatch.WORDS
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(str(tmp_path / "t.json"))
    texts = ["a 1234 b", "", *random_texts(50, 8)]
    data, offsets = textbatch.text_buffers(pa.array(texts))
    ids, place = textbatch.encode_chunk(data, offsets, str(tmp_path / "t.json"))
    assert textbatch.shape(str(tmp_path / "t.json")) is None
    assert [x.tolist() for x in np.split(ids, place[1:-1])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frequent in (4, 1 << 20):  # most words encoded in their batches, or before
        got = byte_bpe.decode(byte_bpe.encode(docs, path, frequent=frequent), path).toPandas()
        assert len(got) == 2 * len(ODD)
        for r in got.itertuples():
            text = ODD[r.doc_id % len(ODD)] or ""
            assert np.frombuffer(r.ids, "<i4").tolist() == e.encode_ordinary(text) and r.text == text.encode()
    assert byte_bpe.decode(byte_bpe.encode(empty, path), path).count() == 0


def test_quality_rules(spark, docs, empty):
    import re

    def brute(t):
        t = (t or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for k in range(3)}
        return len(w), sum(len(x.decode()) for x in w), sum(t.count(bytes([s])) for s in b"#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    texts = ODD + random_texts(300, 3)
    got = quality_rules.rules(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality_rules._COLUMNS) for r in got] == [brute(t) for t in texts]
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert all(not r["kept"] for r in got if r["base_failed"])
    words = [f"w{k}" for k in range(300)]
    half = " ".join(words[:100] + words[:60] + words[100:])
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.rules(frame(spark, [" ".join(words), half, " ".join(words[:60] * 3 + words)])).collect()}
    assert verdict == {0: True, 1: True, 2: False}
    assert quality_rules.rules(empty).count() == 0 and quality_rules.keep(docs).columns == docs.columns


def test_cover_shares_by_force(spark):
    def shares(t):
        lines = (t or "").split("\n")
        w = [x for x in (t or "").translate({k: " " for k in (*range(9, 14), 32)}).split(" ") if x]
        total, out = max(1, sum(map(len, w))), {}
        for n in quality_rules.NGRAM_LIMITS:
            seen, covered = set(), set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in seen:
                    covered |= set(range(i, i + n))
                seen.add(tuple(w[i : i + n]))
            out[f"cover_{n}"] = sum(len(w[i]) for i in covered) / total
        solid = lambda x: sum(c not in " \t\n\x0b\x0c\r" for c in x)
        seen, again = set(), 0
        for line in lines:
            if solid(line):
                again += solid(line) * (line in seen)
                seen.add(line)
        return out | {"line_cover": again / total}

    rnd = random.Random(23)
    words = [f"é{k}" if k % 5 == 0 else f"w{k}" for k in range(40)]
    texts = [*ODD]
    for _ in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30))) for _ in range(4)]
        texts.append("".join(rnd.choice(parts) + rnd.choice(["\n", " ", "\t", "\n\n", "\x0b"]) for _ in range(rnd.randrange(1, 12))))
    for r in quality_rules.rules(frame(spark, texts)).collect():
        expected = shares(texts[r["doc_id"]])
        assert {c: r[c] for c in expected} == pytest.approx(expected), texts[r["doc_id"]]
        fine = expected["line_cover"] <= quality_rules.LINE_LIMIT and all(expected[f"cover_{n}"] <= most for n, most in quality_rules.NGRAM_LIMITS.items())
        assert r["kept"] == (fine and not r["base_failed"])
    assert {True, False} == {r["kept"] for r in quality_rules.rules(frame(spark, texts)).collect()}


def test_packing(spark, docs, empty):
    path = P.path("word_bpe_49k.json")
    texts = ODD + random_texts(60, 4)
    got = packing.pack(frame(spark, texts), path, end_id=1, window=256, shard_ids=4000).toPandas()
    expected = [np.array([*e.ids, 1], "<u4") for e in textbatch.library_tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for name, part in got.sort_values("start").groupby("doc_id"):
        ids = expected[name]
        assert part["start"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() == len(ids) == part["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(part["start"], part["length"], part["ids_crc32"], strict=True))
    assert got["doc_id"].nunique() == len(texts)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]]
        total = part["length"].sum()
        assert total == 256 or total & (total - 1) == 0
    assert packing.pack(empty, path, end_id=1).count() == 0


def test_packing_retrieves_neighbours():
    rng = np.random.default_rng(0)
    lists = [np.append(rng.integers(1000 * (k % 4), 1000 * (k % 4) + 40, 90), 1).astype("<u2") for k in range(40)]  # four topics
    df = np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=5000)
    order = packing.ordered(lists, np.log1p((40 - df + 0.5) / (df + 0.5)), 512, 32)
    assert sorted(order) == list(range(40))
    assert sum(a % 4 == b % 4 for a, b in zip(order, order[1:], strict=False)) >= 30


def bm25_tops(lists, seeds, idf, k):
    """The k best documents of the whole corpus for each seed, with all of its ids."""
    mean = np.mean([len(x) for x in lists])
    impacts = [{int(t): idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, c in zip(*np.unique(x, return_counts=True), strict=True)} for x in lists]
    return {s: sorted((d for d in range(len(lists)) if d != s), key=lambda d: (-sum(impacts[d].get(int(t), 0) for t in np.unique(lists[s])), d))[:k] for s in seeds}


def test_packing_shards_keep_neighbours(spark):
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 40, 800)
    lists = [np.append(np.where(rng.random(120) < 0.5, rng.integers(1000, 1400, 120), 2000 + 100 * t + rng.integers(0, 60, 120)), 1).astype("<u2") for t in topic.tolist()]
    df = np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=8000)
    idf = np.log1p((800 - df + 0.5) / (df + 0.5))
    ids = spark.createDataFrame([(k, len(x), x.tobytes()) for k, x in enumerate(lists)], "doc_id long, n long, ids binary").repartition(6)
    shard = {r["doc_id"]: r["shard"] for r in packing.dealt(ids, "<u2", idf, 800, 8).collect()}
    sizes = Counter(shard.values())
    assert len(shard) == 800 and set(sizes) == set(range(8)) and max(sizes.values()) <= 200
    tops = bm25_tops(lists, range(0, 800, 40), idf, 10)
    recall = np.mean([shard[s] == shard[d] for s, best in tops.items() for d in best])
    assert recall >= 0.9, recall


def test_packing_splits_copies(spark):
    ids = spark.createDataFrame([(k, 50, np.arange(50, dtype="<u2").tobytes()) for k in range(800)], "doc_id long, n long, ids binary")
    sizes = Counter(r["shard"] for r in packing.dealt(ids, "<u2", np.ones(60), 800, 8).collect())
    assert len(sizes) == 8 and max(sizes.values()) <= 200


def test_packing_asks_with_all_terms():
    shared_ids = np.arange(10, 20)
    seed = np.concatenate([np.arange(1000, 1100), shared_ids])  # a hundred ids that only the seed has, and ten of its neighbour
    lists = [x.astype("<u2") for x in (seed, *(np.arange(2000 + 100 * k, 2050 + 100 * k) for k in range(20)), np.concatenate([shared_ids, np.arange(5000, 5040)]))]
    df = np.bincount(np.concatenate(lists), minlength=6000)
    assert packing.ordered(lists, np.log1p((len(lists) - df + 0.5) / (df + 0.5)), 512)[:2] == [0, 21]


def brute_lines(texts, min_docs=3):
    keys = {}
    for k, t in enumerate(texts):
        for line in (t or "").split("\n"):
            key = line_dedup.key_of(line.encode())
            if len(key.decode()) >= 20:
                keys.setdefault(key, set()).add(k)
    out = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(keys.get(key := line_dedup.key_of(x.encode()), ())) >= min_docs and max(keys[key]) != k)]
        out[k] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(spark, empty):
    rnd = random.Random(5)
    pool = [f"  A line number {k} that is long enough é" for k in range(12)] + ["short", "", "A Line NUMBER 3 that is long enough é\t", "a hot line that many of the documents share"]
    texts = [None, "", *["\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(120)]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs_ = frame(spark, texts)
        bitmaps = line_dedup.keep_bitmaps(docs_)
        got = line_dedup.apply(docs_, bitmaps).collect()
        cleaned = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs_, bitmaps).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = brute_lines(texts)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"] or "") for r in got} == expected
    assert {k: v or "" for k, v in cleaned.items()} == {k: v[2] for k, v in expected.items()} and cleaned[0] is None
    assert line_dedup.apply(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    line = "a line that three documents share"
    rows = [(1, line), (1, "other text\nx"), (1, None), (2, line), (3, f"y\n{line}"), (None, line), (2, line)]
    docs_ = spark.createDataFrame([(k, t, "en", 7, 1) for k, t in rows], "doc_id long, text string, _row string, _key int, _bitmap int")
    bitmaps = line_dedup.keep_bitmaps(docs_)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.apply(docs_, bitmaps).collect())
    assert got == Counter([(1, 1, 1, ""), (1, 2, 0, "other text\nx"), (1, 1, 0, None), (2, 1, 1, ""), (2, 1, 1, ""), (3, 2, 0, f"y\n{line}"), (None, 1, 0, line)])
    cleaned = line_dedup.cleaned(docs_, bitmaps)
    assert cleaned.columns == docs_.columns and Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == Counter((k, t) for k, _, _, t in got.elements())


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("parts", [1, 2, 5])
def test_runs_over_partitions(batch, parts):
    rnd = random.Random(batch * 10 + parts)
    rows = sorted({(rnd.choice([1, 1, 1, 2, 3, 4]), 0, rnd.randrange(15), rnd.randrange(2), rnd.randrange(3)) for _ in range(70)}, key=lambda r: (r[0], -r[2], r[3], r[4]))
    groups = sorted({(r[0], r[2]) for r in rows}, key=lambda g: (g[0], -g[1]))
    part_of = {g: k * parts // len(groups) for k, g in enumerate(groups)}  # a document's lines of one hash stay together
    drops, pending, ends = set(), [], {}
    for p in range(parts):
        mine = [r for r in rows if part_of[r[0], r[2]] == p]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*mine[k : k + batch], strict=True)], ["h1", "h2", "doc_id", "row", "line"]) for k in range(0, len(mine), batch)]
        for out in line_dedup.stream_runs(iter(batches)):
            for r in out.to_pylist():
                if r["kind"] == line_dedup.DROP:
                    drops.add((r["h1"], r["doc_id"], r["row"], r["line"]))
                elif r["kind"] == line_dedup.PENDING:
                    pending.append(r)
                else:
                    n, keeper = ends.get(r["h1"], (0, -1))
                    ends[r["h1"]] = (n + r["line"], max(keeper, r["doc_id"]))
    drops |= {(r["h1"], r["doc_id"], r["row"], r["line"]) for r in pending if ends[r["h1"]][0] >= 3 and ends[r["h1"]][1] != r["doc_id"]}
    by = {}
    for r in rows:
        by.setdefault(r[0], set()).add(r[2])
    assert drops == {(r[0], r[2], r[3], r[4]) for r in rows if len(by[r[0]]) >= 3 and max(by[r[0]]) != r[2]}


@pytest.mark.parametrize("bits", [1, 7, 16, 17])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001)
    payload = token_files.pack(ids, bits, 1000)
    assert (token_files.unpack(payload) == ids).all() and (token_files.unpack(payload, 999, 4321) == ids[999:4321]).all()
    assert len(payload) < 10_001 * bits / 8 + 200 and len(token_files.unpack(token_files.pack(ids[:0], bits))) == 0


def test_token_files(spark, docs, tmp_path, empty):
    path = P.path("byte_bpe_50k.json")
    token_files.write(docs, str(tmp_path / "f"), path, segment_ids=500)
    got = token_files.documents(token_files.read(spark, str(tmp_path / "f"))).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, [*ODD, *ODD], strict=True):
        ids = [*textbatch.library_tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    token_files.write(empty, str(tmp_path / "e"), path)
    assert token_files.documents(token_files.read(spark, str(tmp_path / "e"))).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there.\n\nSecond part"), (1, 1, "a", "> hello   THERE.\nyes"), (1, 2, "u", "> > Hello there.\n> yes\nno"), (1, 3, "u", "nothing quoted"), (2, 0, "u", ">second part\nfrom elsewhere"), (2, 1, "u", "> unknown words\nx"), (2, 2, "a", None), (2, 3, "a", "")]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.linked(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert len(got) == 8
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_conv"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 1)} | ({(2, 0): (1, 0)})
    assert (got[1, 2]["thread"]["turn"], got[1, 2]["depth"]) == (0, 2) and got[1, 2]["body"] == "no" and got[1, 2]["max_level"] == 2
    assert (got[2, 0]["thread"]["conv_id"], got[2, 0]["thread"]["turn"]) == (1, 0) and got[2, 2]["body"] == "" and got[2, 1]["n_passages"] == 1
    plain = quote_links.linked(spark.createDataFrame(rows[3:4], "conv_id long, turn int, role string, text string"))
    assert (plain.first()["thread"]["turn"], plain.first()["depth"]) == (3, 0) and quote_links.linked(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_partial_quotes_and_later_conversations(spark):
    rows = [(1, 0, "u", "one a\ntwo b\nthree c\n\npara two\n\npara three"), (1, 1, "a", "> two b\n> three c\nhm"), (1, 2, "a", "> one a two b three c\n>\n> para two\nok"),
            (3, 0, "u", "> from the later one\nearly words"), (9, 0, "u", "from the later one"), (9, 1, "u", "> early words\nx"),
            (5, 0, "u", "> pong ball\nping ball"), (6, 0, "u", "> ping ball\npong ball"), (7, 0, "u", "> pong ball\nz"), (8, 0, "u", "> nowhere\n> at all")]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.linked(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_conv"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 0), (3, 0): (9, 0), (9, 1): (3, 0), (6, 0): (5, 0), (7, 0): (6, 0)}  # 5 and 6 quote each other
    assert (got[7, 0]["thread"]["conv_id"], got[7, 0]["depth"]) == (5, 2) and (got[9, 1]["thread"]["conv_id"], got[9, 1]["depth"]) == (9, 2) and len(got) == 10
    assert got[1, 2]["n_passages"] == 1 and got[8, 0]["n_linked"] == 0


def links_by_force(rows):
    """(reply, thread, depth, n_passages, n_linked) of each (conv_id, turn) by looking through all messages; rows are distinct in both."""
    import re

    def normal(t):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")

    def units(t):
        return [[t], re.split(r"\n[ \t]*\n", t), t.split("\n")]

    own, passages = {}, {}
    for conv, turn, _, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            mark = re.match(r"(?:[ \t]?>)+", line)
            lines.append((mark.group().count(">") if mark else 0, re.sub(r"^(?:[ \t]?>)+[ \t]?", "", line)))
        body = "\n".join(c for level, c in lines if not level)
        own[conv, turn] = {normal(u) for us in units(body) for u in us} - {""}
        groups, last = [], None
        for level, content in lines:
            if level == last:
                groups[-1][1].append(content)
            else:
                groups.append((level, [content]))
            last = level
        quoted = [(level, [normal(u) for us in units("\n".join(part)) for u in us if normal(u)]) for level, part in groups if level]
        passages[conv, turn] = [q for q in quoted if q[1]]

    def origin(me, piece):
        near = min((k for k in own if k[0] == me[0] and piece in own[k]), default=None)
        if near and near < me:
            return near
        firsts = sorted(min(k for k in own if k[0] == c and piece in own[k]) for c in {k[0] for k in own if piece in own[k]})
        return next((f for f in (firsts[:1] + firsts[-1:]) if f[0] != me[0]), None)

    parent, counts = {}, {}
    for me, quoted in passages.items():
        found = [(level, k, next((o for piece in pieces if (o := origin(me, piece))), None)) for k, (level, pieces) in enumerate(quoted)]
        counts[me] = (len(quoted), sum(o is not None for _, _, o in found))
        linked = [f for f in found if f[2]]
        if linked:
            parent[me] = min(linked)[2]
    for start in sorted(own):  # the smallest message of a circle loses its link
        seen, at = [], start
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            parent.pop(min(seen[seen.index(at) :]))
    out = {}
    for me in own:
        at, depth = me, 0
        while at in parent:
            at, depth = parent[at], depth + 1
        out[me] = (parent.get(me), at, depth, *counts[me])
    return out


def test_quotes_by_force(spark):
    rnd = random.Random(17)
    words = "yes no maybe later the plan is fine we meet at noon tomorrow".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 7)))
    rows, texts = [], []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 9)):
            lines = []
            for _ in range(rnd.randrange(3)):
                mark = rnd.choice(["> ", ">", "> > ", ">>> "])
                source = rnd.choice(texts).split("\n") if texts and rnd.random() < 0.8 else [sentence()]
                at = rnd.randrange(len(source))
                lines += [mark + x.upper() if rnd.random() < 0.3 else mark + x for x in source[at : at + rnd.randrange(1, 4)]]
            lines += [rnd.choice([sentence(), "yes", "", "  "]) for _ in range(rnd.randrange(1, 5))]
            texts.append("\n".join(lines))
            rows.append((conv, turn, "u", rnd.choice([texts[-1]] * 9 + [None])))
    rows += [(1000, k, "u", f"> step {k - 1} of the chain\nstep {k} of the chain") for k in range(70)]
    rows += [(2000 + k, 0, "u", f"> ring {(k + 1) % 5} here\nring {k} here") for k in range(5)]
    expected = links_by_force(rows)
    frame_ = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, _salt int, hash string")
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.linked(frame_).collect()}
    assert len(got) == len(rows) and sum(e[0] is not None for e in expected.values()) > 150 and max(e[2] for e in expected.values()) >= 69
    for me, (reply, root, depth, n, linked) in expected.items():
        r = got[me]
        assert ((r["reply_conv"], r["reply_turn"]) == (reply or (None, None)), tuple(r["thread"]), r["depth"], r["n_passages"], r["n_linked"]) == (True, root, depth, n, linked), me


def test_quotes_of_repeated_rows(spark):
    rows = [(1, 0, "u", "a first message"), (1, 1, "u", "> a first message\nhm"), (1, 1, "u", "> a first message\nhm"), (None, 1, "u", "> a first message"), (1, None, "u", "> a first message")]
    got = [(r["conv_id"], r["turn"], r["n_linked"], r["reply_turn"], r["depth"]) for r in quote_links.linked(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()]
    assert Counter(got) == Counter([(1, 0, 0, None, 0), (1, 1, 1, 0, 1), (1, 1, 1, 0, 1), (None, 1, 0, None, 0), (1, None, 0, None, 0)])


def test_packing_of_many_short_documents():
    """Documents of the end id alone come last, in place; a shard of short ones is ordered in seconds."""
    import time

    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 500)
    lists = [np.array([1], np.int32)] * 200_000 + [np.append(rng.integers(2, 500, rng.integers(1, 4)), 1).astype(np.int32) for _ in range(30_000)]
    rng.shuffle(lists := np.array(lists, object))
    lists, began = list(lists), time.time()
    order = packing.ordered(lists, idf, 2048)
    assert time.time() - began < 60 and sorted(order) == list(range(len(lists)))
    bare = [k for k, x in enumerate(lists) if len(x) == 1]
    assert order[-len(bare) :] == bare


def test_packing_deals_repeated_rows(spark):
    """Equal rows of one id, and rows without an id, spread over shards; every id lies in one piece."""
    text = "many words that all of these rows have in common and no other row has " * 3
    rows = spark.createDataFrame([(1, text)] * 600 + [(None, text)] * 600, "doc_id long, text string").repartition(3)
    got = packing.pack(rows, P.path("word_bpe_49k.json"), end_id=1, shard_ids=4096)
    shards = got.groupBy(F.shiftright("sequence_id", 32).alias("shard")).agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in shards)
    assert total == got.where("start = 0").agg(F.sum("doc_tokens")).first()[0] and got.where("start = 0").count() == 1200
    assert len(shards) == round(total / 4096) and max(r["n"] for r in shards) < 4 * 4096


def test_topk(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (300, 8)).round(1)
    v[10] = v[11] = v[12]
    odd = [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (904, [0.0] * 8), (905, [1e30] * 8), (906, [1.0] * 7 + [-1e30]), (907, []), (910, []), (920, []), (None, [1.0] * 8)]
    rows = [(k, x.tolist(), 1, 2) for k, x in enumerate(v)] + [(*r, 1, 2) for r in odd] + [(30, v[30].tolist(), 3, 4)] * 7 + [(77, v[5].tolist(), 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _n int, _id int")
    got = topk.topk(df, df.where("vec_id % 10 = 0"), 5, block_rows=64, block_queries=8).toPandas()
    q = np.vstack([np.floor(64 * v.astype(np.float32).astype(float)), np.zeros(8)]).astype(int).astype(object)
    large = int(np.float32(1e30)) * 64
    ids, q = np.array([*range(300), 904, *[30] * 7, 77, 905, 906]), np.vstack([q, *[q[30]] * 7, q[5], [large] * 8, [64] * 7 + [-large]])
    assert sorted(got["query_id"].unique()) == [*range(0, 300, 10), 910, 920]  # 900 and others take no part
    for name, part in got.sort_values("rank").groupby("query_id"):
        if name > 300:  # empty vectors score 0 with each other
            assert part["vec_id"].tolist() == [x for x in (907, 910, 920) if x != name] and not part["score"].any()
            continue
        s = q @ q[name]
        best = [k for k in sorted(range(len(s)), key=lambda k: (-s[k], ids[k])) if ids[k] != name][:5]
        assert part["vec_id"].tolist() == ids[best].tolist() and part["score"].tolist() == [min(2**63 - 1, max(-(2**63), x)) for x in s[best]]
    assert topk.topk(df.where("vec_id < 3"), df.where("vec_id = 0"), 20).count() == 2 and topk.topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_wide_values(spark):
    rows = [(k, [float(x), -float(x), 1.0]) for k, x in enumerate([2**20, 2**21 + 1, -(2**22), 3, 0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk(df, df, 4).collect()}
    q = np.array([[64 * x for x in r[1]] for r in rows], object)
    for a in range(5):
        scores = sorted(((-int(q[a].astype(int) @ q[b].astype(int)), b) for b in range(5) if b != a))
        assert [got[a, k + 1] for k in range(4)] == [(b, -s) for s, b in scores]


def test_topk_of_scores_beyond_a_long(spark):
    """Queries and rows of all sizes up to 1e300: exact order, ties by id, the nearest long as the score."""
    rows = [(k, [float(s) * 10.0**e, float(k % 3), -1.5]) for k, (s, e) in enumerate([(a, e) for e in (0, 12, 18, 19, 30, 150, 300) for a in (1, -1, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [[int(x) * 64 if abs(x) >= 2**53 else int(np.floor(x * 64)) for x in r[1]] for r in rows]
    got = {}
    for r in topk.topk(df, df, 20, block_rows=7, block_queries=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for a, q in enumerate(whole):
        scores = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), b) for b, w in enumerate(whole) if b != a)
        assert [got[a][k + 1] for k in range(20)] == [(b, min(2**63 - 1, max(-(2**63), -s))) for s, b in scores]


def test_hosts(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "x://example.org#f/en/1", "http://b.com/fr/", "http://b.com/de", "http://b.com/de/x", "http://spam.net/q", "http://notorg/", "s://good.net?://y/z"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + k, f"http://spam.net/{k}") for k in range(60)] + [(200 + k, f"http://h{k % 9}.net/") for k in range(90)], "page_id long, url string")
    bad = spark.createDataFrame([(100 + k, 1) for k in range(60)] + [(200 + k, 0) for k in range(90)] + [(8, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in host_reputation.judge(pages, bad, queries.RULES).collect()}
    assert len(got) == len(urls) + 150
    assert [(got[k]["host"], got[k]["path"]) for k in (0, 1, 2, 4, 10)] == [("", ""), ("", ""), ("a.example.org", "/es/1"), ("example.org", ""), ("good.net", "")]
    assert [got[k]["rule"] for k in range(len(urls))] == [None, None, "example.org/es/", "example.org/en/1", None, "com/fr/", None, "com/de/", None, None, None]
    assert got[2]["verdict"] == got[3]["verdict"] == got[7]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert got[8]["verdict"] == "block" and all(got[200 + k]["verdict"] == "allow" for k in range(90))
    assert host_reputation.judge(pages.limit(0), bad, queries.RULES).count() == 0 and host_reputation.judge(pages, bad.limit(0), queries.RULES).where("verdict is null").count() == 0


def classes_by_force(texts):
    def sets(t):
        w = [x for x in (t or "").encode().lower().split()]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    s, parent = [sets(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(texts))]


def test_near_dedup(spark, empty):
    rnd = random.Random(11)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    for _ in range(25):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(8)):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(500)}"
            texts.append("  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_by_force(texts)
    kept = near_dedup.representatives(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == frame(spark, []).columns
    assert near_dedup.classes(empty).count() == 0


def test_near_dedup_of_a_large_bucket(spark, monkeypatch):
    """More members than a leader's part holds, in one bucket with others that only share most of a template."""
    monkeypatch.setattr(near_dedup, "SPLIT", 16)
    rnd = random.Random(5)
    template = [f"t{k}" for k in range(200)]
    texts = []
    for group in range(4):
        base = template[: 150 + group] + [f"g{group}w{k}" for k in range(24)]
        for _ in range(60):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_by_force(texts)


def test_near_dedup_recall_of_pairs(spark):
    """Of pairs just above the threshold, some with repeated shingles, nine in ten or more are found."""
    rnd = random.Random(6)
    texts, alike = [], []
    for k in range(200):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        base += (base[:30] * 3 if k % 3 == 0 else [])
        other = list(base)
        for _ in range(2):
            other[rnd.randrange(len(other))] = f"y{rnd.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    alike = [k for k in range(0, len(texts), 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.95]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, texts)).collect()}
    assert len(alike) > 100 and np.mean([got[k] == got[k + 1] for k in alike]) >= 0.9 and len({got[k] for k in range(0, len(texts), 2)}) == 200


def test_probminhash_estimates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 62, 300).astype(np.uint64), rng.integers(1, 1 << 62, 300).astype(np.uint64)
    b[:200] = a[:200]
    h, of = np.concatenate([a, b]), np.repeat([0, 1], 300)
    s = near_dedup.signatures(of, h, np.ones(600), 2, 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(200 / 400, abs=0.05)
    weight = np.concatenate([rng.uniform(0.5, 6, 300), rng.uniform(0.5, 6, 300)])
    s = near_dedup.signatures(of, h, weight, 2, 4000)
    x, y = (dict(zip(h[part].tolist(), (weight[part] / 1).tolist(), strict=True)) for part in (slice(0, 300), slice(300, 600)))
    expected = sum(1 / sum(max(x.get(d, 0) / x[e], y.get(d, 0) / y[e]) for d in {*x, *y}) for e in x.keys() & y.keys())  # probability Jaccard
    assert (s[0] == s[1]).mean() == pytest.approx(expected, abs=0.03)


def test_quality_qda(spark, empty):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice("alpha beta gamma delta of the and with".split()) + rnd.choice(["", "", ".", ","]) for _ in range(rnd.randrange(30, 200))) for _ in range(300)]
    bad = ["!! ".join(rnd.choice("ALPHA BETA GAMMA".split()) for _ in range(rnd.randrange(30, 200))) if k % 2 else "spam " * rnd.randrange(30, 200) for k in range(100)]
    texts = [*good, *bad, None, ""]
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(400)] + [(401, None)], "doc_id long, quality int")
    got = quality_qda.classify(frame(spark, texts), labels).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(texts) and got["score"].between(0, 1).all()
    assert all(got.loc[k, "held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    assert (got.loc[:299, "predicted"] == 1).mean() > 0.98 and (got.loc[300:399, "predicted"] == 0).mean() > 0.98
    flipped = labels.withColumn("quality", F.when(quality_qda.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_qda.classify(frame(spark, texts), flipped).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(again["score"].loc[got.index], got["score"])  # held-out labels are never learned
    assert (quality_qda.classify(frame(spark, texts[:5]), labels.limit(0)).toPandas()["score"] == 0.5).all() and quality_qda.classify(empty, labels).count() == 0


def test_discriminant_is_the_density_ratio():
    """Scores are those of two normal densities with shrunk covariances, written out."""
    rng = np.random.default_rng(9)
    d = len(quality_qda.FEATURES)
    x = [rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + k for k in range(2)]
    n, total, square = np.array([300.0, 300.0]), np.stack([v.sum(axis=0) for v in x]), np.stack([v.T @ v for v in x])
    n[1], total[1], square[1] = 200, x[1][:200].sum(axis=0), x[1][:200].T @ x[1][:200]
    model = quality_qda.solve(n, total, square, to_pooled=0.3, to_diagonal=0.1, floor=0.003)
    parts = [x[0], x[1][:200]]
    own = [np.cov(v.T, bias=True) for v in parts]
    pooled = (300 * own[0] + 200 * own[1]) / 500
    asked = rng.normal(size=(20, d))
    log = []
    for k in range(2):
        c = 0.7 * own[k] + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.003 * np.eye(d)
        z = asked - parts[k].mean(axis=0)
        log.append(-0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    expected = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(301) - np.log(201), -500, 500)))
    assert np.allclose(model.scores(asked), expected, atol=1e-6)


def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_qda.classify(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")).join(queries.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").toPandas()
    rank = got["score"].rank()
    one = got["quality"] == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert len(got) > 50 and auc > 0.9 and (got["predicted"] == got["quality"]).mean() > 0.9, (auc, len(got))


def test_queries_match_sql(spark, sf_dir):
    import oracle

    c = oracle.connect(sf_dir)
    for name, sql in queries.SQL.items():
        assert oracle.differences(queries.QUERIES[name](spark, sf_dir), sql, c) == "", name


def test_digests(spark, sf_dir):
    import tiktoken

    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op1_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = e.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    library, at = textbatch.library_tokenizer(P.path("byte_bpe_50k.json")), 0
    for r in sorted(queries.op5_token_files(spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_long_words_merge_by_heap():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(4)
    for n in (1, 2, 40, 700, 5000):
        for alphabet in ("ab", "etaoin shrdlu", "xé中😀"):
            word = "".join(rnd.choice(alphabet) for _ in range(n)).encode()
            assert byte_bpe.merged_by_heap(word, path) == e.encode_ordinary(word.decode())


def test_spans_that_share_a_hash(monkeypatch):
    """With a hash of three values, words still have ids of their own."""
    true = textbatch.word_hashes
    weak = lambda data, starts, ends, salt=0: np.where(ends - starts > 8, true(data, starts, ends, salt) % np.uint64(3), true(data, starts, ends, salt)) if salt == 0 else true(data, starts, ends, salt)
    monkeypatch.setattr(textbatch, "word_hashes", weak)
    words = [f"{k} some word of over sixteen bytes".encode() if k % 3 else str(k).encode() for k in range(50)] * 2
    data, offsets = textbatch.text_buffers(pa.array(words, pa.binary()))
    codes, values, first = textbatch.distinct_spans(data, offsets[:-1], offsets[1:])
    assert len(first) == len(values) == 50 and (codes[:50] == codes[50:]).all() and len(set(codes.tolist())) == 50
    coder = textbatch.SpanEncoder(lambda spans: [np.frombuffer(w.ljust(-(-len(w) // 4) * 4), np.int32).tobytes() for w in spans])
    for _ in range(2):
        ids, size = coder.ids(data, offsets[:-1], offsets[1:])
        assert [x.tobytes().rstrip() for x in np.split(ids, np.cumsum(size)[:-1])] == words


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs_ = queries.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_.toPandas().set_index("doc_id")
        docs_ = corpus_pipeline.shared.written(stage(spark, docs_, sf_dir), name)
        after = docs_.toPandas().set_index("doc_id")
        assert list(after.columns) == list(before.columns) and set(after.index) <= set(before.index), name
        if name == "line_dedup":
            expected = brute_lines_by_id(before["text"].to_dict())
            assert after["text"].to_dict() == expected
        elif name == "near_dedup":
            order = sorted(before.index)
            roots = classes_by_force([before.loc[k, "text"] for k in order])
            assert sorted(after.index) == sorted({order[r] for r in roots})
        else:
            assert after["text"].equals(before["text"].loc[after.index])
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == docs_.count()


def brute_lines_by_id(texts):
    order = sorted(texts)
    got = brute_lines([texts[k] for k in order])
    return {k: got[i][2] for i, k in enumerate(order)}


def test_registered():
    import __spark_entry__ as e

    assert {q.split("_")[0] for q in e.queries() if q.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in e.queries()


def test_frames_are_pandas_free():
    """The two native operators hold no Python in their plans' modules."""
    import inspect

    for module in (host_reputation, quote_links):
        source = inspect.getsource(module)
        assert not any(word in source for word in ("mapIn", "applyIn", "udf", "toPandas", "rdd", "pandas"))
    assert pd.__name__ == "pandas"
