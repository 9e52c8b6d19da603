"""Operators 11 to 13 against the library, against every pair of rows and against every pair of words; steps of operator 3."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from genolake.llm import hard_negatives, packing, queries, spelling, textbatch, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_counts(texts):
    return [len(e.ids) for e in textbatch.library_tokenizer(BYTES).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(3)
    texts = ["", "a", " ", "it's  <|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endof", "text|> y", "a" * 999, "ab" * 777 + "c", "-" * 5000, " " * 3000 + "x", "\n\t" * 300, "日本語テキスト" * 300, "ÃÂ" * 500, "🙂é" * 50]
    for alphabet, most in ((list("aabcdeé ñth'si "), 300), (list("aaabetnhirs"), 5000), (["aaa", "-", "=", "--", "the", "ing", " "], 1500), (list("日本語中文字漢"), 1200)):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for _ in range(25)]
    return texts


def test_merging_at_once_counts_as_the_library():
    texts = odd_texts()
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
    assert token_counts.count_chunk(data, offsets, BYTES).tolist() == library_counts(texts)


def test_long_words_take_few_rounds():
    """A word of 100,000 letters is counted in windows; the library agrees."""
    rng = random.Random(5)
    text = "".join(rng.choice("aaabetnhirs") for _ in range(100_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert token_counts.count_chunk(raw, np.array([0, len(raw)]), BYTES).tolist() == library_counts([text])


def test_token_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "hello world", "z"), (2, "hello world", None), (2, "hello world", None), (3, "<|endoftext|>", "z")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.token_counts(docs, BYTES, 1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, True), (2, 11, 2, True), (2, 11, 2, True), (3, 13, 1, False)], key=str)
    assert token_counts.token_counts(docs.limit(0), BYTES).collect() == []
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_of_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    want = dict(zip([d["doc_id"] for d in docs], library_counts([d["text"] or "" for d in docs]), strict=True))
    got = queries.op11_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(docs)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def brute_negatives(rows, anchors, positives=5, negatives=5, low=80, high=100, scale=256):
    def q(v):
        return [int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in v]

    fine = [(i, c, q(v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for i, c, v in fine:
        if i not in anchors:
            continue
        others = [(-score(v, w), j, d) for j, d, w in fine if j != i and len(w) == len(v)]
        for s, j, _ in sorted(o for o in others if o[2] == c)[:positives]:
            inside = sorted(o for o in others if o[2] != c and low * -s <= 100 * -o[0] <= high * -s)
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")
    got = hard_negatives.mine(df, df.where(F.col("vec_id").isin(*anchors)), **more)
    return sorted(tuple(r)[:6] for r in got.collect())


def test_hard_negatives_are_those_of_all_pairs(spark):
    """Clusters, ties, equal rows, odd rows, several lengths, and vectors whose products no long holds; blocks and parts of a few rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 7))
    rows = [(k, int(rng.integers(3)), (centres[rng.integers(12)] + 0.3 * rng.normal(size=7)).round(2).tolist(), "x") for k in range(300)]
    rows += [(k, k % 2, centres[0].round(2).tolist(), None) for k in range(300, 420)]  # a group of equal vectors
    rows += [(500 + k, k % 3, rng.normal(size=3).tolist(), "x") for k in range(40)] + [(560 + k, k % 2, [], "x") for k in range(4)]
    rows += [(600 + k, k % 2, [float(10.0 ** (14 + k)), -1.5, 3e30, 2.0, 0.0, 1.0, -7e37], "x") for k in range(6)]
    rows += [(700, 1, None, "x"), (701, None, [1.0] * 7, "x"), (None, 1, [1.0] * 7, "x"), (702, 1, [1.0, None] + [1.0] * 5, "x"), (703, 1, [float("inf")] * 7, "x"), (704, 1, [float("nan")] * 7, "x")]
    anchors = [0, 7, 100, 310, 311, 505, 560, 601, 604, 703]
    want = brute_negatives([r[:3] for r in rows], set(anchors))
    assert len(want) > 60 and any(w[0] == 601 for w in want)
    assert mined(spark, rows, anchors, block=7 * 64, part=7 * 3) == want
    assert mined(spark, rows, anchors, sample=200) == want


def test_hard_negatives_of_repeated_ids_and_nothing(spark):
    rows = [(1, 0, [1.0, 0.0], "x"), (1, 1, [9.0, 9.0], "x"), (2, 0, [1.0, 1.0], "x"), (3, 1, [0.9, 0.0], "x"), (3, 1, [0.9, 0.0], "x")]
    score = 256 * int(np.floor(0.9 * 256))
    assert mined(spark, rows, [1]) == [(1, 2, 1, 3, 65536, score), (1, 2, 2, 3, 65536, score)]
    assert mined(spark, [(1, 0, [-1.0], "x"), (2, 0, [1.0], "x"), (4, 1, [1.0], "x")], [1, 2]) == []  # a negative positive score has no window
    assert mined(spark, rows[:0], [1]) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(500, 9)))
    books = hard_negatives.fit(x[:300])
    codes, residuals = hard_negatives.encode(x, books)
    middle, reach = hard_negatives.estimates(x[:20], codes, books), np.sqrt((x[:20] ** 2).sum(1))[:, None] * residuals
    exact = x[:20] @ x.T
    assert (np.abs(exact - middle) <= reach).all() and np.median(reach) < np.abs(exact).std()


def test_hard_negatives_of_embeddings(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], list(map(float, r["embedding"]))) for r in table]
    got = queries.op12_hard_negatives(spark, sf_dir).collect()
    assert sorted(tuple(r)[:6] for r in got) == brute_negatives(rows, {r[0] for r in rows if r[0] % 100 == 0})


def slipped_words(docs):
    counts = Counter()
    for name, text in docs:
        run = []
        for c in (text or "") + "\n":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run.append(c.lower() if c <= "Z" else c)
            elif run:
                w, run = "".join(run), []
                h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
                counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    form, out = {}, []
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.append((w, n, len(near)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, k, words.get(form[w])))
    return sorted(rows)


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    stems = ["abcde", "aaaaaa", "straßen", "élève", "garçonnet", "maintenant", "xyzzyx"]
    texts = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(60)):
            w = list(rng.choice(stems) + rng.choice(["", "", "s", "es", "n"]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, what = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (what > 0)] = [rng.choice("abé")] if what < 2 else []
            words.append("".join(w) if rng.random() < 0.9 else "".join(w).upper())
        texts.append((k, " ".join(words)))
    texts += [(None, "abcdf abcdf"), (None, None), (5, ""), (5, "abcdf"), (5, "abcdf"), (9, "q" * 3000), (10, "q" * 3000), (11, "q" * 3000), (12, "q" * 2999 + "r"), (13, "q" * 2999 + "r"), (14, "q" * 2999 + "r"), (15, ("q" * 2998 + " ") * 9)]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    want = brute_variants(slipped_words(texts))
    got = sorted(map(tuple, spelling.variants(docs).collect()))
    assert got == want
    assert len(want) > 150 and any(w[1] is not None and w[2] != w[1] for w in want)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    """63 words, each twice as frequent as the one before."""
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(62)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w62"}


def test_variants_of_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, queries.op13_spelling(spark, sf_dir).collect())) == brute_variants(slipped_words(docs))


def test_letter_words_are_encoded_as_the_library_does():
    """Words of a to z don't go through the library; all others and long ones do."""
    rng = random.Random(2)
    assert textbatch.letter_word_encoding(WORDS) is not None
    vocabulary = [t.removesuffix("</w>") for t in textbatch.library_tokenizer(WORDS).get_vocab()]
    words = [t for t in vocabulary if t.isascii() and t.isalpha()]
    words += ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxzETAéß") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    words += ["x" * 5000, "aB" * 200, "a", "Z", "é", "1", "!?"]
    got = textbatch.span_encoder(WORDS).encode([w.encode() for w in words])
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [e.ids for e in textbatch.library_tokenizer(WORDS).encode_batch(words, add_special_tokens=False)]


def test_lower_case_tokens_follow_the_pattern():
    import regex

    rng = random.Random(4)
    pattern = regex.compile(textbatch.WORD_SPLIT)
    pieces = ["'", "'", "s", "T", "re", "VE", "ll", "L", "d", "m", "é", "ÿ", "Ñ", "²", "½", " ", "\n", "\u0085", "1", "23", "!", "ʰ", "˙", "ª", "\x00"]
    for _ in range(500):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(12)]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
        starts, ends, doc = textbatch.lower_case_tokens(data, offsets)
        want = [(k, t[m.start() : m.end()].encode()) for k, t in enumerate(texts) for m in pattern.finditer(t.lower())]
        assert list(zip(doc.tolist(), textbatch.spans(data, starts, ends), strict=True)) == want


@pytest.mark.parametrize("kind", ["<u2", "<u4", "<i8"])
def test_distinct_ids_by_one_sort(kind):
    rng = np.random.default_rng(6)
    lists = [rng.integers(0, 60_000 if k % 3 else 20, k % 50).astype(kind) for k in range(300)]
    terms, counts, length = packing.distinct(np.concatenate(lists), np.array([len(x) for x in lists]))
    want = [np.unique(x, return_counts=True) for x in lists]
    assert length.tolist() == [len(t) for t, _ in want]
    assert terms.tolist() == [v for t, _ in want for v in t.tolist()] and counts.tolist() == [v for _, c in want for v in c.tolist()]
