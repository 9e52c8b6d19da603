"""Operator 13: spelling variants of a corpus's words, without pairs.

Two words that differ by one replaced letter share a key that has a mark at its
place: (position, prefix, suffix).  Two that differ by one more letter share a
key as well: the shorter word itself is what a deletion makes of the longer one.
Each word gives all its keys once; a key's group says how many words it has and
which two are the most frequent, and that is all that a word needs of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the replaced letter: not in RUN.
MARK = "*"
REPLACED, DELETED, WHOLE = range(3)


def word_counts(docs: DataFrame, least: int = 5, often: int = 3, slip: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least`` letters that stand ``often`` times in all texts.

    A word is a maximal run of RUN with A-Z lower-cased.  Where ``slip`` divides the
    crc32 of "id:word", the word loses its letter at that number modulo its length.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    runs = runs.select("_run", F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = F.pmod(F.col("_h"), F.length("_run")).cast("int")
    slipped = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select(F.when(F.col("_h") % slip == 0, slipped).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def keys(words: DataFrame, least: int = 5) -> DataFrame:
    """(key, kind, word, n): a word's keys with a mark for each letter, its different deletions of at least ``least`` letters, and itself."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_i"))
    before, after = F.substring("word", F.lit(1), F.col("_i") - 1), F.substring("word", F.col("_i") + 1, F.length("word"))
    letter = lambda i: F.substring("word", i, F.lit(1))
    # a deletion anywhere in a row of equal letters is the same
    shorter = F.when((F.length("word") > least) & ((F.col("_i") == 1) | (letter(F.col("_i")) != letter(F.col("_i") - 1))), F.concat(before, after))
    own = F.when(F.col("_i") == 1, F.col("word"))
    entry = lambda kind, key: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    made = places.select("word", "n", F.explode(F.array(entry(REPLACED, F.concat(before, F.lit(MARK), after)), entry(DELETED, shorter), entry(WHOLE, own))).alias("_e"))
    return made.where("_e.key is not null").select("_e.key", "_e.kind", "word", "n")


def near(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n, n_near, best): how many words differ by one letter, and the most frequent of them as (-n, word).

    A group of a marked key has no more words than there are letters, one of a word and its longer ones no
    more than letters x places: windows of a bounded size, in one exchange by key and one by word.
    """
    group = Window.partitionBy("key").orderBy(F.col("kind") == WHOLE, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    grouped = keys(words, least).select(
        "word", "n", "kind", F.count_if(F.col("kind") != WHOLE).over(group).alias("_size"), F.first(me).over(group).alias("_first"), F.nth_value(me, 2).over(group).alias("_second"),
        F.max(F.when(F.col("kind") == WHOLE, me)).over(group).alias("_whole"))
    kind = F.col("kind")
    count = F.when(kind == REPLACED, F.col("_size") - 1).when(kind == DELETED, F.col("_whole").isNotNull().cast("long")).otherwise(F.col("_size"))
    other = F.when(F.col("_first.word") == F.col("word"), F.col("_second")).otherwise(F.col("_first"))
    best = F.when(kind == REPLACED, F.when(F.col("_size") > 1, other)).when(kind == DELETED, F.col("_whole")).otherwise(F.when(F.col("_size") > 0, F.col("_first")))
    return grouped.select("word", "n", count.alias("_count"), best.alias("_best")).groupBy("word", "n").agg(F.sum("_count").alias("n_near"), F.min("_best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): where following forms ends.

    Each round follows twice as far, and a form is at least as frequent as twice its word: six rounds are enough.
    """
    found = shared.written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = shared.written(found.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        found = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return found


def variants(docs: DataFrame, least: int = 5, often: int = 3, slip: int = 97, ratio: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts (``word_counts``).

    Two words are near if they differ by exactly one inserted, deleted or replaced
    letter.  A word's form is the most frequent near word (ties: the smallest in
    code-point order) if that is at least ``ratio`` times as frequent (2 or more),
    else null, and so is form_n; ``root`` follows forms to the last.  Null and empty
    texts have no words; a row without an id counts with an empty id, a repeated
    row counts again, no words give no rows.  A word of L letters gives L keys of
    about its length.
    """
    if ratio < 2:
        raise ValueError("ratio: at least 2, so that forms have no circles")
    words = shared.written(word_counts(docs, least, often, slip, id_col, text_col), "words")
    linked = near(words, least)
    formed = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    linked = shared.written(linked.select("word", formed["word"].alias("form"), "n", "n_near", (-formed["n"]).alias("form_n")), "near")
    last = roots(linked.where("form is not null"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
