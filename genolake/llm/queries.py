"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hard_negatives, host_reputation, line_dedup, near_dedup, packing, quality_qda, quality_rules, quote_links, shared, spelling, token_counts, token_files, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by byte-level BPE; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    decoded = byte_bpe.decoder(path)

    def digests(batches):
        import hashlib

        import numpy as np

        decimal = [str(k) for k in range(1 << 16)].__getitem__
        for batch in decoded(batches):
            ids = [hashlib.sha256(",".join(map(decimal, np.frombuffer(x.as_buffer(), "<i4").tolist())).encode()).hexdigest() for x in batch.column(2)]
            text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
            yield shared.rows(schema, batch.column(0), batch.column(1), ids, text)

    return byte_bpe.encode(table(spark, sf_dir, "documents"), path, then=digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, repetition coverage and verdict of every document."""
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids, lexical neighbours together."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the newest."""
    docs = table(spark, sf_dir, "documents")
    done = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
keyed AS (SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
many AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.doc_id, k, line, many.key IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN many ON keyed.key = many.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ids to bit-packed files in document order and reads them back."""
    path = shared.new_path(spark, "ids")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.documents(token_files.read(spark, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, in reply order."""
    linked = quote_links.linked(table(spark, sf_dir, "conversations"))
    return linked.select(
        F.col("thread.conv_id").alias("thread_conv"), F.col("thread.turn").alias("thread_turn"), "depth",
        "conv_id", "turn", "role", "body", "n_passages", F.col("max_level").cast("long").alias("max_level"), "n_linked", "reply_conv", "reply_turn")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP7_SQL = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM own a JOIN own b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER best AS rank, vec_id, score FROM pair WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; a labelled page (labels by page_id = doc_id) is bad with quality 0 or if toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return host_reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)


def _op8_sql() -> str:
    level = """
{name}_u AS (SELECT {level}, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM {table} GROUP BY {level}),
{name}_r AS (SELECT least(greatest(coalesce((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.0), 0.001), 0.999) AS r FROM {name}_u),
{name} AS (SELECT t.host, t.suffix, t.domain, t.n, t.bad, (u.m * ((1 - r) / r) + u.bad) / ((1 - r) / r + u.n) AS m, (1 - r) / r + u.n AS weight
  FROM {table} t JOIN {name}_u u ON t.{level} = u.{level} CROSS JOIN {name}_r)"""
    levels, last = [], "start"
    for name in host_reputation.LEVELS:
        levels.append(level.format(name=f"by_{name}", level=name, table=last))
        last = f"by_{name}"
    fits = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1])))
    verdicts = " ".join(f"WHEN '{r}' THEN '{how}'" for how, r in RULES)
    return f"""
WITH page AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{host_reputation.UPPER}', '{host_reputation.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
outcome AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels),
hosts AS (SELECT host, string_split(host, '.') AS p, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM page LEFT JOIN outcome ON page_id = doc_id GROUP BY host),
start AS (SELECT host, p[-1] AS suffix, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS domain, n, bad, (sum(bad) OVER () + 1) / (sum(n) OVER () + 2) AS m FROM hosts),{','.join(levels)},
judged AS (SELECT host, CASE WHEN m - {host_reputation.DEVIATIONS} * sqrt(m * (1 - m) / (weight + 1)) > {host_reputation.LIMIT} THEN 'block' ELSE 'allow' END AS judged FROM by_host),
ruled AS (SELECT *, CASE {fits} END AS rule FROM page)
SELECT page_id, ruled.host, path, rule, coalesce(CASE rule {verdicts} END, judged) AS verdict FROM ruled JOIN judged ON ruled.host = judged.host
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that aren't held out."""
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as the positives of each hundredth vector; each seventh label is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"), label_col=label)


OP12_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER near AS rank, vec_id AS negative_id, positive_score, score AS negative_score,
  dense_rank() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) AS positive_rank
FROM (SELECT * FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words' number, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n))),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
told AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS told, run, count(*) AS n FROM run GROUP BY ALL),
octets AS (SELECT *, flatten(list_transform(string_split(told, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::BIGINT[] END)) AS o FROM told),
hashed AS (SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || o, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM octets, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
rep AS (SELECT word, n, left(word, (i - 1)::INT) || '*' || substr(word, (i + 1)::INT) AS key FROM place),
del AS (SELECT DISTINCT word, n, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS key FROM place),
pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM rep a JOIN rep b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT del.word, w.word, w.n FROM del JOIN w ON del.key = w.word UNION ALL SELECT w.word, del.word, del.n FROM del JOIN w ON del.key = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pair GROUP BY word),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
chain AS (SELECT word, word AS here, form AS onward FROM formed UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.onward = formed.word)
SELECT formed.word, form, here AS root, n, n_near, form_n FROM formed JOIN chain ON formed.word = chain.word AND chain.onward IS NULL
"""


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_packing, op4_line_dedup, op5_token_files, op6_quote_links, op7_topk, op8_host_reputation, op9_near_dedup, op10_quality_qda, op11_token_counts, op12_hard_negatives, op13_spelling)}
SQL = {"op4_line_dedup": OP4_SQL, "op7_topk": OP7_SQL, "op8_host_reputation": _op8_sql(), "op12_hard_negatives": OP12_SQL, "op13_spelling": OP13_SQL}
