"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, curve_ann, debruijn, exact_topk, jaccard, licenses, ngram_trie, packing, pair_bpe, quality
from .common import doc_texts, table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.bpe_digests(doc_texts(table(spark, sf_dir, "documents")), tokenizer_file("word_bpe_49k.json"))


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeat_digests(table(spark, sf_dir, "documents"))


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.trie_scores(table(spark, sf_dir, "documents"), order=3)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document counts as the file source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(doc_texts(table(spark, sf_dir, "documents")), tokenizer_file("byte_bpe_50k.json"))


def op8_curve_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return curve_ann.curve_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
hit AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS p FROM hit CROSS JOIN range(0, 35) t(k)),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
e AS (SELECT r, unnest(s) AS g FROM s),
both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN s a ON a.r = x JOIN s b ON b.r = y WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
reach AS (SELECT r, r AS t FROM s UNION SELECT reach.r, y FROM reach JOIN link ON x = t)
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN s a ON a.r = reach.r JOIN s b ON b.r = reach.t GROUP BY reach.r, a.doc_id, len(a.s)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_debruijn": op2_debruijn,
        "op3_ngram_trie": op3_ngram_trie,
        "op4_licenses": op4_licenses,
        "op5_quality": op5_quality,
        "op6_chat": op6_chat,
        "op7_packing": op7_packing,
        "op8_curve_ann": op8_curve_ann,
        "op9_exact_topk": op9_exact_topk,
        "op10_jaccard": op10_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_debruijn": OP2_SQL, "op6_chat": chat.SQL, "op9_exact_topk": OP9_SQL, "op10_jaccard": OP10_SQL}
