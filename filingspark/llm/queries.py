"""The queries op1_ ... op10_ over the tables documents, pages, embeddings, benchmark, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.llm.common import crc_bucket, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import warc

    collection = warc.write(table(spark, sf_dir, "pages"), least=1000)
    return collection.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from filingspark.llm import packing

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, with_ids=False)


def op4_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from filingspark.llm import lattice_lm

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return lattice_lm.score(table(spark, sf_dir, "documents"), vocabulary, held_out_mod=7, held_out=2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import langid

    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit(documents, held_out_mod=5))
    return found.select("doc_id", held_out("doc_id", 5, 0), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import topk

    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import quality

    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), held_out_mod=4, held_out=2)
    found = quality.score(documents, model)
    return found.select("doc_id", held_out("doc_id", 4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import html_main

    return html_main.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingspark.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"), held_out_mod=5, held_out=0)
    found = toxicity.score(documents, lexicon)
    return found.select("doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(key: str, mod: int, remainder: int):
    return F.coalesce(crc_bucket(F.col(key), mod) == remainder, F.lit(False)).alias("held_out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_warc, op3_packing, op4_lattice_lm, op5_simhash, op6_langid, op7_topk, op8_quality, op9_html_main, op10_toxicity)
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bk),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM m""",
    "op7_topk": """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM e)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score FROM v AS q JOIN v AS c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
