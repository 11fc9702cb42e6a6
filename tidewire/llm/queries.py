"""One query for each corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aligning import align
from .bpe import encode_decode
from .common import table, train_fold
from .htmltext import extract_text
from .language import fit_languages, predict_languages
from .lines import line_dedup
from .neardup import jaccard_classes
from .neighbours import nearest
from .packing import pack_documents
from .quality import BASE, quality_rules
from .sharding import shard_documents
from .spelling import spelling_variants, word_counts
from .toxicity import fit_toxicity, score_toxicity
from .urls import ALLOW, BLOCK, Rule, fit_urls, judge_urls, with_rules

#: The rules that op13 is asked about.
URL_RULES = [Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/")]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), 5, 0.8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), 1024, 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, 5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = predict_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return done.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard_documents(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = quality_rules(docs, carry=("doc_id",))
    return stats.select("doc_id", *BASE, "base_failed", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slips=199))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The URLs that a rule judges are the labelled ones.
    labelled = with_rules(pages, URL_RULES).filter("rule is not null")
    model = fit_urls(labelled.select("url", (F.col("rule_verdict") == BLOCK).cast("int").alias("blocked")))
    return judge_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_packing": op2_packing,
    "op6_line_dedup": op6_line_dedup,
    "op8_bpe": op8_bpe,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_alignment": op11_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filters": op13_url_filters,
}

#: The other queries rest on a tokenizer, on learning, or on a layout that is the method's own: brute-force versions are in tests/llm.
SQL: dict[str, str] = {
    "op6_line_dedup": """WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split) AS u),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, repeated.k IS NOT NULL AND keyed.doc_id <> repeated.last AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
}
