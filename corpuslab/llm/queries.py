"""Registered queries of the operators, over whole tables, with production parameters."""
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontamination, fill_middle, jaccard_join, licenses, mixing, packing, quality, secrets, token_counts, token_output, toxicity, url_filter, whitening
from corpuslab.llm.words import word_count
from corpuslab.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"

#: The url rules.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path(TOKENIZER))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op8_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs, carry_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


@query
def op2_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(materialize(docs, "sizes"))
    position = F.get(F.col("copies"), F.lit(0))["position"]
    # Documents that the mix does not take follow in hash order, so that no range of the sort holds them all.
    order = F.coalesce(position, 2 + F.xxhash64("doc_id").cast("double") / 2.0**64)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", position.alias("position")).orderBy(order)


@query
def op7_secrets(spark, sf):
    found = secrets.find(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op1_decontamination(spark, sf):
    found = decontamination.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("_row")


@query
def op10_token_output(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_output.materialise(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("key", "doc_id")


@query
def op3_licenses(spark, sf):
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


@query
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(~held_out()).select("doc_id", "toxic")
    scored = toxicity.score(docs, labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_jaccard_join(spark, sf):
    return jaccard_join.join(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_fill_middle(spark, sf):
    made = fill_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


@query
def op11_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op13_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER)).rows("doc_id")
