"""The corpus pipeline: documents through the stages, each written and read again."""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontamination, jaccard_join, mixing, quality, token_output
from corpuslab.llm.words import word_count
from corpuslab.storage import materialize

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, sorted by training position; the last copy of a source is cut."""
    used = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = [c for c in docs.columns if c not in used]
    # Extra columns travel in a struct, so that none has the name of a column of the mix.
    shaped = docs.select(*used, F.struct(*extra).alias("_extra")) if extra else docs
    mixed = mixing.mix(shaped.withColumn("size", word_count(F.col("text"))))
    return mixing.training_order(mixed).select(*used, *(["_extra.*"] if extra else [])).select(docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; returns where each sequence lies. Copies of a document are numbered
    by their rows, so that the permutation parts them."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_number"))
    written = token_output.materialise(numbered, public_tokenizers.path(TOKENIZER), number="row_number")
    return written.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", target_weights),
    ("token-ID / binary output", token_shards),
]

#: Token records, adaptive fences and templates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
