"""Corpus clean-up as one plan."""
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.functions.text import (
    clean_id, id_from_subfolder, id_from_third_part, long_enough, mentions_any, normalize_text,
)
from corpuslab.operators.dedupe import dedup_first, dedup_none, union_all
from corpuslab.operators.joins import ingest_exact


def clean_corpus(
    corpus: DataFrame, text: str = "text", keywords: Sequence[str] = K.TIME_TREE_KEYWORDS
) -> DataFrame:
    """Long enough, relevant, distinct rows. Both filters run before the shuffle."""
    c = F.col(text)
    return dedup_first(corpus.where(long_enough(c) & mentions_any(c, keywords)))


def text_corpus(*tables: DataFrame) -> DataFrame:
    """All texts of several tables in model form, as one ``text`` column."""
    return union_all(*[t.select("text") for t in tables]).select(normalize_text(F.col("text")).alias("text"))


def ingest_own(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, text, downloaded, Binary) of files(path, text) below a folder of own papers.

    The id is the file's name, in quotes, as some are numbers. Metadata rows that occur more than
    once are left out altogether; every file of an id is kept.
    """
    named = files.select("path", id_from_third_part(F.col("path")).alias("id"), "text")
    return ingest_exact(named, dedup_none(metadata), keep=["Binary"], quote_ids=True, first_file_only=False)


def ingest_crawled(files: DataFrame, metadata: DataFrame, suffix: str = " pdf") -> DataFrame:
    """(id, text, downloaded) of files(path, text) below a crawled folder.

    Ids are cleaned on both sides, repeated metadata rows count once, and the files of an id that
    come after its first downloaded one are left out.
    """
    named = files.select("path", id_from_subfolder(F.col("path"), suffix).alias("id"), "text")
    known = dedup_first(metadata.withColumn("ID", clean_id(F.col("ID"))))
    return ingest_exact(named, known)
