"""Exact token counts of a byte-level BPE tokenizer with a whole-token shortcut.

Vocabulary strings proved offline to encode alone as one token count 1 at once; only the
other pre-tokens are merged (byte_pairs.py). Special strings inside a text are tokens of
their own, as the library has it by default.

Defined cases: a null or empty text has 0 tokens and 0 bytes; no length limit; extra
columns stay (one named `into` is replaced); repeated rows are counted alike; an empty table gives an empty one.
"""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.byte_pairs import BytePairs, load, odd_characters, special_strings, whole_tokens
from corpuslab.llm.columns import free
from corpuslab.llm.words import text_batches


def tokenizer_parts(tokenizer_path: str) -> tuple[str, dict[str, int], frozenset[str]]:
    """What BytePairs needs of a tokenizer's file, which the driver reads."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    special_strings(spec)
    return spec, whole_tokens(load(spec)), odd_characters(spec)


def with_token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of `text` (a long)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_parts(tokenizer_path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = BytePairs(*shared.value, summary=len)
        for batch in batches:
            yield pd.Series([sum(pairs.summaries(t)) for t in batch], dtype="int64")

    return free(docs, into).withColumn(into, count(F.col(text)))
