"""Token arrays: words, n-grams, stop words, truncation."""
from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab import constants as K


def words(c: Column, min_chars: int = 1) -> Column:
    """Word runs of at least ``min_chars`` characters, in text order."""
    return F.regexp_extract_all(c, F.lit(f"[{K.WORD_CHARS}]{{{min_chars},}}"), F.lit(0))


def feature_words(c: Column) -> Column:
    """Lowercased words of two characters or more (the TF-IDF default)."""
    return words(F.lower(c), 2)


def ngrams(tokens: Column, longest: int) -> Column:
    """All 1..longest grams, joined by a space. NULL tokens break a gram."""
    def of_length(n: int):
        # Past the end, and so in a gram that is cut off, a word is NULL.
        return lambda word, at: F.concat(word, *[part for k in range(1, n) for part in (F.lit(" "), F.get(tokens, at + k))])

    grams = tokens
    for n in range(2, longest + 1):
        grams = F.concat(grams, F.transform(tokens, of_length(n)))
    return F.filter(grams, lambda g: g.isNotNull())


def keep_only(tokens: Column, allowed: Sequence[str]) -> Column:
    """Tokens outside ``allowed`` become NULL, so positions stay."""
    return F.transform(tokens, lambda t: F.when(t.isin(list(allowed)), t))


def truncate(tokens: Column, limit: int = K.TOKEN_LIMIT) -> Column:
    return F.slice(tokens, 1, limit)


def english_stop_words() -> list[str]:
    """Public English list that ships with Spark ML."""
    return StopWordsRemover.loadDefaultStopWords("english")


def stop_words(library: Sequence[str] | None = None) -> list[str]:
    base = english_stop_words() if library is None else library
    return sorted({*base, *K.DOMAIN_STOP_WORDS})


def is_content_word(word: Column, stop: Sequence[str]) -> Column:
    """Neither a stop word nor a number."""
    return ~word.isin(list(stop)) & ~word.rlike(r"^\p{N}+$")
