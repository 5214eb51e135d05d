"""Exact-size, reproducible splits and samples.

Rows are ordered by an md5 of a seed and their key. The first k rows of that
order are found by radix selection on the hex digits: every step is a grouped
count (pre-aggregated before the shuffle) with at most 4,096 groups, and only
those counts reach the driver. The flag itself is then a narrow comparison, so
neither texts nor features are sorted or shuffled.
"""
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab import constants as K

DIGITS_PER_STEP = 3
HASH_DIGITS = 32
COPIES_PER_BLOCK = 100_000


@dataclass(frozen=True)
class Cut:
    """Rows whose hash starts at or before ``prefix`` are taken; of the rows that
    carry the full hash ``tie`` only ``from_tie`` out of ``tie_rows``."""

    total: int
    prefix: str
    tie: str | None = None
    from_tie: int = 0


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def find_cut(hashes: DataFrame, rows_wanted) -> Cut:
    """``hashes`` has one column ``h``; ``rows_wanted`` maps the total to k."""
    prefix, total, wanted = "", None, None
    while True:
        width = min(len(prefix) + DIGITS_PER_STEP, HASH_DIGITS)
        counts = (
            hashes.where(F.col("h").startswith(prefix))
            .groupBy(F.substring("h", 1, width).alias("p"))
            .count()
            .orderBy("p")
            .collect()
        )
        if total is None:
            total = sum(r["count"] for r in counts)
            wanted = min(rows_wanted(total), total)
            if wanted <= 0:
                return Cut(total, "")
        for row in counts:
            if row["count"] >= wanted:
                break
            wanted -= row["count"]
        prefix = row["p"]
        if row["count"] == wanted:
            return Cut(total, prefix)
        if width == HASH_DIGITS:
            return Cut(total, prefix, tie=prefix, from_tie=wanted)


def mark_first(
    df: DataFrame, rows_wanted, key: Sequence[str] | None = None, seed: int = 42,
    flag: str = "taken", among: Column | None = None,
) -> DataFrame:
    """Add a boolean: is the row among the first k in hash order?

    Rows outside ``among`` are neither counted nor flagged. ``key`` should identify
    a row. Where several rows share the key at the cut, they are ordered by all
    their columns; full copies are interchangeable and are counted and re-emitted,
    never ranked one by one.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    order = hash_order(key or df.columns, seed)
    cut = find_cut(df.where(among).select(order.alias("h")), rows_wanted)
    width = len(cut.prefix)
    if not width:
        return df.withColumn(flag, F.lit(False))
    inside = among & (F.substring(order, 1, width) <= cut.prefix)
    if cut.tie is None:
        return df.withColumn(flag, inside)
    at_tie = among & (order == cut.tie)
    tied = df.where(at_tie)
    if key and set(key) != set(df.columns):
        resolved = mark_first(tied, lambda _: cut.from_tie, None, seed, flag)
    else:
        resolved = _split_copies(tied, cut.from_tie, flag)
    return df.where(~at_tie).withColumn(flag, inside).unionByName(resolved)


def _split_copies(copies: DataFrame, wanted: int, flag: str) -> DataFrame:
    """``wanted`` of the equal rows are flagged. One counted row fans out into
    blocks, spread over tasks, before it becomes single rows again."""
    blocks = (
        copies.groupBy(*copies.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES_PER_BLOCK)))
        )
        .repartition("_b")
    )
    first = F.col("_b") * COPIES_PER_BLOCK + 1
    last = F.least(first + (COPIES_PER_BLOCK - 1), F.col("_n"))
    numbered = blocks.withColumn("_i", F.explode(F.sequence(first, last)))
    return numbered.withColumn(flag, F.col("_i") <= wanted).drop("_n", "_b", "_i")


def exact_split(
    df: DataFrame,
    key: Sequence[str] | None = None,
    test_share: float = K.TEST_SHARE,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exactly int(test_share * n) rows are 'test', the rest 'train'."""
    marked = mark_first(df, lambda n: int(test_share * n), key, seed, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def holdout(
    df: DataFrame, key: Sequence[str] | None = None, rows: int = K.HOLDOUT_ROWS, seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ``rows`` rows (or all, if fewer) are 'cv', the rest 'train'."""
    marked = mark_first(df, lambda n: rows, key, seed, "_cv")
    return marked.withColumn("split", F.when(F.col("_cv"), "cv").otherwise("train")).drop("_cv")


def sample_share(
    df: DataFrame,
    key: Sequence[str] | None = None,
    share: float = K.SAMPLE_SHARE,
    seed: int = 42,
) -> DataFrame:
    """Exactly round(share * n) rows, half to even."""
    marked = mark_first(df, lambda n: round(share * n), key, seed, "_in")
    return marked.where("_in").drop("_in")


def first_rows(df: DataFrame, rows: int, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows in hash order (all of them if there are fewer)."""
    return mark_first(df, lambda n: rows, key, seed, "_in").where("_in").drop("_in")
