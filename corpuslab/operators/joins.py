"""Joins of files with metadata, membership flags and positional joins.

No broadcast hints on data: small sides are measured (written tables or scans) and
Spark broadcasts them by size; larger ones fall back to a shuffle join whose hot
keys the adaptive skew join splits.
"""
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import downloaded_flag, mentions_any, quoted
from corpuslab.storage import materialize


def ingest_exact(
    files: DataFrame, metadata: DataFrame, keep: Sequence[str] = (), quote_ids: bool = False,
    first_file_only: bool = True,
) -> DataFrame:
    """files(path, id, text) with metadata(ID, ...) on the id.

    Repeated metadata ids give several rows. With ``first_file_only`` the files of
    an id that come (by path) after its first long enough text are dropped. Rows
    are written whether or not the text is long enough; ``downloaded`` says so.

    Paths are unique. Which files stay is decided on path, id and length; texts follow
    in one join on the path.
    """
    facts = files.select("path", "id", downloaded_flag(F.col("text")).alias("downloaded"))
    if first_file_only:
        first = facts.where("downloaded = 1").groupBy("id").agg(F.min("path").alias("_first"))
        facts = (
            facts.join(first, "id", "left")
            .where(F.col("_first").isNull() | (F.col("path") <= F.col("_first")))
            .drop("_first")
        )
    chosen = facts.join(metadata.withColumnRenamed("ID", "id").select("id", *keep), "id")
    out_id = quoted(F.col("id")) if quote_ids else F.col("id")
    return files.select("path", "text").join(chosen, "path").select(
        out_id.alias("id"), "text", "downloaded", *keep
    )


def ingest_versioned(
    files: DataFrame, metadata: DataFrame, keywords: Sequence[str] | None = None
) -> DataFrame:
    """files(id, version, text) with metadata(ID, Version) where that pair is unique.

    Only relevant and long enough texts are kept.
    """
    distinct_rows = metadata.dropDuplicates()
    unique = (
        distinct_rows.groupBy(F.col("ID").alias("id"), F.col("Version").alias("version"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n = 1")
        .drop("_n")
    )
    hit = mentions_any(F.col("text")) if keywords is None else mentions_any(F.col("text"), keywords)
    wanted = files.where(hit & (downloaded_flag(F.col("text")) == 1))
    return wanted.join(unique, ["id", "version"], "left_semi").select(
        "id", "text", F.lit(1).alias("downloaded")
    )


def orphans(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files whose id the metadata does not know. They are reported, not deleted."""
    known = metadata.select(F.col("ID").alias("id")).distinct()
    return files.join(known, "id", "left_anti")


def flag_members(df: DataFrame, column: str, members: DataFrame, flag: str) -> DataFrame:
    """Boolean: is ``column`` among ``members.id`` (a set)?"""
    marked = members.select(F.col("id").alias(column), F.lit(True).alias(flag))
    return df.join(marked, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_row_index(df: DataFrame, order: Sequence[str], index: str = "row_index") -> DataFrame:
    """0-based position in the global order, without a one-task window.

    Range-sort, note (partition, offset in partition), write that down, then add
    the number of rows in earlier partitions: one small row per partition.
    """
    noted = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(noted, "indexed").withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per written partition, so a single ordered window is small here.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    offset = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(index, (F.col("_start") + offset).cast("long"))
        .drop("_at", "_part", "_start")
    )


def positional_join(
    left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]
) -> DataFrame:
    """Pair the i-th row of one table with the i-th row of the other."""
    return with_row_index(left, left_order).join(with_row_index(right, right_order), "row_index")
