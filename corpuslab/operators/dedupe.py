"""Duplicates, versions and set operations."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame) -> DataFrame:
    """One row per set of equal rows."""
    return df.dropDuplicates()


def dedup_none(df: DataFrame) -> DataFrame:
    """Only rows that occur exactly once."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.where("_copies = 1").drop("_copies")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], row_id: str | None = None
) -> DataFrame:
    """First row of every key.

    ``row_number() = 1`` lets Spark keep one row per key in each map task before
    the shuffle, so a hot key does not collect in one task. With ``row_id`` (a
    unique column) only keys, order and id take part in that shuffle; wide
    columns follow in one semi join on the evenly spread id.
    """
    spot = Window.partitionBy(*keys).orderBy(*order)
    if row_id is None:
        return df.withColumn("_rn", F.row_number().over(spot)).where("_rn = 1").drop("_rn")
    winners = df.withColumn("_rn", F.row_number().over(spot)).where("_rn = 1").select(row_id)
    return df.join(winners, row_id, "left_semi")


def latest_version(
    files: DataFrame, id_col: str, version_col: str, name_col: str
) -> DataFrame:
    """Highest version of every id; of equal versions the first name."""
    return first_per_key(
        files, [id_col], [F.col(version_col).desc(), F.col(name_col)], row_id=name_col
    )


def union_all(*tables: DataFrame) -> DataFrame:
    """By column name; a column a table lacks is NULL there."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def non_empty_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-empty values of several columns, as ``id``."""
    values = F.explode(F.array(*columns)).alias("id")
    return df.select(values).where("id is not null and id <> ''").distinct()
