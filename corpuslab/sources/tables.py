"""CSV and Parquet tables, splits, metrics and models."""
from pyspark.ml.base import Model
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpuslab.sources.split_csv import read_split_csv

_QUOTING = {"quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, header: bool = False,
    multiline: bool = True, source: str | None = None,
) -> DataFrame:
    """CSV with an explicit schema; paths and globs may name many files.

    ``source`` adds the file name as a column. Texts hold newlines, hence ``multiline``:
    records are put together across lines and splits, so many tasks read one file.
    Without it, every line is a record.
    """
    if multiline:
        return read_split_csv(spark, path, schema, header, _QUOTING, source)
    df = spark.read.schema(schema).options(**_QUOTING).csv(path, header=header)
    return df.withColumn(source, F.col("_metadata.file_name")) if source else df


def read_csv_strings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All-string table in which a missing value is the empty string."""
    return read_csv(spark, path, schema, header=True).na.fill("")


def write_csv(df: DataFrame, path: str, mode: str = "append", header: bool = False, rows_per_file: int = 0) -> None:
    """``append`` for incremental corpora, ``overwrite`` for finished tables.

    A table must not be overwritten by a plan that reads it.
    """
    df.write.mode(mode).options(**_QUOTING, maxRecordsPerFile=rows_per_file).csv(path, header=header)


def write_csv_quoted_strings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Strings in quotes, numbers bare, one record per line group, no header."""

    def cell(field):
        if isinstance(field.dataType, StringType):
            inner = F.replace(F.coalesce(field.name, F.lit("")), F.lit('"'), F.lit('""'))
            return F.concat(F.lit('"'), inner, F.lit('"'))
        return F.coalesce(F.col(field.name).cast("string"), F.lit('""'))

    line = F.concat_ws(",", *[cell(f) for f in df.schema.fields])
    df.select(line.alias("value")).write.mode(mode).text(path)


def csv_to_parquet(df: DataFrame, path: str, source: str = "source") -> None:
    """Corpus as Parquet, one folder per source, so a source filter prunes files."""
    df.write.mode("append").partitionBy(source).parquet(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: StructType, header: bool = True) -> DataFrame:
    """Named files as one table with a ``split`` column."""
    out = None
    for split, path in paths.items():
        part = read_csv(spark, path, schema, header=header).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str) -> Model:
    return kind.load(path)
