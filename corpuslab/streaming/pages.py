"""Incremental ingest of saved API pages."""
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.operators.dedupe import first_per_key
from corpuslab.sources.documents import preprint_metadata
from corpuslab.storage import exists, materialize, remove, write_once

SALTS = 32

#: Parts of the ingested table by hash of the DOI; a batch reads those it touches.
BUCKETS = 64


def read_page_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, multiline: bool = True
) -> DataFrame:
    """Publications of the page files that arrive below ``path``, with their file.

    One page per file, or one per line without ``multiline``.
    """
    pages = (
        spark.readStream.schema(schemas.API_PAGE)
        .option("multiLine", multiline)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    files = pages.select(F.col("_metadata.file_path").alias("page"), "collection")
    return files.select("page", F.posexplode("collection").alias("pos", "p")).select("page", "pos", "p.*")


def recent_publications(listed: DataFrame, memory: str) -> DataFrame:
    """One row per DOI, remembered for ``memory`` of publication date.

    State is bounded, but rows older than that are dropped as late: only for pages
    that arrive in date order. The first pass, per DOI and group of files, keeps a
    DOI that is listed everywhere from meeting in one task.
    """
    salted = listed.withColumns(
        {"_date": F.try_to_timestamp("date"), "_salt": F.pmod(F.xxhash64("page"), F.lit(SALTS))}
    )
    return (
        salted.withWatermark("_date", memory)
        .dropDuplicatesWithinWatermark(["doi", "_salt"])
        .dropDuplicatesWithinWatermark(["doi"])
        .drop("_date", "_salt")
    )


# --- the table: buckets of the DOI and a ledger of batches ---------------------------
#
# data/commit=<name>/bucket=<n>/   rows of one batch, by hash of the DOI
# ledger/<name>                    one line of JSON per commit that counts
#
# A batch first writes its rows, then its ledger line; rows without a line are invisible. The line
# names the stream and the batch, so a repeated batch is known, and a stream that starts over with
# a new checkpoint finds its DOIs in the buckets that a batch touches. One stream writes at a time.


def _ledger(spark: SparkSession, table_path: str) -> list[dict]:
    """The lines of the ledger; a batch adds one, a compaction leaves one."""
    if not exists(spark, f"{table_path}/ledger"):
        return []
    lines = spark.read.option("pathGlobFilter", "*[0-9a-f]").text(f"{table_path}/ledger")
    return [json.loads(r["value"]) for r in lines.collect()]


def _live(lines: list[dict]) -> list[str]:
    replaced = {name for line in lines for name in line["replaces"]}
    return sorted(line["commit"] for line in lines if line["commit"] not in replaced)


def _rows(spark: SparkSession, table_path: str, commits: list[str]) -> DataFrame:
    schema = f"{schemas.PREPRINT_METADATA.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, commit string, bucket int"
    if not commits:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table_path}/data").where(F.col("commit").isin(commits))


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The metadata rows of all batches in the ledger, each DOI once."""
    return _rows(spark, table_path, _live(_ledger(spark, table_path))).drop("commit", "bucket")


def _in_buckets(spark: SparkSession, table_path: str, commits: list[str], buckets: list[int]) -> DataFrame:
    """(bucket, ID) of the rows in some buckets; only their files are read."""
    return _rows(spark, table_path, commits).where(F.col("bucket").isin(buckets)).select("bucket", "ID")


def _bucket(doi: str):
    return F.pmod(F.xxhash64(doi), F.lit(BUCKETS)).cast("int")


def _stream_id(spark: SparkSession, checkpoint_path: str) -> str:
    """The name of a checkpoint, kept in it: a checkpoint that is lost or new has another one."""
    path = f"{checkpoint_path}/stream-id"
    if not exists(spark, path):
        write_once(spark, path, uuid.uuid4().hex)
    return spark.read.text(path).first()["value"]


def append_batch(batch: DataFrame, table_path: str, stream: str, batch_id: int) -> None:
    """Write the DOIs of a batch that the table does not have; a batch in the ledger is left alone."""
    spark = batch.sparkSession
    lines = _ledger(spark, table_path)
    done = {tuple(b) for line in lines for b in line["batches"]}
    if (stream, batch_id) in done:
        return
    firsts = first_per_key(batch, ["doi"], [F.col("page"), F.col("pos")])
    rows = materialize(preprint_metadata(firsts).withColumn("bucket", _bucket("ID")), "ingest-batch")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    earlier = _in_buckets(spark, table_path, _live(lines), touched)
    new = rows.join(earlier, ["bucket", "ID"], "left_anti")
    # The name follows from stream and batch: an attempt that failed is overwritten by the next one.
    name = f"{stream}-{batch_id}"
    new.select(*schemas.PREPRINT_METADATA.fieldNames(), "bucket").repartition("bucket").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{table_path}/data/commit={name}")
    write_once(spark, f"{table_path}/ledger/{name}", json.dumps({"commit": name, "batches": [[stream, batch_id]], "replaces": []}))


def compact(spark: SparkSession, table_path: str) -> None:
    """Merge all batches into one commit with one file per bucket; the ledger keeps what was ingested."""
    lines = _ledger(spark, table_path)
    old = _live(lines)
    if len(old) < 2:
        return
    name = f"compact-{uuid.uuid4().hex}"
    _rows(spark, table_path, old).drop("commit").repartition("bucket").write.partitionBy("bucket").parquet(f"{table_path}/data/commit={name}")
    batches = sorted(b for line in lines for b in line["batches"])
    gone = sorted({line["commit"] for line in lines})
    write_once(spark, f"{table_path}/ledger/{name}", json.dumps({"commit": name, "batches": batches, "replaces": gone}))
    for commit in gone:
        remove(spark, f"{table_path}/data/commit={commit}")
        remove(spark, f"{table_path}/ledger/{commit}")


def ingest_page_stream(
    spark: SparkSession, pages_path: str, table_path: str, checkpoint_path: str,
    memory: str | None = None, files_per_trigger: int = 1000, multiline: bool = True,
) -> None:
    """Process what has arrived, append new metadata rows to Parquet, then stop.

    Run again with the same checkpoint to pick up where it left off. Without
    ``memory`` a DOI is looked up in the table itself (``read_ingested`` reads it): nothing
    is lost however late it comes or whatever its date, a new checkpoint adds no row twice,
    there is no growing state, and a hot DOI is cut down in the map tasks.
    """
    listed = read_page_stream(spark, pages_path, files_per_trigger, multiline)
    if memory is None:
        stream = _stream_id(spark, checkpoint_path)
        writer = listed.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, table_path, stream, batch_id))
    else:
        rows = preprint_metadata(recent_publications(listed, memory))
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", table_path)
    query = writer.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    query.awaitTermination()
