"""Document files, archives and saved API pages."""
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab import schemas
from corpuslab.functions.text import id_from_text_file, mentions_any, quoted
from corpuslab.operators.dedupe import first_per_key

ROWS_PER_BATCH = 256
PAYLOAD_PER_BATCH = 8 << 20


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of every file below ``path``, such as "*.txt" or
    "{*.zip,*.tar.gz}"."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )


def latin1_texts(files: DataFrame, keywords: Sequence[str] = K.TIME_TREE_KEYWORDS) -> DataFrame:
    """(id, text, downloaded) of the relevant texts among (path, content), whose
    bytes are ISO-8859-1. All line ends become \\n."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n")
    texts = files.select(id_from_text_file(F.col("path")).alias("id"), text.alias("text"))
    return texts.where(mentions_any(F.col("text"), keywords)).withColumn("downloaded", F.lit(1))


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name.split("/")[-1], archive.extractfile(info).read()


def _frames(rows: Iterator[tuple], columns: list[str], payload: int) -> Iterator[pd.DataFrame]:
    """Frames of limited row count and limited size of the payload column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or "")
        if len(held) >= ROWS_PER_BATCH or size >= PAYLOAD_PER_BATCH:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def expand_archives(archives: DataFrame) -> DataFrame:
    """(archive, member, content, error) from (path, content) of .zip and .tar.gz files.

    Zip members keep their path; tar members are flattened to the base name. A
    broken archive gives one row with its error. Members leave in small batches.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    for member, data in _members(name, content):
                        yield name, member, data, None
                except Exception as problem:  # keep going with the other archives
                    yield name, None, None, repr(problem)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(members(batches), ["archive", "member", "content", "error"], payload=2)

    return archives.select("path", "content").mapInPandas(
        expand, "archive string, member string, content binary, error string"
    )


def extract_texts(files: DataFrame, extractor: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) from (path, content); ``extractor`` is any function from
    file bytes to text. A failing file keeps its row, with the error."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    yield name, extractor(content), None
                except Exception as problem:
                    yield name, None, repr(problem)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(texts(batches), ["path", "text", "error"], payload=1)

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


# --- API pages ---------------------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, collection), one row per page file; a page is one JSON document."""
    return spark.read.schema(schemas.API_PAGE).json(path, multiLine=True).select(
        F.col("_metadata.file_path").alias("page"), "collection"
    )


def parse_pages(pages: DataFrame) -> DataFrame:
    """The same from pages(page, json)."""
    return pages.select("page", F.from_json("json", schemas.API_PAGE)["collection"].alias("collection"))


def publications(pages: DataFrame) -> DataFrame:
    """One row per listed publication: page, position and the seven fields."""
    return pages.select("page", F.posexplode("collection").alias("pos", "p")).select("page", "pos", "p.*")


def preprint_metadata(listed: DataFrame) -> DataFrame:
    """Renamed fields, version as a number, title and authors in quotes."""
    return listed.select(
        F.col("doi").alias("ID"),
        F.col("version").try_cast("int").alias("Version"),
        quoted(F.col("title")).alias("Title"),
        quoted(F.col("authors")).alias("Authors"),
        F.col("date").alias("Date"),
        F.col("category").alias("Category"),
        F.col("published").alias("Published"),
    )


def ingest_pages(pages: DataFrame) -> DataFrame:
    """Metadata rows of pages(page, collection); the first listing of a DOI wins.

    Listings are ordered by page and position.
    """
    listed = publications(pages)
    return preprint_metadata(first_per_key(listed, ["doi"], [F.col("page"), F.col("pos")]))
