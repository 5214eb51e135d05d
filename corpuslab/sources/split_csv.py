"""CSV records with line breaks in quotes, read by many tasks per file (S2).

Spark's text source splits a file at lines. Whether a line begins inside quotes depends on all
quotes before it, so a first pass counts the quotes of each split; their running parity tells each
split how it begins. In the second pass every split puts its own records together. What is cut by a
split's border is a fragment, at most two per split, and fragments are joined by record afterwards.

Quotes inside a quoted field are doubled, as ``write_csv`` and RFC 4180 have it.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslab.storage import materialize

RECORD, HEAD, TAIL, MIDDLE = range(4)
ROWS = "file string, block long, seq long, kind int, value string"


class Assembler:
    """Puts the lines of one split together; ``inside`` says whether the split begins within quotes."""

    def __init__(self, inside: bool):
        self.begins_inside = self.inside = inside
        self.pending: str | None = None
        self.done = 0

    def feed(self, lines: pa.Array) -> list[tuple[int, int, str]]:
        """(seq, kind, value) of the records that end in these lines."""
        if self.pending is not None:
            lines = pa.concat_arrays([pa.array([self.pending]), lines.cast(pa.string())])
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((np.cumsum(quotes) + self.inside) % 2 == 0) + 1
        last = int(ends[-1]) if len(ends) else 0
        rest = lines[last:].to_pylist()
        self.pending = "\n".join(rest) if rest else None
        if not last:
            return []
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, lines[:last]), "\n").to_pylist()
        self.inside = False
        out = [(self.done + k, RECORD, value) for k, value in enumerate(whole)]
        if self.begins_inside and not self.done:
            out[0] = (0, HEAD, whole[0])
        self.done += len(out)
        return out

    def finish(self) -> list[tuple[int, int, str]]:
        if self.pending is None:
            return []
        return [(self.done, MIDDLE if self.begins_inside and not self.done else TAIL, self.pending)]


def _splits(batches: Iterator[pa.RecordBatch]):
    """((file, block), lines) of each stretch of lines that one split has in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = files.indices.to_numpy()
        starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield (files.dictionary[int(codes[a])].as_py(), int(blocks[a])), batch.column(0).slice(a, b - a)


def _records(lines: DataFrame, inside: frozenset[tuple[str, int]]) -> DataFrame:
    """Records and fragments of all splits; ``inside`` has the splits that begin within quotes."""
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None

        def out(found):
            seq, kind, value = zip(*found)
            n = len(found)
            return pa.RecordBatch.from_arrays([
                pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array(seq, pa.int64()), pa.array(kind, pa.int32()), pa.array(value)],
                ["file", "block", "seq", "kind", "value"])

        for split, some in _splits(batches):
            if split != at:
                if own and (found := own.finish()):
                    yield out(found)
                at, own = split, Assembler(split in shared.value)
            if found := own.feed(some):
                yield out(found)
        if own and (found := own.finish()):
            yield out(found)

    return lines.mapInArrow(assemble, ROWS)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first, value): the records of CSV files as text; ``first`` marks the first record of a file."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    # One row per split of a file at most: a hundred-millionth of the bytes or so.
    inside = frozenset((r["file"], r["block"]) for r in starts.where(F.col("before") % 2 == 1).select("file", "block").collect())
    found = materialize(_records(lines, inside), "csv-records")
    whole = found.where(F.col("kind") == RECORD).select("file", ((F.col("block") == 0) & (F.col("seq") == 0)).alias("first"), "value")
    # A fragment belongs to the last split before it that a record was left open in.
    order = Window.partitionBy("file").orderBy("block", "kind")
    cut = found.where(F.col("kind") != RECORD).withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "seq", "value")))
    joined = cut.groupBy("file", "record").agg(parts.alias("parts")).select(
        "file", ((F.col("parts")[0]["block"] == 0) & (F.col("parts")[0]["seq"] == 0)).alias("first"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined)


def read_split_csv(spark: SparkSession, path: str | list[str], schema: StructType, header: bool, options: dict[str, str], source: str | None) -> DataFrame:
    """The table of the records; empty lines are skipped, a carriage return before a line's end is part of it."""
    records = read_records(spark, path)
    if header:
        records = records.where(~F.col("first"))
    plain = records.withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")
    parsed = plain.select("file", F.from_csv("value", _ddl(schema), {**options, "multiLine": "true"}).alias("row"))
    columns = [F.col("row")[f.name].alias(f.name) for f in schema.fields]
    name = [F.element_at(F.split(F.col("file"), "/"), -1).alias(source)] if source else []
    return parsed.select(*columns, *name)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
