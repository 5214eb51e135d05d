"""Packing tokenised documents into sequences of a fixed size, with little padding.

Documents are cut into full sequences and a rest. The rests are a cutting-stock problem over a
histogram of lengths: a linear program by column generation finds the patterns (cutting_stock.py)
and how many sequences use each. Pieces of one length are ranked, and rank ranges belong to
patterns, so a piece's sequence and offset follow from its length and rank by arithmetic. Ranks
come from two counts, within a task and over the tasks, so a length that most documents have
needs no large group. Sequences that no pattern fills to within SLACK tokens are laid end
to end instead and cut anew at every `size` tokens; only the last of those is padded.

Tokenising runs once: the pieces with their ids are written, the layout is made from their
lengths alone, and ids are only read again where a piece is cut. A text is cut at white space,
which no token of such a tokenizer crosses, the distinct words of a batch are merged together
(word_merges.py), and numpy puts the ids of the words in text order.

Defined cases: a null or empty text is the end id alone; a null key is kept; repeated rows are
packed one by one; columns other than key and text are ignored; an empty table gives no row.
"""
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import cutting_stock
from corpuslab.llm.word_merges import WordIds, checked, word_ids
from corpuslab.llm.words import text_batches
from corpuslab.storage import materialize, scratch_path

SIZE, END_ID = 2048, 1

#: Sequences that lack at most so many tokens are padded rather than cut.
SLACK = 8

#: Bytes of a text that are tokenised at a time; it bounds memory, not results.
SLICE_BYTES = 4 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")

PIECES = "part int, place long, key long, start long, length int, rank long, ids binary, ids_crc32 long, doc_tokens long"


def ids_of(reader: WordIds, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text. Long texts are cut at white space, so that their words fit in memory."""
    sizes = pc.binary_length(texts).to_numpy()
    if sizes.max(initial=0) <= SLICE_BYTES:
        ids, bounds = reader.encode(texts)
        yield from (ids[a:b] for a, b in zip(bounds, bounds[1:]))
        return
    for k, size in enumerate(sizes.tolist()):
        raw, parts, at = texts[k].as_py().encode(), [], 0
        while at < size:
            found = SPACE.search(raw, at + SLICE_BYTES)
            to = found.start() if found else size
            parts.append(reader.encode(pa.array([raw[at:to].decode()]))[0])
            at = to
        yield np.concatenate(parts) if parts else np.empty(0, np.uint32)


def tokenise(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Write the pieces: full sequences and the rest of each document, with their ids.

    (part, place) is a piece's number, rank its place among the task's pieces of that length."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(checked(file.read()))
    kinds = pa.schema([
        ("part", pa.int32()), ("place", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
        ("rank", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, place = word_ids(shared.value), TaskContext.get().partitionId(), 0
        ranks = [0] * (size + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(reader, batch.column(1))):
                raw, tokens = ids.astype("<u4", copy=False).tobytes() + end, len(ids) + 1
                for start in range(0, tokens, size):
                    body = raw[4 * start : 4 * (start + size)]
                    length = len(body) // 4
                    rows.append((part, place, doc, start, length, ranks[length], body, zlib.crc32(body), tokens))
                    ranks[length] += 1
                    place += 1
                    held += len(body)
                if held >= SLICE_BYTES:
                    yield _batch(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)

    used = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    path = scratch_path(spark, "pieces")
    used.mapInArrow(cut, PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


class Places:
    """Where the pieces of each length go, by rank: rank ranges of patterns, and the stretch that is cut anew."""

    COLUMNS = ("length", "pieces", "copies", "sequence", "offset", "stream")

    def __init__(self, patterns: list[tuple[cutting_stock.Pattern, int]], size: int, slack: int = SLACK):
        self.size, sequence, rows, cut = size, 0, [], {}
        for pattern, times in patterns:
            fill = cutting_stock.fill_of(pattern)
            if cutting_stock.padded(fill, size) - fill > slack:
                for length, copies in pattern:
                    cut[length] = cut.get(length, 0) + copies * times
                continue
            offset = 0
            for length, copies in pattern:
                rows.append((length, copies * times, copies, sequence, offset, 0))
                offset += length * copies
            sequence += times
        token = 0
        for length, pieces in sorted(cut.items(), reverse=True):
            rows.append((length, pieces, 1, sequence, token, 1))
            token += length * pieces
        self.sequences = sequence + -(-token // size)
        # Ranges in order of length; a length's ranks run through its ranges.
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, len(self.COLUMNS)).T
        self.length, self.pieces, self.copies, self.sequence, self.offset, self.stream = table
        self.begin = np.cumsum(self.pieces) - self.pieces
        self.first = np.zeros(size + 2, np.int64)
        np.add.at(self.first, self.length + 1, self.pieces)
        self.first = np.cumsum(self.first)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece's first token. Past the sequence's end, the rest goes to the next one."""
        order = self.first[length] + rank
        k = np.searchsorted(self.begin, order, "right") - 1
        rank = order - self.begin[k]
        turn, within = rank // self.copies[k], rank % self.copies[k]
        token = self.offset[k] + np.where(self.stream[k], rank, within) * length
        turn = np.where(self.stream[k], token // self.size, turn)
        return self.sequence[k] + turn, np.where(self.stream[k], token % self.size, token)


class Packing:
    """Pieces, and where they lie."""

    def __init__(self, pieces: DataFrame, size: int = SIZE, slack: int = SLACK):
        self.pieces, self.size = pieces, size
        counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        # One row for each length, at most `size`.
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        full = histogram.pop(size, 0)
        patterns, self.plan = cutting_stock.whole_patterns(histogram, size)
        self.places = places = Places([(((size, 1),), full)] * bool(full) + patterns, size, slack)
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        light = pieces.drop("ids").join(starts, ["length", "part"])
        columns = ["part", "place", "key", "start", "length", "ids_crc32", "doc_tokens"]
        kinds = "part int, place long, key long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long, skip int"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length = batch.column("length").to_numpy().astype(np.int64)
                rank = batch.column("rank").to_numpy() + batch.column("first").to_numpy()
                sequence, offset = places.find(length, rank)
                here = np.minimum(length, places.size - offset)
                # A cut piece is two rows: up to the sequence's end, and from the next one's begin.
                two = here < length
                rows = np.concatenate([np.arange(len(length)), np.flatnonzero(two)])
                skip = np.concatenate([np.zeros(len(length), np.int64), here[two]])
                out = {c: batch.column(c).take(pa.array(rows)) for c in columns}
                out["start"] = pa.array(out["start"].to_numpy() + skip)
                out["length"] = pa.array(np.concatenate([here, (length - here)[two]]).astype(np.int32))
                out["ids_crc32"] = pc.if_else(pa.array(two[rows]), pa.scalar(None, pa.int64()), out["ids_crc32"])
                out["sequence_id"] = pa.array(np.concatenate([sequence, sequence[two] + 1]))
                out["offset"] = pa.array(np.concatenate([offset, np.zeros(int(two.sum()), np.int64)]))
                out["skip"] = pa.array(skip.astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)

        self.layout = materialize(light.select(*columns, "rank", "first").mapInArrow(place, kinds), "layout")

    def _with_ids(self, layout: DataFrame) -> DataFrame:
        """Layout rows with their own ids, from the written pieces."""
        ids = self.pieces.select("part", "place", "ids")
        joined = layout.join(ids, ["part", "place"])
        return joined.withColumn("ids", F.expr("substring(ids, 4 * skip + 1, 4 * length)"))

    def rows(self, key: str = "key") -> DataFrame:
        """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
        columns = [F.col("key").alias(key), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        whole = self.layout.where(F.col("ids_crc32").isNotNull())
        # Written, so that their number is known: the ids of few cut pieces need no shuffle of all pieces.
        pieces = materialize(self.layout.where(F.col("ids_crc32").isNull()), "cut-pieces")
        cut = self._with_ids(pieces).withColumn("ids_crc32", F.crc32("ids"))
        return whole.select(columns).unionByName(cut.select(columns))

    def sequences(self, pad_id: int = 0) -> DataFrame:
        """(sequence_id, n_tokens, ids): the sequences themselves, padded unless their fill is a power of two."""
        parts = self._with_ids(self.layout).groupBy("sequence_id").agg(
            F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
        body = F.aggregate("parts", F.lit(b""), lambda all, p: F.concat(all, p["ids"]))
        filled = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, body).otherwise(
            F.rpad(body, F.lit(4 * self.size), F.lit(pad_id.to_bytes(4, "little"))))
        return parts.select("sequence_id", "n_tokens", filled.alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, slack: int = SLACK) -> Packing:
    """Tokenise `text` and lay the documents, each ended by `end_id`, into sequences of at most `size` ids."""
    return Packing(tokenise(docs, tokenizer_path, key, text, size, end_id), size, slack)
