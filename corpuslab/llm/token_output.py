"""Training-order output: token ids in fixed-stride shards that are read in sequence.

Each document is cut into sequences of `length` tokens; a sequence's number is its
document's number times the most sequences any document can have, plus its place. A
keyed Feistel network permutes these numbers, walking cycles until the image lies in
the same domain, so every sequence gets one place of its own and no table of places is
needed. Ranges of the permuted numbers are shards: one shuffle brings each sequence to
its range, where it is sorted and written as a record of fixed size. Ranks within the
shards, counted on from shard to shard, are the global slots 0..n-1.

A record is: key (int64), place (int32), tokens (int32), then `length` little-endian
ids, padded with zeros, and a line feed. Record k of a shard begins at k * stride, so a
reader can seek to any slot, read on in sequence, and resume. Shards are written
by Spark's committer: a lost executor repeats its tasks and leaves no partial file.

Defined cases: a null or empty text has no sequence; a null key is kept and shares one
number; repeated keys share a number and are ordered by their records; an empty
table gives no shard and no row.
"""
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.byte_merges import byte_ids
from corpuslab.llm.token_counts import tokenizer_parts
from corpuslab.llm.words import mix, text_batches
from corpuslab.storage import scratch_path

LENGTH, SHARD_BYTES, KEY, ROUNDS = 256, 16 << 20, 20_26, 4

#: Stands for a null key in records.
NULL_KEY = -(1 << 63)

HEADER = np.dtype([("key", "<i8"), ("place", "<i4"), ("tokens", "<i4")])


def permute(numbers: np.ndarray, domain: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..domain-1."""
    half = np.uint64(max(1, ((max(domain - 1, 1)).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in range(ROUNDS):
            salt = mix(np.array([key * ROUNDS + k + 1], np.uint64))
            left, right = right, left ^ (mix(right + salt) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(domain)]
    return out


def record_type(length: int, id_type: str) -> np.dtype:
    return np.dtype([*HEADER.descr, ("ids", id_type, (length,)), ("end", "S1")])


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, key: str = "doc_id", text: str = "text", number: str | None = None,
                 length: int = LENGTH, shard_bytes: int = SHARD_BYTES, permutation_key: int = KEY) -> int:
    """Write the shards below `path`; returns the stride in bytes. `key` is an integer column;
    `number` names an integer column to number documents by, where keys repeat."""
    docs = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.col(number or key).cast("long").alias("number"), F.col(text).alias("text"))
    text_batches(docs.sparkSession)
    size = F.octet_length("text")
    # A token has at least one byte, so bytes bound what a document and the corpus can have.
    low, high, longest, total = docs.agg(F.min("number"), F.max("number"), F.max(size), F.sum(size)).first()
    low, high, longest = low or 0, high or 0, longest or 0
    most = max(1, math.ceil(longest / length))
    domain = (high - low + 2) * most
    if domain >= 1 << 62:
        raise ValueError("keys are too far apart to number the sequences")
    # A missing number comes after the last one.
    docs = docs.withColumn("number", F.coalesce(F.col("number"), F.lit(high + 1)))
    parts = tokenizer_parts(tokenizer_path)
    id_type = "<u2" if max(parts[1].values()) < 1 << 16 else "<u4"
    kind = record_type(length, id_type)
    shards = max(1, math.ceil((total or 0) / 2.5 * kind["ids"].base.itemsize / shard_bytes))
    width = math.ceil(domain / shards)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = byte_ids(shared.value)
        step = length * kind["ids"].base.itemsize
        for batch in batches:
            for start in range(0, len(batch), 512):
                keys, numbers, places, bodies = [], [], [], []
                part = batch.iloc[start : start + 512]
                texts = pa.array(part["text"], pa.string(), from_pandas=True)
                for k, no, found in zip(part["key"], part["number"], reader.texts(texts)):
                    ids = found.astype(id_type).tobytes()
                    here = range(0, len(ids), step)
                    keys += [k] * len(here)
                    numbers += [(no - low) * most + place for place in range(len(here))]
                    places += range(len(here))
                    bodies += [ids[i : i + step] for i in here]
                if not bodies:
                    continue
                to = permute(np.array(numbers, np.int64), domain, permutation_key).astype(np.int64)
                yield pd.DataFrame({"shard": (to // width).astype("int32"), "to": to, "key": keys, "place": places, "body": bodies})

    schema = "shard int, to long, key long, place int, body binary"
    moved = docs.mapInPandas(sequences, schema).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "to", "key", "place", "body")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), kind)
            out["key"], out["place"], out["end"] = batch["key"], batch["place"], b"\n"
            step = length * kind["ids"].base.itemsize
            out["tokens"] = [len(body) * length // step for body in batch["body"]]
            out["ids"] = np.frombuffer(b"".join(body.ljust(step, b"\0") for body in batch["body"]), id_type).reshape(-1, length)
            raw = out.tobytes()
            yield pd.DataFrame({"shard": batch["shard"], "value": [raw[i : i + kind.itemsize - 1] for i in range(0, len(raw), kind.itemsize)]})

    # The text sink writes the bytes of its strings as they are and ends each record with the line feed.
    written = moved.select("shard", "key", "place", "body").mapInPandas(records, "shard int, value binary")
    written.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return kind.itemsize


def manifest(spark, path: str, stride: int) -> DataFrame:
    """One row per sequence, from the shards themselves: key, place, n_tokens, slot, shard and offset."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                raw = np.frombuffer(content, np.uint8).reshape(-1, stride)[:, : HEADER.itemsize]
                head = np.ascontiguousarray(raw).view(HEADER).ravel()
                yield pd.DataFrame({
                    "key": head["key"], "place": head["place"], "n_tokens": head["tokens"], "shard": shard,
                    "rank": np.arange(len(head))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("int").alias("shard"), "content", "length")
    # One row per shard: the shards before it hold so many records.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", F.coalesce(F.sum((F.col("length") / stride).cast("long")).over(before), F.lit(0)).alias("first"))
    rows = files.select("shard", "content").mapInPandas(headers, "key long, place int, n_tokens int, shard int, rank long")
    return rows.join(starts, "shard").select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("key"), "place", "n_tokens",
        (F.col("first") + F.col("rank")).alias("slot"), "shard", (F.col("rank") * stride).alias("offset"))


def materialise(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards (below the shared folder unless `path` is given) and return their manifest."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    stride = write_shards(docs, tokenizer_path, path, **options)
    return manifest(spark, path, stride)
