"""What the operators share: the word definition and word hashing inside tasks."""
import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What ends a word (space, tab, line feed, vertical tab, form feed, carriage return).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Entries that a task's memory of words may hold; it bounds memory, not results.
CACHE_ENTRIES = 300_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    out = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(31)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of `size` well-mixed word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= FACTOR
        out += words[k : k + n]
    return mix(out)


#: An odd number and its inverse modulo 2 ** 64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ENDS_WORD = np.zeros(256, bool)
ENDS_WORD[[9, 10, 11, 12, 13, 32]] = True


def text_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Small Arrow batches of at most about `size` bytes, so that a task holds few texts at a time, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class WordReader:
    """Hashes of all words of many texts at once.

    A word's hash is the difference of two running sums of bytes times powers of FACTOR,
    taken back to the word's start; so no word becomes an object of its own."""

    def __init__(self):
        self.powers = self.inverses = np.empty(0, np.uint64)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words in a row, bounds: text k has the words bounds[k]:bounds[k + 1]); A-Z count as a-z."""
        raw = [(t or "").encode().lower() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if len(data) > len(self.powers):
            ones = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate([ones, np.full(len(data), FACTOR)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([ones, np.full(len(data), INVERSE)]), dtype=np.uint64)
        edges = np.flatnonzero(np.diff(ENDS_WORD[data].view(np.int8), prepend=np.int8(1)))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        return hashes, np.searchsorted(starts, offsets)
