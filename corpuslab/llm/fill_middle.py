"""Fill-in-the-middle examples: documents cut at two places, the middle moved to the end.

A unit is a run of ASCII letters or one other character. Both cuts lie between units, at
places drawn from a hash of the key, so the number of units must be known first. A rolling
hash of the last 32 bytes cuts texts into chunks wherever its leading bits are zero; the same
passage is therefore cut alike in every document. A chunk's summary (units, characters,
letter at either end) is kept under its content, which a lookup compares byte by byte, and
serves all later copies of the passage in that worker. Summaries combine: two neighbours
share one unit where letters meet. Running totals over a text's chunks then name the chunk
that a cut lies in, and only that chunk is read to place the cut.

Only the places come from Python; the text is cut and joined by Spark's string functions.

Defined cases: a null or empty text is empty and plain; a null key is hashed as an empty
string; repeated rows are cut alike; texts that hold a sentinel stay plain; columns named
like an added one are replaced, other columns stay; an empty table gives an empty one.
"""
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.columns import free
from corpuslab.llm.words import text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of 100 documents with units, so many are transformed; of 100 of those, so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

WINDOW, CUT_BITS, LEAST, MOST = 32, 10, 256, 8192

#: Bytes of text that are hashed at a time; it bounds memory, not results.
BLOCK = 4 << 20

#: Bytes of chunks in one generation of a worker's memory; it bounds memory, not results.
REMEMBERED_BYTES = 32 << 20

#: The rolling hash's value of each byte: the top half of multiples of an odd number.
GEAR = (((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

PLACES = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def _hash_cuts(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW bytes has leading zeros."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        # The hash of 2w bytes is that of the last w, plus that of the w before, shifted by w.
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, on character borders; the last is its length."""
    data = np.frombuffer(raw, np.uint8)
    parts = []
    for start in range(0, len(data), BLOCK):
        before = min(start, WINDOW)
        cuts = _hash_cuts(data[start - before : start + BLOCK])
        parts.append(cuts[cuts > before] + (start - before))
    ends, last = [], 0

    def cut(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
        return at

    for part in parts:
        for at in part.tolist():
            while at - last > MOST:
                last = cut(last + MOST)
            if at - last >= LEAST and at < len(raw):
                last = cut(at)
    while len(raw) - last > MOST:
        last = cut(last + MOST)
    if last < len(raw):
        ends.append(len(raw))
    return ends


def unit_starts(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a chunk: does a character begin here; does a unit, if the chunk stood alone?"""
    data = np.frombuffer(chunk, np.uint8)
    letters = LETTER[data]
    characters = (data & 0xC0) != 0x80
    units = characters.copy()
    units[1:] &= ~(letters[1:] & letters[:-1])
    return characters, units


Summary = tuple[int, int, bool, bool]


class Summaries:
    """Summaries of chunks under their content, in two generations: what is asked for again stays."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.limit, self.held, self.computed = limit, 0, 0

    def __getitem__(self, chunk: bytes) -> Summary:
        # A dict compares the content itself, not the hash alone.
        found = self.young.get(chunk)
        if found is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            characters, units = unit_starts(chunk)
            found = (int(np.count_nonzero(units)), int(np.count_nonzero(characters)), bool(LETTER[chunk[0]]), bool(LETTER[chunk[-1]]))
            self.computed += 1
        if self.held + len(chunk) > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[chunk] = found
        self.held += len(chunk)
        return found


def cut_places(raw: bytes, draws: tuple[int, int], memory: Summaries) -> tuple[int, int, int]:
    """(units, characters before the first cut, characters before the second)."""
    ends = chunk_ends(raw)
    begins = [0, *ends[:-1]]
    summaries = [memory[raw[a:b]] for a, b in zip(begins, ends)]
    # A chunk that goes on with a letter where the last one ended with a letter begins no unit there.
    joined = [False, *(a[3] and b[2] for a, b in zip(summaries, summaries[1:]))]
    units = list(accumulate((s[0] - j for s, j in zip(summaries, joined)), initial=0))
    characters = list(accumulate((s[1] for s in summaries), initial=0))
    n = units[-1]
    places = []
    for unit in sorted(d % (n + 1) for d in draws):
        if unit == n:
            places.append(characters[-1])
            continue
        k = int(np.searchsorted(units, unit, "right")) - 1
        begun, starts = unit_starts(raw[begins[k] : ends[k]])
        at = np.flatnonzero(starts)[unit - units[k] + joined[k]]
        places.append(characters[k] + int(np.count_nonzero(begun[:at])))
    return n, places[0], places[1]


def places(text: Column, first: Column, second: Column) -> Column:
    """Struct of the number of units and the characters before the cuts that two draws choose."""

    @F.arrow_udf("struct<n: long, first: long, second: long>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memory = Summaries()
        for texts, firsts, seconds in batches:
            found = [
                cut_places(raw or b"", draws, memory)
                for raw, *draws in zip(texts.cast(pa.binary()).to_pylist(), firsts.to_pylist(), seconds.to_pylist())
            ]
            yield pa.array([dict(zip(("n", "first", "second"), f)) for f in found], PLACES)

    return find(text, first, second)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form. A transformed text holds no sentinel of its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Add n (units), form, prefix_chars, middle_chars (null if plain) and output, the training text."""
    spark = docs.sparkSession
    text_batches(spark)
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = free(docs, *(a for a in added if a not in (key, text)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    whole = F.coalesce(F.col(text), F.lit(""))
    cuts = kept.withColumn("_cuts", places(whole, draw[0], draw[1]))
    plain = whole.rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}") | (F.length(whole) == 0) | (draw[2] % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(draw[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    first, second = F.col("_cuts.first"), F.col("_cuts.second")
    formed = cuts.withColumn("form", form).withColumn("n", F.col("_cuts.n"))
    transformed = F.col("form") != "plain"
    formed = formed.withColumns({
        "prefix_chars": F.when(transformed, first), "middle_chars": F.when(transformed, second - first),
    })
    begin, middle = (F.col(c).cast("int") for c in ("prefix_chars", "middle_chars"))
    prefix = F.concat(F.lit(PREFIX), F.substring(whole, F.lit(1), begin))
    ending = F.concat(F.lit(SUFFIX), F.substring(whole, begin + middle + 1, F.length(whole)))
    moved = F.concat(F.lit(MIDDLE), F.substring(whole, begin + 1, middle))
    output = F.when(F.col("form") == "psm", F.concat(prefix, ending, moved)).when(
        F.col("form") == "spm", F.concat(ending, prefix, moved)).otherwise(whole)
    return formed.withColumn("output", output).drop("_cuts")
