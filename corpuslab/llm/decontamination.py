"""Benchmark decontamination by templates.

Words are canonical: lower case without outer punctuation; numbers, units after a
number and names (capitalised inside a sentence) become typed placeholders. Windows of
WINDOW canonical words with at least LEAST_LITERAL literal ones are template windows. Casing tells
names only in some texts, so windows are also cut from a case-folded reading without names,
and from one in which line feeds end sentences; a match in any reading counts.
Benchmark and documents meet in a hash join of these windows. A hit keeps the words
behind its placeholders, its slots: along one alignment of an item in a document each
slot value of the item must always become the same value. So a question asked with
other numbers or names is found, and a chance mixture of templates is not.

Items with too few template windows (short ones, and such with many slots) are looked for
as a whole: one window of the item's own length, with the same check of slots.

A bit table of fixed size made of the benchmark's windows lets tasks drop nearly all of
a document's windows before anything is shuffled; it only ever lets too much pass.

Defined cases: null and empty texts match nothing; items with fewer than LEAST_WHOLE
canonical words (signs alone are none) cannot be told from chance and match nothing; a
whole item with fewer than LEAST_TEMPLATE literal words matches as written only; repeated rows and items are each
reported; documents are told apart by key and text, so a null key is no obstacle;
extra columns stay; empty tables give no row.
"""
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.bits import bit_table, in_table
from corpuslab.llm.columns import fresh
from corpuslab.llm.words import CACHE_ENTRIES, FACTOR, mix, text_batches, window_hashes
from corpuslab.storage import materialize

WINDOW, LEAST_LITERAL = 8, 5
#: Words of an item that must be found along one alignment (or the whole item, if shorter).
LEAST_WORDS = 12
#: Words that an item found as a whole has at least, and literal ones among them for other slot values to pass.
LEAST_WHOLE, LEAST_TEMPLATE = 6, 3
#: The benchmark's windows are broadcast up to this many; a larger benchmark is shuffled.
BROADCAST_WINDOWS = 500_000

#: Units and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters "
    "litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros percent degree degrees hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal mph kph"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
LITERAL, NUM, UNIT, CAPITAL, EMPTY = 0, 1, 2, 4, 8
ENDS = 16
FLAGS = 31


class Words(dict):
    """Per written word its canonical hash, the lowest bits of which say what it may be; remembered within a task."""

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        core = word.strip(string.punctuation + "“”‘’«»…–—¿¡")
        low = core.lower()
        flags = ENDS if word.rstrip("\"'”’)»").endswith((".", "!", "?", ":")) else 0
        if not core:
            flags |= EMPTY
        elif NUMBER.fullmatch(core) or low in NUMBERS:
            flags |= NUM
        else:
            flags |= UNIT * (low in UNITS) | CAPITAL * (core[0].isupper() and not core[1:].isupper())
        value = xxhash.xxh3_64_intdigest(low.encode()) & ~FLAGS | flags
        if len(self) < CACHE_ENTRIES:
            self[raw] = value
        return value


def template(texts: list[str | None], words: Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[bytes]]:
    """Of all words of the texts in a row: the readings (canonical hashes, placeholders), the text's number, the words.
    The readings: names by casing, where a line's first word is no name; the same where it may be one; case-folded
    with numbers and units as the only placeholders; and the words as written, without placeholders."""
    raw: list[bytes] = []
    owner, lines = [], []
    for t in texts:
        before = len(raw)
        for line in (t or "").encode().split(b"\n"):
            lines.append(len(raw))
            raw += line.split()
        owner.append(len(raw) - before)
    packed = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    flags = (packed & np.uint64(FLAGS)).astype(np.int64)
    hashes, owner = packed - flags.astype(np.uint64), np.repeat(np.arange(len(texts)), owner)
    first = np.ones(len(raw), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (flags[:-1] & ENDS > 0)
    # A line feed may end a sentence or only wrap one.
    opens = first.copy()
    opens[[k for k in lines if k < len(raw)]] = True
    use = flags & EMPTY == 0
    hashes, flags, owner, first, opens = hashes[use], flags[use], owner[use], first[use], opens[use]
    after_number = np.zeros(len(flags), bool)
    after_number[1:] = (flags[:-1] & NUM > 0) & (owner[1:] == owner[:-1])
    folded = np.where(flags & NUM, NUM, np.where((flags & UNIT > 0) & after_number, UNIT, LITERAL))
    named = [np.where((folded == LITERAL) & (flags & CAPITAL > 0) & ~begins, CAPITAL, folded) for begins in (opens, first)]
    readings = [(np.where(s == LITERAL, hashes, s.astype(np.uint64)), s) for s in (*named, folded, np.zeros_like(folded))]
    return readings, owner, [w for w, u in zip(raw, use) if u]


def usable(hashes: np.ndarray, slot: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of WINDOW words, and which of them lie in one text with enough literal words."""
    at = window_hashes(hashes, WINDOW)
    literal = np.concatenate([[0], np.cumsum(slot == LITERAL)])
    return at, (owner[: len(at)] == owner[WINDOW - 1 :][: len(at)]) & (literal[WINDOW:][: len(at)] - literal[: len(at)] >= LEAST_LITERAL)


def whole_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hashes) of the runs of each length, ascending, that end within their texts."""
    out, read = hashes[starts], 1
    for n in lengths:
        inside = starts + n <= ends
        starts, ends, out = starts[inside], ends[inside], out[inside]
        if not len(starts):
            return
        for k in range(read, n):
            out *= FACTOR
            out += hashes[starts + k]
        read = n
        # Apart from the hashes of windows, which may be of the same words.
        yield n, starts, mix(out + FACTOR)


def slots(raw: list[bytes], slot: np.ndarray, start: int, n: int) -> list[str]:
    return [raw[j].decode().strip(string.punctuation).lower() for j in range(start, start + n) if slot[j] != LITERAL]


def item_windows(text: str | None, words: Words) -> Iterator[tuple]:
    """ITEM_COLUMNS of an item: its template windows, and the item as a whole where these are too few."""
    readings, owner, raw = template([text], words)
    size, seen = len(raw), set()
    cut = [usable(*r, owner) for r in readings[:-1]]
    *named, folded = (int(fits.sum()) for _, fits in cut)
    counts = max(1, min(named)), folded
    for no, ((at, fits), (_, slot)) in enumerate(zip(cut, readings)):
        for k in np.flatnonzero(fits):
            if (k, at[k]) not in seen:
                seen.add((k, at[k]))
                yield int(k), int(at[k].astype(np.int64)), slots(raw, slot, k, WINDOW), size, *counts, no < len(named), False, None
    if size < LEAST_WHOLE or min(named) >= LEAST_WORDS - WINDOW + 1:
        return
    told = [r for r in readings[:-1] if (r[1] == LITERAL).sum() >= LEAST_TEMPLATE]
    for hashes, slot in told or readings[-1:]:
        (_, _, value), = whole_hashes(hashes, np.zeros(1, int), np.full(1, size), [size])
        if value[0] not in seen:
            seen.add(value[0])
            anchor = window_hashes(hashes[:LEAST_WHOLE], LEAST_WHOLE)[0]
            yield 0, int(value[0].astype(np.int64)), slots(raw, slot, 0, size), size, *counts, True, True, int(anchor.astype(np.int64))


def windows(texts: list[str | None], words: Words, wanted: np.ndarray, anchors: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, int, list[str]]]:
    """(text number, place of the first word in its text, hash, slot values) of the windows and whole items in the table `wanted`.
    Whole items are looked for where their first LEAST_WHOLE words are in the table `anchors`."""
    readings, owner, raw = template(texts, words)
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    seen = set()
    for no, (hashes, slot) in enumerate(readings):
        found = []
        if no < len(readings) - 1:
            at, fits = usable(hashes, slot, owner)
            starts = np.flatnonzero(fits & in_table(wanted, at))
            found.append((WINDOW, starts, at[starts]))
        if lengths:
            at = window_hashes(hashes, LEAST_WHOLE)
            starts = np.flatnonzero(in_table(anchors, at))
            found += whole_hashes(hashes, starts, begins[owner[starts] + 1], lengths)
        for n, starts, values in found:
            for k, value in zip(starts, values):
                if in_table(wanted, value) and (k, value) not in seen:
                    seen.add((k, value))
                    yield int(owner[k]), int(k - begins[owner[k]]), int(value.astype(np.int64)), slots(raw, slot, k, n)


WINDOW_COLUMNS = "place int, hash long, slots array<string>"
ITEM_COLUMNS = "_at int, hash long, _slots array<string>, _size int, _usable_named int, _usable int, _named boolean, _whole boolean, _anchor long"


def cut_texts(rows: DataFrame, keys: list[str], text: str, columns: str, cut: Callable[[list, Words], Iterator[tuple]]) -> DataFrame:
    """The key columns and `columns` for all that `cut` finds in texts: tuples of the text's number and the columns."""
    text_batches(rows.sparkSession)
    rows = rows.select(*keys, F.col(text).alias("_text"))
    types = ", ".join(f"`{k}` {t}" for k, t in rows.drop("_text").dtypes)
    names = [c.split()[0] for c in columns.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [arrow[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = list(cut(part.column("_text").to_pylist(), words))
                if found:
                    owner, *values = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(k).take(pa.array(owner)) for k in keys] + [pa.array(v, t) for v, t in zip(values, kinds)], [*keys, *names])

    return rows.mapInArrow(run, f"{types}, {columns}")


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item found in it: key, _row (tells documents apart), item,
    n_words (found along the best alignment), exact (no slot differs there), occurrences."""
    items = materialize(
        cut_texts(benchmark, [item], text, ITEM_COLUMNS, lambda texts, words: ((k, *w) for k, t in enumerate(texts) for w in item_windows(t, words))),
        "benchmark-windows")
    docs = docs.select(F.col(key), F.xxhash64(key, text).alias("_row"), text)
    whole = items.where("_whole")
    # Distinct lengths: fewer than the square root of twice the words of the benchmark.
    lengths = sorted(r[0] for r in whole.select("_size").distinct().collect())
    tables = docs.sparkSession.sparkContext.broadcast((bit_table(items), bit_table(whole.select(F.col("_anchor").alias("hash")))))
    hits = cut_texts(docs, [key, "_row"], text, WINDOW_COLUMNS, lambda texts, words: windows(texts, words, *tables.value, lengths))
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    pairs = F.arrays_zip(F.col("_slots").alias("a"), F.col("slots").alias("b"))
    along = (
        hits.join(items, "hash").where(F.size("slots") == F.size("_slots"))
        .groupBy(key, "_row", item, "_size", "_usable_named", "_usable", (F.col("place") - F.col("_at")).alias("_line"))
        .agg(F.collect_set(F.when(~F.col("_whole"), F.col("_at"))).alias("_found"),
             F.collect_set(F.when(~F.col("_whole") & F.col("_named"), F.col("_at"))).alias("_found_named"), F.max("_whole").alias("_whole"),
             F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    )
    values = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    consistent = F.size(values) == F.size("pairs")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_found", lambda a: F.sequence(a, a + (WINDOW - 1))))))
    n_words = F.when(F.col("_whole"), F.col("_size")).otherwise(covered)
    # An item's windows with too few literal words cannot be found, so they are not asked for.
    all_of = lambda found, usable: F.size(found) >= F.least(F.lit(LEAST_WORDS - WINDOW + 1), F.col(usable))
    enough = (n_words >= F.least(F.lit(LEAST_WORDS), F.col("_size"))) & (
        F.col("_whole") | all_of("_found", "_usable") | all_of("_found_named", "_usable_named"))
    exact = ~F.exists("pairs", lambda p: p["a"] != p["b"])
    return along.where(consistent & enough).groupBy(key, "_row", item).agg(
        F.max(n_words).cast("int").alias("n_words"), F.max(exact).alias("exact"), F.count("*").cast("int").alias("occurrences"))


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark item is found."""
    row = fresh(docs, "_row")
    found = find(docs, benchmark, key, text=text, **options).select(F.col("_row").alias(row)).distinct()
    return docs.withColumn(row, F.xxhash64(key, text)).join(found, row, "left_anti").drop(row)
