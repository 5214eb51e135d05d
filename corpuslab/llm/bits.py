"""Bit tables of fixed size: a test, before anything is shuffled, that lets too much pass but never too little."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table, as a power of two (1 MiB).
TABLE_BITS = 23


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits set at the leading TABLE_BITS of the column `hash`. At most 2 ** TABLE_BITS / 32
    numbers reach the driver, however many hashes there are."""
    bit = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - TABLE_BITS}) % 32 as int))")
    words = hashes.select(F.floor(bit / 32).cast("int").alias("word"), one.alias("bit"))
    out = np.zeros(1 << (TABLE_BITS - 5), "<u4")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - TABLE_BITS)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
