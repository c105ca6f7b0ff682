"""A bit per key before a join: rows whose key the other side cannot hold do not shuffle.

Keys are hashed to bits, 16 for each key, and kept as bitmaps of 32,768 bits that are
broadcast behind a bound on their number. A row passes if its key's bit is set: all rows
with a partner pass, and of the others about one in 17. Everything stays in Catalyst
expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BITMAP = 32_768                       # bits of one bitmap, as Spark's bitmap functions have it
MAX_BYTES = 256 * 1024 * 1024         # bitmaps broadcast at most


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bits(keys: DataFrame, column: str, n_keys: int, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, int] | None:
    """(bitmaps, number of bits) of the non-null values of ``column``; None if about
    ``n_keys`` keys would take more than ``max_bytes``."""
    bits = BITMAP
    while bits < BITS_PER_KEY * n_keys:
        bits *= 2
    if bits // 8 > max_bytes:
        return None
    place = _place(F.col(column), bits)
    rows = keys.filter(F.col(column).isNotNull()).select(
        F.floor(place / BITMAP).cast("int").alias("_map"), (place % BITMAP).alias("_bit"))
    return rows.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), bits


def may_match(rows: DataFrame, column: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """The ``rows`` whose key may be among the filter's (never losing one that is); null
    keys go. A map-side join with the bitmaps and a test of one bit."""
    maps, bits = filter_
    place = _place(F.col(column), bits)
    bit = (place % BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1
    found = rows.filter(F.col(column).isNotNull()).withColumn("_map", F.floor(place / BITMAP).cast("int"))
    return found.join(F.broadcast(maps), "_map").filter(hit).select(*rows.columns)
