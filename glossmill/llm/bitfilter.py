"""A bit filter of fixed size over 64-bit hashes, built by Spark and tested in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MB, whatever it is built from; the more goes in, the more it lets through.
BITS = 24
_MAP = 15  # bits of one bitmap_construct_agg bitmap: 4 KB


def build(rows: DataFrame, hashed: Column) -> np.ndarray:
    """Bits set at the top ``BITS`` bits of each hash; at most 512 maps of 4 KB come to the driver."""
    bit = F.shiftrightunsigned(hashed, 64 - BITS)
    maps = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", _MAP).alias("map")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << _MAP) - 1)).alias("bits")).collect()
    bits = np.zeros((1 << BITS - _MAP, 1 << _MAP - 3), np.uint8)
    for r in maps:
        bits[r["map"], : len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.ravel()


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h >> np.uint64(64 - BITS)
    return (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
