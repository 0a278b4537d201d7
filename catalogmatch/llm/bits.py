"""Sets of 64-bit hashes as bitmaps of bounded size: a filter that lets some strangers pass, but no member out.

Built by Spark's bitmap aggregation, so no hash reaches the driver, only the bitmap, whose size is
bounded by ``MOST``.  A set too large for it makes the filter let more strangers through; who needs
exact answers joins with the set afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 22, 1 << 28  # bits: half a MB to 32 MB
_PER = 32_768  # bits in one value of bitmap_construct_agg


def size_for(members: int, least: int = LEAST, most: int = MOST) -> int:
    """Bits for so many members: 64 each, rounded up to a power of two, within the bounds."""
    return min(most, max(least, 1 << (64 * max(members, 1) - 1).bit_length()))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Two bits of ``bits`` (a power of two) set for each hash in ``column``, as packed bytes."""
    h = F.col(column)
    places = hashes.select(F.explode(F.array(
        F.shiftrightunsigned(h, 2).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 33).bitwiseAND(F.lit(bits - 1)))).alias("__at"))
    found = places.groupBy((F.col("__at") / _PER).cast("long").alias("__bucket")).agg(
        F.bitmap_construct_agg((F.col("__at") % _PER).cast("long")).alias("__bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in found.collect():  # one job; at most MOST bits
        out[row["__bucket"] * _PER // 8:(row["__bucket"] + 1) * _PER // 8] = np.frombuffer(row["__bits"], np.uint8)
    return out


def member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` may be in the set: all that are, and few others."""
    mask = np.uint64(len(bitmap) * 8 - 1)
    out = np.ones(len(hashes), bool)
    for shift in (2, 33):
        at = (hashes >> np.uint64(shift)) & mask
        out &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out
