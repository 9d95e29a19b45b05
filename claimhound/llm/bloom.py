"""A Bloom filter of fixed size over a column of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24
PROBES = 4


def _probe(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(10 * k)) & np.uint64((1 << BITS) - 1)


def bloom_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bit array of 2**BITS bits, whatever ``rows`` holds."""
    mask = F.lit((1 << BITS) - 1)
    probes = [F.shiftrightunsigned(column, 10 * k).bitwiseAND(mask) for k in range(PROBES)]
    bits = rows.select(F.explode(F.array(*probes)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("bits")
    )
    found = words.toPandas()  # at most 2**(BITS - 5) rows
    out = np.zeros(1 << (BITS - 5), dtype="<u4")
    out[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` (uint64) of hashes that the filter may hold."""
    places = np.arange(len(h))
    for k in range(PROBES):
        at = _probe(h[places], k)
        places = places[np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)) & 1)]
    return places
