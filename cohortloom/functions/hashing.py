"""Deterministic hash values for sampling and splitting.

`portable=True` uses MD5, whose value any SQL engine can reproduce. The
default, xxHash64, is several times cheaper per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER_BITS = 60


def hash_bucket(key: Column, buckets: int, portable: bool = False) -> Column:
    """Bucket number of a key, 0 <= bucket < buckets."""
    if portable:
        word = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    else:
        word = F.xxhash64(key)
    return F.pmod(word, F.lit(buckets).cast("bigint"))


def hash_order(keys: Sequence[Column], seed: int, portable: bool = False) -> Column:
    """A pseudo-random position of a row: a 60-bit number fixed by its keys and the seed."""
    if portable:
        text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
        digits = F.substring(F.md5(text), 1, ORDER_BITS // 4)
        return F.conv(digits, 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 64 - ORDER_BITS)
