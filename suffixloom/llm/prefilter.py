"""A Bloom filter of bounded size, to drop most rows of a large table before they are shuffled.

The filter has about 16 bits for each key, so that some 1.4 % of the other rows pass; an exact join follows. Beyond
MOST_KEYS keys no filter is sent; the rows are joined with the keys instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 23 keys give 16 MB.
MOST_KEYS, LEAST_BITS = 1 << 23, 1 << 16


def key_hash(key: str) -> Column:
    return F.xxhash64(key)


def bits_for(n: int) -> int:
    """Bits of a filter of n keys, a power of two."""
    return max(LEAST_BITS, 1 << (16 * n).bit_length())


def bloom_words(keys: DataFrame, key: str, bits: int, hashed: bool = False) -> np.ndarray:
    """The filter of distinct keys, which may be hashes already, as bits // 64 words. At most that many rows reach the driver."""
    h = F.col(key) if hashed else key_hash(key)
    places = keys.select(F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash of a key whether the filter may hold it."""
    h, last = hashes.view(np.uint64), np.uint64(64 * len(words) - 1)
    found = np.ones(len(h), dtype=bool)
    for at in (h & last, (h >> np.uint64(32)) & last):
        found &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def map_wanted(rows: DataFrame, wanted: DataFrame, key: str, run: Callable, schema: str, most_keys: int = MOST_KEYS) -> DataFrame:
    """`rows` through `run`, a function of Arrow batches: all rows whose `key` is in `wanted`, and perhaps a few more.

    Rows are not shuffled while the keys are at most `most_keys`: a filter of them goes to the rows.
    """
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    if n > most_keys:
        return rows.join(keys, key, "left_semi").mapInArrow(run, schema)
    words = rows.sparkSession.sparkContext.broadcast(bloom_words(keys, key, bits_for(n)))

    def filtered(batches):
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(may_hold(words.value, hashes)))

    return rows.select(*[F.col(f"`{c}`") for c in rows.columns], key_hash(key).alias("h")).mapInArrow(lambda batches: run(filtered(batches)), schema)
