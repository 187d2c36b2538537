"""Columns of unsigned 64-bit integers that travel as packed bytes, a row for each block and bucket instead of one for each value.

A block holds what one task makes; a bucket is a range of keys that one task sorts. Both sides know in which order a block
deals its rows to the buckets, so that no places have to travel with the keys or with what is found for them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a bucket should hold.
BUCKET = 1 << 21
#: Keys that are looked at for each bucket to cut the range of keys.
SAMPLE = 64
#: Blocks whose keys are looked at for that, about.
SAMPLE_BLOCKS = 64


def packed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of one length as bytes: the number of planes of each, then the planes, least byte first, compressed."""
    heads, planes = [], []
    for c in columns:
        c = c.astype(np.uint64, copy=False)
        k = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        heads.append(k)
        planes += [(c >> np.uint64(8 * j)).astype(np.uint8) for j in range(k)]
    return bytes(heads) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data, count: int, n: int) -> list[np.ndarray]:
    """The `count` columns of `n` values that `packed` was given."""
    data = memoryview(data)
    heads = list(data[:count])
    raw = np.frombuffer(pa.decompress(data[count:], decompressed_size=n * sum(heads), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for k in heads:
        cells = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            cells |= raw[at : at + n].astype(np.uint64) << np.uint64(8 * j)
            at += n
        out.append(cells)
    return out


def lex_order(keys: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of unsigned keys, and which of them begin a group of equal keys.

    Bits of the keys are sorted together with the number of the row and of its group, so that plain sorts of integers do;
    only rows that are still tied are sorted on.
    """
    n = len(keys[0])
    order, begins = np.arange(n), np.zeros(n, dtype=bool)
    begins[:1] = True
    for key in keys:
        if not n:
            break
        key = key - key.min()
        left = int(key.max()).bit_length()
        while left:
            alone = begins.copy()
            alone[:-1] &= begins[1:]
            pos = np.flatnonzero(~alone)
            if not len(pos):
                return order, begins
            group = (np.cumsum(begins[pos]) - 1).astype(np.uint64)
            index_bits = (len(pos) - 1).bit_length()
            bits = min(left, 64 - int(group[-1]).bit_length() - index_bits)
            own = order[pos]
            mixed = (key[own] >> np.uint64(left - bits)) & np.uint64((1 << bits) - 1)
            mixed = ((group << np.uint64(bits) | mixed) << np.uint64(index_bits)) | np.arange(len(pos), dtype=np.uint64)
            mixed.sort()
            order[pos] = own[(mixed & np.uint64((1 << index_bits) - 1)).astype(np.int64)]
            mixed >>= np.uint64(index_bits)
            begins[pos] = np.concatenate([[True], mixed[1:] != mixed[:-1]])
            left -= bits
    return order, begins


def placed(keys: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bucket of each row: 2 i + 1 where it equals cut i, 2 i where it lies before it and behind cut i - 1.

    Rows of a frequent key are so a bucket of their own, which needs no sort.
    """
    low = np.searchsorted(cuts[0], keys[0], side="left")
    high = np.searchsorted(cuts[0], keys[0], side="right")
    out = 2 * low
    open_rows = np.flatnonzero(high > low)
    if len(open_rows):
        own = [k[open_rows] for k in keys]
        lo, hi = low[open_rows], high[open_rows]
        last = len(cuts[0]) - 1
        while (live := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, last)
            less, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
            for k, c in zip(own, cuts, strict=True):
                at = c[mid]
                less |= same & (at < k)
                same &= at == k
            lo, hi = np.where(live & less, mid + 1, lo), np.where(live & ~less, mid, hi)
        same = lo <= last
        for k, c in zip(own, cuts, strict=True):
            same &= c[np.minimum(lo, last)] == k
        out[open_rows] = 2 * lo + same
    return out


def cut_points(sample: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Different keys that cut the sample, a row for each, into so many equal parts."""
    if not len(sample) or buckets < 2:
        return [np.zeros(0, dtype=np.uint64) for _ in range(sample.shape[1])]
    order, _ = lex_order(list(sample.T))
    at = np.unique(np.linspace(0, len(order) - 1, buckets + 1).astype(np.int64)[1:-1])
    chosen = np.unique(sample[order[at]], axis=0)
    return [np.ascontiguousarray(c) for c in chosen.T]


def dealing(keys: Sequence[np.ndarray], cuts: Sequence[np.ndarray], plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How a block is dealt: rows by bucket, the buckets that have some, and where the rows of each begin and end.

    With `plain` buckets, for keys that are no more frequent than others, those that equal a cut lie with those behind it.
    """
    at = placed(keys, cuts) if cuts else np.zeros(len(keys[0]), dtype=np.int64)
    if plain:
        at = (at + 1) // 2
    at = at.astype(np.uint16) if not cuts or 2 * len(cuts[0]) < 1 << 16 else at
    order = np.argsort(at, kind="stable")
    in_order = at[order]
    first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    return order, in_order[first].astype(np.int64), first, np.append(first[1:], len(order))[: len(first)]


def sample_of(keys: Sequence[np.ndarray], share: float, seed: int) -> bytes:
    """Keys of a random share of the rows, at most."""
    n = len(keys[0])
    rows = np.random.default_rng(abs(seed)).integers(0, n, min(n, int(np.ceil(n * share)))) if n else np.zeros(0, dtype=np.int64)
    return np.stack([k[rows] for k in keys], axis=1).astype("<u8").tobytes()


def cut_by(table: DataFrame, keys_of, total: int) -> list[np.ndarray]:
    """Cuts of the keys that `keys_of` makes of the rows of `table`, `total` of them, for buckets of BUCKET keys."""
    buckets = -(-total // BUCKET)
    if buckets < 2:
        return []
    blocks = table.count()
    share = SAMPLE * buckets / total * max(1, blocks / SAMPLE_BLOCKS)

    def run(batches):
        for row in rows_of(batches):
            keys = keys_of(row)
            found = sample_of(keys, share, row["block"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)]), pa.array([found], pa.binary())], names=["width", "keys"])

    # Strings lie in blocks by chance; some blocks stand for all, and uneven cuts only make uneven buckets.
    some = table.where(F.pmod(F.xxhash64("block"), F.lit(blocks)) < SAMPLE_BLOCKS) if blocks > SAMPLE_BLOCKS else table
    found = [(r["width"], np.frombuffer(bytes(r["keys"]), dtype="<u8")) for r in some.mapInArrow(run, "width bigint, keys binary").collect()]
    if not found:
        return []
    return cut_points(np.concatenate([k.reshape(-1, w) for w, k in found]), buckets)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches as dicts of Arrow scalars."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def by_key(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that come one after the other under one value of a column."""
    held, key = [], None
    for row in rows_of(batches):
        if held and row[name].as_py() != key:
            yield key, held
            held = []
        key = row[name].as_py()
        held.append(row)
    if held:
        yield key, held


def gathered(df: DataFrame, key: str, then: str, parts: int) -> DataFrame:
    """Rows of one value of `key` in one task, in the order of `then`."""
    return df.repartition(parts, F.col(key)).sortWithinPartitions(key, then)
