"""Ranks of all suffixes of a collection by prefix doubling.

Strings are laid end to end in blocks, one row each, with the ranks of their suffixes: the rank of a suffix is the number of
suffixes that differ from it earlier and are smaller. After a round over h symbols, suffixes of equal rank are told apart by the
ranks of the suffixes h symbols further on, which stand in the same row: a lookup is no join. Only suffixes that are still tied
are sorted, by range, and of these only the keys travel, packed: what is found for them comes back in the order in which their
block dealt them out. Suffixes that are equal to their end stay tied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import partitions
from ..functions.packed import by_key, cut_by, dealing, gathered, lex_order, packed, rows_of, unpacked
from ..functions.storage import discard, stored
from ..sources.collection import BYTES, INTEGERS, is_bytes

#: Symbols of a block, terminators included; a longer string is a block of its own.
BLOCK = 1 << 21
#: A round tells suffixes apart by the ranks at so many places further on, less one.
FACTOR = 8
#: Packed string_ids are unsigned.
SIGN = 1 << 63

_STATE = "block bigint, n bigint, strings bigint, members bigint, most bigint, sizes binary, copies binary, ids binary, syms binary, ranks binary, open bigint"
_COLUMNS = [c.split(" ")[0] for c in _STATE.split(", ")]
_KINDS = [pa.int64()] * 5 + [pa.binary()] * 5 + [pa.int64()]


def _symbols(value, of_bytes: bool) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint8) if of_bytes else value.values.to_numpy()


def _row(values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values[c]], k) for c, k in zip(_COLUMNS, _KINDS, strict=True)], names=_COLUMNS)


def blocks(strings: DataFrame, most: int | None = None) -> DataFrame:
    """Strings (string_id, body or syms, ids) end to end, each with its terminator; `ids` are those of its copies, in order.

    sizes and copies go by string, ids by copy, syms and ranks by suffix; the column `most` is the greatest symbol, the argument
    the symbols of a block.
    """
    of_bytes = is_bytes(strings)
    column, most = BYTES if of_bytes else INTEGERS, most or BLOCK

    def run(batches):
        part, made, texts, copies, n = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            nonlocal made
            sizes = np.array([len(t) + 1 for t in texts])
            whole = np.zeros(n, dtype=np.uint64)
            for t, end in zip(texts, np.cumsum(sizes).tolist(), strict=True):
                whole[end - 1 - len(t) : end - 1] = t
            ids = np.concatenate(copies).view(np.uint64) ^ np.uint64(SIGN)
            made += 1
            return _row({
                "block": (part << 32) + made, "n": n, "strings": len(sizes), "members": len(ids), "most": int(whole.max()), "sizes": packed([sizes]), "copies": packed([np.array([len(c) for c in copies])]),
                "ids": packed([ids]), "syms": packed([whole]), "ranks": None, "open": n,
            })

        for batch in batches:
            for sid, value, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                syms = _symbols(value, of_bytes)
                if len(syms) and syms.min() < 1:
                    raise ValueError(f"string {sid} holds a symbol under 1, which is kept for the terminator")
                if texts and n + len(syms) + 1 > most:
                    yield out()
                    texts, copies, n = [], [], 0
                texts.append(syms)
                copies.append(ids.values.to_numpy())
                n += len(syms) + 1
        if texts:
            yield out()

    return strings.select("string_id", column, "ids").mapInArrow(run, _STATE)


class Block:
    """A row of `blocks`, unpacked."""

    def __init__(self, row: dict):
        self.row = row
        self.n, self.strings = row["n"].as_py(), row["strings"].as_py()
        self.sizes = self.column("sizes", self.strings).astype(np.int64)
        #: How many symbols stand before the terminator of the string, from each suffix on.
        self.left = np.repeat(np.cumsum(self.sizes) - 1, self.sizes) - np.arange(self.n)

    def column(self, name: str, n: int) -> np.ndarray:
        return unpacked(self.row[name].as_buffer(), 1, n)[0]

    def prefixes(self, bits: int) -> list[np.ndarray]:
        """As many symbols of each suffix, up to its end, as two integers hold."""
        syms, per = self.column("syms", self.n), 64 // bits
        one, two = np.zeros((2, self.n), dtype=np.uint64)
        for j in range(min(per, self.n)):
            one[: self.n - j] |= np.where(self.left[: self.n - j] >= j, syms[j:], 0) << np.uint64(bits * (per - 1 - j))
        if per < self.n:
            two[: self.n - per] = np.where(self.left[: self.n - per] >= per, one[per:], 0)
        return [one, two]

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each suffix, and whether it is tied."""
        coded = self.column("ranks", self.n)
        return coded >> np.uint64(1), (coded & np.uint64(1)).astype(bool)

    def owners(self) -> np.ndarray:
        """The number in the block of each suffix's string."""
        return np.repeat(np.arange(self.strings), self.sizes)

    def by_copy(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of `owner`, once for each copy of the string, and the copies' ids."""
        copies = self.column("copies", self.strings).astype(np.int64)
        n = copies[owner]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = self.column("ids", self.row["members"].as_py())[np.repeat((np.cumsum(copies) - copies)[owner], n) + within]
        return np.repeat(np.arange(len(owner)), n), ids

    def left_symbols(self) -> np.ndarray:
        """The symbol before each suffix; before a whole string stands the terminator of the one before, which is 0 too."""
        return np.concatenate([np.zeros(1, dtype=np.uint64), self.column("syms", self.n)[:-1]])


def with_copies(block: Block, owner: np.ndarray, keys: list[np.ndarray], tied: np.ndarray, sym: np.ndarray) -> list[np.ndarray]:
    """Rows for `dealt_runs`: the keys, then 0 with the number of copies of the string, or each copy's id where rows are tied."""
    alone, each = np.flatnonzero(~tied), np.flatnonzero(tied)
    rows, ids = block.by_copy(owner[each])
    at = np.concatenate([alone, each[rows]])
    copies = block.column("copies", block.strings)[owner[alone]]
    return [*(k[at] for k in keys), np.concatenate([np.zeros(len(alone), dtype=np.uint64), ids]), sym[at], np.concatenate([copies, np.ones(len(rows), dtype=np.uint64)])]


def _open(block: Block, bits: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes that a round tells apart, and the keys by which it does: first the symbols themselves, then the rank in which
    they are tied and those `width`, twice as many ... symbols on; a place beyond the string comes before all."""
    if not width:
        return np.arange(block.n), block.prefixes(bits)
    ranks, tied = block.ranks()
    at = np.flatnonzero(tied & (block.left >= width))
    ahead = [np.where(block.left[at] >= k * width, ranks[np.minimum(at + k * width, block.n - 1)] + np.uint64(1), np.uint64(0)) for k in range(1, FACTOR)]
    return at, [ranks[at], *ahead]


def _sorted_bucket(width: int):
    """For each block's part of a bucket, by suffix: four times how many rows of the bucket with the same old rank are smaller, 2
    if that rank is the bucket's first one, which may begin in a bucket before, and 1 if another row has the same keys."""

    def run(batches):
        for bucket, rows in by_key(batches, "bucket"):
            counts = [r["n"].as_py() for r in rows]
            owners = [r["block"].as_py() for r in rows]
            if bucket % 2:  # equal keys
                out, first, last, last_start = [None] * len(rows), 0, 0, 0
            else:
                n_keys = FACTOR if width else 2
                parts = [unpacked(r["data"].as_buffer(), n_keys, n) for r, n in zip(rows, counts, strict=True)]
                keys = [np.concatenate([p[k] for p in parts]) for k in range(n_keys)]
                del parts
                order, begins = lex_order(keys)
                places = np.arange(len(order))
                start = np.maximum.accumulate(np.where(begins, places, 0))
                alone = begins & np.append(begins[1:], True)
                first = last = last_start = 0
                group = np.zeros(len(order), dtype=np.int64)
                if width:
                    tie = keys[0][order]
                    group = np.maximum.accumulate(np.where(np.append(True, tie[1:] != tie[:-1]), places, 0))
                    first, last, last_start = int(tie[0]), int(tie[-1]), int(group[-1])
                found = np.empty(len(order), dtype=np.int64)
                found[order] = 4 * (start - group) + 2 * (group == 0) + ~alone
                ends = np.cumsum(counts)
                out = [packed([found[e - n : e]]) for e, n in zip(ends.tolist(), counts, strict=True)]
            same = [pa.array([x] * len(rows), pa.int64()) for x in (first, last, last_start)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int64()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary()), *same], names=["bucket", "block", "n", "data", "first", "last", "last_start"])

    return run


def _round(state: DataFrame, bits: int, width: int, total: int, step: int) -> DataFrame:
    """The state after the `total` open suffixes are told apart."""
    cuts = cut_by(state, lambda row: _open(Block(row), bits, width)[1], total)

    def deal(batches):
        for row in rows_of(batches):
            keys = _open(Block(row), bits, width)[1]
            order, buckets, begin, end = dealing(keys, cuts)
            data = [None if b % 2 else packed([k[order[s:e]] for k in keys]) for b, s, e in zip(buckets.tolist(), begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), row["block"].as_py())), pa.array(end - begin), pa.array(data, pa.binary())], names=["bucket", "block", "n", "data"])

    parts = partitions(state)
    dealt = state.where("open > 0").mapInArrow(deal, "bucket bigint, block bigint, n bigint, data binary")
    told = gathered(dealt, "bucket", "block", max(parts, len(cuts[0]) if cuts else 1)).mapInArrow(_sorted_bucket(width), "bucket bigint, block bigint, n bigint, data binary, first bigint, last bigint, last_start bigint")
    news = stored(told, "news")

    # A bucket's first rank may go on from the bucket before: how many rows of that rank lie there.
    shifts, sizes, offset, tie, began = {}, {}, 0, None, 0
    ends = news.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("first", "last", "last_start")])
    for e in ends.orderBy("bucket").collect():
        equal = e["bucket"] % 2 and width
        first, last = [int(cuts[0][e["bucket"] // 2])] * 2 if equal else (e["first"], e["last"])
        if first != tie:
            began = offset
        shifts[e["bucket"]], sizes[e["bucket"]] = offset - began, e["n"]
        if last != first:
            began = offset + e["last_start"]
        tie, offset = last, offset + e["n"]

    def fill(batches):
        for _, (row, *rows) in by_key(batches, "block"):
            if not row["open"].as_py():
                yield _row({c: row[c].as_py() for c in _COLUMNS})
                continue
            block = Block(row)
            at, keys = _open(block, bits, width)
            order, buckets, begin, end = dealing(keys, cuts)
            data = {r["bucket"].as_py(): r["data"].as_buffer() for r in rows}
            counts = (end - begin).tolist()
            parts = [np.full(n, 2 + (sizes[b] > 1), dtype=np.uint64) if b % 2 else unpacked(data[b], 1, n)[0] for b, n in zip(buckets.tolist(), counts, strict=True)]
            coded = block.column("ranks", block.n) if width else np.zeros(block.n, dtype=np.uint64)
            if parts:
                found = np.concatenate(parts)
                shift = np.repeat(np.array([shifts[b] for b in buckets.tolist()], dtype=np.uint64), counts)
                old = keys[0][order] if width else np.uint64(0)
                new = old + (found >> np.uint64(2)) + np.where(found & np.uint64(2), shift, np.uint64(0))
                coded[at[order]] = (new << np.uint64(1)) | (found & np.uint64(1))
            left = int(((coded & np.uint64(1)).astype(bool) & (block.left >= step)).sum())
            yield _row({c: row[c].as_py() for c in _COLUMNS} | {"ranks": packed([coded]), "open": left})

    both = state.select(F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), *_COLUMNS)
    both = both.unionByName(news.where("data is not null").select("bucket", "data", "block"), allowMissingColumns=True)
    after = stored(gathered(both, "block", "bucket", parts).mapInArrow(fill, _STATE), "ranks")
    discard(news, state)
    return after


def ranked_blocks(strings: DataFrame, most: int | None = None) -> DataFrame:
    """`blocks` with the ranks of their suffixes; suffixes are tied only if they are equal to their end."""
    state = stored(blocks(strings, most), "blocks")
    size = state.agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    if not size["n"]:
        return state
    bits = max(1, size["most"].bit_length())
    width, total, step = 0, size["n"], 2 * (64 // bits)
    while total:
        state = _round(state, bits, width, total, step)
        width, step = step, FACTOR * step
        total = state.agg(F.sum("open").alias("n")).first()["n"]
    return state


def suffix_ranks(strings: DataFrame) -> DataFrame:
    """(string_id, ranks ARRAY<BIGINT>): a rank for each position of each string, its terminator's included.

    Suffixes have equal ranks only if they are equal. A string is handled in one row and has less than 2 ** 31 symbols.
    Byte strings hold no byte 0, integer strings no value under 1.
    """

    def run(batches):
        for row in rows_of(batches):
            block = Block(row)
            ids = (block.column("ids", block.strings) ^ np.uint64(SIGN)).view(np.int64)
            ranks = pa.array(block.ranks()[0].astype(np.int64))
            offsets = pa.array(np.append(0, np.cumsum(block.sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, ranks)], names=["string_id", "ranks"])

    return ranked_blocks(strings.withColumn("ids", F.array("string_id"))).mapInArrow(run, "string_id bigint, ranks array<bigint>")
