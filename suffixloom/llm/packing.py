"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces that fit k times into a sequence, and every sequence
of the class takes exactly k pieces, whatever else is packed. So a piece's place follows from its number within its class,
which a worker can tell from its own count and the counts of the workers before it; no worker waits for another's bins.

Documents may be cut. A document gives as many whole sequences as it fills; of the rest, pieces of capacity / 2, / 4, ...
down to `smallest` go to the classes 2, 4, ..., which they fill without padding. What is left, under `smallest`, goes to
the class of its length and pads at most a (k + 1)-th of its sequence. The last sequence of each class may be unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .tokens import encoder, public_path
from .workspace import materialize

#: Classes of uneven pieces are numbered from here, to keep them apart from those that are filled exactly.
UNEVEN = 1 << 20


def cut(total: int, capacity: int, smallest: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of `total` tokens, in order."""
    out = [(capacity, 1)] * (total // capacity)
    rest, size = total % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append((size, capacity // size))
            rest -= size
        size //= 2
    while rest > 0 and rest >= smallest:  # capacities that are no powers of two
        out.append((smallest, capacity // smallest))
        rest -= smallest
    if rest:
        out.append((rest, UNEVEN + capacity // rest))
    return out


def _joined(batches, least: int = 4 << 20):
    """Batches put together until they have `least` bytes: the more text at a time, the fewer lookups of a chunk."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, smallest: int = 128, end_id: int = 1, with_ids: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's tokens are those of its text by the tokenizer file and then `end_id`; a null or empty text is the one
    token `end_id`. Repeated rows and rows without an id are packed like any other. A sequence_id numbers the sequences
    without gaps; offsets within one run without gaps from 0. `order` names integer columns by which documents follow each
    other in the sequences. Other columns of `docs` are not looked at; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("long").alias(f"order_{i}") for i, c in enumerate(order)])
    by = [f"order_{i}" for i in range(len(order))]
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        encode, worker, counts = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        for batch in _joined(batches):
            of, start, length, crc, total, cls, number, ids = [], [], [], [], [], [], [], []
            for row, raw in enumerate(encode(batch.column(1))):
                raw = np.append(raw, end)
                n, at = len(raw), 0
                for size, k in cut(n, capacity, smallest):
                    piece = raw[at : at + size]
                    of.append(row), start.append(at), length.append(size), crc.append(zlib.crc32(piece)), total.append(n), cls.append(k)
                    counts[k] = counts.get(k, -1) + 1
                    number.append(counts[k])
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    at += size
            if not of:
                continue
            columns = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(cls, pa.int32()), pa.array([worker] * len(of), pa.int32()), pa.array(number, pa.int64())]
            columns += [batch.column(c).take(pa.array(of, pa.int64())) for c in by]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "number", *by]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, worker int, number bigint" + "".join(f", {c} bigint" for c in by) + ", ids array<int>" * with_ids
    pieces = materialize(source.mapInArrow(run, schema), "pieces", batch=256)

    per_bin = F.when(F.col("class") >= UNEVEN, F.col("class") - UNEVEN).otherwise(F.col("class")).cast("long")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"] + ["ids"] * with_ids
    if by:
        return _offsets(_in_order(pieces, per_bin, by), out)

    # Counts of (class, worker): at most some hundred classes, a row for each worker.
    per_worker = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(per_worker.select("class", "worker", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts")
    bins = shifts.groupBy("class").agg(F.ceil(F.sum("n") / F.first(per_bin)).cast("long").alias("bins"))
    earlier = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # a row for each class
    first = bins.select("class", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("first"))
    placed = shifts.select("class", "worker", "shift").join(F.broadcast(first), "class")

    dealt = pieces.join(placed, ["class", "worker"]).withColumn("number", F.col("shift") + F.col("number"))
    located = dealt.withColumn("slot", F.col("number") % per_bin).withColumn("sequence_id", F.col("first") + ((F.col("number") - F.col("slot")) / per_bin).cast("long"))
    return _offsets(located, out)


def _in_order(pieces: DataFrame, per_bin, by: list[str]) -> DataFrame:
    """`pieces` with slot and sequence_id: pieces of a class in the order `by`, sequences in that of their first pieces."""
    keys = [*by, "start"]
    ranked = numbered(pieces.drop("worker", "number"), ["class", *keys], "number")
    first = ranked.groupBy("class").agg(F.min("number").alias("first"))  # a row for each class
    ranked = ranked.join(F.broadcast(first), "class").withColumn("number", F.col("number") - F.col("first"))
    binned = ranked.withColumn("slot", F.col("number") % per_bin).withColumn("bin", ((F.col("number") - F.col("slot")) / per_bin).cast("long"))
    sequences = numbered(binned.where("slot = 0").select("class", "bin", *keys), [*keys, "class", "bin"], "sequence_id")
    return binned.join(sequences.select("class", "bin", "sequence_id"), ["class", "bin"])


def _offsets(located: DataFrame, out: list[str]) -> DataFrame:
    """`out` of pieces with slot and sequence_id."""
    even = located.where(F.col("class") < UNEVEN).withColumn("offset", F.col("slot") * F.col("length")).select(*out)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    uneven = located.where(F.col("class") >= UNEVEN).withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(*out)
    return even.unionByName(uneven)


def op6_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens of the public word BPE; odd rows as in `pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"))
