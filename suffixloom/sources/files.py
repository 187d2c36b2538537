"""Files of transforms: run-length binary, plain bytes, two-column run lengths, histograms and recovered text.

Tables of runs are best kept as Parquet. The binary formats here are for exchange: a file is written by the driver as a
stream of chunks that tasks have encoded, in order, and read by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.collection import BYTES, INTEGERS

#: The header holds the bytes of a symbol and of a length as two unsigned 64-bit integers, least byte first;
#: a record is a symbol and a length of as many bytes, least byte first, without padding.
HEADER, CELL = 16, "<u8"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stream(chunks: DataFrame, path: str, head: bytes = b"") -> None:
    """Write the binary column `data` of rows ordered by `place`."""
    spark = chunks.sparkSession
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        if head:
            out.write(bytearray(head))
        for row in chunks.orderBy("place").select("data").toLocalIterator():
            out.write(bytearray(row["data"]))
    finally:
        out.close()


def byte_width(largest: int) -> int:
    """The least number of bytes, at least 1, that holds an unsigned integer."""
    return max(1, (int(largest).bit_length() + 7) // 8)


def _encoded(runs: DataFrame, encode) -> DataFrame:
    """(place, data): a chunk for each batch of runs in order."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                start, sym, length = (batch.column(k).to_numpy() for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([int(start[0])]), pa.array([encode(sym, length)], pa.binary())], names=["place", "data"])

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.select("start", "sym", "len").repartitionByRange(parts, "start").sortWithinPartitions("start").mapInArrow(run, "place bigint, data binary")


def _little(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype(CELL).view(np.uint8).reshape(-1, 8)[:, :width]


def write_runs(runs: DataFrame, path: str) -> tuple[int, int]:
    """One run-length binary file, in the smallest widths that fit; returns (symbol bytes, length bytes)."""
    most = runs.agg(F.coalesce(F.max("sym"), F.lit(0)).alias("s"), F.coalesce(F.max("len"), F.lit(0)).alias("n")).first()
    sb, fb = byte_width(most["s"]), byte_width(most["n"])
    _stream(_encoded(runs, lambda s, n: np.hstack([_little(s, sb), _little(n, fb)]).tobytes()), path, np.array([sb, fb], dtype=CELL).tobytes())
    return sb, fb


def read_runs(spark: SparkSession, path: str, piece: int = 1 << 16) -> DataFrame:
    """(run_id, start, sym, len) of a run-length binary file."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                raw = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                sb, fb = (int(x) for x in raw[:HEADER].view(CELL))
                records = raw[HEADER:].reshape(-1, sb + fb)
                at = 0
                for first in range(0, len(records), piece):
                    part = records[first : first + piece]
                    cells = np.zeros((2, len(part), 8), dtype=np.uint8)
                    cells[0, :, :sb], cells[1, :, :fb] = part[:, :sb], part[:, sb:]
                    sym, length = (c.reshape(-1).view(CELL).astype(np.int64) for c in cells)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), pa.array(at + np.cumsum(length) - length), pa.array(sym), pa.array(length)], names=["run_id", "start", "sym", "len"])
                    at += int(length.sum())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "run_id bigint, start bigint, sym bigint, len bigint")


def write_plain(runs: DataFrame, path: str, null_symbol: int | None = None) -> None:
    """One byte for each row of the transform; `null_symbol` in place of the terminator, if given."""
    _stream(_encoded(runs, lambda s, n: np.repeat(np.where(s == 0, null_symbol or 0, s).astype(np.uint8), n).tobytes()), path)


def write_columns(runs: DataFrame, prefix: str) -> None:
    """`prefix`.len with 32-bit lengths, least byte first, and `prefix`.syms with symbols of a byte."""
    most = runs.agg(F.coalesce(F.max("sym"), F.lit(0)).alias("s"), F.coalesce(F.max("len"), F.lit(0)).alias("n")).first()
    if most["s"] > 0xFF or most["n"] > 0xFFFFFFFF:
        raise ValueError("symbols of a byte and lengths of four are needed; keep these runs as Parquet")
    _stream(_encoded(runs, lambda s, n: n.astype("<u4").tobytes()), f"{prefix}.len")
    _stream(_encoded(runs, lambda s, n: s.astype(np.uint8).tobytes()), f"{prefix}.syms")


def read_columns(spark: SparkSession, prefix: str) -> DataFrame:
    """(run_id, start, sym, len) of the two files of `write_columns`, each of which is a row while it is read."""

    def run(batches):
        for batch in batches:
            for lens, syms in zip(batch.column(0), batch.column(1), strict=True):
                length = np.frombuffer(lens.as_buffer(), dtype="<u4").astype(np.int64)
                sym = np.frombuffer(syms.as_buffer(), dtype=np.uint8).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sym))), pa.array(np.cumsum(length) - length), pa.array(sym), pa.array(length)], names=["run_id", "start", "sym", "len"])

    content = lambda name: spark.read.format("binaryFile").load(f"{prefix}.{name}").select(F.lit(1).alias("one"), F.col("content").alias(name))
    both = content("len").join(content("syms"), "one")  # a row each
    return both.select("len", "syms").mapInArrow(run, "run_id bigint, start bigint, sym bigint, len bigint")


def write_cells(strings: DataFrame, path: str, width: int) -> None:
    """Integer strings in order, as little-endian unsigned cells of `width` bytes, each with a cell of 0 behind it."""

    def run(batches):
        for batch in batches:
            data = [np.append(v.values.to_numpy(), 0).astype(f"<u{width}").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["place", "data"])

    _stream(strings.select("string_id", INTEGERS).mapInArrow(run, "place bigint, data binary"), path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """A block histogram as tab-separated text with a header, in a directory of one file."""
    named = histogram.orderBy("runs_in_block").withColumnRenamed("runs_in_block", "number_of_runs_in_a_block")
    named.coalesce(1).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """A block histogram that `write_histogram` wrote."""
    schema = "number_of_runs_in_a_block bigint, freq bigint, relative_freq double, acc_freq double"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path).withColumnRenamed("number_of_runs_in_a_block", "runs_in_block")


def write_text(found: DataFrame, path: str, terminator: bytes = b"\n") -> None:
    """Recovered strings in order, each with the terminator behind it, as one file."""
    _stream(found.select(F.col("string_index").alias("place"), F.concat(F.col(BYTES), F.lit(terminator)).alias("data")), path)
