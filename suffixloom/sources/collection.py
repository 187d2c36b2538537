"""String collections: (string_id, body BINARY) over bytes, or (string_id, syms ARRAY<BIGINT>) over integers from 1.

The terminator is symbol 0; it is never stored. string_id orders the strings and breaks ties between equal suffixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import sums_before
from ..functions.storage import stored

BYTES, INTEGERS = "body", "syms"


def is_bytes(strings: DataFrame) -> bool:
    return BYTES in strings.columns


def from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A string or binary column as bytes (UTF-8 for strings); null texts are empty strings."""
    column = F.col(f"`{text_col}`")
    kind = df.schema[text_col].dataType.simpleString()
    body = column if kind == "binary" else F.encode(column, "UTF-8")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("string_id"), F.coalesce(body, F.lit(b"")).alias(BYTES))


def from_text_files(spark: SparkSession, path: str, line_separator: str = "\n") -> DataFrame:
    """One string for each line, numbered without gaps by file (in the order of their paths), then place in the file."""
    lines = spark.read.option("lineSep", line_separator).text(path)
    part = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    held = stored(lines.select(part.alias("part"), F.monotonically_increasing_id().alias("place"), F.encode("value", "UTF-8").alias(BYTES)), "lines")
    # A part of a file is read in order by one task; how many lines lie before it follows from the counts.
    counts = held.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    shifts = sums_before(counts.select("part", "n", "first"), ["part"], "n", "shift").select("part", "first", "shift")
    return held.join(shifts, "part").select((F.col("shift") + F.col("place") - F.col("first")).alias("string_id"), BYTES)


def from_int_arrays(df: DataFrame, id_col: str, array_col: str, shift: int = 0) -> DataFrame:
    """An array column of integers; `shift` is added to each, so that the smallest symbol is at least 1."""
    syms = F.transform(F.coalesce(F.col(f"`{array_col}`"), F.array().cast("array<bigint>")), lambda x: x.cast("long") + shift)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("string_id"), syms.alias(INTEGERS))


def from_cells(spark: SparkSession, path: str, width: int, shift: int = 0) -> DataFrame:
    """Files of little-endian unsigned cells of 1, 2, 4 or 8 bytes, whose smallest value ends each string.

    Each file is a collection of its own and a row while it is read; string_id = 2 ** 32 * file + number in the file.
    """
    import numpy as np
    import pyarrow as pa

    if width not in (1, 2, 4, 8):
        raise ValueError("cells have 1, 2, 4 or 8 bytes")

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(data, dtype=f"<u{width}").astype(np.int64)
                ends = np.flatnonzero(cells == cells.min()) if len(cells) else cells
                parts = np.split(cells, ends + 1)
                parts = [p[:-1] for p in parts[:-1]] + ([parts[-1]] if len(parts[-1]) else [])
                yield pa.RecordBatch.from_arrays([pa.array([(number << 32) + i for i in range(len(parts))], pa.int64()), pa.array([p + shift for p in parts], pa.list_(pa.int64()))], names=["string_id", INTEGERS])

    files = spark.read.format("binaryFile").load(path)
    paths = sorted(r["path"] for r in files.select("path").collect())
    numbered = spark.createDataFrame(list(enumerate(paths)), "number bigint, path string")
    return files.join(F.broadcast(numbered), "path").select("number", "content").mapInArrow(run, f"string_id bigint, {INTEGERS} array<bigint>")


def reverse_complements(strings: DataFrame) -> DataFrame:
    """DNA strings and, numbered behind them, their reverse complements."""
    text = F.translate(F.reverse(F.decode(BYTES, "UTF-8")), "ACGTacgt", "TGCAtgca")
    last = strings.agg(F.max("string_id").alias("m")).first()["m"]
    return strings.unionByName(strings.select((F.col("string_id") + (last or 0) + 1).alias("string_id"), F.encode(text, "UTF-8").alias(BYTES)))


def lengths(strings: DataFrame):
    return F.length(BYTES) if is_bytes(strings) else F.size(INTEGERS)


def collection_stats(strings: DataFrame) -> DataFrame:
    """n_strings, n_symbols (terminators included), longest (with terminator): one row."""
    n = (lengths(strings) + 1).cast("long")
    return strings.agg(F.count("*").alias("n_strings"), F.coalesce(F.sum(n), F.lit(0)).alias("n_symbols"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))


def symbol_histogram(strings: DataFrame) -> DataFrame:
    """(sym, freq) with the terminator as 0."""
    import numpy as np
    import pyarrow as pa

    if is_bytes(strings):

        def run(batches):
            total = np.zeros(256, dtype=np.int64)
            for batch in batches:
                for body in batch.column(0):
                    total += np.bincount(np.frombuffer(body.as_buffer(), dtype=np.uint8), minlength=256)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["sym", "freq"])

        parts = strings.select(BYTES).mapInArrow(run, "sym bigint, freq bigint")
    else:
        parts = strings.select(F.explode(INTEGERS).alias("sym")).groupBy("sym").agg(F.count("*").alias("freq"))
    ends = strings.agg(F.lit(0).cast("long").alias("sym"), F.count("*").alias("freq")).where("freq > 0")
    return parts.unionByName(ends).groupBy("sym").agg(F.sum("freq").alias("freq"))
