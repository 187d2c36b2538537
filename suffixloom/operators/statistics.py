"""Statistics of the runs of a transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import sums_before
from ..functions.storage import stored


def run_stats(runs: DataFrame) -> DataFrame:
    """One row: runs, alphabet, n, n_per_run, longest, shortest, and the least bytes that hold symbols and lengths."""
    out = runs.agg(F.count("*").alias("runs"), F.countDistinct("sym").alias("alphabet"), F.sum("len").alias("n"), F.max("len").alias("longest"), F.min("len").alias("shortest"), F.max("sym").alias("largest_sym"))
    symbols = runs.groupBy("sym").agg(F.sum("len").alias("n")).agg(F.max("n").alias("most"))
    bytes_of = lambda c: F.greatest(F.lit(1), F.ceil(F.length(F.hex(c)) / 2)).cast("int")
    return out.crossJoin(F.broadcast(symbols)).select("runs", "alphabet", "n", (F.col("n") / F.col("runs")).alias("n_per_run"), "longest", "shortest", bytes_of("largest_sym").alias("symbol_bytes"), bytes_of("longest").alias("length_bytes"), bytes_of("most").alias("count_bytes"))


def symbol_stats(runs: DataFrame, bits: int = 32) -> DataFrame:
    """(place, sym, runs, freq, space, space_before) by ascending number of runs, then symbol: the space of a symbol's runs
    as 2 * `bits` bits each, and that of the symbols before it."""
    by_sym = runs.groupBy("sym").agg(F.count("*").alias("runs"), F.sum("len").alias("freq")).withColumn("space", F.col("runs") * (2 * bits))
    return sums_before(by_sym, ["runs", "sym"], "space", "space_before").select("place", "sym", "runs", "freq", "space", "space_before")


def length_bins(runs: DataFrame) -> DataFrame:
    """(bin, runs, percent): runs whose length takes 1 byte, 2 bytes, 3 or more. The bins exclude each other."""
    width = F.when(F.col("len") <= 0xFF, 1).when(F.col("len") <= 0xFFFF, 2).otherwise(3)
    counts = runs.groupBy(width.alias("bin")).agg(F.count("*").alias("runs"))
    bins = runs.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("bin"))
    total = F.sum("runs").over(Window.partitionBy())  # of three rows
    filled = bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("runs", F.lit(0)).alias("runs"))
    return filled.select("bin", "runs", (F.col("runs") * 100 / F.when(total > 0, total)).alias("percent"))


def invariants(runs: DataFrame) -> DataFrame:
    """One row: n, n_strings, unmerged (runs of the symbol of the run before), gaps (runs that do not begin where it ends).

    Tasks compare neighbours among the rows they get, which come in order; only runs whose neighbour is elsewhere are joined.
    """

    def run(batches):
        total, last = np.zeros(4, dtype=np.int64), None

        def ends(kind, row):
            return [kind, *(int(x) for x in row)]

        for batch in batches:
            if not batch.num_rows:
                continue
            number, start, sym, length = (c.to_numpy() for c in batch.columns)
            total[:2] += length.sum(), length[sym == 0].sum()
            out = []
            if last is not None:
                number, start, sym, length = (np.append(x, c) for x, c in zip(last, (number, start, sym, length), strict=True))
            follows = number[1:] == number[:-1] + 1
            total[2] += (follows & (sym[1:] == sym[:-1])).sum()
            total[3] += (follows & (start[1:] != start[:-1] + length[:-1])).sum()
            rows = np.stack([number, sym, start, start + length], axis=1)
            if last is None:
                out.append(ends(1, rows[0]))
            for i in np.flatnonzero(~follows).tolist():
                out += [ends(2, rows[i]), ends(1, rows[i + 1])]
            last = [c[-1] for c in (number, start, sym, length)]
            if out:
                yield edges(out)
        if last is not None:
            number, start, sym, length = last
            yield edges([ends(2, (number, sym, start, start + length)), [0, *total.tolist()]])

    def edges(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["kind", "a", "b", "c", "d"])

    found = stored(runs.select("run_id", "start", "sym", "len").mapInArrow(run, "kind bigint, a bigint, b bigint, c bigint, d bigint"), "edges")
    first = found.where("kind = 1").select(F.col("a").alias("run_id"), "b", "c")
    before = found.where("kind = 2").select((F.col("a") + 1).alias("run_id"), F.col("b").alias("sym"), F.col("d").alias("stop"))
    met = first.join(before, "run_id", "left").agg(F.count_if(F.col("b") == F.col("sym")).alias("u"), F.count_if(F.col("c") != F.coalesce("stop", F.lit(0))).alias("g"))
    sums = found.where("kind = 0").agg(*[F.sum(c).alias(c) for c in "abcd"])
    return sums.crossJoin(F.broadcast(met)).select(F.col("a").alias("n"), F.col("b").alias("n_strings"), (F.col("c") + F.col("u")).alias("unmerged"), (F.col("d") + F.col("g")).alias("gaps"))


def length_counts(runs: DataFrame) -> DataFrame:
    """(len, runs): the histogram of lengths, which is small beside the runs themselves."""
    return runs.groupBy("len").agg(F.count("*").alias("runs"))


def length_deciles(runs: DataFrame) -> DataFrame:
    """(decile, len): the length at place min(ceil(r * i / 10), r - 1), from 0, of the r sorted lengths, i = 1..9.

    Places are found in the running sum of the histogram, exactly and without sorting the runs.
    """
    histogram = length_counts(runs)
    reached = F.sum("runs").over(Window.orderBy("len"))  # a row for each different length
    total = F.sum("runs").over(Window.partitionBy())
    steps = histogram.select("len", reached.alias("to"), (reached - F.col("runs")).alias("from"), total.alias("r"))
    each = steps.withColumn("decile", F.explode(F.sequence(F.lit(1), F.lit(9))))
    place = F.least(F.expr("(r * decile + 9) div 10"), F.col("r") - 1)
    return each.where((place >= F.col("from")) & (place < F.col("to"))).select("decile", "len")
