"""Splitting runs by a largest length and at block boundaries, and how runs lie in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import PART, in_parts


def split_runs(runs: DataFrame, max_len: int, block_size: int | None = None) -> DataFrame:
    """(start, sym, len, block): pieces of at most `max_len` rows, counted from each run's start, cut again at every
    multiple of `block_size`. Without a block size no such cuts, and `block` is null. No piece is empty."""
    if max_len < 1 or (block_size is not None and block_size < 1):
        raise ValueError("lengths must be positive")
    # Long runs are taken apart first, where they are cut anyway, so that no row holds the cuts of a whole run.
    runs = in_parts(runs, max(1, PART // max_len) * max_len)
    end = "start + len"
    cuts = f"sequence(start, {end} - 1, {max_len}L)"
    if block_size is not None:
        first = f"(start div {block_size}L + 1) * {block_size}L"
        cuts = f"array_union({cuts}, if({first} < {end}, sequence({first}, {end} - 1, {block_size}L), array()))"
    pieces = runs.select("sym", F.expr(end).alias("stop"), F.expr(f"array_sort({cuts})").alias("cuts"))
    pieces = pieces.select("sym", F.posexplode(F.expr("transform(cuts, (c, i) -> named_struct('a', c, 'b', coalesce(get(cuts, i + 1), stop)))")).alias("i", "p"))
    block = F.expr(f"p.a div {block_size}L") if block_size is not None else F.lit(None).cast("long")
    return pieces.select(F.col("p.a").alias("start"), "sym", (F.col("p.b") - F.col("p.a")).alias("len"), block.alias("block"))


def bits_to_length(bits: int) -> int:
    """The largest length that `bits` bits hold."""
    return (1 << bits) - 1


def block_counts(pieces: DataFrame) -> DataFrame:
    """(block, runs)."""
    return pieces.groupBy("block").agg(F.count("*").alias("runs"))


def split_summary(runs: DataFrame, max_len: int, block_size: int) -> DataFrame:
    """One row: runs_before, runs_after, length_splits, block_splits, increase, most_in_block, fewest_in_block.

    A cut that both rules ask for counts as a split by length.
    """
    pieces = split_runs(runs, max_len, block_size)
    by_block = block_counts(pieces).agg(F.max("runs").alias("most_in_block"), F.min("runs").alias("fewest_in_block"), F.sum("runs").alias("runs_after"))
    before = runs.agg(F.count("*").alias("runs_before"), F.coalesce(F.sum(F.expr(f"(len - 1) div {max_len}L")), F.lit(0)).alias("length_splits"))
    both = before.crossJoin(F.broadcast(by_block))
    return both.select("runs_before", "runs_after", "length_splits", (F.col("runs_after") - F.col("runs_before") - F.col("length_splits")).alias("block_splits"), (F.col("runs_after") / F.col("runs_before")).alias("increase"), "most_in_block", "fewest_in_block")


def block_histogram(pieces: DataFrame) -> DataFrame:
    """(runs_in_block, freq, relative_freq, acc_freq): how many blocks hold so many runs. One row for each number."""
    counts = block_counts(pieces).groupBy(F.col("runs").alias("runs_in_block")).agg(F.count("*").alias("freq"))
    total, upto = F.sum("freq").over(Window.partitionBy()), F.sum("freq").over(Window.orderBy("runs_in_block"))
    return counts.select("runs_in_block", "freq", (F.col("freq") / total).alias("relative_freq"), (upto / total).alias("acc_freq"))


def block_quartiles(pieces: DataFrame) -> DataFrame:
    """One row: blocks, q1, q2, q3, upper_whisker of the runs in a block.

    q_i is the least number whose running count exceeds (B + 1) / 4, (B + 1) / 2 or 3 (B + 1) / 4, by integer division for
    B blocks; the whisker is q3 + 1.5 (q3 - q1).
    """
    counts = block_counts(pieces).groupBy(F.col("runs").alias("v")).agg(F.count("*").alias("freq"))
    running = counts.select("v", F.sum("freq").over(Window.orderBy("v")).alias("acc"), F.sum("freq").over(Window.partitionBy()).alias("b"))
    q = lambda share: F.min(F.when(F.col("acc") > F.expr(share), F.col("v")))
    rows = running.agg(F.max("b").alias("blocks"), q("(b + 1) div 4").alias("q1"), q("(b + 1) div 2").alias("q2"), q("3 * (b + 1) div 4").alias("q3"))
    return rows.select("*", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_whisker"))
