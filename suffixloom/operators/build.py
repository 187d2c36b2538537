"""Run-length multi-string Burrows-Wheeler transforms.

Suffixes of all strings are ordered, the terminator first, equal suffixes by string_id; the transform is the symbol before
each suffix, the terminator (0) before a whole string, and its maximal runs are the result: (run_id, start, sym, len).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dealt_runs, in_parts, run_lengths
from ..functions.storage import discard
from ..sources.collection import BYTES, INTEGERS, is_bytes, lengths
from .suffix_order import Block, ranked_blocks, with_copies

#: Total squared length up to which whole suffixes are sorted.
NAIVE_LIMIT = 1 << 28


def distinct_strings(strings: DataFrame) -> DataFrame:
    """One row for each different string, under its smallest id, with `ids`: those of all its copies, in order."""
    column = BYTES if is_bytes(strings) else INTEGERS
    keyed = strings.select("string_id", F.sha2(F.col(column) if column == BYTES else F.to_json(column).cast("binary"), 256).alias("digest"))
    members = keyed.groupBy("digest").agg(F.array_sort(F.collect_list("string_id")).alias("ids"))
    return strings.join(members.select(F.col("ids")[0].alias("string_id"), "ids"), "string_id")


def whole_suffixes(strings: DataFrame) -> DataFrame:
    """(suffix, string_id, sym) of every suffix, as binary: prefixes sort first, as the terminator asks."""
    if is_bytes(strings):
        at = strings.select("string_id", BYTES, F.explode(F.expr(f"sequence(0, length({BYTES}))")).alias("p"))
        sym = F.when(F.col("p") == 0, 0).otherwise(F.conv(F.hex(F.expr(f"substring({BYTES}, p, 1)")), 16, 10).cast("long"))
        return at.select(F.expr(f"substring({BYTES}, p + 1)").alias("suffix"), "string_id", sym.cast("long").alias("sym"))
    at = strings.select("string_id", INTEGERS, F.explode(F.expr(f"sequence(0, size({INTEGERS}))")).alias("p"))
    return at.select(F.expr(f"slice({INTEGERS}, p + 1, size({INTEGERS}))").alias("suffix"), "string_id", F.expr(f"if(p = 0, 0L, {INTEGERS}[p - 1])").alias("sym"))


def _entries(row: dict) -> list[np.ndarray]:
    """The suffixes of a block, by rank, with the symbols before them."""
    block = Block(row)
    ranks, tied = block.ranks()
    return with_copies(block, block.owners(), [ranks], tied, block.left_symbols())


def build_bwt(strings: DataFrame, strategy: str = "auto") -> DataFrame:
    """Runs of the transform of a collection: (run_id, start, sym, len).

    `naive` sorts whole suffixes, `doubling` ranks them in rounds, `parse` ranks the phrases of a parse instead; `auto`
    takes whole suffixes while their total length is small and doubling beyond.
    """
    if strategy == "auto":
        n = lengths(strings).cast("double")
        total = strings.agg(F.sum(n * n)).first()[0] or 0
        strategy = "naive" if total <= NAIVE_LIMIT else "doubling"
    if strategy == "naive":
        return run_lengths(whole_suffixes(strings), ["suffix"], ["string_id"])
    if strategy not in ("doubling", "parse"):
        raise ValueError(f"no strategy {strategy!r}")
    if strategy == "parse":
        from .parse import build_from_parse

        return build_from_parse(distinct_strings(strings))
    ranked = ranked_blocks(distinct_strings(strings))
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    runs = dealt_runs(ranked, _entries, total)
    discard(ranked)
    return runs


def expand(runs: DataFrame, null_symbol: int | None = None) -> DataFrame:
    """(bwt_pos, sym): the plain transform; with `null_symbol` in place of the terminator."""
    sym = F.col("sym") if null_symbol is None else F.when(F.col("sym") == 0, F.lit(null_symbol)).otherwise(F.col("sym"))
    return in_parts(runs).select(F.explode(F.expr("sequence(start, start + len - 1)")).alias("bwt_pos"), sym.cast("long").alias("sym"))
