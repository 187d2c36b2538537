"""Phrases of a collection, and the transform by way of them.

A position is of type S if its symbol is smaller than the next different one, and of type L otherwise; the last symbol of a
string counts as L, and so does a run that reaches it. A phrase begins at each S position behind an L position and ends with
the first symbol of the next phrase, so that neighbours share a symbol; the last phrase of a string ends with the
terminator. Equal phrases are one row of the dictionary. Phrases are ordered as sequences, one that begins another behind it.

The transform follows in three joins: suffixes of phrases are grouped by equality over the dictionary alone; a group before
which one symbol stands, whatever the phrase, is written out at once with its frequency; the members of the others are
ordered by the suffix of the parse that follows them, which doubling ranks over the much shorter sequence of phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dealt_runs, numbered
from ..functions.storage import discard, stored
from ..sources.collection import BYTES, INTEGERS, is_bytes
from . import suffix_order
from .suffix_order import Block, _symbols, ranked_blocks, with_copies

#: Phrases that a task counts before it hands them on, and those of a dictionary that tasks hold.
COUNTED, HELD = 1 << 18, 1 << 21
#: Rows of a phrase that blocks leave space for.
PER_PHRASE = 8


def breaks(syms: np.ndarray) -> np.ndarray:
    """Positions at which phrases begin, 0 first."""
    n = len(syms)
    if n < 3:
        return np.zeros(1, dtype=np.int64)
    step = np.sign(np.diff(syms.astype(np.int64)))  # 1: the next symbol is larger
    at = np.arange(n - 1)
    # For each position the next one whose successor differs; without one the run reaches the end and is of type L.
    later = np.where(step != 0, at, n)
    later = np.minimum.accumulate(later[::-1])[::-1]
    small = np.zeros(n, dtype=bool)
    known = later < n
    small[:-1][known] = step[later[known]] > 0
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return np.concatenate([[0], starts])


def _width(of_bytes: bool) -> int:
    return 2 if of_bytes else 8


def _cut(value, of_bytes: bool) -> tuple[np.ndarray, list[bytes]]:
    """Where the phrases of a string begin, and the phrases."""
    syms, width = _symbols(value, of_bytes), _width(of_bytes)
    at = breaks(syms)
    cells = np.concatenate([syms.astype(np.int64), [0]]).astype(">u2" if of_bytes else ">u8").tobytes()
    stops = np.concatenate([at[1:] + 1, [len(syms) + 1]])
    return at, [cells[a:b] for a, b in zip((width * at).tolist(), (width * stops).tolist(), strict=True)]


def parse(strings: DataFrame) -> DataFrame:
    """(string_id, j, start, phrase, terminal): the phrases of each string in order.

    A phrase is binary: its symbols in big-endian cells of 2 bytes for byte strings and of 8 for integers; the terminator
    is a cell of zeros.
    """
    of_bytes = is_bytes(strings)

    def run(batches):
        for batch in batches:
            for sid, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, phrases = _cut(value, of_bytes)
                last = np.zeros(len(at), dtype=bool)
                last[-1] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), sid, dtype=np.int64)), pa.array(np.arange(len(at))), pa.array(at), pa.array(phrases, pa.binary()), pa.array(last)], names=["string_id", "j", "start", "phrase", "terminal"])

    return strings.select("string_id", BYTES if of_bytes else INTEGERS).mapInArrow(run, "string_id bigint, j bigint, start bigint, phrase binary, terminal boolean")


def counted_phrases(strings: DataFrame) -> DataFrame:
    """The dictionary of strings with their copies' `ids`; tasks count phrases before a row is made of them."""
    of_bytes = is_bytes(strings)

    def run(batches):
        found: dict[bytes, int] = {}

        def out():
            phrases = list(found)
            cells = _width(of_bytes)
            ends = [p.endswith(bytes(cells)) for p in phrases]
            batch = pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(list(found.values()), pa.int64()), pa.array(ends)], names=["phrase", "freq", "terminal"])
            found.clear()
            return batch

        for batch in batches:
            for value, copies in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for p in _cut(value, of_bytes)[1]:
                    found[p] = found.get(p, 0) + copies
            if len(found) > COUNTED:
                yield out()
        if found:
            yield out()

    parts = strings.select(BYTES if of_bytes else INTEGERS, F.size("ids").alias("copies")).mapInArrow(run, "phrase binary, freq bigint, terminal boolean")
    return parts.groupBy("phrase").agg(F.sum("freq").alias("freq"), F.first("terminal").alias("terminal"))


def _coded(strings: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """(string_id, syms, ids): the ranks of each string's phrases, by a dictionary that tasks hold or, if it is large, by a join."""
    if n > HELD:
        coded = parse(strings).join(phrases.select("phrase", "rank"), "phrase")
        lists = coded.groupBy("string_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "rank"))), lambda x: x["rank"]).alias(INTEGERS))
        return lists.join(strings.select("string_id", "ids"), "string_id")
    of_bytes = is_bytes(strings)
    table = phrases.select("phrase", "rank").toArrow()
    ranks = strings.sparkSession.sparkContext.broadcast(dict(zip(table.column("phrase").to_pylist(), table.column("rank").to_pylist(), strict=True)))

    def run(batches):
        of = ranks.value.__getitem__
        for batch in batches:
            coded = [np.fromiter(map(of, _cut(value, of_bytes)[1]), dtype=np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.list_(pa.int64())), batch.column(2)], names=["string_id", INTEGERS, "ids"])

    return strings.select("string_id", BYTES if of_bytes else INTEGERS, "ids").mapInArrow(run, f"string_id bigint, {INTEGERS} array<bigint>, ids array<bigint>")


def phrase_counts(occurrences: DataFrame) -> DataFrame:
    """(phrase, freq, terminal): the dictionary."""
    return occurrences.groupBy("phrase").agg(F.count("*").alias("freq"), F.first("terminal").alias("terminal"))


def dictionary_size(phrases: DataFrame, of_bytes: bool) -> DataFrame:
    """One row: n_phrases, total symbols (overlaps and terminators included), largest frequency, phrases seen again."""
    return phrases.agg(F.count("*").alias("n_phrases"), F.coalesce(F.sum(F.length("phrase") / _width(of_bytes)).cast("long"), F.lit(0)).alias("n_symbols"), F.coalesce(F.max("freq"), F.lit(0)).alias("max_freq"), F.count_if(F.col("freq") > 1).alias("repeated"))


def order_key(phrase: Column, terminal: Column, of_bytes: bool) -> Column:
    """A binary key under which a phrase comes behind those that it begins; terminal ones end in their least symbol."""
    return F.when(terminal, phrase).otherwise(F.concat(phrase, F.lit(b"\xff" * _width(of_bytes))))


def phrase_ranks(phrases: DataFrame, of_bytes: bool) -> DataFrame:
    """`phrases` with `rank`: from 1, in phrase order, without gaps."""
    keyed = phrases.withColumn("key", order_key(F.col("phrase"), F.col("terminal"), of_bytes))
    return dense_ranks(keyed, "key").drop("key")


def dense_ranks(df: DataFrame, key: str) -> DataFrame:
    """`df` with `rank`: from 1 without gaps over the different values of a binary key."""
    return df.join(numbered(df.select(key).distinct(), [key], "rank", first=1), key)


def phrase_suffixes(phrases: DataFrame, of_bytes: bool) -> DataFrame:
    """(phrase, freq, terminal, off, suffix, left_sym): suffixes of phrases, without those that are the shared symbol
    alone. left_sym is null for a whole phrase: what stands before it is known where it occurs."""
    width = _width(of_bytes)
    size = F.length("phrase") / width
    offs = phrases.withColumn("off", F.explode(F.sequence(F.lit(0), (size - 1).cast("int")))).where(F.col("terminal") | (F.col("off") < size - 1))
    left = F.conv(F.hex(F.expr(f"substring(phrase, (off - 1) * {width} + 1, {width})")), 16, 10).cast("long")
    return offs.select("phrase", "freq", "terminal", "off", F.expr(f"substring(phrase, off * {width} + 1)").alias("suffix"), F.when(F.col("off") > 0, left).alias("left_sym"))


def suffix_groups(suffixes: DataFrame, of_bytes: bool) -> DataFrame:
    """(alpha, suffix, n_left, n_whole, freq, solved_sym) by equal suffix, `alpha` their order; solved_sym is set where
    the same symbol stands before all of them."""
    groups = suffixes.groupBy("suffix").agg(
        F.min("left_sym").alias("lo"), F.max("left_sym").alias("hi"), F.countDistinct("left_sym").alias("n_left"), F.count_if(F.col("off") == 0).alias("n_whole"), F.sum("freq").alias("freq"), F.first("terminal").alias("terminal")
    )
    solved = F.when((F.col("n_whole") == 0) & (F.col("lo") == F.col("hi")), F.col("lo"))
    keyed = groups.withColumn("key", order_key(F.col("suffix"), F.col("terminal"), of_bytes)).withColumn("solved_sym", solved)
    return dense_ranks(keyed, "key").select(F.col("rank").alias("alpha"), "suffix", "n_left", "n_whole", "freq", "solved_sym")


def build_from_parse(strings: DataFrame) -> DataFrame:
    """Runs of the transform by way of the parse of distinct strings (string_id, body or syms, ids): (run_id, start, sym, len)."""
    of_bytes = is_bytes(strings)
    width = _width(of_bytes)
    strings = stored(strings, "strings")
    phrases = stored(phrase_ranks(counted_phrases(strings), of_bytes), "phrases")
    n_phrases = phrases.count()
    # The parse as integer strings; ranks of its suffixes order what follows each phrase.
    ranked = ranked_blocks(_coded(strings, phrases, n_phrases), max(1, suffix_order.BLOCK // PER_PHRASE))
    discard(strings)

    suffixes = phrase_suffixes(phrases.select("phrase", "freq", "terminal"), of_bytes)
    groups = stored(suffix_groups(suffixes, of_bytes), "groups")
    open_rows = suffixes.join(groups.where("solved_sym is null").select("suffix", "alpha"), "suffix").join(phrases.select("phrase", "rank"), "phrase")
    open_rows = _sorted(open_rows.select("rank", "off", "alpha", F.coalesce("left_sym", F.lit(0)).alias("left")), ["off", "rank"])
    head = F.conv(F.hex(F.expr(f"substring(phrase, length(phrase) - {2 * width} + 1, {width})")), 16, 10).cast("long")
    heads = _sorted(phrases.select("rank", F.coalesce(head, F.lit(0)).alias("head")), ["rank"])["head"]
    first = np.searchsorted(open_rows["rank"], np.arange(n_phrases + 2))
    held = strings.sparkSession.sparkContext.broadcast((first, open_rows["off"], open_rows["alpha"].astype(np.uint64), open_rows["left"].astype(np.uint64), np.append(0, heads).astype(np.uint64)))
    solved = _sorted(groups.where("solved_sym is not null").select("alpha", "solved_sym", "freq"), ["alpha"])
    whole = [solved[c].astype(np.uint64) for c in ("alpha", "solved_sym", "freq")]

    def entries(row):
        """By suffix group, then by what follows the phrase, the symbols before the suffixes that the dictionary leaves open."""
        if row["block"].as_py() < 0:
            none = np.zeros(len(whole[0]), dtype=np.uint64)
            return [whole[0], none, none, whole[1], whole[2]]
        first, off, alpha, left, heads = held.value
        block = Block(row)
        ranks, tied = block.ranks()
        phrase = block.column("syms", block.n).astype(np.int64)
        before = np.append(0, phrase[:-1])  # 0 is the end of the string before
        at = np.flatnonzero(phrase)
        n = (first[1:] - first[:-1])[phrase[at]]
        place = np.repeat(first[phrase[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        sym = np.where(off[place] == 0, heads[before[at]], left[place])
        return with_copies(block, block.owners()[at], [alpha[place], ranks[at + 1]], tied[at + 1], sym)

    # One more row stands for the groups that the dictionary settles.
    spark = strings.sparkSession
    every = ranked.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("block")), allowMissingColumns=True) if len(whole[0]) else ranked
    total = groups.where("solved_sym is null").agg(F.sum("freq").alias("n")).first()["n"] or 0
    runs = dealt_runs(every, entries, total)
    discard(ranked, phrases, groups)
    return runs


def _sorted(rows: DataFrame, by: list[str]) -> dict[str, np.ndarray]:
    """Columns of a small table, by the last of the names in `by` first."""
    table = rows.toArrow()
    columns = {c: table.column(c).to_numpy() for c in rows.columns}
    order = np.lexsort([columns[c] for c in by])
    return {c: v[order] for c, v in columns.items()}
