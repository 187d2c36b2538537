"""Row numbers, ranks and run lengths over one global order, without a window that takes all rows to one task.

Rows are partitioned by range and sorted within partitions; each task numbers or folds its own rows, and what the tasks need
of each other (a row for each partition) is summed on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import by_key, cut_by, dealing, gathered, lex_order, packed, rows_of, unpacked
from .storage import stored


#: Rows of a run that are handled in one row of a table.
PART = 1 << 16


def in_parts(runs: DataFrame, most: int = PART) -> DataFrame:
    """`runs` with long ones cut into rows of `most` from their start; lf_start, where there is one, moves along."""
    at = F.explode(F.expr(f"sequence(0L, (len - 1) div {most}L)")).alias("__at")
    parts = runs.where("len > 0").select("*", at).withColumn("__at", F.col("__at") * most)
    moved = {c: F.col(c) + F.col("__at") for c in ("start", "lf_start") if c in runs.columns}
    return parts.withColumns({**moved, "len": F.least(F.col("len") - F.col("__at"), F.lit(most)).cast("long")}).select(*runs.columns)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def smaller_rows(df: DataFrame, keys: Sequence[str], ties: Sequence[str], keep: Sequence[str], within: int = 0) -> DataFrame:
    """`keep`, `rank` (how many rows have smaller keys) and `alone` (no other row has the keys); with `within`, `before` too:
    how many of the rows with the same first `within` keys have smaller ones.

    All columns are 64-bit integers. `ties` only spread the rows of a frequent key over partitions.
    """
    names = [*keys, *[k for k in keep if k not in keys]]
    levels = [len(keys), *([within] if within else [])]  # numbers of keys by which rows are told apart
    local_names = ["local", "local_group"][: len(levels)]

    def run(batches):
        part, seen, start = TaskContext.get().partitionId(), 0, [0] * len(levels)
        held = None  # the last row: whether it stands alone is known with the next

        def out(columns, begins, last_alone):
            nonlocal seen
            n = len(begins[0])
            places = np.arange(seen, seen + n)
            starts = [np.maximum.accumulate(np.where(b, places, s)) for b, s in zip(begins, start, strict=True)]
            alone = begins[0] & np.concatenate([begins[0][1:], [last_alone]])
            seen, start[:] = seen + n, [int(s[-1]) for s in starts]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(pa.array, starts), pa.array(alone), pa.array(np.full(n, part, dtype=np.int32))], names=[*names, *local_names, "alone", "part"])

        previous = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            begins = [np.ones(len(columns[0]), dtype=bool) for _ in levels]
            for b, level in zip(begins, levels, strict=True):
                b[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:level]])
                if held is not None:
                    b[0] = any(c[0] != h for c, h in zip(columns[:level], previous, strict=False))
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns, strict=True)]
                begins = [np.concatenate([h, b]) for h, b in zip(held[1], begins, strict=True)]
            previous = [c[-1] for c in columns[: len(keys)]]
            held = [c[-1:] for c in columns], [b[-1:] for b in begins]
            if len(begins[0]) > 1:
                yield out([c[:-1] for c in columns], [b[:-1] for b in begins], begins[0][-1])
        if held is not None:
            yield out(held[0], held[1], True)

    ordered = df.select(*names, *[t for t in ties if t not in names]).repartitionByRange(partitions(df), *keys, *ties).sortWithinPartitions(*keys).select(*names)
    local = stored(ordered.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, *local_names]) + ", alone boolean, part int"), "key_ranks")
    ends = [F.count("*").alias("n")]
    for level, at in zip(levels, local_names, strict=True):
        key = F.struct(*keys[:level])
        ends += [F.min_by(key, at).alias(f"first_{at}"), F.max_by(key, at).alias(f"last_{at}"), F.max(at).alias(f"start_{at}")]
    found = local.groupBy("part").agg(*ends).orderBy("part").collect()  # a row for each partition
    seams, columns = [{"part": e["part"]} for e in found], ["part int", "shift bigint"]
    for at in local_names:
        shift, before = 0, None
        for seam, e in zip(seams, found, strict=True):
            joins = before is not None and before["key"] == e[f"first_{at}"]
            first = before["rank"] if joins else shift
            if joins:
                before["seam"][f"joined_{at}"] = True
            seam |= {"shift": shift, f"first_{at}": first, f"joins_{at}": joins, f"start_{at}": e[f"start_{at}"], f"joined_{at}": False}
            before = {"key": e[f"last_{at}"], "rank": first if e[f"start_{at}"] == 0 else shift + e[f"start_{at}"], "seam": seam}
            shift += e["n"]
        columns += [f"first_{at} bigint", f"joins_{at} boolean", f"start_{at} bigint", f"joined_{at} boolean"]
    rows = [tuple(s[c.split(" ")[0]] for c in columns) for s in seams]
    met = ((F.col("local") == 0) & F.col("joins_local")) | ((F.col("local") == F.col("start_local")) & F.col("joined_local"))
    rank_of = lambda at: F.when(F.col(at) == 0, F.col(f"first_{at}")).otherwise(F.col("shift") + F.col(at))
    joined = local.join(F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(columns))), "part")
    more = [(rank_of("local") - rank_of("local_group")).alias("before")] if within else []
    return joined.select(*keep, rank_of("local").alias("rank"), (F.col("alone") & ~met).alias("alone"), *more)


def _seams(ends) -> list[dict]:
    """How the runs of parts, given in order, go together: whether the first run of a part joins the one before, what the numbers
    and places of its runs begin at, and what its last run is longer by."""
    plan, runs, rows_before, open_part = [], 0, 0, None
    for e in ends:
        joins = open_part is not None and plan[open_part]["last_sym"] == e["first_sym"]
        if joins:
            plan[open_part]["extra"] += e["first_len"]
        plan.append({"part": e["part"], "joins": joins, "base": runs - joins, "shift": rows_before, "last": e["n"] - 1, "extra": 0, "last_sym": e["last_sym"]})
        if not (joins and e["n"] == 1):  # a partition of one run that joins leaves the run before open
            open_part = len(plan) - 1
        runs += e["n"] - joins
        rows_before += e["total"]
    return plan


def run_lengths(df: DataFrame, keys: Sequence[str], ties: Sequence[str] = (), weight: str | None = None, split_ties: bool = True) -> DataFrame:
    """(run_id, start, sym, len): maximal runs of `sym` when rows are sorted by `keys` and `ties`.

    `weight` names a column of row multiplicities. With `split_ties` rows of equal keys may lie in two partitions, in the
    order of their ties.
    """
    by = [*keys, *ties] if split_ties else list(keys)
    rows = df.select(*keys, *ties, F.col("sym").cast("long").alias("sym"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    ordered = rows.repartitionByRange(partitions(df), *by).sortWithinPartitions(*keys, *ties).select("sym", "w")

    def run(batches):
        part, index, start = TaskContext.get().partitionId(), 0, 0
        held_sym, held_len = None, 0

        def out(syms, lens):
            nonlocal index, start
            lens = np.asarray(lens, dtype=np.int64)
            n = len(lens)
            starts = start + np.cumsum(lens) - lens
            columns = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(index, index + n)), pa.array(starts), pa.array(np.asarray(syms, dtype=np.int64)), pa.array(lens)]
            index, start = index + n, start + int(lens.sum())
            return pa.RecordBatch.from_arrays(columns, names=["part", "index", "start", "sym", "len"])

        for batch in batches:
            sym, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sym):
                continue
            first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            syms, lens = sym[first], np.add.reduceat(w, first)
            if held_sym is not None:
                if held_sym == syms[0]:
                    lens[0] += held_len
                else:
                    syms, lens = np.concatenate([[held_sym], syms]), np.concatenate([[held_len], lens])
            held_sym, held_len = int(syms[-1]), int(lens[-1])
            if len(syms) > 1:
                yield out(syms[:-1], lens[:-1])
        if held_sym is not None:
            yield out([held_sym], [held_len])

    local = stored(ordered.mapInArrow(run, "part int, index bigint, start bigint, sym bigint, len bigint"), "local_runs")
    ends = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.min_by("sym", "index").alias("first_sym"), F.min_by("len", "index").alias("first_len"), F.max_by("sym", "index").alias("last_sym")).orderBy("part").collect()
    plan = _seams(ends)
    rows = [(p["part"], bool(p["joins"]), p["base"], p["shift"], p["last"], p["extra"]) for p in plan]
    seams = df.sparkSession.createDataFrame(rows, "part int, joins boolean, base bigint, shift bigint, last bigint, extra bigint")
    fixed = local.join(F.broadcast(seams), "part").where("not (joins and index = 0)")
    length = F.col("len") + F.when(F.col("index") == F.col("last"), F.col("extra")).otherwise(0)
    return fixed.select((F.col("base") + F.col("index")).alias("run_id"), (F.col("shift") + F.col("start")).alias("start"), "sym", length.alias("len"))


def dealt_runs(table: DataFrame, entries, total: int) -> DataFrame:
    """(run_id, start, sym, len): maximal runs of `sym` of packed rows in the order of their keys.

    `entries` makes columns of unsigned integers of a row of `table`, which has a `block`: the keys, that no two rows share,
    the symbol and the multiplicity. `total` is about how many there are.
    """
    cuts = cut_by(table, lambda row: entries(row)[:-2], total)

    def deal(batches):
        for row in rows_of(batches):
            columns = entries(row)
            order, buckets, begin, end = dealing(columns[:-2], cuts, plain=True)
            data = [packed([c[order[s:e]] for c in columns]) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
            same = [pa.array(np.full(len(buckets), x)) for x in (row["block"].as_py(), len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *same, pa.array(end - begin), pa.array(data, pa.binary())], names=["bucket", "block", "width", "n", "data"])

    def sort(batches):
        for bucket, rows in by_key(batches, "bucket"):
            parts = [unpacked(r["data"].as_buffer(), r["width"].as_py(), r["n"].as_py()) for r in rows]
            *keys, sym, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            order, _ = lex_order(keys)
            yield from local_runs(bucket, sym[order], weight[order])

    dealt = table.mapInArrow(deal, "bucket bigint, block bigint, width bigint, n bigint, data binary")
    parts = max(partitions(table), len(cuts[0]) + 1 if cuts else 1)
    return joined_runs(stored(gathered(dealt, "bucket", "block", parts).mapInArrow(sort, LOCAL_RUNS), "local_runs"))


#: Packed runs of a part of the rows; `piece` goes by order in a bucket.
LOCAL_RUNS = "bucket bigint, piece bigint, n bigint, total bigint, first_sym bigint, first_len bigint, last_sym bigint, data binary"


def local_runs(bucket: int, sym: np.ndarray, weight: np.ndarray, most: int = PART):
    """LOCAL_RUNS of symbols in order, `most` runs in a row."""
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    syms, lens = sym[first], np.add.reduceat(weight, first)
    for piece, at in enumerate(range(0, len(syms), most)):
        s, n = syms[at : at + most], lens[at : at + most]
        row = [bucket, piece, len(s), int(n.sum()), int(s[0]), int(n[0]), int(s[-1])]
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in row], pa.array([packed([s, n])], pa.binary())], names=[c.split(" ")[0] for c in LOCAL_RUNS.split(", ")])


def joined_runs(local: DataFrame) -> DataFrame:
    """(run_id, start, sym, len) of the parts of a table of LOCAL_RUNS, in order."""
    ends = local.drop("data").orderBy("bucket", "piece").collect()  # a row for each PART runs, and for each bucket
    plan = _seams([e.asDict() | {"part": (e["bucket"], e["piece"])} for e in ends])
    seams = {p["part"]: (p["joins"], p["base"], p["shift"], p["extra"]) for p in plan}

    def run(batches):
        for row in rows_of(batches):
            joins, base, shift, extra = seams[row["bucket"].as_py(), row["piece"].as_py()]
            sym, length = (c.astype(np.int64) for c in unpacked(row["data"].as_buffer(), 2, row["n"].as_py()))
            start = shift + np.cumsum(length) - length
            length[-1] += extra
            number = base + np.arange(len(sym))
            yield pa.RecordBatch.from_arrays([pa.array(c[int(joins) :]) for c in (number, start, sym, length)], names=["run_id", "start", "sym", "len"])

    return local.select("bucket", "piece", "n", "data").mapInArrow(run, "run_id bigint, start bigint, sym bigint, len bigint")


def _placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` stored in global order, with __part and __at: the partition, and the place in it."""
    ordered = df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    return stored(ordered.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m") % (1 << 33)).drop("__m"), "placed")


def _shifts(placed: DataFrame, amount) -> DataFrame:
    """(__part, __shift): the sum of `amount` in the partitions before, a row for each partition."""
    rows, total = [], 0
    for r in placed.groupBy("__part").agg(amount.alias("n")).orderBy("__part").collect():
        rows.append((r["__part"], total))
        total += r["n"]
    return F.broadcast(placed.sparkSession.createDataFrame(rows, "__part bigint, __shift bigint"))


def numbered(df: DataFrame, keys: Sequence[str], name: str = "number", first: int = 0) -> DataFrame:
    """`df` with a number for each row in the order of `keys`, from `first` without gaps."""
    placed = _placed(df, keys)
    out = placed.join(_shifts(placed, F.count("*")), "__part")
    return out.withColumn(name, F.col("__at") + F.col("__shift") + first).select(*df.columns, name)


def sums_before(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows before each in the order of `keys`, and `place`, its number from 1."""
    placed = _placed(df, keys)
    before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__inner", F.coalesce(F.sum(value).over(before), F.lit(0)))
    sums, counts = _shifts(placed, F.sum(value)), _shifts(placed, F.count("*")).withColumnRenamed("__shift", "__count")
    out = local.join(sums, "__part").join(counts, "__part")
    return out.withColumn(name, (F.col("__shift") + F.col("__inner")).cast("long")).withColumn("place", F.col("__count") + F.col("__at") + 1).select(*df.columns, name, "place")
