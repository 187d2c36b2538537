"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source with weight w should have had w * t blocks after t slots. Its j-th block is released at floor(j / w) and is due at
ceil((j + 1) / w); in each slot the released block that is due first runs (earliest deadline first). Each source is then
always less than one block from its share. The documents of a source are put in a fixed pseudo-random order and cut into
blocks, so few that the driver plans every slot from the exact weights; a plan has at most MOST_SLOTS of them. Where a block
size that is asked for needs more, the weights are rounded to fractions of a period of that many slots, which repeats.

Every document is placed once. A source that is used up leaves its slots empty from then on; the others keep their slots,
and so their ratio to each other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import carried, column, restored, unused


#: Slots of a plan: that many rows are broadcast at most. Weights are integers, fractions of WHOLE.
MOST_SLOTS, WHOLE = 1 << 18, 1 << 40


def shares(weights: Mapping, whole: int = WHOLE) -> dict:
    """Integers in the ratio of the weights: at least one each, and `whole` in all, by largest remainders."""
    if len(weights) > whole:
        raise ValueError(f"{len(weights)} sources need as many shares; there are {whole}")
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * whole for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(out, key=lambda s: (out[s] - exact[s], str(s)))
    short = whole - sum(out.values())
    for s in by_rest[: max(0, short)]:
        out[s] += 1
    while sum(out.values()) > whole:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -whole, str(s)))] -= 1
    return out


def pfair_slots(share: Mapping, slots: int) -> list:
    """The source of each slot: earliest deadline first among the released blocks.

    Block j of a source with q of all the shares, W together, is released at floor(j * W / q) and due at the end of slot
    ceil((j + 1) * W / q); ties go to the larger share, then to the name.
    """
    whole = sum(share.values())
    waiting = [(0, str(s), s, 0) for s in share]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, name, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * whole // share[s]), -share[s], name, s, j))
        _, _, name, s, j = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, ((j + 1) * whole // share[s], name, s, j + 1))
    return out


def tempered_weights(counts: Mapping, temperature: float = 0.5) -> dict:
    """Target weights as powers of the sources' sizes: 1 keeps their shares, 0 makes them equal."""
    return {s: math.sqrt(n) if temperature == 0.5 else n**temperature for s, n in counts.items()}


def _plan(counts: Mapping, target: Mapping, block: int | None, most_slots: int) -> tuple[int, list[tuple], dict, int]:
    """Documents of a block, (source, turn, slot) of one round, the blocks of each source in a round, and its slots."""
    share, least = shares(target), 32 if block is None else block
    slots_of = lambda size: max(-(-(-(-counts[s] // size)) * WHOLE // share[s]) for s in counts)
    while block is None and slots_of(least) > most_slots and least < max(counts.values()):
        least *= 2
    slots, seen, turns = slots_of(least), dict.fromkeys(counts, 0), []
    if slots > most_slots:
        slots, share = most_slots, shares(target, most_slots)
        rounds = share
    else:
        rounds = dict.fromkeys(counts, 1 << 40)  # more blocks than there are: no second round
    blocks = {s: -(-n // least) for s, n in counts.items()}
    for slot, s in enumerate(pfair_slots(share, slots)):
        if seen[s] < blocks[s]:
            turns.append((s, seen[s], slot))
        seen[s] += 1
    return least, turns, rounds, slots


def mix_sources(docs: DataFrame, weights: Mapping | None = None, source_col: str = "source", id_col: str = "doc_id", block: int | None = None, most_sources: int = 4096, most_slots: int = MOST_SLOTS, seed: int = 17) -> DataFrame:
    """`docs` with __block (its number in its source), __slot and __place (in the block): their order is the mix.

    `weights` has a positive target for each source (None for rows without one); sources it does not name, and all of them
    if it is None, get the tempered size. A block has 32 documents, or as many times 2 as keep the plan within `most_slots`,
    if `block` does not say. More than `most_sources` sources are an error, since the driver plans for them. Null sources are
    a source of their own. The order of a source's rows follows from the values of all their columns (but maps), so that
    rows of one id, or without one, are spread like others; rows that are equal in all of them are interchangeable. Columns
    of the names added here are replaced; other columns stay, whatever their names. An empty table gives no rows.
    """
    added = ("__block", "__slot", "__place")
    docs = docs.select(*[column(c) for c in docs.columns if c not in added])
    sizes = docs.groupBy(column(source_col).alias("source")).agg(F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    counts = {r["source"]: r["n"] for r in sizes}
    if not counts:
        return docs.withColumns({c: F.lit(0).cast("long") for c in added})
    target = tempered_weights(counts)
    if weights:
        target = {s: weights.get(s, target[s]) for s in counts}
    size, turns, rounds, slots = _plan(counts, target, block, most_slots)
    spark, kind = docs.sparkSession, docs.select(column(source_col).alias("source")).schema["source"].dataType.simpleString()
    plan = spark.createDataFrame([(s, turn, slot, rounds[s]) for s, turn, slot in turns], f"of_source {kind}, turn bigint, slot bigint, round bigint")

    # Numbers within a source: its rows are dealt by their hash into ranges of a few thousand, so that no source is one
    # group; a row's number is its number in its range plus the sizes of the ranges before.
    ranges = max(1, -(-max(counts.values()) // 4096))
    text_of = [column(f.name).cast("string") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *text_of)), 1, 10), 16, 10).cast("long")
    rows = docs.withColumn(key := unused(docs, "draw"), draw)
    dealt = carried(rows, source=source_col, draw=key).withColumn("range", F.floor(F.col("draw") * ranges / float(1 << 40)).cast("long"))
    each = Window.partitionBy("range", "source").orderBy("draw")
    before = Window.partitionBy("of_source").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(F.col("source").alias("of_source"), F.col("range").alias("of_range")).agg(F.count("*").alias("n"))
    shifts = shifts.select("of_source", "of_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    if ranges * len(counts) <= 500_000:
        shifts = F.broadcast(shifts)
    same = F.col("source").eqNullSafe(F.col("of_source"))
    numbered = dealt.withColumn("local", F.row_number().over(each).cast("long") - 1).join(shifts, same & (F.col("range") == F.col("of_range"))).drop("of_source", "of_range")
    numbered = numbered.withColumn("number", F.col("local") + F.col("shift")).withColumn("block", F.expr(f"number div {size}"))
    of = [x for s, q in rounds.items() if s is not None for x in (F.lit(s), F.lit(q).cast("long"))]
    blocks = F.element_at(F.create_map(*of), F.col("source")) if of else F.lit(None).cast("long")
    numbered = numbered.withColumn("blocks", F.coalesce(blocks, F.lit(rounds.get(None, 1)).cast("long")))
    placed = numbered.join(F.broadcast(plan), same & (F.col("block") % F.col("blocks") == F.col("turn")))
    slot = F.expr(f"(block div blocks) * {slots}L") + F.col("slot")
    return placed.select(*restored(rows, but=(key,), source=source_col), F.col("block").alias("__block"), slot.alias("__slot"), F.expr(f"number % {size}").alias("__place"))


def op10_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of all sources, weighted by the square roots of their sizes.

    Null sources are one source; repeated rows are placed each; a table without rows gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__place").alias("place"))


#: The same by a walk over the slots, which holds the number of the next block of each source in a list. Sizes up to some
#: thousand blocks; the weights are rounded as in `shares` (no remainder is left over there but for the largest ones).
ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), exact AS (
  SELECT source, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) AS part FROM sizes
), sources AS (
  SELECT row_number() OVER (ORDER BY part DESC, coalesce(source, 'None')) AS k, source, n, part, CAST(ceil(n / 32.0) AS BIGINT) AS blocks FROM exact
), whole AS (
  SELECT max(CAST(ceil(blocks / part) AS BIGINT)) AS slots, count(*) AS sources FROM sources
), walk AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS block,
         (SELECT list(CAST(0 AS BIGINT) ORDER BY k) FROM sources) AS todo
  UNION ALL
  SELECT z.t + 1, c.k, z.todo[c.k], list_transform(z.todo, lambda x, i: x + CASE WHEN i = c.k THEN 1 ELSE 0 END)
  FROM walk z CROSS JOIN LATERAL (
    SELECT s.k FROM sources s WHERE floor(z.todo[s.k] / s.part + 1e-9) <= z.t
    ORDER BY ceil((z.todo[s.k] + 1) / s.part - 1e-9), s.k LIMIT 1
  ) c
  WHERE z.t < (SELECT slots FROM whole)
), numbered AS (
  SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY left(md5(concat_ws('-', '17', CAST(doc_id AS VARCHAR), d.source)), 10)) - 1 AS number
  FROM documents d
)
SELECT d.doc_id, d.source, CAST(number // 32 AS BIGINT) AS block, CAST(z.t - 1 AS BIGINT) AS slot, CAST(number % 32 AS BIGINT) AS place
FROM numbered d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source JOIN walk z ON z.k = s.k AND z.block = number // 32
"""
