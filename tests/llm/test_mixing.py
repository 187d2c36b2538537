import random

import duckdb
import pytest

from suffixloom.llm import mixing


def test_every_prefix_is_within_one_block():
    """Of the target weights themselves, however the shares are rounded."""
    rng = random.Random(1)
    for _ in range(100):
        weights = {f"s{i}": rng.choice([1, 1, 2, 5, 100, rng.random() + 0.01]) for i in range(rng.randint(1, 25))}
        share, slots = mixing.shares(weights), 3000
        assert sum(share.values()) == mixing.WHOLE and min(share.values()) >= 1
        got, total = dict.fromkeys(share, 0), sum(weights.values())
        for t, s in enumerate(mixing.pfair_slots(share, slots), 1):
            got[s] += 1
            assert all(abs(got[x] - weights[x] / total * t) < 1 + 1e-6 for x in share)


def test_bad_weights():
    with pytest.raises(ValueError):
        mixing.shares({"a": 1, "b": 0}, 8)
    with pytest.raises(ValueError):
        mixing.shares({i: 1 for i in range(9)}, 8)
    assert mixing.shares({"a": 1, "b": 10**9, "c": 1}, 8) == {"a": 1, "b": 6, "c": 1}


def by_hand(rows, weights, block, period=None):
    """Slots of each source's blocks by walking the schedule, which may repeat after `period`."""
    counts = {}
    for s in rows:
        counts[s] = counts.get(s, 0) + 1
    share = mixing.shares({s: weights.get(s, 1) for s in counts}, period or mixing.WHOLE)
    pattern = mixing.pfair_slots(share, period or 3000)
    out, done, t = {}, dict.fromkeys(counts, 0), 0
    while any(done[s] < -(-n // block) for s, n in counts.items()):
        s = pattern[t % len(pattern)]
        if done[s] < -(-counts[s] // block):
            out[(s, done[s])] = t
        done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("period", [None, 64])
def test_places(spark, period):
    rng = random.Random(2)
    sources = rng.choices(["hot", "a", "b", None], weights=[20, 4, 2, 1], k=9000)
    df = spark.createDataFrame([(i, s, f"t{i}", 5) for i, s in enumerate(sources)], "doc_id long, source string, text string, n int").repartition(6)
    weights = {"hot": 1.0, "a": 1.0, "b": 2.0, None: 1.0}
    mixed = mixing.mix_sources(df, weights, block=8, most_slots=period or mixing.MOST_SLOTS)
    assert mixed.columns == [*df.columns, "__block", "__slot", "__place"]
    rows = mixed.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(9000))
    assert all(r["source"] == sources[r["doc_id"]] and r["text"] == f"t{r['doc_id']}" for r in rows)
    numbers = {}
    for r in rows:
        numbers.setdefault(r["source"], []).append(8 * r["__block"] + r["__place"])
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert {(r["source"], r["__block"]): r["__slot"] for r in rows} == by_hand(sources, weights, 8, period)


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (None, "a", ""), (None, None, "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, __slot string")
    got = mixing.mix_sources(df).collect()
    assert sorted(((r["doc_id"], r["source"], r["text"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert len({(r["__slot"], r["__place"]) for r in got}) == 4
    assert mixing.mix_sources(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, source string")
    assert [(r["doc_id"], r["__slot"]) for r in mixing.mix_sources(nothing).collect()] == [(1, 0)]
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.range(10).selectExpr("id as doc_id", "string(id) as source"), most_sources=5)


def test_rows_without_an_id_and_of_one_id_are_spread(spark):
    rows = [(None if i % 2 else 7, "s", f"text {i}") for i in range(20_000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    places = {(r["__block"], r["__place"]) for r in mixed.collect()}
    assert places == {(i // 32, i % 32) for i in range(20_000)}


def test_blocks_grow_until_the_plan_fits(spark):
    rows = [(i, "ab"[i % 10 == 0]) for i in range(4000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 1, "b": 1}, most_slots=40).collect()
    assert max(r["__slot"] for r in mixed) < 40 and max(r["__place"] for r in mixed) == 255
    slots = {(r["source"], r["__block"]): r["__slot"] for r in mixed}
    assert [slots["b", j] for j in range(2)] == [1, 3] and len(set(slots.values())) == len(slots)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "source", "block", "slot", "place"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in mixing.op10_pfair_mixing(spark, sf).select(*columns).collect()) == sorted(expected)
