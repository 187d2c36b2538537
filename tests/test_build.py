"""Transforms against goldens and against the definition."""

import random

import numpy as np
import pytest

from suffixloom.functions import packed, storage
from suffixloom.operators import index, parse, suffix_order
from suffixloom.operators.build import build_bwt, expand
from suffixloom.sources import collection

GOLDENS = [
    (["banana"], "annb$aa"),
    (["mississippi"], "ipssm$pissii"),
    (["aaaa"], "aaaa$"),
    (["b"], "b$"),
    (["banana", "ananas", "banana"], "asannnnbb$nn$$aaaaaaa"),
    (["ab", "ab"], "bb$$aa"),
    (["", "a", ""], "$a$$"),
    (["TTT", "TT", "T"], "TTTTT$T$$"),
    (["ACGT", "ACGT", "ACG", "CGT"], "TTGT$$$AAA$CCCCGGG"),
    (["a\nb", "a"], "baa$$\n"),
    (["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "AAAETECCI$$$EIIIDPL M$ASRRMDA$ROFEUAASE"),
]
STRATEGIES = ["naive", "doubling", "parse"]


def strings_of(spark, strings, start=0):
    return spark.createDataFrame([(start + i, bytearray(s)) for i, s in enumerate(strings)], "string_id bigint, body binary")


def ints_of(spark, strings):
    return spark.createDataFrame([(i, list(s)) for i, s in enumerate(strings)], "string_id bigint, syms array<bigint>")


def by_definition(strings):
    rows = sorted((tuple(s[p:]), d, s[p - 1] if p else 0) for d, s in enumerate(strings) for p in range(len(s) + 1))
    out = []
    for _, _, x in rows:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return [tuple(x) for x in out]


def collected(runs):
    rows, at = runs.orderBy("run_id").collect(), 0
    for i, r in enumerate(rows):
        assert (r["run_id"], r["start"]) == (i, at)
        at += r["len"]
    return [(r["sym"], r["len"]) for r in rows]


def plain(runs):
    return "".join(("$" if s == 0 else chr(s)) * n for s, n in runs)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_goldens(spark, strategy):
    for strings, expected in GOLDENS if strategy == "naive" else GOLDENS[::3]:
        assert plain(collected(build_bwt(strings_of(spark, [s.encode() for s in strings]), strategy))) == expected, strings


def test_bytes_beyond_ascii(spark):
    assert collected(build_bwt(strings_of(spark, ["é".encode()]))) == [(0xA9, 1), (0xC3, 1), (0, 1)]


def test_integer_golden(spark):
    strings = [[300, 5, 300, 5], [5, 300], [70000]]
    expected = [(5, 1), (300, 1), (70000, 1), (300, 1), (0, 1), (300, 1), (5, 2), (0, 2)]
    for strategy in STRATEGIES:
        assert collected(build_bwt(ints_of(spark, strings), strategy)) == expected


@pytest.mark.parametrize("strategy", ["doubling", "parse"])
def test_random_collections(spark, strategy):
    rng = random.Random(5)
    for k in range(4):
        alphabet = [b"a", b"ab", b"abc", b"a\xff"][k]
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, 70))) for _ in range(rng.randint(1, 6))]
        strings += strings[:1] + [s[: len(s) // 2] for s in strings[:2]]
        assert collected(build_bwt(strings_of(spark, strings), strategy)) == by_definition(strings), strings


def test_long_repeats_need_many_rounds(spark):
    strings = [b"ab" * 400, b"ab" * 399 + b"a", b"b" + b"ab" * 400]
    assert collected(build_bwt(strings_of(spark, strings), "doubling")) == by_definition(strings)


def test_ids_need_not_be_dense(spark):
    assert plain(collected(build_bwt(strings_of(spark, [b"banana", b"ananas", b"banana"], start=1000), "doubling"))) == "asannnnbb$nn$$aaaaaaa"


def test_empty_collection(spark):
    for strategy in STRATEGIES:
        assert collected(build_bwt(strings_of(spark, []), strategy)) == []


def test_byte_zero_is_refused(spark):
    with pytest.raises(Exception, match="kept for the terminator"):
        build_bwt(strings_of(spark, [b"a\x00b"]), "doubling")


def test_many_blocks_and_buckets(spark, monkeypatch):
    """Suffixes of one frequent beginning, and those that are tied over the bounds of buckets, are ranked all the same."""
    monkeypatch.setattr(packed, "BUCKET", 64)
    monkeypatch.setattr(suffix_order, "BLOCK", 100)
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"ab", k=40)), b"a" * 60, bytes(rng.choices(b"abc", k=30))]
    strings = [b"".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(25)]
    assert collected(build_bwt(strings_of(spark, strings), "doubling")) == by_definition(strings)
    ints = [[1 + c for c in s[:90]] for s in strings[:12]]
    assert collected(build_bwt(ints_of(spark, ints), "doubling")) == by_definition(ints)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_parse_of_many_blocks_and_buckets(spark, monkeypatch, held):
    """With a dictionary that tasks hold, and with one that is joined."""
    monkeypatch.setattr(packed, "BUCKET", 64)
    monkeypatch.setattr(suffix_order, "BLOCK", 50)
    monkeypatch.setattr(parse, "HELD", held)
    rng = random.Random(6)
    parts = [bytes(rng.choices(b"abc", k=30)), b"a" * 9, b"bca", bytes(rng.choices(b"abcd", k=20))]
    strings = [b"".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(25)]
    assert collected(build_bwt(strings_of(spark, strings), "parse")) == by_definition(strings)


@pytest.mark.parametrize("strategy", ["doubling", "parse"])
def test_no_table_holds_a_row_for_each_suffix(spark, strategy):
    before, rng = len(storage._made), random.Random(4)
    words = [bytes(rng.choices(b"abcd", k=4)) for _ in range(9)]
    build_bwt(strings_of(spark, [b"".join(rng.choices(words, k=100)) for _ in range(20)]), strategy)
    assert sum(spark.read.parquet(p).count() for p in storage._made[before:]) < 1000


def test_expand_and_null_symbol(spark):
    runs = build_bwt(strings_of(spark, [b"banana"]))
    rows = expand(runs, ord("$")).orderBy("bwt_pos").collect()
    assert "".join(chr(r["sym"]) for r in rows) == "annb$aa"


def test_lf_golden(spark):
    runs = build_bwt(strings_of(spark, [b"banana", b"ananas", b"banana"]))
    assert {r["sym"]: r["c"] for r in index.c_table(runs).collect()} == {0: 0, 97: 3, 98: 12, 110: 14, 115: 20}
    assert [r["lf_pos"] for r in index.lf(runs).orderBy("bwt_pos").collect()] == [3, 20, 4, 14, 15, 16, 17, 12, 13, 0, 18, 19, 1, 2, 5, 6, 7, 8, 9, 10, 11]
    assert tuple(index.summary(runs).first()) == (21, 5, 0, 3)


@pytest.mark.parametrize("strategy", ["walk", "doubling"])
def test_inversion(spark, strategy):
    strings = [b"banana", b"", b"ananas", b"banana", "é\nß".encode(), b"a" * 50]
    found = index.invert(build_bwt(strings_of(spark, strings)), strategy=strategy).orderBy("string_index").collect()
    assert [bytes(r["body"]) for r in found] == strings
    first = index.invert(build_bwt(strings_of(spark, strings)), first=2, strategy=strategy).orderBy("string_index").collect()
    assert [bytes(r["body"]) for r in first] == strings[:2]


def test_inversion_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packed, "BUCKET", 64)
    monkeypatch.setattr(index, "ROWS", 50)
    rng = random.Random(8)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(20)]
    runs = storage.stored(build_bwt(strings_of(spark, strings)), "runs")
    before = len(storage._made)
    for first in (None, 3):
        found = index.invert(runs, first, strategy="doubling").orderBy("string_index").collect()
        assert [bytes(r["body"]) for r in found] == strings[:first]
    kept = [spark.read.parquet(p) for p in storage._made[before:]]
    assert not any("row" in t.columns for t in kept)  # no pointer is a row of a table


def test_integer_inversion(spark):
    strings = [[300, 5, 300, 5], [], [70000]]
    for strategy in ("walk", "doubling"):
        found = index.invert(build_bwt(ints_of(spark, strings)), strategy=strategy, of_bytes=False).orderBy("string_index").collect()
        assert [list(r["syms"]) for r in found] == strings


def lms_by_definition(s):
    n, kinds = len(s), [None] * len(s)
    for i in range(n - 1, -1, -1):
        kinds[i] = "L" if i == n - 1 else "S" if s[i] < s[i + 1] else "L" if s[i] > s[i + 1] else kinds[i + 1]
    return [0, *(i for i in range(1, n) if kinds[i] == "S" and kinds[i - 1] == "L")]


def test_breaks():
    rng = random.Random(2)
    for _ in range(2000):
        s = rng.choices([1, 2, 3], k=rng.randint(0, 14))
        assert parse.breaks(np.array(s, dtype=np.int64)).tolist() == lms_by_definition(s)


def test_phrases_golden(spark):
    rows = parse.parse(strings_of(spark, [b"banana", b"ananas", b"mississippi", b"aaaa", b""])).collect()
    text = lambda p: "".join("$" if c == 0 else chr(c) for c in np.frombuffer(p, dtype=">u2"))
    found = {}
    for r in sorted(rows, key=lambda r: (r["string_id"], r["j"])):
        found.setdefault(r["string_id"], []).append(text(bytes(r["phrase"])))
    assert list(found.values()) == [["ba", "ana", "ana$"], ["ana", "ana", "as$"], ["mi", "issi", "issi", "ippi$"], ["aaaa$"], ["$"]]


def test_null_texts_are_empty_strings(spark):
    df = spark.createDataFrame([(0, None), (1, "a")], "id int, t string")
    assert collected(build_bwt(collection.from_table(df, "id", "t"))) == by_definition([b"", b"a"])
