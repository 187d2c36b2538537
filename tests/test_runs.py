"""Statistics, splitting and files of runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from suffixloom.functions.ordered import in_parts, smaller_rows
from suffixloom.functions import storage
from suffixloom.operators import index, splitting, statistics
from suffixloom.operators.build import build_bwt
from suffixloom.sources import collection, files
from suffixloom.streaming import streaming_symbol_counts

from .test_build import collected, strings_of


def runs_of(spark, pairs):
    rows, at = [], 0
    for i, (s, n) in enumerate(pairs):
        rows.append((i, at, s, n))
        at += n
    return spark.createDataFrame(rows, "run_id bigint, start bigint, sym bigint, len bigint")


@pytest.fixture
def fruit(spark):
    return build_bwt(strings_of(spark, [b"banana", b"ananas", b"banana"]))


def test_run_stats(fruit):
    r = statistics.run_stats(fruit).first()
    assert (r["runs"], r["alphabet"], r["n"], r["longest"], r["shortest"]) == (9, 5, 21, 7, 1)
    assert round(r["n_per_run"], 4) == 2.3333
    assert (r["symbol_bytes"], r["length_bytes"], r["count_bytes"]) == (1, 1, 1)


def test_symbol_stats(fruit):
    rows = statistics.symbol_stats(fruit).orderBy("place").collect()
    assert {chr(r["sym"]): (r["runs"], r["freq"]) for r in rows if r["sym"]} == {"a": (3, 9), "n": (2, 6), "s": (1, 1), "b": (1, 2)}
    assert [r["space_before"] for r in rows] == [0, 64, 128, 256, 384]


def test_deciles(fruit, spark):
    assert [r["len"] for r in statistics.length_deciles(fruit).orderBy("decile").collect()] == [1, 1, 1, 2, 2, 2, 4, 7, 7]
    one = runs_of(spark, [(5, 3)])
    assert [r["len"] for r in statistics.length_deciles(one).collect()] == [3] * 9


def test_length_bins(spark):
    rows = statistics.length_bins(runs_of(spark, [(1, 255), (2, 256), (1, 65535), (2, 65536)])).orderBy("bin").collect()
    assert [(r["bin"], r["runs"], r["percent"]) for r in rows] == [(1, 1, 25.0), (2, 2, 50.0), (3, 1, 25.0)]


@pytest.mark.parametrize("order", [1, 2])
def test_invariants(spark, order):
    """In order only the ends of partitions are kept; in any other order the same comes out."""
    pairs = [(97 + i % 3, 1 + i % 5) for i in range(300)] + [(0, 4), (97, 2), (97, 3)]
    rows = runs_of(spark, pairs).collect()
    rows = [(r["run_id"], r["start"] + (r["run_id"] >= 150), r["sym"], r["len"]) for r in rows]
    kept = spark.createDataFrame(rows[::order] + rows[1::2] * (order - 1), "run_id bigint, start bigint, sym bigint, len bigint")
    before = len(storage._made)
    assert tuple(statistics.invariants(kept).first()) == (sum(n for _, n in pairs), 4, 1, 1)
    made = sum(spark.read.parquet(p).count() for p in storage._made[before:])
    assert order == 2 or made <= 3 * 8


SPLIT = [
    (4, 5, [(97, 0, 4, 0), (97, 4, 1, 0), (97, 5, 3, 1), (97, 8, 2, 1), (98, 10, 3, 2), (99, 13, 2, 2), (99, 15, 2, 3), (99, 17, 3, 3)]),
    (7, None, [(97, 0, 7, None), (97, 7, 3, None), (98, 10, 3, None), (99, 13, 7, None)]),
    (255, 10, [(97, 0, 10, 0), (98, 10, 3, 1), (99, 13, 7, 1)]),
]


@pytest.mark.parametrize("max_len,block,expected", SPLIT)
def test_split_goldens(spark, max_len, block, expected):
    rows = splitting.split_runs(runs_of(spark, [(97, 10), (98, 3), (99, 7)]), max_len, block).orderBy("start").collect()
    assert [(r["sym"], r["start"], r["len"], r["block"]) for r in rows] == expected


def test_split_summary_and_histogram(spark):
    runs = runs_of(spark, [(97, 10), (98, 3), (99, 7)])
    s = splitting.split_summary(runs, 4, 5).first()
    assert (s["runs_before"], s["runs_after"], s["length_splits"], s["block_splits"], s["most_in_block"], s["fewest_in_block"]) == (3, 8, 3, 2, 2, 2)
    pieces = splitting.split_runs(runs, 4, 5)
    assert [tuple(r) for r in splitting.block_histogram(pieces).collect()] == [(2, 4, 1.0, 1.0)]
    assert tuple(splitting.block_quartiles(pieces).first()) == (4, 2, 2, 2, 2.0)


def test_run_file_round_trip(spark, tmp_path):
    for pairs in ([(97, 1), (0, 3), (98, 70000)], [(70000, 5), (3, 1)], [(300, 256)]):
        path = str(tmp_path / f"runs{len(pairs)}{pairs[0][0]}")
        files.write_runs(runs_of(spark, pairs), path)
        assert collected(files.read_runs(spark, path)) == pairs


def test_run_file_layout(spark, tmp_path):
    path = tmp_path / "layout"
    assert files.write_runs(runs_of(spark, [(97, 1), (0, 300)]), str(path)) == (1, 2)
    assert path.read_bytes() == b"\x01" + bytes(7) + b"\x02" + bytes(7) + b"a\x01\x00" + b"\x00\x2c\x01"


def test_plain_columns_and_text(spark, tmp_path, fruit):
    files.write_plain(fruit, str(tmp_path / "plain"), ord("$"))
    assert (tmp_path / "plain").read_bytes() == b"asannnnbb$nn$$aaaaaaa"
    files.write_columns(fruit, str(tmp_path / "cols"))
    assert np.frombuffer((tmp_path / "cols.len").read_bytes(), dtype="<u4").tolist() == [1, 1, 1, 4, 2, 1, 2, 2, 7]
    assert (tmp_path / "cols.syms").read_bytes() == b"asanb\x00n\x00a"
    from suffixloom.operators.index import invert

    files.write_text(invert(fruit), str(tmp_path / "text"))
    assert (tmp_path / "text").read_bytes() == b"banana\nananas\nbanana\n"


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_bytes("banana\nananas\n\né\n".encode())
    rows = collection.from_text_files(spark, str(tmp_path / "lines.txt")).orderBy("string_id").collect()
    assert [bytes(r["body"]).decode() for r in rows] == ["banana", "ananas", "", "é"]
    for width in (1, 2, 4, 8):
        (tmp_path / f"cells{width}").write_bytes(np.array([9, 7, 2, 2, 8, 2], dtype=f"<u{width}").tobytes())
        rows = collection.from_cells(spark, str(tmp_path / f"cells{width}"), width).orderBy("string_id").collect()
        assert [list(r["syms"]) for r in rows] == [[9, 7], [], [8]]


def test_lines_of_files_of_any_size(spark, tmp_path):
    """Spark reads larger files first; numbers follow the paths and the places all the same."""
    (tmp_path / "a.txt").write_text("first\n")
    (tmp_path / "b.txt").write_text("".join(f"line{i}\n" for i in range(5000)))
    (tmp_path / "c.txt").write_text("last")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = collection.from_text_files(spark, str(tmp_path)).orderBy("string_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [bytes(r["body"]).decode() for r in rows] == ["first", *[f"line{i}" for i in range(5000)], "last"]
    assert [r["string_id"] for r in rows] == list(range(5002))


def test_cells_and_columns_round_trip(spark, tmp_path, fruit):
    strings = spark.createDataFrame([(0, [3, 1, 70000]), (1, []), (2, [5])], "string_id bigint, syms array<bigint>")
    files.write_cells(strings, str(tmp_path / "cells"), 4)
    assert [list(r["syms"]) for r in collection.from_cells(spark, str(tmp_path / "cells"), 4).orderBy("string_id").collect()] == [[3, 1, 70000], [], [5]]
    files.write_columns(fruit, str(tmp_path / "both"))
    assert sorted(map(tuple, files.read_columns(spark, str(tmp_path / "both")).collect())) == sorted(map(tuple, fruit.collect()))


def test_histogram_file(spark, tmp_path):
    found = splitting.block_histogram(splitting.split_runs(runs_of(spark, [(97, 10), (98, 3), (99, 8)]), 4, 5))
    files.write_histogram(found, str(tmp_path / "tsv"))
    lines = next((tmp_path / "tsv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "number_of_runs_in_a_block\tfreq\trelative_freq\tacc_freq" and lines[1:] == ["1\t1\t0.2\t0.2", "2\t4\t0.8\t1.0"]
    assert sorted(map(tuple, files.read_histogram(spark, str(tmp_path / "tsv")).collect())) == sorted(map(tuple, found.collect()))


def test_a_very_long_run(spark):
    """A run of 2 ** 32 rows is cut and counted without a row that holds all of its pieces."""
    runs = runs_of(spark, [(97, 5), (98, 2**32), (99, 3)])
    r = splitting.split_summary(runs, 4096, 1 << 30).first()
    assert (r["runs_before"], r["runs_after"], r["length_splits"], r["block_splits"]) == (3, 2**20 + 2 + 4, 2**20 - 1, 4)
    parts = in_parts(runs, 1 << 20).agg(F.count("*"), F.sum("len"), F.max("len")).first()
    assert tuple(parts) == (2 + 4096, 2**32 + 8, 1 << 20)
    assert index.lf(runs_of(spark, [(97, 200_000), (0, 1)])).where("lf_pos <> if(sym = 0, 0, bwt_pos + 1)").count() == 0


def test_ranks_within_groups_over_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.choice([1, 5, 5, 5, 9], 4000), rng.integers(0, 30, 4000), strict=True))]
    got = smaller_rows(spark.createDataFrame(rows, "k bigint, j bigint, i bigint").repartition(7), ["k", "j"], ["i"], ["i"], within=1).collect()
    keys = sorted((a, b) for a, b, _ in rows)
    firsts = {k: keys.index(k) for k in set(keys)}
    groups = {a: [x for x, _ in keys].index(a) for a in {x for x, _ in keys}}
    counts = {k: keys.count(k) for k in firsts}
    assert {r["i"]: (r["rank"], r["alone"], r["before"]) for r in got} == {i: (firsts[a, b], counts[a, b] == 1, firsts[a, b] - groups[a]) for a, b, i in rows}


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    build_bwt(strings_of(spark, [b"banana"] * 3), "doubling").collect()
    assert spark.conf.get(key) == before


def test_collection_stats(spark):
    strings = strings_of(spark, [b"banana", b"", b"nab"])
    assert tuple(collection.collection_stats(strings).first()) == (3, 12, 7)
    assert {r["sym"]: r["freq"] for r in collection.symbol_histogram(strings).collect()} == {0: 3, 97: 4, 98: 2, 110: 3}


def test_reverse_complements(spark):
    rows = collection.reverse_complements(strings_of(spark, [b"ACGT", b"AAC"])).orderBy("string_id").collect()
    assert [bytes(r["body"]) for r in rows] == [b"ACGT", b"AAC", b"ACGT", b"GTT"]


def test_streamed_symbol_counts(spark, tmp_path):
    strings_of(spark, [b"ab", b"b\xc3"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("string_id bigint, body binary").parquet(str(tmp_path / "in"))
    query = streaming_symbol_counts(stream).writeStream.format("memory").queryName("symbol_counts").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["sym"]: r["freq"] for r in spark.table("symbol_counts").collect()} == {0: 2, 97: 1, 98: 2, 195: 1}
