"""Near-duplicates against all pairs, and the parts by themselves."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

from suffixloom.llm import graph, near_dedup
from suffixloom.llm.text import shingle_hashes, word_hashes


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """{id: (set size, component)} by comparing all pairs; the rows of one id are one node."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_against_all_pairs(spark, n):
    rng = random.Random(n)
    texts = []
    for _ in range(4):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(40, 160))]
        texts += family(rng, base, 25, 14)
    texts += ["", None, "  \n", "one", "One", "one two", "ONE\ttwo", "É é", "É É", "x y z"] + texts[:5]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, node string")
    got = near_dedup.near_duplicates(df, ngram=n)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    rows_got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]
    assert sorted(rows_got) == brute(rows, n, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_a_member_that_misses_its_pivot_is_still_linked(spark):
    base = [f"v{i}" for i in range(200)]
    chain = [" ".join(base[k * 16 : k * 16 + 120]) for k in range(5)]  # neighbours at about 0.76, farther ones lower
    close = [" ".join(base[k * 10 : k * 10 + 120]) for k in range(6)]  # neighbours at about 0.85
    rows = list(enumerate(chain + close))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 2, 80)


@pytest.mark.parametrize("copies", [240])
def test_large_families_of_which_many_are_not_similar(spark, tmp_path, copies, monkeypatch):
    """Random edits of one text, up to a quarter of its words, and a family within the family: no link is lost, and the
    pairs that are looked at do not grow with the square of the family."""
    rng = random.Random(copies)
    base = [f"v{i}" for i in range(150)]
    other = [f"u{i}" if i < 25 else w for i, w in enumerate(base)]
    texts = family(rng, base, copies, 26) + family(rng, other, copies // 2, 20)
    rows = list(enumerate(texts))
    looked = []
    plain = near_dedup.open_candidates
    monkeypatch.setattr(near_dedup, "open_candidates", lambda moved, percent: (looked.append(plain(moved, percent)), looked[-1])[1])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 2, 80)
    assert looked[0].count() <= 4 * len(texts)


def test_candidates_lose_no_link_of_a_group(spark):
    """All pairs of one group that are similar and of different components are candidates, whatever the components are."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(90)]
    texts = [" ".join(base)] + family(rng, base, 70, 16)
    for _ in range(6):  # some share their edits
        own = [w if rng.random() > 0.12 else f"x{rng.randrange(1000)}" for w in base]
        texts += family(rng, own, 10, 5)
    sets = [sorted({xxhash.xxh3_64_intdigest(repr(s).encode()) >> 1 for s in shingles(t, 2)}) for t in texts]
    for percent in (80, 65):
        frame = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "doc_id long, set_id long, shingles array<long>")
        similar = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))  # noqa: B023, E731
        component = [0 if similar(sets[0], s) else i for i, s in enumerate(sets)]
        members = spark.createDataFrame([(0, i, c) for i, c in enumerate(component)], "g long, a long, c long")
        moved = near_dedup.differences(members, frame, percent)
        assert {r["a"]: r["open"] for r in moved.collect()} == {i: c != 0 for i, c in enumerate(component) if i}
        got = {(r["a"], r["b"]) for r in near_dedup.open_candidates(moved, percent).collect()}
        links = {(i, j) for j in range(1, len(sets)) for i in range(1, j) if component[i] != component[j] and similar(sets[i], sets[j])}
        assert links and links <= got
        confirmed = near_dedup.confirmed(spark.createDataFrame(sorted(got), "a long, b long"), frame, percent)
        assert {(r["a"], r["b"]) for r in confirmed.collect()} == links


def test_long_texts_against_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for size in (900, 3000):
        texts += family(rng, [f"v{rng.randrange(10**5)}" for _ in range(size)], 8, size // 12)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 2, 80)


def test_repeated_and_unnamed_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got) == [(-1, 0, -1, True), (-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_an_id_of_several_texts_is_one_document(spark):
    rows = [(5, "a b c"), (5, "d e f"), (2, "a b c"), (3, "d e f"), (1, "g h i"), (6, "g h i"), (6, "j k l")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 2), (2, 2), (3, 2), (1, 1), (6, 1)}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = near_dedup.op3_minhash_near_dedup(spark, sf)
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({near_dedup.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_words_and_shingles():
    assert len(word_hashes("A b\x0bC\x1cd É")) == 4
    assert (word_hashes("ABC") == word_hashes("abc")).all() and (word_hashes("É") != word_hashes("é")).all()
    assert len(shingle_hashes(word_hashes("a b c"), 2)) == 2 and len(shingle_hashes(word_hashes("a"), 2)) == 1
    assert shingle_hashes(word_hashes("a"), 2)[0] != shingle_hashes(word_hashes("a"), 1)[0]


def test_sketches_keep_similar_sets_and_rule_others_out(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in (6, 150, 600, 2000, 20_000):
        for share in (0.5, 0.8, 0.81, 0.9):
            for _ in range(12):
                common = -int(-2 * n * share // (1 + share))
                pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                x, y = near_dedup.one_permutation(a), near_dedup.one_permutation(b)
                rows.append((n, share, true, len(np.intersect1d(x, y)), len(a), len(b), len(x), len(y), near_dedup.odd_sketch(x).tolist(), near_dedup.odd_sketch(y).tolist()))
    df = spark.createDataFrame(rows, "n int, share double, true double, shared int, n_a long, n_b long, m_a long, m_b long, sk_a array<long>, sk_b array<long>")
    common = near_dedup.sketched_common(near_dedup.differing_bits("sk_a", "sk_b"), df["m_a"] + df["m_b"])
    for r in df.select("*", near_dedup._plausible(80).alias("kept"), common.alias("common")).collect():
        assert abs(r["common"] - r["shared"]) <= 3 + 0.08 * (r["m_a"] + r["m_b"] - 2 * r["shared"])
        assert r["kept"] or r["true"] < 0.8
        assert not (r["kept"] and r["share"] == 0.5 and r["n"] >= 150)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
