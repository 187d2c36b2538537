import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from suffixloom.llm import merkle


def spread(text):
    """The tree of a text by plain Python: sections, paragraphs, sentences."""
    sections = [s for s in re.split(r"(?<=\n\n)(?!\n|\Z)", text)]
    return [[[m.group(0) for m in re.finditer(r"[^.!?|]{1,160}[.!?|]*|[.!?|]+", p)] for p in re.split(r"(?<=\n)(?!\n|\Z)", s)] for s in sections]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(text):
    h = lambda x: sha(x)[:12]
    p_hash = lambda p: sha("".join(sha(x) for x in p))
    s_hash = lambda s: sha("".join(p_hash(p) for p in s))
    tree = spread(text)
    section = lambda s: s_hash(s)[:12] + "(" + ",".join(p_hash(p)[:12] + "(" + ".".join(h(x) for x in p) + ")" for p in s) + ")"
    return sha("".join(s_hash(s) for s in tree)) + ":" + "/".join(section(s) for s in tree)


def alike(a, b):
    x, y = (Counter(re.findall("[0-9a-f]+", f)) for f in (a, b))
    return 1.0 if a.split(":")[0] == b.split(":")[0] else 2 * (x & y).total() / (x.total() + y.total())


TEXTS = ["", "One. Two!\nThree | four\n\n\nNext section? é 漢字.\n", "x" * 1000, "a\n\nb", "a\n\n\nb", "...", "no marks at all"]


def test_fingerprint_is_the_merkle_tree(spark):
    df = spark.createDataFrame([(t, "kept") for t in [*TEXTS, None]], "text string, other string")
    got = {r["text"]: r["fingerprint"] for r in merkle.with_fingerprint(df).collect()}
    assert got == {t: expected(t or "") for t in [*TEXTS, None]}
    assert len({got[t] for t in TEXTS}) == len(TEXTS) and got[None] == got[""]
    assert all("".join(x for s in spread(t) for p in s for x in p) == t for t in TEXTS)


def compared(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(*[merkle.fingerprint(merkle.leaves(F.col(c))).alias(c) for c in "ab"])
    return df.select(merkle.likeness("a", "b").alias("likeness"), merkle.differing_branches("a", "b").alias("branches")).collect()


def test_likeness(spark):
    four = "One. Two. Three. Four."
    texts = [(four, four), (four, "One. Two. 3. 4."), ("", ""), ("", "a"), ("a. b.", "c. d."), ("Line.\n" * 50, "Line.\n" * 2), ("a\n\nb\n\nc\n\n", "b\n\na\n\nc\n\n")]
    got = [r["likeness"] for r in compared(spark, texts)]
    assert got == pytest.approx([alike(expected(a), expected(b)) for a, b in texts])
    assert got[0] == got[2] == 1.0 and got[3] == got[4] == 0.0 and got[5] < 0.2 and 0.8 < got[6] < 1


def test_differing_branches(spark):
    a = "s1 p1\ns1 p2\n\ns2 p1\ns2 p2\n\ns3\n\n"
    texts = [a, a.replace("s2 p2", "s2 new\nmore"), "s0\n\n" + a, a + "end", a.replace("s2 p1\n", ""), a.replace("s1 p1", "x").replace("s3", "y"), ""]
    got = [tuple(r["branches"]) for r in compared(spark, [(a, t) for t in texts])]
    assert got == [(3, 0, 0, 0), (1, 1, 1, 0), (0, 3, 0, 0), (3, 0, 0, 0), (1, 1, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = merkle.op4_merkle_fingerprints(spark, sf)
    expected_rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({merkle.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected_rows)


def test_sql_takes_texts_apart_alike(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab.!\n\n |é") for _ in range(rng.randint(0, 40)))) for i in range(600)] + [(700, None), (701, "\n"), (702, "\n\n\n"), (703, "x" * 700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = merkle.op4_merkle_fingerprints(spark, str(tmp_path))
    expected_rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({merkle.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected_rows)


def edited_by_hand(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half], rows[(k + 1) % len(rows)][1])
    return out


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_next_row(spark, blocks):
    rows = [(i * i % 101 * 10**9, f"text {i} " * (i % 7)) for i in range(60)]
    rows = list({i: t for i, t in rows}.items()) + [(-5, None)]
    got = merkle.with_next(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(4), "doc_id", "text", blocks=blocks)
    hand = edited_by_hand(rows)
    assert {r["doc_id"]: r["next_text"] for r in got.collect()} == {i: v[2] for i, v in hand.items()}
    assert got.count() == len(rows)


def test_blocks_of_large_tables_are_planned_in_little(spark):
    """As many bounds as 6 GB have (384 blocks) and many more: the expression grows with the bounds, not with their power."""
    df = spark.createDataFrame([(None,), *[(i,) for i in range(-3, 8300, 7)]], "k long")
    for n in (1, 2, 383, 4095):
        bounds = list(range(0, 2 * n, 2))
        got = df.select("k", merkle._block_of(F.col("k"), bounds, "bigint").alias("block"))
        assert len(got._jdf.queryExecution().analyzed().toString()) < 10_000 + 100 * n
        assert all(r["block"] == (0 if r["k"] is None else sum(b <= r["k"] for b in bounds)) for r in got.collect())


def test_next_row_of_repeated_missing_and_no_rows(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (2, "c")]
    got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", blocks=4)
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in got.collect()} == {(None, "n"): "a", (1, "a"): "b", (1, "b"): "c", (2, "c"): "n"}
    assert merkle.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    one = merkle.with_next(spark.createDataFrame([(7, "x")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [tuple(r) for r in one] == [(7, "x", "x")]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    hand = edited_by_hand(map(tuple, rows))
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    got = merkle.op4_merkle_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, edited, _ = hand[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha(edited))
        assert r["fingerprint"] == expected(texts[r["doc_id"]]) and r["edited_fingerprint"] == expected(edited)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.95 * len(got)
