"""Quality and toxicity: held-out accuracy on the test tables, the models by themselves, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from suffixloom.llm import quality, toxicity, trees

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = query(spark, SF)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    both = rows.join(labels, "doc_id", "left").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert len(both) == n and all(0 <= r["score"] <= 1 for r in both)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in both)
    return [(r["score"], r["predicted"], r[label]) for r in both if r["held_out"] and r[label] is not None]


def area(rows):
    order = np.argsort(np.argsort([r[0] for r in rows], kind="stable"), kind="stable")
    y = np.array([r[2] for r in rows])
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_rows_held_out(spark):
    rows = held_out(spark, quality.op9_quality_rules, "quality")
    assert area(rows) > 0.98
    assert np.mean([p == y for _, p, y in rows]) > 0.98


def test_toxicity_on_rows_held_out(spark):
    rows = held_out(spark, toxicity.op5_toxicity_kneser_ney, "toxic")
    assert area(rows) > 0.93
    assert np.mean([p for _, p, y in rows if y == 1]) > 0.85 and np.mean([p for _, p, y in rows if y == 0]) < 0.02


def test_rules_compile_to_the_model(spark):
    rng = np.random.default_rng(0)
    texts = ["plain words in a row. And more of them.", "### !!! ### !!!", "a a a a a a", "", None, "UPPER CASE | 12 | 34\nUPPER CASE | 12 | 34"] * 3
    x = np.array([quality.statistics(t) for t in texts])
    y = np.array([1, 0, 0, 0, 0, 1] * 3)
    model = quality.fit_rules(x + rng.normal(0, 1e-9, x.shape), y, trees=8)
    df = spark.createDataFrame([(i, t, "old", 5) for i, t in enumerate(texts)], "doc_id long, text string, score string, __x int")
    got = quality.score_quality(df, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], model.scores(x))
    assert set(got[0].asDict()) == {"doc_id", "text", "score", "__x"}
    assert model.rules


def test_lasso_prefers_few_rules():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = (x[:, 3] > 0.2).astype(int)
    model = quality.fit_rules(x, y)
    assert len(model.rules) < 60 and ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for marks in ([], [(i, 1, 1) for i in range(20)], [(i, 0, 0) for i in range(20)], [(None, 1, 1), (1, None, None)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        scores = [r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()]
        assert len(scores) == 20 and all(0 <= s <= 1 for s in scores)
        assert [r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()] == [0.0] * 20


def test_odd_rows_get_scores(spark):
    base = [(i, "you idiot " + "word " * (i % 9) if i % 3 == 0 else "kind words " * (i % 7 + 1), i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in base] + [(None, "idiot", "x"), (900, None, None), (901, "", "x"), (901, "", "x"), (902, "word " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(not t), int(t)) for i, _, t in base], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    rows = scored.collect()
    assert len(rows) == 305 and all(0 <= r["score"] <= 1 for r in rows)
    known = {r["doc_id"]: r["score"] for r in rows}
    assert np.mean([(known[i] >= 0.5) == t for i, _, t in base]) > 0.95
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).where(F.col("score").between(0, 1)).count() == 305
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(docs, labels)).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0


def test_evidence_against_plain_kneser_ney():
    """A few probabilities by dictionaries."""
    texts = [("ab ab ac", 0), ("ab ad", 1), ("b", 1)]
    counts = np.zeros((2, toxicity.SYMBOLS**toxicity.ORDER), dtype=np.int64)
    for t, y in texts:
        np.add.at(counts[y], toxicity.ngrams(t)[0], 1)
    table = toxicity.evidence_table(counts.reshape(2, *[toxicity.SYMBOLS] * 4)).reshape([toxicity.SYMBOLS] * 4)
    d, a, b = toxicity.DISCOUNT, 1, 2

    def sequences(y):
        for t, of in texts:
            if of == y:
                for w in t.split():
                    yield [0, 0, 0] + [ord(c) - 96 for c in w] + [0]

    def grams(y, n):
        return [tuple(s[i - n + 1 : i + 1]) for s in sequences(y) for i in range(3, len(s))]

    kinds = lambda y: {(g[0] if g[1] else 0, *g[1:]) for g in map(tuple, grams(y, 4))}
    tri = {y: {} for y in (0, 1)}
    for y in (0, 1):
        for g in set(kinds(y)):
            tri[y][g[1:]] = tri[y].get(g[1:], 0) + 1
    pooled = {}
    for g in set(tri[0]) | set(tri[1]):
        pooled[g[1:]] = pooled.get(g[1:], 0) + 1
    uni = [1.0 + len({g for g in pooled if g[1] == s}) for s in range(32)]

    def p2(x, c):
        n = sum(v for g, v in pooled.items() if g[0] == c)
        base = uni[x] / sum(uni)
        return base if not n else (max(pooled.get((c, x), 0) - d, 0) + d * sum(1 for g in pooled if g[0] == c) * base) / n

    def p3(y, x, c):
        n = sum(v for g, v in tri[y].items() if g[:2] == c)
        base = p2(x, c[1])
        return base if not n else (max(tri[y].get((*c, x), 0) - d, 0) + d * sum(1 for g in tri[y] if g[:2] == c) * base) / n

    def p4(y, x, c):
        found = [g for g in grams(y, 4) if g[:3] == c]
        base = p3(y, x, c[1:])
        return base if not found else (max(found.count((*c, x)) - d, 0) + d * len(set(found)) * base) / len(found)

    for x, c in ((a, (0, 0, 0)), (b, (0, 0, a)), (3, (0, 0, a)), (0, (0, a, b)), (5, (1, 2, 3))):
        assert table[(*c, x)] == pytest.approx(np.log(p4(1, x, c) / p4(0, x, c)), abs=1e-5)


def test_trees_find_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 4] < 0)).astype(int)
    found = trees.forest(x, y, 10, 5, tries=3)
    assert (np.mean([trees.predict(t, x) for t in found], axis=0).round() == y).mean() > 0.97


def test_queries_against_plain_scores(spark):
    """The registered queries against statistics, evidence and weights that are worked out row by row."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules, model = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    by_rules = dict(zip(texts, rules.scores(np.array([quality.statistics(t) for t in texts.values()])), strict=True))
    evidence = {i: toxicity.features(model.table.value, t) if model else None for i, t in texts.items()}
    by_model = {i: 1 / (1 + math.exp(-(sum(a * b for a, b in zip(e, model.weights[:3], strict=True)) + model.weights[3]))) if model else 0.0 for i, e in evidence.items()}
    for query, expected, least in ((quality.op9_quality_rules, by_rules, 0.3), (toxicity.op5_toxicity_kneser_ney, by_model, 0.5)):
        got = query(spark, sf).collect()
        assert len(got) == len(texts)
        for r in got:
            assert abs(r["score"] - expected[r["doc_id"]]) < 1e-6 and r["predicted"] == int(r["score"] >= least)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
