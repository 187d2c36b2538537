"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark column expressions.

Statistics of a bounded sample of labelled rows train a forest of shallow trees; each path in it is a rule, a conjunction
of conditions on statistics. A logistic model with an L1 penalty (the lasso) keeps few of the rules, and what it keeps is
compiled into one column expression, which is all that scoring evaluates beside the statistics themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import arrow_batches
from .trees import forest, paths
from .workspace import carried, materialize, restored

STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "stop_marks", "space", "accented",
    "distinct_words", "top_word", "repeat_next", "short_words", "no_letter_words", "log_lines", "mean_line", "copied_lines", "ends_alike",
)
_CLASS = np.zeros(256, dtype=np.int64)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 other ASCII, 6 beyond ASCII, 7 sentence marks
_CLASS[[*range(33, 127)]] = 5
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:], _CLASS[[46, 63, 44]] = 4, 6, 7
_LETTER = re.compile(r"[^\W\d_]")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all of the ratios of an empty text are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), max(1, len(raw))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=8) / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    m, counts = max(1, len(words)), Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    k = max(1, len(lines))
    marks = Counter(w[-1:] for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,")
    plain = sum(c for w, c in counts.items() if not _LETTER.search(w.decode("utf-8", "replace")))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float(lengths.max(initial=0)), kinds[2], kinds[3], kinds[5], kinds[7], kinds[4], kinds[6],
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m, float((lengths <= 3).sum()) / m, plain / m, float(np.log1p(len(lines))), float(np.log1p(len(raw) / k)), 1 - len(set(lines)) / k if lines else 0.0, max(marks.values(), default=0) / m,
    ]


def statistics_column(text: str) -> Column:
    """A struct of STATISTICS of a text column, computed in Arrow batches."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def compute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype="float64")

    return compute(F.col(text))


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    """sigmoid(intercept + the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def sql(self, struct: str) -> str:
        """The score as a SQL expression over a struct column of statistics."""
        name = lambda j: f"{struct}.{STATISTICS[j]}"
        terms = [f"CASE WHEN {' AND '.join(f'{name(j)} {"<=" if low else ">"} {t!r}D' for j, low, t in rule)} THEN {w!r}D ELSE 0D END" for rule, w in self.rules]
        return f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))"

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, low, t in rule:
        out &= (x[:, j] <= t) if low else (x[:, j] > t)
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradient steps; the intercept is free."""
    n, k = m.shape
    centre = m.mean(axis=0)
    a = (m - centre).astype(np.float32)
    v, step = np.random.default_rng(0).normal(size=k).astype(np.float32), 1.0
    for _ in range(20):  # largest curvature, by power iteration
        v = a.T @ (a @ v)
        step = float(np.linalg.norm(v)) or 1.0
        v /= step
    step = 1 / (0.25 * step / n * 1.1 + 0.25)
    b = z = np.zeros(k, dtype=np.float32)
    c = cz = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ z + cz))) - y
        new = z - step * (a.T @ r.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        c_new, t_new = cz - step * float(r.mean()), (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, cz = new + (t - 1) / t_new * (new - b), c_new + (t - 1) / t_new * (c_new - c)
        b, c, t = new, c_new, t_new
    return c - float(centre @ b), b.astype(np.float64)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 3) -> RuleModel:
    """Rules from the paths of a forest, weighted by the lasso. Without both labels a constant."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else float(6 * (2 * y[0] - 1)), [])
    rules: dict[bytes, Rule] = {}
    for tree in forest(x, y, trees, depth, leaf=max(2.0, len(y) / 400), seed=seed, tries=6):
        for path in paths(tree):
            held = holds(path, x)
            if 0 < held.sum() < len(y):
                rules.setdefault(np.packbits(held).tobytes(), path)  # rules that hold for the same rows are one
    kept = list(rules.values())
    if not kept:
        return RuleModel(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [])
    intercept, weights = lasso(np.stack([holds(r, x) for r in kept], axis=1).astype(np.float32), y.astype(np.float64), penalty)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-4])


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled rows outside the held-out fold, drawn by a hash of their ids."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded table
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 12_000) -> RuleModel:
    """Fit on at most `most` labelled rows (the bound of what reaches the driver: as many rows of 20 numbers)."""
    rows = training_rows(docs, labels, label, id_col, text_col, most).select("doc_id", "y", statistics_column("text").alias("s")).select("doc_id", "y", "s.*")
    # Copies of one row may come more than once; the hash order above makes them few.
    with arrow_batches(docs.sparkSession, 512):
        rows = rows.limit(2 * most).collect()
    found = sorted(rows, key=lambda r: (str(r["doc_id"]), tuple(r)[2:]))
    x = np.array([tuple(r)[2:] for r in found], dtype=np.float64).reshape(len(found), len(STATISTICS))
    return fit_rules(x, np.array([r["y"] for r in found], dtype=np.int64))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for every row, in place of a column of that name.

    Null and empty texts get the score of empty statistics; repeated rows get theirs each; other columns stay as they are. An
    empty table gives no rows.
    """
    marked = carried(docs, text=text_col).withColumn("statistics", statistics_column("text"))
    return marked.select(*restored(docs, but=(score_col,), text=text_col), F.expr(model.sql("statistics")).alias(score_col))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score; the model is fitted on labelled rows outside the held-out fold; odd rows as in
    `score_quality`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = materialize(score_quality(docs.select("doc_id", "text"), model).drop("text"), "quality")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
