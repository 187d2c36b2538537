"""Toxicity by class-conditional Kneser-Ney models of characters.

Two interpolated Kneser-Ney models of order four, of toxic and of ordinary texts, spell out every word: each predicts a
character, or the end of the word, from the three before it in the word. The upper two orders of a class back off to its
own continuation counts, and these to orders two and one that both classes share, so that an expression that is rare in
one class is smoothed by what is known of both. Word models were tried first: most words of a large corpus are rare, and
tables of word pairs of a bounded size fill up with them, while a word that no row has shown is still spelled by n-grams
that rows have shown.

A word's evidence is the difference of its log-likelihoods under the two models. A text's evidence is normalised by length:
the mean over all its characters, the largest evidence of one word, and the share of words with strong evidence; a logistic
function of these three, fitted on labelled rows that the models have not counted, is the score.

Every labelled row of folds 1 to 3 is counted (fold 4 fits the weights, fold 0 is held out), in tables of 32 ** 4 exact cells: the alphabet has the word's end,
26 letters, one symbol for digits and four for bytes beyond ASCII. That bounds the model at any size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import arrow_batches
from .quality import fold
from .workspace import carried, materialize, restored

SYMBOLS, ORDER, DISCOUNT, STRONG = 32, 4, 0.75, 3.0
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[97:123], _SYMBOL[48:58], _SYMBOL[128:] = range(1, 27), 27, [28 + b % 4 for b in range(128)]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character or word end of a text, and where the words begin among them."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    s = np.concatenate([[0, 0, 0], _SYMBOL[raw], [0]])
    one = s[2:-1]
    two = np.where(one == 0, 0, s[1:-2])
    three = np.where(two == 0, 0, s[:-3])
    codes = ((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + s[3:]
    codes = codes[(s[3:] != 0) | (one != 0)]  # no end of a word without letters
    return codes, np.flatnonzero((codes % SYMBOLS**ORDER) < SYMBOLS) if len(codes) else codes


def count_ngrams(rows: DataFrame) -> np.ndarray:
    """Counts [2, 32, 32, 32, 32] by class of all rows (text, y); at most 32 ** 4 rows of sums reach the driver."""

    def partial(batches):
        sums = np.zeros((2, SYMBOLS**ORDER), dtype=np.int64)
        for batch in batches:
            by_label: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_label[y].append(ngrams(text)[0])
            for y, found in by_label.items():
                if found:
                    sums[y] += np.bincount(np.concatenate(found), minlength=SYMBOLS**ORDER)
        seen = np.flatnonzero(sums.any(axis=0))
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(sums[0][part]), pa.array(sums[1][part])], names=["cell", "n0", "n1"])

    cells = rows.select("text", "y").mapInArrow(partial, "cell int, n0 bigint, n1 bigint").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = np.zeros((2, SYMBOLS**ORDER), dtype=np.int64)
    with arrow_batches(rows.sparkSession, 256):
        found = cells.toArrow()
    at = found.column("cell").to_numpy()
    out[0][at], out[1][at] = found.column("n0").to_numpy(), found.column("n1").to_numpy()
    return out.reshape(2, *[SYMBOLS] * ORDER)


def interpolated(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """P(last | the others): discounted counts, and the discounts spread as `below`; unseen contexts take `below`."""
    total = counts.sum(axis=-1, keepdims=True)
    left = DISCOUNT * (counts > 0).sum(axis=-1, keepdims=True)
    p = (np.maximum(counts - DISCOUNT, 0) + left * below) / np.maximum(total, 1)
    return np.where(total > 0, p, below)


def evidence_table(counts: np.ndarray) -> np.ndarray:
    """Log-probability of every n-gram's last symbol as toxic less that as ordinary."""
    continued = lambda n: (n > 0).sum(axis=0).astype(np.float64)  # noqa: E731  how many symbols precede
    trigrams = [continued(c) for c in counts]
    pooled = continued(trigrams[0] + trigrams[1])
    unigrams = continued(pooled) + 1.0
    shared = interpolated(pooled, unigrams / unigrams.sum())
    logs = []
    for y in (0, 1):
        middle = interpolated(trigrams[y], shared[None, :, :])
        logs.append(np.log(interpolated(counts[y].astype(np.float64), middle[None])))
    return (logs[1] - logs[0]).astype(np.float32).reshape(-1)


def features(table: np.ndarray, text: str | None) -> tuple[float, float, float]:
    """Mean evidence of a character, largest of a word, share of strong words; zeros without words."""
    codes, starts = ngrams(text)
    if not len(codes):
        return 0.0, 0.0, 0.0
    evidence = table[codes]
    words = np.add.reduceat(evidence, starts)
    return float(evidence.mean()), float(words.max()), float((words > STRONG).mean())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(a.shape[1]) * len(x)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def evidence_column(table, text: str):
    """A struct of the three features; `table` is a broadcast evidence table."""

    @F.pandas_udf("mean double, peak double, strong double")
    def compute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(table.value, t) for t in texts], columns=["mean", "peak", "strong"], dtype="float64")

    return compute(F.col(text))


@dataclass
class ToxicityModel:
    table: object  # broadcast evidence of every n-gram
    weights: list[float]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_fitted: int = 20_000) -> ToxicityModel | None:
    """Count all labelled rows of folds 1 to 3; fit the three weights on at most `most_fitted` rows of fold 4.

    Rows of fold 0 are never looked at. Null labels and ids are left out; null and empty texts have no n-grams; repeated rows
    are counted as often as they come. None if one of the classes has no row, as in empty tables.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("fold", fold(F.col("doc_id")))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = text.where(fold(F.col("doc_id")).between(1, 3))  # before the join: less to shuffle
    learned = marked.where("fold between 1 and 3").select("doc_id", "y")
    counts = count_ngrams(counted.join(learned.hint("merge"), "doc_id"))  # labels grow with the texts: one plan at any size
    if not counts[0].any() or not counts[1].any():
        return None
    table = spark.sparkContext.broadcast(evidence_table(counts))
    drawn = marked.where("fold = 4").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_fitted)
    rows = text.join(F.broadcast(drawn), "doc_id").select("y", evidence_column(table, "text").alias("s")).select("y", "s.*")
    with arrow_batches(spark, 256):
        found = rows.limit(2 * most_fitted).collect()
    x, y = np.array([tuple(r)[1:] for r in found], dtype=np.float64).reshape(len(found), 3), np.array([r["y"] for r in found], dtype=np.float64)
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return ToxicityModel(table, [1.0, 1.0, 0.0, -6.0])
    scale = np.maximum(x.std(axis=0), 1e-9)
    w = logistic(x / scale, y, ridge=1e-5)
    return ToxicityModel(table, [float(v) for v in (*(w[:3] / scale), w[3])])


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for every row, in place of a column of that name.

    Without a model it is 0; a text without words, null and empty ones too, has no evidence; repeated rows get theirs each;
    other columns stay as they are. An empty table gives no rows.
    """
    rows, kept = carried(docs, text=text_col), restored(docs, but=(score_col,), text=text_col)
    if model is None:
        return rows.select(*kept, F.lit(0.0).alias(score_col))
    w = model.weights
    marked = rows.withColumn("evidence", evidence_column(model.table, "text"))
    z = F.col("evidence.mean") * w[0] + F.col("evidence.peak") * w[1] + F.col("evidence.strong") * w[2] + w[3]
    return marked.select(*kept, (1 / (1 + F.exp(-z))).alias(score_col))


def op5_toxicity_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels come from outside the held-out fold; odd rows as in `score_toxicity`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = materialize(score_toxicity(docs, model).drop("text"), "toxicity", batch=256)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
