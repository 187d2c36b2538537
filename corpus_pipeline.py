"""A training corpus from `documents`: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all the rows of its input and returns a frame; all but the last return the
columns that they were given. `run` writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suffixloom.llm.mixing import mix_sources
from suffixloom.llm.near_dedup import near_duplicates
from suffixloom.llm.packing import pack
from suffixloom.llm.quality import fit_quality, score_quality
from suffixloom.llm.secrets import redact_secrets
from suffixloom.llm.tokens import public_path
from suffixloom.llm.workspace import carried, column, materialize, restored, unused

QUALITY_AT_LEAST = 0.3


#: Ids that are sent to every task instead of shuffling whole texts: some 20 MB.
MOST_SENT = 1_000_000

_USED = {c: c for c in ("doc_id", "text", "source")}


def _mixed(docs: DataFrame) -> DataFrame:
    """`docs`, `carried`, with their places in the mix of sources at tempered weights."""
    return mix_sources(carried(docs, **_USED))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least QUALITY_AT_LEAST; the model learns from the labelled rows of `docs`.

    Null and empty texts have the score of empty statistics; repeated rows are kept or not alike; an empty table gives none.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")  # the script's session: its stages hold whole texts
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_AT_LEAST).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id.

    Of rows that share an id one stays; rows without an id are in no group and stay, as do those without words. An empty
    table gives none.
    """
    near = near_duplicates(docs, ngram=5, percent=80).where("doc_id is not null").groupBy(F.col("doc_id").alias("other_id"))
    near = materialize(near.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "near")
    dropped, repeated = near.where("not kept").select("other_id"), near.where("kept").select("other_id")

    def without(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
        return rows.join(ids, rows["doc_id"] == ids["other_id"], how)

    chosen = without(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return chosen
    each = carried(without(chosen, repeated, "left_semi"), **_USED)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source", F.to_json("row")))
    one = each.withColumn("number", F.row_number().over(first)).where("number = 1").select(*restored(docs, **_USED))
    return without(chosen, repeated, "left_anti").unionByName(one)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their texts and n_chars counted again; null texts stay null and keep their n_chars."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mix_in_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, sorted by their place in the mix of sources at tempered weights; null sources are one source."""
    return _mixed(docs).orderBy("__slot", "__place").select(*restored(docs, **_USED))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences of 2048 tokens, which follow the mix; a null or empty text is its end alone.

    Files keep no order when they are read, and stages no columns of their own; but a row's place in the mix follows from
    the rows alone, so it is worked out again here.
    """
    return pack(_mixed(docs), public_path("word_bpe_49k.json"), order=("__slot", "__place"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mix_in_order),
    ("packing", pack_sequences),
]

#: SQL cannot express the fitted classifier, the forest or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
