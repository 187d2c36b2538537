"""The queries. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stored
from ..operators import index, parse, splitting, statistics
from ..operators.build import build_bwt, expand
from ..sources import collection, files


def _column(spark: SparkSession, sf_dir: str, table: str, id_col: str, text_col: str) -> DataFrame:
    return collection.from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), id_col, text_col)


def _runs(spark, sf_dir, table, id_col, text_col, strategy="auto") -> DataFrame:
    return build_bwt(_column(spark, sf_dir, table, id_col, text_col), strategy)


def _collected(rows: DataFrame, key: str, order: list[str], value) -> DataFrame:
    """Integer strings: `value` of each key's rows, in order."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, value.cast("long").alias("v")))).alias("l"))
    return collection.from_int_arrays(listed.select(key, F.transform("l", lambda x: x["v"]).alias("syms")), key, "syms")


def _code(column: str, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))




def event_sequences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())
    return _collected(rows, "user_id", ["ts", "event_id"], _code("event_type", kinds))


def order_parts(spark, sf_dir):
    return _collected(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", ["l_linenumber", "l_partkey"], F.col("l_partkey") + 1)


def role_sequences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kinds = sorted(r[0] for r in rows.select("role").distinct().collect())
    return _collected(rows, "conv_id", ["turn"], _code("role", kinds))


def _documents(spark, sf_dir) -> DataFrame:
    return _column(spark, sf_dir, "documents", "doc_id", "text")


def documents_runs(spark, sf_dir):
    return build_bwt(_documents(spark, sf_dir), "doubling")


def documents_runs_by_parse(spark, sf_dir):
    return build_bwt(_documents(spark, sf_dir), "parse")


def documents_invariants(spark, sf_dir):
    """Totals that the transform of `documents` must have: rows, strings, runs that repeat their neighbour's symbol."""
    return statistics.invariants(documents_runs(spark, sf_dir))


def documents_symbol_totals(spark, sf_dir):
    return documents_runs(spark, sf_dir).groupBy("sym").agg(F.sum("len").alias("freq"))


def _inverted(spark, sf_dir, table, id_col, text_col, first=None, strategy="auto", build="auto") -> DataFrame:
    strings = _column(spark, sf_dir, table, id_col, text_col)
    runs = stored(build_bwt(strings, build), "runs")
    found = index.with_string_ids(index.invert(runs, first, strategy), strings)
    return found.select(F.col("string_id").alias(id_col), F.decode("body", "UTF-8").alias(text_col))


def _saved_and_read(spark, sf_dir):
    path = f"{shared_folder(spark)}/suffixloom/nation_names_{uuid.uuid4().hex}.runs"
    files.write_runs(stored(_runs(spark, sf_dir, "nation", "n_nationkey", "n_name"), "runs"), path)
    return files.read_runs(spark, path)


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/suffixloom/{uuid.uuid4().hex}/{name}"


def text_lines(spark, sf_dir):
    """Lines of two files, of which the second is the larger."""
    names, path = spark.read.parquet(f"{sf_dir}/nation.parquet"), _fresh(spark, "lines")
    for part, rows in (("1", names.where("n_nationkey < 5")), ("2", names.where("n_nationkey >= 5"))):
        rows.coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(f"{path}/{part}")
    return collection.from_text_files(spark, f"{path}/*").select("string_id", F.decode("body", "UTF-8").alias("line"))


def integer_cells(spark, sf_dir):
    """The nations of each region as integers, written as cells of two bytes and read again."""
    path = _fresh(spark, "nations.cells")
    nations = _collected(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_regionkey", ["n_nationkey"], F.col("n_nationkey") + 1)
    files.write_cells(nations, path, 2)
    return collection.from_cells(spark, path, 2).select("string_id", F.array_join("syms", ",").alias("syms"))


def columns_saved_and_read(spark, sf_dir):
    prefix = _fresh(spark, "brands")
    files.write_columns(stored(_runs(spark, sf_dir, "part", "p_partkey", "p_brand"), "runs"), prefix)
    return files.read_columns(spark, prefix)


def histogram_saved_and_read(spark, sf_dir):
    path = _fresh(spark, "histogram.tsv")
    files.write_histogram(histogram(spark, sf_dir), path)
    return files.read_histogram(spark, path)


def recovered_text(spark, sf_dir):
    """The lines of the file that the strings were recovered to."""
    path = _fresh(spark, "recovered.txt")
    files.write_text(index.invert(stored(_runs(spark, sf_dir, *_NATION), "runs")), path)
    return collection.from_text_files(spark, path).select("string_id", F.decode("body", "UTF-8").alias("line"))


def collection_symbols(spark, sf_dir):
    """The smallest and the greatest symbol but the terminator, and how often the most frequent one occurs."""
    found = collection.symbol_histogram(_documents(spark, sf_dir)).where("sym > 0")
    return found.agg(F.min("sym").alias("smallest"), F.max("sym").alias("greatest"), F.max("freq").alias("max_freq"))


def documents_differences(spark, sf_dir):
    """How many runs of the two ways to build the transform of `documents` the other one does not have."""
    one, other = stored(documents_runs(spark, sf_dir), "runs"), stored(documents_runs_by_parse(spark, sf_dir), "runs")
    sides = one.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(-1)))
    counts = sides.groupBy("run_id", "start", "sym", "len").agg(F.sum("side").alias("n"))
    return counts.agg(F.count_if(F.col("n") != 0).alias("differences"))


def _pieces(spark, sf_dir, max_len=7, block=64):
    return splitting.split_runs(_runs(spark, sf_dir, "customer", "c_custkey", "c_name"), max_len, block)


def _phrases(spark, sf_dir):
    occurrences = parse.parse(_column(spark, sf_dir, "benchmark", "item_id", "text"))
    return parse.phrase_counts(stored(occurrences, "occurrences"))


def phrase_counts(spark, sf_dir):
    return _phrases(spark, sf_dir).select(F.hex("phrase").alias("phrase"), "freq", F.col("terminal"))


def parse_positions(spark, sf_dir):
    return parse.parse(_column(spark, sf_dir, "nation", "n_nationkey", "n_name")).select(F.col("string_id").alias("n_nationkey"), "j", "start", F.hex("phrase").alias("phrase"))


def phrase_ranks(spark, sf_dir):
    return parse.phrase_ranks(stored(_phrases(spark, sf_dir), "phrases"), True).select(F.hex("phrase").alias("phrase"), "rank")


def dictionary_size(spark, sf_dir):
    return parse.dictionary_size(_phrases(spark, sf_dir), True)


def suffix_groups(spark, sf_dir):
    phrases = parse.phrase_counts(parse.parse(_column(spark, sf_dir, "benchmark", "item_id", "text")))
    groups = parse.suffix_groups(parse.phrase_suffixes(stored(phrases, "phrases"), True), True)
    return groups.select(F.hex("suffix").alias("suffix"), "n_left", "n_whole", "freq", "solved_sym")


def histogram(spark, sf_dir):
    found = splitting.block_histogram(_pieces(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("relative_freq", "acc_freq")})


_NATION, _PART = ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_name")
_TYPE, _BENCH, _CUSTOMER = ("part", "p_partkey", "p_type"), ("benchmark", "item_id", "text"), ("customer", "c_custkey", "c_name")


def _stats(spark, sf_dir):
    return statistics.run_stats(_runs(spark, sf_dir, *_BENCH)).withColumn("n_per_run", F.round("n_per_run", 9))


QUERIES = {
    "collection_stats": lambda s, d: collection.collection_stats(_documents(s, d)),
    "symbol_histogram": lambda s, d: collection.symbol_histogram(_documents(s, d)),
    "bwt_region_name": lambda s, d: _runs(s, d, "region", "r_regionkey", "r_name"),
    "bwt_nation_name": lambda s, d: _runs(s, d, *_NATION),
    "bwt_customer_name": lambda s, d: _runs(s, d, *_CUSTOMER),
    "bwt_part_name": lambda s, d: _runs(s, d, *_PART),
    "bwt_part_name_doubling": lambda s, d: _runs(s, d, *_PART, "doubling"),
    "bwt_part_name_parse": lambda s, d: _runs(s, d, *_PART, "parse"),
    "bwt_benchmark": lambda s, d: _runs(s, d, *_BENCH),
    "bwt_benchmark_parse": lambda s, d: _runs(s, d, *_BENCH, "parse"),
    "bwt_documents": documents_runs,
    "bwt_documents_parse": documents_runs_by_parse,
    "bwt_documents_invariants": documents_invariants,
    "bwt_documents_symbols": documents_symbol_totals,
    "bwt_invert_documents": lambda s, d: _inverted(s, d, "documents", "doc_id", "text", build="doubling"),
    "bwt_invert_customer_doubling": lambda s, d: _inverted(s, d, *_CUSTOMER, strategy="doubling"),
    "bwt_invert_first_100": lambda s, d: _inverted(s, d, *_CUSTOMER, first=100),
    "bwt_event_sequences": lambda s, d: build_bwt(event_sequences(s, d)),
    "bwt_event_sequences_doubling": lambda s, d: build_bwt(event_sequences(s, d), "doubling"),
    "bwt_order_parts": lambda s, d: build_bwt(order_parts(s, d)),
    "bwt_conversation_roles": lambda s, d: build_bwt(role_sequences(s, d)),
    "plain_nation_null_replaced": lambda s, d: expand(_runs(s, d, *_NATION), 36),
    "runs_part_brand": lambda s, d: _runs(s, d, "part", "p_partkey", "p_brand").select("run_id", "sym", "len"),
    "runs_saved_and_read": _saved_and_read,
    "fm_c_table": lambda s, d: index.c_table(_runs(s, d, *_TYPE)),
    "fm_lf": lambda s, d: index.lf(stored(_runs(s, d, *_TYPE), "runs")),
    "fm_summary": lambda s, d: index.summary(_runs(s, d, *_TYPE)),
    "fm_n_strings": lambda s, d: index.summary(documents_runs(s, d)).select("n_strings"),
    "run_stats": _stats,
    "run_symbol_stats": lambda s, d: statistics.symbol_stats(_runs(s, d, *_BENCH)),
    "run_length_bins": lambda s, d: statistics.length_bins(_runs(s, d, *_CUSTOMER)).withColumn("percent", F.round("percent", 9)),
    "run_length_deciles": lambda s, d: statistics.length_deciles(_runs(s, d, *_BENCH)),
    "split_runs": _pieces,
    "split_runs_unblocked": lambda s, d: splitting.split_runs(_runs(s, d, *_CUSTOMER), splitting.bits_to_length(3)).select("start", "sym", "len"),
    "split_summary": lambda s, d: splitting.split_summary(_runs(s, d, *_CUSTOMER), 7, 64).withColumn("increase", F.round("increase", 9)),
    "split_block_histogram": histogram,
    "split_quartiles": lambda s, d: splitting.block_quartiles(_pieces(s, d)),
    "text_lines": text_lines,
    "integer_cells": integer_cells,
    "columns_saved_and_read": columns_saved_and_read,
    "histogram_saved_and_read": histogram_saved_and_read,
    "recovered_text": recovered_text,
    "collection_symbols": collection_symbols,
    "bwt_documents_differences": documents_differences,
    "lms_parse": parse_positions,
    "lms_phrase_counts": phrase_counts,
    "lms_phrase_ranks": phrase_ranks,
    "lms_dictionary_size": dictionary_size,
    "lms_suffix_groups": suffix_groups,
}
