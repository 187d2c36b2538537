"""DuckDB SQL of the queries, from the definition: sort whole suffixes, then ask."""

from __future__ import annotations



def transform(table: str, id_col: str, text_col: str) -> str:
    """Common table expressions `bwt` (bwt_pos, sym) and `runs` (run_id, start, sym, len) over a text column."""
    return f"""
b AS (SELECT {id_col} AS id, hex(encode(coalesce({text_col}, ''))) AS h FROM {table}),
x AS (SELECT id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) + 1)) AS pos FROM b),
bwt AS (SELECT row_number() OVER (ORDER BY substr(h, 2 * pos + 1), id) - 1 AS bwt_pos,
        CASE WHEN pos = 0 THEN 0 ELSE CAST('0x' || substr(h, 2 * pos - 1, 2) AS BIGINT) END AS sym FROM x),
{_RUNS}"""


def int_transform(sequences: str) -> str:
    """The same over a query (id, syms)."""
    return f"""
b AS ({sequences}),
x AS (SELECT id, syms, unnest(range(0, len(syms) + 1)) AS pos FROM b),
bwt AS (SELECT row_number() OVER (ORDER BY syms[pos + 1:], id) - 1 AS bwt_pos,
        CASE WHEN pos = 0 THEN 0 ELSE CAST(syms[pos] AS BIGINT) END AS sym FROM x),
{_RUNS}"""


_RUNS = """
f AS (SELECT bwt_pos, sym, CASE WHEN sym = lag(sym) OVER (ORDER BY bwt_pos) THEN 0 ELSE 1 END AS first FROM bwt),
g AS (SELECT bwt_pos, sym, sum(first) OVER (ORDER BY bwt_pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f),
runs AS (SELECT CAST(run AS BIGINT) AS run_id, CAST(min(bwt_pos) AS BIGINT) AS start, CAST(any_value(sym) AS BIGINT) AS sym, CAST(count(*) AS BIGINT) AS len FROM g GROUP BY run)"""

_NATION, _PART = ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_name")
_TYPE, _BENCH, _CUSTOMER = ("part", "p_partkey", "p_type"), ("benchmark", "item_id", "text"), ("customer", "c_custkey", "c_name")


def _over(at: tuple[str, str, str], query: str, more: str = "") -> str:
    return f"WITH {transform(*at)}{more} {query}"


def _all(at: tuple[str, str, str]) -> str:
    return _over(at, "SELECT run_id, start, sym, len FROM runs")


_EVENTS = """SELECT user_id AS id, list(list_position((SELECT list(DISTINCT event_type ORDER BY event_type) FROM events), event_type) ORDER BY ts, event_id) AS syms FROM events GROUP BY user_id"""
_ORDERS = "SELECT l_orderkey AS id, list(l_partkey + 1 ORDER BY l_linenumber, l_partkey) AS syms FROM lineitem GROUP BY l_orderkey"
_ROLES = """SELECT conv_id AS id, list(list_position((SELECT list(DISTINCT role ORDER BY role) FROM conversations), role) ORDER BY turn) AS syms FROM conversations GROUP BY conv_id"""


def _ints(sequences: str) -> str:
    return f"WITH {int_transform(sequences)} SELECT run_id, start, sym, len FROM runs"


def _parse(table: str, id_col: str, text_col: str) -> str:
    """`occ` (id, j, start, phrase, terminal) and `phrases` (phrase, freq, terminal)."""
    return f"""
b AS (SELECT {id_col} AS id, hex(encode(coalesce({text_col}, ''))) AS h FROM {table}),
cells AS (SELECT id, CAST(length(h) / 2 AS BIGINT) AS n, regexp_replace(h, '(..)', '00\\1', 'g') || '0000' AS w FROM b),
s AS (SELECT id, i, CAST('0x' || substr(w, 4 * i + 1, 4) AS BIGINT) AS s FROM (SELECT id, w, unnest(range(0, n)) AS i FROM cells)),
e AS (SELECT id, i, s, CASE WHEN s = lag(s) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS first FROM s),
q AS (SELECT id, i, s, sum(first) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT id, run, min(i) AS a, any_value(s) AS s FROM q GROUP BY id, run),
t AS (SELECT id, a, s, lag(s) OVER (PARTITION BY id ORDER BY run) AS ps, lead(s) OVER (PARTITION BY id ORDER BY run) AS ns FROM r),
begins AS (SELECT id, a AS start FROM t WHERE ps > s AND ns > s UNION ALL SELECT id, 0 FROM b),
spans AS (SELECT id, start, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS j, lead(start) OVER (PARTITION BY id ORDER BY start) AS next FROM begins),
occ AS (SELECT id, CAST(j AS BIGINT) AS j, CAST(start AS BIGINT) AS start, substr(w, 4 * start + 1, 4 * (coalesce(next, n) + 1 - start)) AS phrase, next IS NULL AS terminal FROM spans JOIN cells USING (id)),
phrases AS (SELECT phrase, CAST(count(*) AS BIGINT) AS freq, any_value(terminal) AS terminal FROM occ GROUP BY phrase)"""


def _pieces(max_len: int, block: int | None) -> str:
    cut = f"list_concat(range(start, start + len, {max_len})" + (f", range((start // {block} + 1) * {block}, start + len, {block}))" if block else ", [])")
    size = f"coalesce(lead(a) OVER (PARTITION BY run_id ORDER BY a), stop) - a"
    return f""",
cuts AS (SELECT run_id, sym, start + len AS stop, unnest(list_distinct({cut})) AS a FROM runs),
pieces AS (SELECT CAST(a AS BIGINT) AS start, sym, CAST({size} AS BIGINT) AS len, CAST(a // {block or 1} AS BIGINT) AS block FROM cuts),
per_block AS (SELECT block, count(*) AS runs FROM pieces GROUP BY block),
hist AS (SELECT runs, count(*) AS freq FROM per_block GROUP BY runs)"""


_BYTES = "greatest(1, CAST(ceil(length(format('{{:x}}', {})) / 2.0) AS INTEGER))"

ORACLES = {
    "collection_stats": "SELECT count(*) AS n_strings, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_symbols, CAST(max(octet_length(encode(text)) + 1) AS BIGINT) AS longest FROM documents",
    "symbol_histogram": "WITH h AS (SELECT hex(encode(text)) AS h FROM documents), s AS (SELECT CAST('0x' || unnest(regexp_extract_all(h, '..')) AS BIGINT) AS sym FROM h UNION ALL SELECT 0 FROM h) SELECT CAST(sym AS BIGINT) AS sym, count(*) AS freq FROM s GROUP BY sym",
    "bwt_region_name": _all(("region", "r_regionkey", "r_name")),
    "bwt_nation_name": _all(_NATION),
    "bwt_customer_name": _all(_CUSTOMER),
    "bwt_part_name": _all(_PART),
    "bwt_part_name_doubling": _all(_PART),
    "bwt_part_name_parse": _all(_PART),
    "bwt_benchmark": _all(_BENCH),
    "bwt_benchmark_parse": _all(_BENCH),
    "bwt_documents_invariants": "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n, count(*) AS n_strings, CAST(0 AS BIGINT) AS unmerged, CAST(0 AS BIGINT) AS gaps FROM documents",
    "bwt_documents_symbols": "WITH h AS (SELECT hex(encode(text)) AS h FROM documents), s AS (SELECT CAST('0x' || unnest(regexp_extract_all(h, '..')) AS BIGINT) AS sym FROM h UNION ALL SELECT 0 FROM h) SELECT CAST(sym AS BIGINT) AS sym, count(*) AS freq FROM s GROUP BY sym",
    "bwt_invert_documents": "SELECT doc_id, text FROM documents",
    "bwt_invert_customer_doubling": "SELECT c_custkey, c_name FROM customer",
    "bwt_invert_first_100": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100",
    "bwt_event_sequences": _ints(_EVENTS),
    "bwt_event_sequences_doubling": _ints(_EVENTS),
    "bwt_order_parts": _ints(_ORDERS),
    "bwt_conversation_roles": _ints(_ROLES),
    "plain_nation_null_replaced": _over(_NATION, "SELECT CAST(bwt_pos AS BIGINT) AS bwt_pos, CAST(CASE WHEN sym = 0 THEN 36 ELSE sym END AS BIGINT) AS sym FROM bwt"),
    "runs_part_brand": _over(("part", "p_partkey", "p_brand"), "SELECT run_id, sym, len FROM runs"),
    "runs_saved_and_read": _all(_NATION),
    "fm_c_table": _over(_TYPE, "SELECT sym, CAST(coalesce(sum(n) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM (SELECT CAST(sym AS BIGINT) AS sym, count(*) AS n FROM bwt GROUP BY sym)"),
    "fm_lf": _over(_TYPE, "SELECT CAST(bwt_pos AS BIGINT) AS bwt_pos, CAST(sym AS BIGINT) AS sym, CAST(row_number() OVER (ORDER BY sym, bwt_pos) - 1 AS BIGINT) AS lf_pos FROM bwt"),
    "fm_summary": _over(_TYPE, "SELECT count(*) AS n, count(DISTINCT sym) AS alphabet, CAST(min(sym) AS BIGINT) AS terminator, CAST(count(*) FILTER (sym = 0) AS BIGINT) AS n_strings FROM bwt"),
    "fm_n_strings": "SELECT count(*) AS n_strings FROM documents",
    "run_stats": _over(
        _BENCH,
        f"SELECT count(*) AS runs, count(DISTINCT sym) AS alphabet, CAST(sum(len) AS BIGINT) AS n, round(sum(len) / count(*), 9) AS n_per_run, max(len) AS longest, min(len) AS shortest, {_BYTES.format('max(sym)')} AS symbol_bytes, {_BYTES.format('max(len)')} AS length_bytes, (SELECT {_BYTES.format('max(n)')} FROM (SELECT CAST(sum(len) AS BIGINT) AS n FROM runs GROUP BY sym)) AS count_bytes FROM runs",
    ),
    "run_symbol_stats": _over(
        _BENCH,
        "SELECT row_number() OVER (ORDER BY runs, sym) AS place, sym, runs, freq, runs * 64 AS space, CAST(coalesce(sum(runs * 64) OVER (ORDER BY runs, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS space_before FROM (SELECT sym, count(*) AS runs, CAST(sum(len) AS BIGINT) AS freq FROM runs GROUP BY sym)",
    ),
    "run_length_bins": _over(_CUSTOMER, "SELECT bin, runs, round(runs * 100.0::DOUBLE / (SELECT count(*) FROM runs), 9) AS percent FROM (SELECT CAST(v AS INTEGER) AS bin, (SELECT count(*) FROM runs WHERE CASE WHEN len <= 255 THEN 1 WHEN len <= 65535 THEN 2 ELSE 3 END = v) AS runs FROM range(1, 4) t(v))"),
    "run_length_deciles": _over(_BENCH, "SELECT CAST(i AS INTEGER) AS decile, (SELECT list(len ORDER BY len) FROM runs)[least(((SELECT count(*) FROM runs) * i + 9) // 10, (SELECT count(*) FROM runs) - 1) + 1] AS len FROM range(1, 10) t(i)"),
    "split_runs": _over(_CUSTOMER, "SELECT start, sym, len, block FROM pieces", _pieces(7, 64)),
    "split_runs_unblocked": _over(_CUSTOMER, "SELECT start, sym, len FROM pieces", _pieces(7, None)),
    "split_summary": _over(
        _CUSTOMER,
        "SELECT r AS runs_before, p AS runs_after, l AS length_splits, p - r - l AS block_splits, round(p / r, 9) AS increase, hi AS most_in_block, lo AS fewest_in_block FROM (SELECT (SELECT count(*) FROM runs) AS r, (SELECT count(*) FROM pieces) AS p, (SELECT CAST(sum((len - 1) // 7) AS BIGINT) FROM runs) AS l, (SELECT max(runs) FROM per_block) AS hi, (SELECT min(runs) FROM per_block) AS lo)",
        _pieces(7, 64),
    ),
    "split_block_histogram": _over(_CUSTOMER, "SELECT runs AS runs_in_block, freq, round(freq / (sum(freq) OVER ())::DOUBLE, 9) AS relative_freq, round((sum(freq) OVER (ORDER BY runs))::DOUBLE / (sum(freq) OVER ())::DOUBLE, 9) AS acc_freq FROM hist", _pieces(7, 64)),
    "split_quartiles": _over(
        _CUSTOMER,
        "SELECT CAST(any_value(b) AS BIGINT) AS blocks, min(runs) FILTER (acc > (b + 1) // 4) AS q1, min(runs) FILTER (acc > (b + 1) // 2) AS q2, min(runs) FILTER (acc > 3 * (b + 1) // 4) AS q3, CAST(min(runs) FILTER (acc > 3 * (b + 1) // 4) + 1.5 * (min(runs) FILTER (acc > 3 * (b + 1) // 4) - min(runs) FILTER (acc > (b + 1) // 4)) AS DOUBLE) AS upper_whisker FROM (SELECT runs, CAST(sum(freq) OVER (ORDER BY runs) AS BIGINT) AS acc, CAST(sum(freq) OVER () AS BIGINT) AS b FROM hist)",
        _pieces(7, 64),
    ),
    "text_lines": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS string_id, n_name AS line FROM nation",
    "integer_cells": "SELECT row_number() OVER (ORDER BY n_regionkey) - 1 AS string_id, string_agg(CAST(n_nationkey + 1 AS VARCHAR), ',' ORDER BY n_nationkey) AS syms FROM nation GROUP BY n_regionkey",
    "columns_saved_and_read": _all(("part", "p_partkey", "p_brand")),
    "recovered_text": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS string_id, n_name AS line FROM nation",
    "bwt_documents_differences": "SELECT CAST(0 AS BIGINT) AS differences",
    "lms_parse": f"WITH {_parse(*_NATION)} SELECT CAST(id AS BIGINT) AS n_nationkey, j, start, phrase FROM occ",
    "lms_phrase_counts": f"WITH {_parse(*_BENCH)} SELECT phrase, freq, terminal FROM phrases",
    "lms_phrase_ranks": f"WITH {_parse(*_BENCH)} SELECT phrase, row_number() OVER (ORDER BY CASE WHEN terminal THEN phrase ELSE phrase || 'FFFF' END) AS rank FROM phrases",
    "lms_dictionary_size": f"WITH {_parse(*_BENCH)} SELECT count(*) AS n_phrases, CAST(sum(length(phrase) // 4) AS BIGINT) AS n_symbols, max(freq) AS max_freq, count(*) FILTER (freq > 1) AS repeated FROM phrases",
    "lms_suffix_groups": f"""WITH {_parse(*_BENCH)},
o AS (SELECT phrase, freq, terminal, length(phrase) // 4 AS n, unnest(range(0, length(phrase) // 4)) AS off FROM phrases),
u AS (SELECT substr(phrase, 4 * off + 1) AS suffix, freq, off, CASE WHEN off > 0 THEN CAST('0x' || substr(phrase, 4 * off - 3, 4) AS BIGINT) END AS l FROM o WHERE terminal OR off < n - 1)
SELECT suffix, count(DISTINCT l) AS n_left, count(*) FILTER (off = 0) AS n_whole, CAST(sum(freq) AS BIGINT) AS freq, CASE WHEN count(*) FILTER (off = 0) = 0 AND min(l) = max(l) THEN min(l) END AS solved_sym FROM u GROUP BY suffix""",
}

ORACLES["histogram_saved_and_read"] = ORACLES["split_block_histogram"]
ORACLES["collection_symbols"] = f"SELECT min(sym) AS smallest, max(sym) AS greatest, max(freq) AS max_freq FROM ({ORACLES['symbol_histogram']}) WHERE sym > 0"
