"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in DataFrame functions only.

A text is cut into sections behind blank lines, these into paragraphs behind line ends, and these into sentences (behind
sentence marks or bars, or after `LONGEST` characters); no character is lost. A sentence's hash is its SHA-256, a
paragraph's that of its sentences' hashes, a section's that of its paragraphs', the root that of the sections'. Equal roots
mean equal texts; where roots differ, only branches with differing hashes need a look to find the edit. The fingerprint is
one string: the root, and the tree of shortened hashes, a branch's before those of its parts, `root:s(p(l.l),p(l))/s(p(l))`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import carried, column, restored

LONGEST, SHORT = 160, 12
#: Blocks of neighbouring rows, whose bounds are in the plan: 6 GB each, sorted with spilling, at 100 TB.
MOST_BLOCKS = 1 << 14
_SENTENCE = r"[^.!?|]{1,%d}[.!?|]*|[.!?|]+" % LONGEST


def leaves(text: Column) -> Column:
    """Sentence hashes as array<array<array<string>>>: sections, paragraphs, sentences. Null is the empty text."""
    sentences = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_SENTENCE), F.lit(0)), lambda s: F.sha2(s, 256))
    paragraphs = lambda s: F.transform(F.split(s, r"(?<=\n)(?!\n|\z)"), sentences)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)(?!\n|\z)"), paragraphs)


def paragraph_hashes(leaf: Column) -> Column:
    return F.transform(leaf, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ""), 256)))


def section_hashes(leaf: Column) -> Column:
    return F.transform(paragraph_hashes(leaf), lambda s: F.sha2(F.array_join(s, ""), 256))


def root(leaf: Column) -> Column:
    return F.sha2(F.array_join(section_hashes(leaf), ""), 256)


def _by_name(x: Column, made) -> Column:
    """`made` of a column that stands for `x`, which is thus worked out once: the list of one holds it."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def fingerprint(leaf: Column) -> Column:
    """Root and tree as one string."""
    short = lambda x: F.substring(x, 1, SHORT)
    paragraph = lambda h, p: F.concat(short(h), F.lit("("), F.array_join(F.transform(p, short), "."), F.lit(")"))

    def tree(leaf: Column, paragraphs: Column, sections: Column) -> Column:
        parts = lambda i: F.array_join(F.zip_with(F.get(paragraphs, i), F.get(leaf, i), paragraph), ",")
        named = F.transform(sections, lambda h, i: F.concat(short(h), F.lit("("), parts(i), F.lit(")")))
        return F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), F.array_join(named, "/"))

    above = lambda x: F.transform(x, lambda s: F.sha2(F.array_join(s, ""), 256))
    return _by_name(leaf, lambda leaf: _by_name(paragraph_hashes(leaf), lambda ps: _by_name(above(ps), lambda ss: tree(leaf, ps, ss))))


def nodes(fingerprint: str) -> Column:
    """The hashes of all nodes of a column of fingerprints, the root's too; each but the first of equal ones with its number
    among them, so that what trees share can be counted as sets."""
    # In sorted order a node is at least the k-th of its kind if the k-th one before is equal: k is found bit by bit.
    steps = ", ".join(str(1 << b) for b in range(20, -1, -1))
    number = f"aggregate(array({steps}), 0, (k, d) -> if(i >= k + d and s[i - k - d] = x, k + d, k))"
    found = f"sort_array(array_remove(split({fingerprint}, '[^0-9a-f]+'), ''))"
    # A list of one holds the array by a name.
    return F.expr(f"transform(array({found}), s -> transform(s, (x, i) -> if(i > 0 and s[i - 1] = x, concat(x, '#', {number}), x)))[0]")


def likeness(a: str, b: str, nodes_a: Column | None = None, nodes_b: Column | None = None) -> Column:
    """Of the nodes of two columns of fingerprints, roots, inner ones and leaves, the share that both trees have: twice the
    common ones over the sum, counted as often as they come. 1 only for equal roots. Nodes may be given."""
    nodes_a, nodes_b = nodes(a) if nodes_a is None else nodes_a, nodes(b) if nodes_b is None else nodes_b
    root_of = lambda c: F.substring_index(F.col(c), ":", 1)
    common = 2.0 * F.size(F.array_intersect(nodes_a, nodes_b)) / (F.size(nodes_a) + F.size(nodes_b))
    return F.when(root_of(a) == root_of(b), F.lit(1.0)).otherwise(common)


def differing_branches(a: str, b: str) -> Column:
    """Where the tree of fingerprint column `b` differs from that of `a`: struct (sections_before, sections_behind,
    paragraphs_before, paragraphs_behind).

    So many leading and trailing sections have equal hashes and need no look; of the paragraphs of those between, so many
    leading and trailing ones. An inserted or changed part is thus the only one left, wherever it is.
    """

    def leading(x: str, y: str) -> str:
        """Equal leading elements of two arrays."""
        return f"int(coalesce(nullif(array_position(zip_with({x}, {y}, (m, n) -> coalesce(m = n, false)), false), 0) - 1, least(size({x}), size({y}))))"

    # Each step is a list of one, which holds what the next one needs by a name.
    sections = lambda c: f"split(substring_index({c}, ':', -1), '/')"
    # The differing sections begin and end in different paragraphs: only the first and the last one are taken apart.
    parts = lambda s: f"coalesce(split(substring({s}, {SHORT + 2}, length({s}) - {SHORT + 3}), '[)],'), array())"
    at = lambda x, i: parts(f"if(t.p < t.n, get(t.{x}, {i}), null)")
    step = f"array(named_struct('a', {sections(a)}, 'b', {sections(b)}))"
    step = f"transform({step}, t -> named_struct('a', t.a, 'b', t.b, 'n', least(size(t.a), size(t.b)), 'p', {leading('t.a', 't.b')}))"
    step = f"transform({step}, t -> named_struct('a', t.a, 'b', t.b, 'n', t.n, 'p', t.p, 'q', if(t.p < t.n, least({leading('reverse(t.a)', 'reverse(t.b)')}, t.n - t.p), 0)))"
    open_ = "t.p + t.q < t.n"
    firsts = f"'fa', if({open_}, {at('a', 't.p')}, array()), 'fb', if({open_}, {at('b', 't.p')}, array())"
    lasts = f"'la', if({open_}, {at('a', 'size(t.a) - 1 - t.q')}, array()), 'lb', if({open_}, {at('b', 'size(t.b) - 1 - t.q')}, array())"
    step = f"transform({step}, t -> named_struct('p', t.p, 'q', t.q, 'one_a', size(t.a) - t.p - t.q = 1, 'one_b', size(t.b) - t.p - t.q = 1, {firsts}, {lasts}))"
    step = f"transform({step}, t -> named_struct('p', t.p, 'q', t.q, 'x', {leading('t.fa', 't.fb')}, 'y', {leading('reverse(t.la)', 'reverse(t.lb)')}, 'm', least(if(t.one_a, size(t.fa), 1073741824), if(t.one_b, size(t.fb), 1073741824))))"
    return F.expr(f"transform({step}, t -> named_struct('sections_before', t.p, 'sections_behind', t.q, 'paragraphs_before', t.x, 'paragraphs_behind', least(t.y, t.m - t.x)))[0]")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of every row's text, in place of a column of that name.

    Null texts have that of the empty text; equal texts, repeated rows too, have equal ones; other columns stay as they are.
    An empty table gives no rows.
    """
    rows = carried(docs, text=text_col).withColumn("leaves", leaves(F.col("text")))
    return rows.select(*restored(docs, but=(out_col,), text=text_col), fingerprint(F.col("leaves")).alias(out_col))


def with_next(docs: DataFrame, id_col: str, text_col: str, carry: Mapping[str, Column] | None = None, blocks: int | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, text, next_text, ...): the text of the row with the next larger id, of the first row after the last.

    For each name in `carry`, an expression over the text, also its value for the row, and as next_<name> for the next one.
    Texts are shuffled once, into blocks of neighbouring ids, of about `block_bytes` each (at most MOST_BLOCKS): the bounds are approximate
    quantiles of the ids. The first row of each block also goes to the block before, behind its rows. Null texts are empty
    ones. Rows of equal ids are ordered by text; rows without an id come first. An empty table gives no rows.
    """
    spark, carry = docs.sparkSession, dict(carry or {})
    rows = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    if blocks is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        blocks = max(8, min(MOST_BLOCKS, -(-size // block_bytes)))
    bounds: list = []
    if blocks > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], min(100 * blocks, 200_000)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.withColumn("block", _block_of(F.col("doc_id"), bounds, kind))
    heads = [(r["block"], r["head"]["doc_id"]) for r in placed.groupBy("block").agg(F.min(F.struct("doc_id")).alias("head")).orderBy("block").collect()]  # a row for each block
    if not heads:
        return rows.select("*", F.col("text").alias("next_text"), *[x for n, e in carry.items() for x in (e.alias(n), e.alias(f"next_{n}"))]).limit(0)
    before = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    heads_df = spark.createDataFrame(before, f"block int, head {kind}")
    guests = rows.join(F.broadcast(heads_df), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "block", F.lit(1).alias("guest"))
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests).withColumns(carry)
    after = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    nexts = {f"next_{n}": F.lead(n).over(after) for n in ("text", *carry)}
    return both.withColumns(nexts).where("guest = 0").drop("guest", "block")


def _block_of(key: Column, bounds: list, kind: str) -> Column:
    """How many of the ascending bounds are at most `key`, by bisection in one array; null keys are in block 0.

    The steps are an array as well, so that the bounds are in the plan once: a step written around the one before would hold it
    three times, and 384 bounds (6 GB) then fill the driver.
    """
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))


def op4_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, their likeness to each other and to the next text's, and the branches
    in which the edited text differs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document. Null
    texts are empty; repeated rows have a row each; a table without rows gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_next(docs, "doc_id", "text", {"fingerprint": fingerprint(leaves(F.col("text")))}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 2)))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", leaves(F.col("edited")).alias("leaves"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("leaves")))
    # Columns of their own, so that none is worked out twice.
    rows = rows.withColumns({"n": nodes("fingerprint"), "edited_n": nodes("edited_fingerprint"), "next_n": nodes("next_fingerprint")})
    near = {"near_edited": likeness("fingerprint", "edited_fingerprint", F.col("n"), F.col("edited_n")), "near_next": likeness("fingerprint", "next_fingerprint", F.col("n"), F.col("next_n"))}
    rows = rows.withColumns(near).withColumn("b", differing_branches("fingerprint", "edited_fingerprint"))
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "b.sections_before", "b.paragraphs_before"]
    return rows.select(*out)


#: The same in DuckDB, whose patterns do not look back: sections and paragraphs are taken instead of cut at their ends.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text
  FROM documents
), edited AS (
  SELECT doc_id, length(text) AS n_chars, text, next_text,
         left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited
  FROM rows
), texts AS (
  SELECT doc_id, 1 AS kind, text AS t FROM edited UNION ALL
  SELECT doc_id, 2, edited FROM edited UNION ALL
  SELECT doc_id, 3, next_text FROM edited
), trees AS (
  SELECT doc_id, kind, t,
         list_transform(CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '(?:
?[^
])*
{2,}|(?:
?[^
])+
?|
') END,
           lambda s: list_transform(CASE WHEN s = '' THEN [''] ELSE regexp_extract_all(s, '[^
]*
+|[^
]+') END,
             lambda p: list_transform(regexp_extract_all(p, '[^.!?|]{1,160}[.!?|]*|[.!?|]+'), lambda x: sha256(x)))) AS leaves
  FROM texts
), hashes AS (
  SELECT *, list_transform(leaves, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS paragraphs FROM trees
), roots AS (
  SELECT *, list_transform(paragraphs, lambda s: sha256(array_to_string(s, ''))) AS sections FROM hashes
), named AS (
  SELECT doc_id, kind, sha256(array_to_string(sections, '')) AS root,
         list_transform(sections, lambda h: left(h, 12)) AS sections,
         list_transform(flatten(paragraphs), lambda h: left(h, 12)) AS paragraphs,
         list_transform(flatten(flatten(leaves)), lambda h: left(h, 12)) AS leaves,
         array_to_string(list_transform(sections, lambda h, i: left(h, 12) || '(' || array_to_string(list_transform(paragraphs[i],
           lambda g, j: left(g, 12) || '(' || array_to_string(list_transform(leaves[i][j], lambda x: left(x, 12)), '.') || ')'), ',') || ')'), '/') AS tree,
         list_transform(paragraphs, lambda s: list_transform(s, lambda h: left(h, 12))) AS by_section
  FROM roots
), nodes AS (
  SELECT doc_id, kind, x, count(*) AS n
  FROM (SELECT doc_id, kind, unnest(list_concat(list_concat([root], sections), list_concat(paragraphs, leaves))) AS x FROM named) GROUP BY ALL
), sums AS (
  SELECT doc_id, kind, sum(n) AS n FROM nodes GROUP BY ALL
), common AS (
  SELECT a.doc_id, b.kind, sum(least(a.n, b.n)) AS n FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.x = b.x AND a.kind = 1 AND b.kind > 1 GROUP BY ALL
), likeness AS (
  SELECT a.doc_id, b.kind, CASE WHEN a.root = b.root THEN 1.0 ELSE 2.0::DOUBLE * coalesce(c.n, 0) / (x.n + y.n) END AS near
  FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind > 1
  JOIN sums x ON x.doc_id = a.doc_id AND x.kind = 1 JOIN sums y ON y.doc_id = b.doc_id AND y.kind = b.kind
  LEFT JOIN common c ON c.doc_id = b.doc_id AND c.kind = b.kind
), heads AS (
  SELECT a.doc_id, a.by_section AS pa, b.by_section AS pb,
         len(list_filter(range(1, least(len(a.sections), len(b.sections)) + 1), lambda i: a.sections[1:i] = b.sections[1:i])) AS s0,
         len(list_filter(range(1, least(len(a.sections), len(b.sections)) + 1), lambda i: a.sections[-i:] = b.sections[-i:])) AS s1,
         least(len(a.sections), len(b.sections)) AS least_n
  FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind = 2
), middles AS (
  SELECT doc_id, s0, flatten(pa[s0 + 1 : len(pa) - least(s1, least_n - s0)]) AS ma, flatten(pb[s0 + 1 : len(pb) - least(s1, least_n - s0)]) AS mb FROM heads
)
SELECT e.doc_id, CAST(e.n_chars AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
       a.root || ':' || a.tree AS fingerprint, b.root || ':' || b.tree AS edited_fingerprint,
       CAST(le.near AS DOUBLE) AS near_edited, CAST(ln.near AS DOUBLE) AS near_next, CAST(m.s0 AS INTEGER) AS sections_before,
       CAST(len(list_filter(range(1, least(len(m.ma), len(m.mb)) + 1), lambda i: m.ma[1:i] = m.mb[1:i])) AS INTEGER) AS paragraphs_before
FROM edited e JOIN named a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN named b ON b.doc_id = e.doc_id AND b.kind = 2
JOIN likeness le ON le.doc_id = e.doc_id AND le.kind = 2 JOIN likeness ln ON ln.doc_id = e.doc_id AND ln.kind = 3 JOIN middles m ON m.doc_id = e.doc_id
"""
