"""MinHash near-duplicates, with odd sketches between the bands and the exact comparison.

A document is the set of its distinct n-word shingles. Equal sets are one class from the start, so that copies never meet
each other again. Each class gets `bands * rows` MinHash values, whose `bands` keys gather candidates, and a MinHash sample by
one permutation, which is folded into a bitmap of parities (an odd sketch): the bits in which two sketches differ estimate
how many values differ, with a standard error of about 0.01 in similarity.

Candidates of a bucket are its members against one pivot, not all pairs: the number of rows grows with the members. Pairs
that the sketches rule out by a wide margin go, the others are compared as full sets. What is then left open are pairs of
one bucket of which at least one is not similar to the pivot's component. They are looked for among the *differences* from
a common reference, see `open_candidates`, which loses none of them and does not compare all pairs either. At 5 rows and 40
bands a pair at similarity 0.8 shares no bucket once in 10 million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .prefilter import map_wanted
from .text import mix, shingle_hashes, word_hashes
from .workspace import materialize

#: Bits of an odd sketch, ranges of the MinHash sample in it, and standard errors that rule a pair out.
SKETCH_BITS, SAMPLE, SIGMAS = 2048, 2048, 5.0


def minhash(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each multiply-permutation of the 64-bit integers."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(out, (multipliers[:, None] * values[None, at : at + 2048]).min(axis=1), out=out)
    return out


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def one_permutation(values: np.ndarray) -> np.ndarray:
    """A MinHash sample by one permutation: the smallest of the ascending `values` in each of SAMPLE equal ranges."""
    ranges = values >> np.uint64(64 - SAMPLE.bit_length() + 1)
    return values[np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))]


def odd_sketch(sample: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of a sample's values over `bits` positions, as bits // 64 signed words."""
    parity = (np.bincount((mix(sample) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketched_common(differing: Column, samples: Column) -> Column:
    """Values that two samples share, from the differing bits of their sketches and the sum of the samples' sizes.

    z parities of n that differ stand for -n/2 ln(1 - 2 z / n) values that only one of the samples has.
    """
    odd = -SKETCH_BITS / 2 * F.log(F.greatest(1 - 2 * differing / F.lit(float(SKETCH_BITS)), F.lit(1e-9)))
    return (samples - odd) / 2


def expected_common(similarity: float, sizes: Column, samples: Column) -> tuple[Column, Column]:
    """Mean and standard error of `sketched_common` for two sets of a similarity, from the sums of their sizes and of their
    samples' sizes: of the ranges that either set occupies, the two agree in as large a share as they are similar."""
    union = sizes / (1 + similarity)
    ranges = SAMPLE * (1 - F.exp(-union / SAMPLE))
    mean = similarity * ranges
    sampling = ranges * similarity * (1 - similarity) * F.greatest(1 - ranges / union, F.lit(0.0))
    parities = 1.3 * math.sqrt(2 / SKETCH_BITS) * F.greatest(samples / 2 - mean, F.lit(0.0))
    return mean, F.sqrt(sampling + parities * parities + 0.25)


def signatures(docs: DataFrame, id_col: str, text_col: str, ngram: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of every row; set_key is null for a text without words."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        factors = multipliers(bands * rows)
        salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, keys, band_keys, samples, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                values = np.unique(shingle_hashes(word_hashes(text), ngram))
                sizes.append(len(values))
                if not len(values):
                    keys.append(None), band_keys.append(None), samples.append(0), sketches.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                key, by_band = salts.copy(), minhash(values, factors).reshape(bands, rows)
                for i in range(rows):
                    key = mix(key * np.uint64(31) + by_band[:, i])
                band_keys.append(key.view(np.int64))
                sample = one_permutation(values)
                samples.append(len(sample))
                sketches.append(odd_sketch(sample))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(samples, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands", "n_samples", "sketch"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, bands array<bigint>, n_samples bigint, sketch array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, set_id, shingles array<bigint>) of the rows of (doc_id, text) with words whose doc_id is in `wanted`, and of a
    few more. set_id tells the sets of one doc_id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t), ngram)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    sets = map_wanted(docs.select("doc_id", "text"), wanted, "doc_id", run, f"doc_id {kind}, shingles array<bigint>")
    return sets.where(F.size("shingles") > 0).select("doc_id", F.xxhash64("shingles").alias("set_id"), "shingles")


def differing_bits(a: str, b: str, words: int = SKETCH_BITS // 64) -> Column:
    """Population count of the XOR of two sketch columns."""
    total = F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))
    for i in range(1, words):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _plausible(percent: int) -> Column:
    """Sizes that allow the similarity, and sketches whose estimate is not below what it gives by SIGMAS standard errors."""
    samples = F.col("m_a") + F.col("m_b")
    mean, error = expected_common(percent / 100, F.col("n_a") + F.col("n_b"), samples)
    common = sketched_common(differing_bits("sk_a", "sk_b"), samples)
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (common >= mean - SIGMAS * error)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    side = lambda c, s: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(s))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return shared.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(g, h, a, m, c, n, r, d, slack, open) of members (g, a, c): the elements `d` that only one of a and g has, the sizes n
    and r of their sets (which have the ids m and h), and whether the two are not similar.

    For sets a and b with x and y elements in their differences from g, |a ^ b| = x + y - 2 o, where o is the number of
    elements in both differences; they are similar if |a ^ b| <= k (|a| + |b|) with k = (100 - percent) / (100 + percent).
    So 2 (100 + percent) o must be at least slack(a) + slack(b), slack(a) = (100 + percent) x - (100 - percent) |a|.
    """
    side = lambda c, i, s: sets.select(F.col("doc_id").alias(c), F.col("set_id").alias(i), F.col("shingles").alias(s))
    both = members.where("a <> g").join(side("a", "m", "x"), "a").join(side("g", "h", "y"), "g")
    sized = both.select("g", "h", "a", "m", "c", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("r"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    slack = (100 + percent) * F.size("d") - (100 - percent) * F.col("n")
    return sized.withColumn("slack", slack.cast("long")).withColumn("open", F.col("slack") > (100 - percent) * F.col("r"))


def open_candidates(moved: DataFrame, percent: int) -> DataFrame:
    """(a, b), once each and a < b: all pairs of one g in `differences` that may be similar, but for those of one component.

    Two that are both similar to g are of its component. Of any other pair one is open, so its slacks sum to more than 0 and
    it must share an element of its differences. Elements that only one component has are left out, the others of each
    member are put in one order, rare ones first. If the first shared one is at place i of p in a's list, then
    o <= p - i, so that slack(b) <= 2 (100 + percent) (p - i) - slack(a) =: reach(a, i), and the same the other way round.
    Random edits of one text share few of their differences, and hardly any pair of them meets these bounds. Rows meet by g,
    element and the classes of both slacks, so that most pairs that fail the bounds do not meet at all.
    """
    own = F.when(F.col("open"), F.col("c")).otherwise(F.col("g"))
    group, member = ["g", "h"], ["g", "h", "a", "m"]
    elements = moved.select(*member, own.alias("c"), F.explode("d").alias("e"))
    shared = elements.groupBy(*group, "e").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*group, "e", "f")
    lists = elements.join(shared, [*group, "e"]).groupBy(*member).agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("l"))
    # The smallest slack that a partner can have: similar sets have similar sizes; that of one similar to g is open.
    least = F.when(F.col("open"), F.floor(-(100 - percent) * F.col("n") * 100 / percent)).otherwise((100 - percent) * F.col("r") + 1)
    wide = F.greatest(F.floor((100 + percent) * F.col("r") / 6), F.lit(1))
    facts = moved.select(*member, own.alias("c"), "open", "slack", least.cast("long").alias("least"), wide.cast("long").alias("wide"))
    reach = 2 * (100 + percent) * (F.size("l") - F.col("i")) - F.col("slack")
    rows = lists.join(facts, member).select("*", F.posexplode(F.transform("l", lambda x: x.e)).alias("i", "e")).withColumn("reach", reach.cast("long")).where("reach >= least")
    class_of = lambda x: F.floor(F.col(x) / F.col("wide")).cast("long")
    others = F.explode(F.sequence(class_of("least"), class_of("reach")))
    rows = materialize(rows.select(*group, "e", "a", "c", "open", "slack", "reach", class_of("slack").alias("own"), others.alias("other")), "differing")
    facts_of = lambda x: [F.col(n).alias(f"{n}_{x}") for n in ("a", "c", "slack", "reach")]
    left = rows.where("open").select(*group, "e", "own", "other", *facts_of("a"))
    right = rows.select(*group, "e", F.col("own").alias("other"), F.col("other").alias("own"), "open", *facts_of("b"))
    fits = F.expr("c_a <> c_b and (not open or a_a < a_b) and slack_b <= reach_a and slack_a <= reach_b")
    pairs = left.join(right, [*group, "e", "own", "other"]).where(fits)
    return pairs.select(F.least("a_a", "a_b").alias("a"), F.greatest("a_a", "a_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links_class) for every row of `docs`.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id reachable over links. Texts that are null, empty or without words have n_shingles 0 and are linked with
    nothing. Texts of fewer than `ngram` words are one shingle, the whole sequence. Repeated rows are copies; a doc_id that
    several rows carry stands for one document, with the links of all of them. Rows without an id stay, with a null
    component_id and kept true. Other columns of `docs` are not looked at. An empty table gives no rows.
    """
    signed = materialize(signatures(docs, id_col, text_col, ngram, bands, rows), "signatures")
    n = signed.count()
    sketched = F.struct("bands", "n_samples", "sketch")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first(sketched).alias("s"))
    classes = materialize(classes.select("node", "set_key", "n", F.col("s.n_samples").alias("m"), "s.bands", "s.sketch").coalesce(1 + n // 20_000), "classes")
    side = lambda x: classes.select(*[F.col(c).alias(f"{d}{x}") for c, d in (("node", ""), ("n", "n_"), ("m", "m_"), ("sketch", "sk_"))])

    members = classes.select("node", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    crowd = members.join(crowded, "key").where("node <> pivot").groupBy("pivot", "node").agg(F.max("size").alias("size"))
    crowd = materialize(crowd.coalesce(1 + n // 50_000), "buckets")
    n_crowd = crowd.count()
    # An id that rows with several sets carry links their classes.
    texts = signed.where("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = texts.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = materialize(texts.join(several, "doc_id").join(classes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "same_id", 1)
    n_same = same_id.count()
    if n_crowd or n_same:
        wanted = crowd.select(F.explode(F.array("pivot", "node")).alias("doc_id"))
        text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        sets = materialize(shingle_sets(text, wanted, ngram), "sets")
        stars = crowd.select(F.col("node").alias("a"), F.col("pivot").alias("b")).join(side("a"), "a").join(side("b"), "b").where(_plausible(percent)).select("a", "b")
        links = materialize(confirmed(stars, sets, percent).unionByName(same_id).distinct(), "links", n_crowd + n_same)
        n_links = links.count()
        labels = materialize(components(links, n_links), "labels", 2 * n_links)

        label_of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        owned = crowd.where("size > 2").join(label_of("node"), "node", "left").join(label_of("pivot"), "pivot", "left")
        owned = owned.select(F.coalesce("c_pivot", "pivot").alias("g"), F.col("node").alias("a"), F.coalesce("c_node", "node").alias("c"), "pivot")
        owned = materialize(owned.select("g", F.explode(F.array(F.struct("a", "c"), F.struct(F.col("pivot").alias("a"), F.col("g").alias("c")))).alias("m")).select("g", "m.a", "m.c").distinct(), "owned", 2 * n_crowd)
        mixed = owned.where("a <> g").groupBy("g").agg(F.max((F.col("c") != F.col("g")).cast("int")).alias("open"), F.count("*").alias("n")).where("open = 1 and n > 1").select("g")
        moved = materialize(differences(owned.join(mixed, "g"), sets, percent), "differences")
        late = moved.where("c <> g and not open").select("a", F.col("g").alias("b"))
        late = late.unionByName(confirmed(materialize(open_candidates(moved, percent), "open"), sets, percent))
        late = materialize(late.distinct(), "late_links", n_crowd)
        n_late = late.count()
        if n_late:
            labels = materialize(components(links.unionByName(late), n_links + n_late), "labels", 2 * (n_links + n_late))
        named = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"), F.col("node").alias("links_class"))
    else:
        named = classes.select("set_key", F.col("node").alias("component_id"), F.col("node").alias("links_class"))

    per_row = signed.select("doc_id", "n_shingles", "set_key")
    joined = per_row.where("set_key is not null and doc_id is not null").join(named, "set_key").select("doc_id", "n_shingles", "component_id", "links_class")
    alone = per_row.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("links_class"))
    out = joined.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "links_class")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles of whole documents at similarity 0.8; exact links on full sets; odd rows as in `near_duplicates`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, ngram=2, percent=80)


#: The same in DuckDB: shared shingles of all pairs of different sets, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), components AS (
  SELECT a AS c, min(b) AS component FROM reached GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(k.component, d.doc_id) AS kept, coalesce(c.c, d.doc_id) AS links_class
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN components k ON k.c = c.c
"""
