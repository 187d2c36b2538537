"""Each stage of the pipeline on its own input against a plain version of it, and odd tables through all of them."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from suffixloom.llm import merkle, mixing, near_dedup, packing, quality, secrets, substring_dedup, token_rollup, toxicity
from suffixloom.llm.tokens import public_path

from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows in, rows out) of every stage, written and read between stages."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_names_and_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "secrets", "mixture", "packing"]
    assert all(s[3] == columns for s in stages[:-1])


def test_quality(spark, stages):
    _, before, after, _ = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    score = model.scores(np.array([quality.statistics(r["text"]) for r in before]))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, score, strict=True) if s >= 0.3}
    kept, marks = {r["doc_id"] for r in after}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [r["doc_id"] for r in before if marks.get(r["doc_id"]) == 1]
    assert len(set(good) - kept) <= 0.03 * len(good)


def test_near_duplicates(stages):
    _, before, after, _ = stages[1]
    nodes = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in nodes if i == c)


def test_secrets(stages):
    _, before, after, _ = stages[2]
    mask = lambda t: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t)
    got = {r["doc_id"]: r for r in after}
    assert {i: r["text"] for i, r in got.items()} == {r["doc_id"]: mask(r["text"]) for r in before}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixture(stages):
    _, before, after, _ = stages[3]
    assert sorted(map(tuple, after)) == sorted(map(tuple, before))


def test_packing(stages):
    _, before, after, _ = stages[4]
    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = {r["doc_id"]: plain.encode(r["text"], add_special_tokens=False).ids + [1] for r in before}
    assert sum(r["length"] for r in after) == sum(map(len, ids.values())) and {r["doc_id"] for r in after} == set(ids)
    for r in after:
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
    filled = {}
    for r in after:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 2048


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, got)) == sorted(map(key, stages[-1][2]))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "word " * 60_000, "en", None, 300_000), (3, None, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data, extra in ((rows, True), ([], False)):
        docs = spark.createDataFrame(data, schema)
        if extra:
            docs = docs.selectExpr("*", "1 AS score", "'x' AS n_shingles", "2 AS start", "'y' AS __matches")
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{extra}")
            (out := stage(spark, docs, SF)).write.parquet(path)
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.read.parquet(path)
        assert (spark.read.parquet(path).count() > 0) == bool(data and docs.count())


HELPERS = """row statistics evidence score draw range number block blocks slot turn round source_ of_source of_range shift local n
    __slot_ __place_ __block_ __matches __gaps __found __scores __cut __around __statistics __leaves leaves matches gaps found
    scores kept other_id first a b c x y m g h i l e f d tid key worker class start length ids order_0 set_key node prints at""".split()


def test_columns_of_any_name_keep_their_values(spark, tmp_path):
    """Columns named like the helpers of the operators and stages come out with the values that they went in with."""
    rows = [(i, f'words {i} and token = "{"%040x" % (i * 7919 + 2**150)}" in a text that is long enough to be kept', "en", f"s{i % 3}", 9, *[f"{h}-{i}" for h in HELPERS]) for i in range(60)]
    fields = ", ".join(f"`{h}` string" for h in [*HELPERS])
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {fields}")
    docs = docs.withColumnsRenamed({"__slot_": "__slot", "__place_": "__place", "__block_": "__block"})
    names = docs.columns[5:]
    given = {r["doc_id"]: [r[c] for c in names] for r in docs.collect()}
    scored = {
        "quality": quality.score_quality(docs, quality.RuleModel(0.0, []), score_col="made"),
        "toxicity": toxicity.score_toxicity(docs, toxicity.ToxicityModel(spark.sparkContext.broadcast(np.zeros(32**4, dtype=np.float32)), [1, 1, 1, 0]), score_col="made"),
        "merkle": merkle.with_fingerprint(docs, out_col="made"),
        "secrets": secrets.redact_secrets(docs),
        "mixing": mixing.mix_sources(docs.drop("__slot", "__place", "__block")),
    }
    for name, frame in scored.items():
        there = [c for c in names if name != "mixing" or not c.startswith("__")]
        assert {r["doc_id"]: [r[c] for c in there] for r in frame.collect()} == {i: [v for c, v in zip(names, g, strict=True) if c in there] for i, g in given.items()}, name
    assert all("[SECRET]" in r["text"] for r in scored["secrets"].collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left = {r["doc_id"]: [r[c] for c in names] for r in out.collect()}
        assert left and all(given[i] == values for i, values in left.items()), name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 60
    by_id = (near_dedup.near_duplicates, substring_dedup.shared_passages, secrets.scan_secrets, lambda d: packing.pack(d, public_path("word_bpe_49k.json")), token_rollup.counted)
    for operator in by_id:
        operator(docs).collect()


def test_sequences_follow_the_mix(spark, tmp_path):
    """Shares of a small source in the first sequences are its weight's, whatever the order of the rows that are read."""
    rows = [(i, f"word{i} " * (20 + i * 7 % 60), "small" if i % 11 == 0 else "hot") for i in range(9900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    corpus_pipeline.mix_in_order(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")).orderBy("source", "doc_id"), SF).collect()
    last = max(r["sequence_id"] for r in got)
    assert {r["sequence_id"] for r in got} == set(range(last + 1)) and sum(r["length"] for r in got if r["start"] == 0) > 0
    weight = 900**0.5 / (900**0.5 + 9000**0.5)
    for part in (0.1, 0.15, 0.2, 0.25):
        first = [r for r in got if r["sequence_id"] < part * last]
        small = sum(r["length"] for r in first if r["doc_id"] % 11 == 0) / sum(r["length"] for r in first)
        assert abs(small - weight) < 0.06, (part, small, weight)
    offsets = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == offsets.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 2048
        offsets[r["sequence_id"]] = r["offset"] + r["length"]
