import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from suffixloom.llm import tokens
from suffixloom.llm.packing import cut, op6_harmonic_packing, pack
from suffixloom.llm.tokens import ChunkEncoder, public_path

PATH = public_path("word_bpe_49k.json")
ODD = ["", None, "a\x1cb", "<|endoftext|> x", "It's DON'T we'll x.'s 'S 're", "É́cole ÉCOLE. İstanbul ΣΑΣ. ὈΔΥΣΣΕΎΣ", "a1b2 3.5 --- ... foo...bar (x) \"q\"", "日本語 テキスト。한글 각", "naïve ﬁ ſ ǅ", "@#$ a$$$ b### \n\n x\t", " \u0085 x", "x" * 5000]


def test_encoder_equals_the_tokenizer():
    plain, fast = Tokenizer.from_file(PATH), ChunkEncoder(PATH, limit=50)
    texts = ODD + ["The cat. the CAT, cat! (cat) caté"] * 3
    array = pa.array(["cut off", *texts, None])
    for text, got in zip(texts, fast.encode(array.slice(1, len(texts))), strict=True):
        assert got.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 40)
    plain, fast = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    texts = [" ".join(f"w{k}x" for k in range(i, i + i % 23)) for i in range(120)] + ODD
    assert [x.tolist() for x in fast.encode(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert fast.encode(pa.array([], pa.string())) == []


def test_encoder_on_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").combine_chunks()
    plain = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in ChunkEncoder(PATH).encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]


def test_cut():
    for capacity, smallest in ((2048, 128), (1000, 50), (16, 4), (8, 1)):
        for n in range(1, 3 * capacity + 2):
            pieces = cut(n, capacity, smallest)
            assert sum(size for size, _ in pieces) == n and all(0 < size <= capacity for size, _ in pieces)


def checked(rows, ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert zlib.crc32(np.array(ids[doc][at : at + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
            if "ids" in r.asDict():
                assert list(r["ids"]) == ids[doc][at : at + r["length"]]
            at += r["length"]
        assert at == len(ids[doc])
    assert set(by_doc) == set(ids) and sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(len(v) for v in ids.values()), len(by_sequence)


def token_ids(rows):
    plain = Tokenizer.from_file(PATH)
    return {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}


@pytest.mark.parametrize("capacity,smallest", [(64, 8), (2048, 128)])
def test_pieces(spark, capacity, smallest):
    rows = list(enumerate(ODD + [f"word{i} " * (i % 90) for i in range(300)]))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    got = pack(df, PATH, capacity=capacity, smallest=smallest, with_ids=True).collect()
    checked(got, token_ids(rows), capacity)


def test_repeated_unnamed_and_empty(spark):
    got = pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((r["length"], r["doc_tokens"]) for r in got) == [(1, 1), (2, 2), (2, 2)]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_has_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    got = op6_harmonic_packing(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    tokens, sequences = checked(got, token_ids(map(tuple, rows)), 2048)
    assert tokens / (2048 * sequences) > 0.85  # a thousand documents; the unfilled last sequences of the classes weigh less in more
