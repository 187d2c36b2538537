import duckdb
import pytest

from suffixloom.llm import token_rollup as tr
from suffixloom.llm.workspace import fresh_path

DOCS = [(1, "a b  c!", "en", "s"), (2, None, None, "s"), (3, "", "en", None), (4, "é漢 x-y\n", "fr", "s"), (4, "é漢 x-y\n", "fr", "s")]


def docs_of(spark, rows=DOCS):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, tokens int")


def totals(df):
    return sorted((tuple(r) for r in df.select("source", "lang", "tokenizer", "documents", "tokens").collect()), key=repr)


def test_counts(spark):
    got = {(r["tokenizer"], r["lang"], r["source"]): (r["documents"], r["tokens"]) for r in tr.rolled_up(tr.counted(docs_of(spark))).collect()}
    assert got == {
        ("words-1", "en", "s"): (1, 3), ("marks-2", "en", "s"): (1, 4), ("words-1", None, "s"): (1, 0), ("marks-2", None, "s"): (1, 0),
        ("words-1", "en", None): (1, 0), ("marks-2", "en", None): (1, 0), ("words-1", "fr", "s"): (2, 4), ("marks-2", "fr", "s"): (2, 8),
    }


def test_batches_are_signed_and_idempotent(spark):
    rows = tr.counted(docs_of(spark), {"words-1": tr.spaced_words})
    table = tr.TokenRollup(spark, fresh_path(spark, "rollup"))
    assert totals(table.totals()) == []
    assert table.apply("b1", tr.signed(rows, 1)) and not table.apply("b1", tr.signed(rows, 1))
    first = totals(table.totals())
    assert first == totals(tr.rolled_up(rows))
    assert table.apply("b2", tr.signed(rows.where("lang = 'en'"), -1))
    assert totals(table.totals()) == totals(tr.rolled_up(rows.where("lang is null or lang <> 'en'")))
    new = tr.counted(docs_of(spark), {"marks-2": tr.words_and_marks}).where("lang = 'fr'")
    assert table.apply("b3", tr.revised(rows.where("lang = 'fr'"), new))
    expected = totals(tr.rolled_up(rows.where("lang is null").unionByName(new)))
    assert totals(table.totals()) == expected
    assert table.compact()
    assert totals(table.totals()) == expected and table.batches() == ["b1", "b2", "b3"] and len(table._log()[1]) == 1
    assert not table.apply("b2", tr.signed(rows, 1)) and totals(table.totals()) == expected
    assert table.apply("b4", tr.signed(new, -1)) and totals(table.totals()) == totals(tr.rolled_up(rows.where("lang is null")))


def test_another_handle_sees_the_commits(spark):
    path = fresh_path(spark, "rollup")
    rows = tr.counted(docs_of(spark))
    assert tr.TokenRollup(spark, path).apply("x", rows)
    assert not tr.TokenRollup(spark, path).apply("x", rows)
    assert tr.TokenRollup(spark, path).batches() == ["x"]
    assert tr.TokenRollup(spark, path).apply("empty", rows.limit(0))


def test_two_writers(spark, monkeypatch):
    """Another writer commits between a writer's look at the log and its own entry: the same id, and another one."""
    path = fresh_path(spark, "rollup")
    rows = tr.counted(docs_of(spark), {"words-1": tr.spaced_words})
    one, other, write = tr.TokenRollup(spark, path), tr.TokenRollup(spark, path), tr.TokenRollup._write
    meanwhile = iter(["same", "different"])

    def slow(self, sums):
        data = write(self, sums)
        if self is one:
            assert other.apply(next(meanwhile), rows)
        return data

    monkeypatch.setattr(tr.TokenRollup, "_write", slow)
    assert not one.apply("same", rows)
    assert one.apply("mine", rows)
    assert tr.TokenRollup(spark, path).batches() == ["different", "mine", "same"] == one.batches()
    assert sum(r["documents"] for r in one.totals().collect()) == 3 * len(DOCS)
    meanwhile = iter(["during"])
    assert not one.compact() and one.batches() == ["different", "during", "mine", "same"]


def test_a_writer_that_is_lost(spark, monkeypatch):
    """Whatever step a commit or a compaction stops at, totals are those before or after it, and it can be done again."""
    table = tr.TokenRollup(spark, fresh_path(spark, "rollup"))
    rows = tr.counted(docs_of(spark), {"words-1": tr.spaced_words})
    for k in range(12):
        assert table.apply(f"{k:02d}" * 100, rows)
    expected = totals(table.totals())
    assert expected == totals(tr.rolled_up(rows).selectExpr("source", "lang", "tokenizer", "documents * 12 as documents", "tokens * 12 as tokens"))

    def lost(*args):
        raise KeyboardInterrupt

    for step in ("_write", "_append", "_drop"):
        with monkeypatch.context() as m:
            m.setattr(tr.TokenRollup, step, lost)
            with pytest.raises(KeyboardInterrupt):
                table.compact()
            assert totals(tr.TokenRollup(spark, table.path).totals()) == expected
            if step != "_drop":
                with pytest.raises(KeyboardInterrupt):
                    table.apply("new", rows)
                assert totals(table.totals()) == expected and len(table.batches()) == 12
    assert len(table._log()[1]) == 1  # the last one was in place before it stopped
    assert table.apply("new", rows) and not table.apply("new", rows) and table.compact()
    assert len(tr.TokenRollup(spark, table.path).batches()) == 13 and not table.compact()


def test_many_batches(spark):
    table = tr.TokenRollup(spark, fresh_path(spark, "rollup"))
    data = table._write(tr.rolled_up(tr.counted(docs_of(spark))))
    for k in range(1000):
        assert table._append(k + 1, {"batches": [f"a batch with a long name, {k}"], "data": data, "compacted": False})
    assert not table._append(7, {"batches": ["late"], "data": data, "compacted": False})
    assert sum(r["documents"] for r in table.totals().collect()) == 2000 * len(DOCS)
    assert table.compact() and len(table.batches()) == 1000
    assert sum(r["documents"] for r in tr.TokenRollup(spark, table.path).totals().collect()) == 2000 * len(DOCS)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(f"SELECT source, lang, tokenizer, documents, tokens FROM ({tr.ORACLE})").fetchall()
    assert totals(tr.op8_token_rollup(spark, sf)) == sorted(expected, key=repr)
