"""Token counts that are maintained by deltas: additive totals by source, language and tokenizer version.

A batch holds signed rows: an insert adds a document and its tokens, a delete takes them away, a revision takes away the
old count and adds the new. A batch is summed by key (the few rows of a hot key meet only as partial sums), written to a
folder of its own, and committed by an entry in a log. Entries are numbered; an entry's file is put in place complete, in one
step that fails if the number is taken. So a batch counts once, whoever else writes the same id or another at the time, and
a writer that is lost leaves nothing but files that no entry names.

`compact` adds an entry with the ids and the sum of all before it, from which readers start. What it replaces stays until
the next one, for readers that are still on it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import fresh_path

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens")
_SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def spaced_words(text: Column) -> Column:
    """Tokens of version `words-1`: runs of characters other than space and \\t to \\r."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def words_and_marks(text: Column) -> Column:
    """Tokens of version `marks-2`: runs of letters and digits (ASCII, and all beyond), and every other character."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]")).cast("long")


#: Versions of the tokenizer: a function from a text column to a count column for each.
VERSIONS = {"words-1": spaced_words, "marks-2": words_and_marks}


def counted(docs: DataFrame, versions: Mapping = VERSIONS, text_col: str = "text") -> DataFrame:
    """(source, lang, tokenizer, documents, tokens): a row for each row of `docs` and version.

    Null and empty texts have 0 tokens; repeated rows count each; other columns are not looked at.
    """
    made = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col(f"`{text_col}`")).alias("tokens")) for name, count in versions.items()])
    rows = docs.select(F.col("source"), F.col("lang"), F.explode(made).alias("t"))
    return rows.select("source", "lang", "t.tokenizer", F.lit(1).cast("long").alias("documents"), "t.tokens")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """The rows as inserts (1) or deletes (-1)."""
    return rows.select(*KEYS, *[(F.col(s) * sign).alias(s) for s in SUMS])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace the counts of `old` by those of `new`."""
    return signed(old, -1).unionByName(signed(new, 1))


def rolled_up(deltas: DataFrame) -> DataFrame:
    """Sums by key; null sources and languages are keys of their own. Keys whose sums are all 0 go."""
    sums = deltas.groupBy(*KEYS).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS])
    return sums.where(reduce(lambda a, b: a | b, [F.col(s) != 0 for s in SUMS]))


class TokenRollup:
    """Totals at `path`, a directory that all executors can reach, on a file system that renames in one step (HDFS) or links
    files (a shared POSIX one).

    Null sources and languages are keys of their own; a batch without rows is committed and changes nothing; repeated rows
    count as often as they come. Without batches the totals have no rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("log", "data", "staged"):
            self._fs.mkdirs(self._path(f"{self.path}/{part}"))
        self._entries: dict[int, dict] = {}  # entries do not change

    def _log(self) -> tuple[int, list[dict]]:
        """The last entry's number (0 without any), and the entries from the last compacted one on."""
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/log"))]
        numbers, live = sorted((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), reverse=True), []
        for number in numbers:
            if number not in self._entries:
                stream = self._fs.open(self._path(f"{self.path}/log/{number:020d}.json"))
                try:
                    self._entries[number] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
            live.append(self._entries[number])
            if self._entries[number]["compacted"]:
                break
        return numbers[0] if numbers else 0, live[::-1]

    def _append(self, number: int, entry: dict) -> bool:
        """Put an entry in place; False if its number is taken."""
        staged, target = self._path(f"{self.path}/staged/{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{number:020d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # where a rename would replace the target
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(local(target), local(staged))
                except Py4JJavaError as e:
                    if "FileAlreadyExistsException" not in str(e.java_exception):
                        raise
                    return False
                return True
            return not self._fs.exists(target) and bool(self._fs.rename(staged, target))
        finally:
            self._fs.delete(staged, False)

    def _write(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.coalesce(1).write.parquet(f"{self.path}/data/{name}")
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)

    def _sum(self, entries: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{e['data']}" for e in entries]
        return rolled_up(self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA))

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(b for e in self._log()[1] for b in e["batches"])

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Commit a batch of signed rows; False, and no change, if a batch of this id is already there."""
        if not batch:
            raise ValueError("a batch needs an id")
        number, entries = self._log()
        if any(batch in e["batches"] for e in entries):
            return False
        data = self._write(rolled_up(deltas))
        while not self._append(number + 1, {"batches": [batch], "data": data, "compacted": False}):
            number, entries = self._log()
            if any(batch in e["batches"] for e in entries):
                self._drop([data])
                return False
        return True

    def totals(self) -> DataFrame:
        """Sums over the committed batches: source, lang, tokenizer, documents, tokens."""
        return self._sum(self._log()[1])

    def compact(self) -> bool:
        """Fold the committed batches into one entry; False if there are none to fold, or others committed meanwhile."""
        number, entries = self._log()
        if len(entries) < 2:
            return False
        data = self._write(self._sum(entries))
        entry = {"batches": sorted(b for e in entries for b in e["batches"]), "data": data, "compacted": True, "replaced": [e["data"] for e in entries]}
        if not self._append(number + 1, entry):
            self._drop([data])
            return False
        self._drop([name for e in entries for name in e.get("replaced", [])])
        for f in self._fs.listStatus(self._path(f"{self.path}/log")):
            if f.getPath().getName() < f"{number + 1 - len(entries):020d}":
                self._fs.delete(f.getPath(), False)
        return True


def op8_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents after three batches, each of them sent twice, with a compaction in between.

    All documents are inserted with the counts of the first version; each of the language `en` is then revised to the
    second; those of the source `src1` with the first version's counts are deleted. Batches that come again change nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    of = lambda version, rows: counted(rows, {version: VERSIONS[version]})
    english, dropped = docs.where("lang = 'en'"), docs.where("source = 'src1' and (lang is null or lang <> 'en')")
    table = TokenRollup(spark, fresh_path(spark, "token_rollup"))
    batches = {
        "0001-insert": signed(of("words-1", docs), 1),
        "0002-revise-en": revised(of("words-1", english), of("marks-2", english)),
        "0003-delete-src1": signed(of("words-1", dropped), -1),
    }
    for batch, deltas in batches.items():
        table.apply(batch, deltas)
    table.compact()
    for batch, deltas in batches.items():
        table.apply(batch, deltas)
    return table.totals()


ORACLE = r"""
WITH d AS (
  SELECT source, lang,
         CASE WHEN lang = 'en' THEN 'marks-2' ELSE 'words-1' END AS tokenizer,
         CASE WHEN lang = 'en'
              THEN len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]'))
              ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS n
  FROM documents
  WHERE NOT (source IS NOT DISTINCT FROM 'src1' AND lang IS DISTINCT FROM 'en')
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM d GROUP BY source, lang, tokenizer
"""
