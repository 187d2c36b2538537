"""Intermediate tables in the folder that the cluster shares.

`materialize` cuts lineage by writing Parquet below `spark.checkpoint.dir` and reading it again, so that a lost executor
costs a re-read and not a recomputation. The setting is read from the session; a folder of our own is made only where the
session has none (tests, local runs).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import arrow_batches, shared_folder, shuffles_dropped  # noqa: F401

_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/suffixloom/{uuid.uuid4().hex}/{name}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000, batch: int = 512) -> DataFrame:
    """Write `df` to the shared folder and return a reader of what was written.

    Arrow batches have `batch` rows at most meanwhile: whole texts, and what is made of them, must fit beside the heap.
    Where a bound of its `rows` is known, narrow rows are dealt anew to files of `per_file`, instead of a file for each
    task before: shared file systems bear few files better than many.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.repartition(max(1, -(-rows // per_file)))
    with arrow_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` has written, once all that is made of them has been written too."""
    for table in tables:
        files = table.inputFiles()
        for path in [p for p in _made if files and p.split("/")[-2] in files[0]]:
            at = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def release(spark: SparkSession) -> int:
    """Delete every table that `materialize` has written in this process; frames that still read them break."""
    jvm, n = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, **used: str) -> DataFrame:
    """The columns of `docs` that are used, by names of our own, and the others in one struct `row`, where their names cannot
    meet those of helper columns."""
    others = [column(c) for c in docs.columns if c not in used.values()]
    return docs.select(F.struct(F.lit(0).alias(""), *others).alias("row"), *[column(c).alias(name) for name, c in used.items()])


def restored(docs: DataFrame, but: tuple[str, ...] = (), **used: str) -> list[Column]:
    """The columns of `docs`, except `but`, from a frame that was made by `carried`."""
    by_column = {c: name for name, c in used.items()}
    return [(F.col(by_column[c]) if c in by_column else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in but]


def unused(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
