"""Tables that cut lineage: written below the cluster's shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only where none is set and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="suffixloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 10_000, most_bytes: int = 32 << 20):
    """Arrow batches of so many rows and bytes at most while something is run; then the session's own settings hold again."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(most_bytes)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as the query that made them ends, instead of when the driver collects its garbage: tables that
    have been written are read from the shared folder. Then the session's own setting holds again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str, rows: int = 10_000) -> DataFrame:
    """`df`, computed once and kept as Parquet in the shared folder; the shuffles that made it are dropped."""
    path = f"{shared_folder(df.sparkSession)}/suffixloom/{uuid.uuid4().hex}/{name}"
    _made.append(path)
    with arrow_batches(df.sparkSession, rows), shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` has written, once all that is made of them has been written too."""
    for table in tables:
        files = table.inputFiles()
        for path in [p for p in _made if files and p.split("/")[-2] in files[0]]:
            at = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def release(spark: SparkSession) -> int:
    """Delete every table that `stored` has written in this process; frames that still read them break."""
    n = 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
