"""What can be kept up on a stream.

A transform is a global order that each new string moves, so building one is a batch. Symbol counts are additive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_symbol_counts(strings: DataFrame) -> DataFrame:
    """(sym, freq) of a stream (string_id, body) of byte strings, terminators as 0; for complete or update mode."""
    codes = F.transform(F.split(F.regexp_replace(F.hex("body"), "(..)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("long"))
    symbols = F.concat(F.filter(codes, lambda c: c.isNotNull()), F.array(F.lit(0).cast("long")))
    return strings.select(F.explode(symbols).alias("sym")).groupBy("sym").agg(F.count("*").alias("freq"))
