"""Operations of a training-data pipeline: deduplication, scanning, scoring, mixing and packing.

Nothing else in the library imports this subpackage. `registry` lists its queries.
"""
