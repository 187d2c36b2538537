"""Media columns: chroma fingerprints of recordings, and their alignment by offset histograms and bit errors.

A recording is a sequence of samples. Its spectrum is folded into twelve pitch classes, a frame each; filters of the integral
image over a window of frames compare sums of rectangles, and each gives two bits (a Gray code of three thresholds), which
are packed into one integer per position. Recordings that hold the same integer at positions a fixed offset apart
vote for that offset. Two different integers at one offset, whose windows share no frame, are a landmark: a key of both
integers and their distance. Landmarks are rare where single integers are not, so that recordings are joined by them, and
unrelated ones hardly meet. At each offset for which a pair has a landmark the share of differing bits over the overlap
decides.

Equal fingerprints are one recording for the search (copies get its matches), so that a recording's copies do not
multiply. A filter of the queries' landmarks goes to the recordings, of which only landmarks that pass are shuffled.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .prefilter import MOST_KEYS, bits_for, bloom_words, may_hold
from .text import mix
from .workspace import materialize

CLASSES, WIDTH = 12, 12
#: Filters (kind, first class, classes, frames) over a window of frames; see `responses`.
FILTERS = tuple((k % 6, (5 * k) % CLASSES, 2 + 2 * (k % 3), (4, 6, 8, 12)[k % 4]) for k in range(16))
THRESHOLDS = (-0.04, 0.0, 0.04)
#: Distances of a landmark's integers: windows of WIDTH frames that share none, and what bounds the landmarks of a position.
NEAR, FAR = WIDTH, 44
#: Queries whose landmarks are in one list, which bounds a row.
TOGETHER = 256
#: What aligns: positions of overlap, and the share of differing bits. The bits of unrelated
#: recordings agree more often than not: among played vectors of the test tables, 859 pairs of 90,000 unrelated ones come
#: below 0.25 at some offset, 53 below 0.2 and none below 0.15; copies with noise lie from 0.05 to 0.11.
LEAST_OVERLAP, MOST_ERROR = 32, 0.15


@cache
def pitch_classes(frame: int, rate: int) -> np.ndarray:
    """Which of the spectrum's bins are of which pitch class, as zeros and ones; bins at the edges are of none."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    used = np.flatnonzero((hz >= 55) & (hz <= rate / 2 * 0.9))
    out = np.zeros((len(hz), CLASSES))
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray, rate: int, frame: int = 1024, hop: int = 256) -> np.ndarray:
    """Frames of 12 pitch-class energies, each of norm 1 (0 for silence); the last frame is padded with zeros."""
    x = np.nan_to_num(np.asarray(samples, dtype=np.float64), posinf=0.0, neginf=0.0)
    if not len(x):
        return np.zeros((0, CLASSES))
    n = 1 + max(0, -(-(len(x) - frame) // hop))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * hop + frame - len(x)))])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop][:n] * np.hanning(frame)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    out = power @ pitch_classes(frame, rate)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def responses(frames: np.ndarray) -> np.ndarray:
    """Filter responses [positions, filters]: differences of rectangle means, from the integral image."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros((0, len(FILTERS)))
    image = np.zeros((len(frames) + 1, 2 * CLASSES + 1))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), axis=0), axis=1)  # classes wrap around
    at = np.arange(n)

    def mean(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return (image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]) / ((t1 - t0) * (c1 - c0))

    out = np.empty((n, len(FILTERS)))
    for k, (kind, c, high, wide) in enumerate(FILTERS):
        t, m, h = wide // 2, c + high // 2, c + high
        if kind == 0:  # this rectangle against all classes
            out[:, k] = mean(0, wide, c, h) - mean(0, wide, 0, CLASSES)
        elif kind == 1:  # lower against upper classes
            out[:, k] = mean(0, wide, c, m) - mean(0, wide, m, h)
        elif kind == 2:  # earlier against later frames
            out[:, k] = mean(0, t, c, h) - mean(t, wide, c, h)
        elif kind == 3:  # chequered
            out[:, k] = (mean(0, t, c, m) + mean(t, wide, m, h) - mean(0, t, m, h) - mean(t, wide, c, m)) / 2
        elif kind == 4:  # middle frames against the outer ones
            q = wide // 4
            out[:, k] = mean(q, wide - q, c, h) - (mean(0, q, c, h) + mean(wide - q, wide, c, h)) / 2
        else:  # middle classes against their neighbours
            out[:, k] = mean(0, wide, c + high // 2, c + high // 2 + 1) - mean(0, wide, c, h)
    return out


def fingerprint(samples: np.ndarray | None, rate: int) -> np.ndarray:
    """One unsigned 32-bit integer for each position; none for recordings shorter than a window."""
    if samples is None:
        return np.zeros(0, dtype=np.uint32)
    r = responses(chroma(samples, rate))
    level = (r[:, :, None] > np.array(THRESHOLDS)).sum(axis=2).astype(np.uint32)
    gray = level ^ (level >> np.uint32(1))
    return (gray << (2 * np.arange(len(FILTERS), dtype=np.uint32))).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def fingerprints(recordings: DataFrame, id_col: str, samples, rate: int) -> DataFrame:
    """(rec_id, prints array<bigint>, print_key) of frames with an id and a column of samples.

    Null and empty samples, and those shorter than a window, have no prints and a null key; samples that are no numbers count
    as 0. Equal samples have equal prints. Rows without an id stay; other columns are not looked at.
    `samples` names an array column, or is a function from an array column's value to samples together with its name.
    """
    name, render = samples if isinstance(samples, tuple) else (samples, lambda x: x)
    source = recordings.select(F.col(id_col).alias("rec_id"), F.col(name).alias("samples"))
    kind = source.schema["rec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                value = batch.column(1)[k]
                values = value.values.to_numpy(zero_copy_only=False) if value.is_valid else None
                made.append(fingerprint(render(values) if values is not None else None, rate))
            keys = [xxhash.xxh3_128_digest(p.tobytes()) if len(p) else None for p in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int64) for p in made], pa.list_(pa.int64())), pa.array(keys, pa.binary())], names=["rec_id", "prints", "print_key"])

    return source.mapInArrow(run, f"rec_id {kind}, prints array<bigint>, print_key binary")


@cache
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second place of all landmarks of n positions."""
    first = [np.arange(max(0, n - d)) for d in range(NEAR, FAR + 1)]
    return np.concatenate(first), np.concatenate([at + d for at, d in zip(first, range(NEAR, FAR + 1), strict=True)])


def landmarks(prints: np.ndarray, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Keys and first places of the landmarks of one recording, of which long ones are taken in overlapping parts."""
    keys, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low in range(0, max(1, len(prints) - NEAR), at_once):
        part = prints[low : low + at_once + FAR].astype(np.uint64)
        first, second = _pairs(len(part)) if len(part) <= 512 else _pairs.__wrapped__(len(part))
        keep = (part[first] != part[second]) & (first < at_once)
        first, second = first[keep], second[keep]
        keys.append(mix((part[first] << np.uint64(32) | part[second]) ^ mix((second - first).astype(np.uint64))).view(np.int64))
        places.append(first + low)
    return np.concatenate(keys), np.concatenate(places)


def landmark_rows(recordings: DataFrame, words=None) -> DataFrame:
    """(key, print_key, at) of (print_key, prints): landmarks, those that may be in a filter (`bloom_words`) if there is one."""

    def run(batches):
        for batch in batches:
            keys, owner, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for k in range(batch.num_rows):
                key, place = landmarks(batch.column(1)[k].values.to_numpy(zero_copy_only=False).astype(np.uint32))
                if words is not None:
                    keep = may_hold(words.value, key)
                    key, place = key[keep], place[keep]
                keys.append(key), at.append(place), owner.append(np.full(len(key), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(at))], names=["key", "print_key", "at"])

    return recordings.select("print_key", "prints").mapInArrow(run, "key bigint, print_key binary, at bigint")


def best_offset(x: np.ndarray, y: np.ndarray, offsets, least_overlap: int, most_error: float):
    """(offset, votes, overlap, error) at which the prints `y` differ least from `x`, of those that align; else None. Votes
    are the distinct integers that the two share there."""
    best = None
    for offset in offsets:
        a, b = max(offset, 0), max(-offset, 0)
        overlap = min(len(x) - a, len(y) - b)
        if overlap >= least_overlap:
            differing = x[a : a + overlap] ^ y[b : b + overlap]
            error = float(np.bitwise_count(differing).sum() / (32 * overlap))
            if error <= most_error and (best is None or (error, abs(offset), offset) < best[:3]):
                best = error, abs(offset), offset, len(np.unique(x[a : a + overlap][differing == 0])), overlap
    return best and (best[2], best[3], best[4], best[0])


def align(prints: DataFrame, queries: DataFrame, least_overlap: int = LEAST_OVERLAP, most_error: float = MOST_ERROR, together: int = TOGETHER, most_keys: int = MOST_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal recordings that hold part of a query, the queries' keys, and the recordings' keys:
    (query_key, print_key, offset, votes, overlap, error), (query_id, query_key), (rec_id, print_key).

    Both frames have (rec_id, prints, print_key). For each pair the offset with the fewest errors of those for which it has a
    landmark is given; `error` is the share of differing bits in the overlap, `votes` the distinct integers that both have
    there. Every landmark is used, however many recordings have it: those of the queries are lists by key, of `together` queries
    at most, so that a landmark of a recording meets a list and not each of a family's queries in a row of its own, and a
    recording's equal offsets are one before they are rows. Rows without an id or without prints (null, empty or short recordings) match nothing; a
    query matches itself at offset 0 if any of its landmarks is used. A recording of one value throughout, silence for one, has no landmarks and matches nothing but by its class.
    Repeated rows are one recording with its ids; empty frames give no rows.
    """
    keyed = prints.where("print_key is not null and rec_id is not null").select("rec_id", "prints", "print_key")
    classes = materialize(keyed.groupBy("print_key").agg(F.first("prints").alias("prints")), "recordings")
    asked = queries.where("print_key is not null and rec_id is not null").select(F.col("rec_id").alias("query_id"), F.col("print_key").alias("query_key"), "prints")
    wanted = materialize(asked.groupBy("query_key").agg(F.first("prints").alias("prints")), "queries")
    numbers = materialize(numbered(wanted.select(F.col("query_key").alias("print_key")), ["print_key"]), "numbers")
    marks = materialize(landmark_rows(wanted.withColumnRenamed("query_key", "print_key")), "landmarks", batch=256)
    keys = marks.select("key").distinct()
    n_keys = keys.count()
    spark, words = prints.sparkSession, None
    if n_keys <= most_keys:
        words = spark.sparkContext.broadcast(bloom_words(keys, "key", bits_for(n_keys), hashed=True))
    rows = materialize(landmark_rows(classes, words), "rows", batch=256)
    # A query's number above the place, or above the offset, in one integer.
    packed = lambda number, low: F.shiftleft(number, 32) + low + F.lit(1 << 31)
    in_list = F.floor(F.col("number") / together).alias("list")
    placed = marks.join(numbers, "print_key").select("key", in_list, packed(F.col("number"), F.col("at")).alias("place"))
    lists = placed.groupBy("key", "list").agg(F.collect_list("place").alias("places"))
    shifted = F.transform("places", lambda p: p + F.col("at") - 2 * (p.bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)))
    met = rows.join(lists, "key").groupBy("print_key", "list").agg(F.array_distinct(F.flatten(F.collect_list(shifted))).alias("met"))
    met = met.select("print_key", F.explode("met").alias("m"))
    offset = F.col("m").bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)
    offsets = met.groupBy(F.shiftright("m", 32).alias("number"), "print_key").agg(F.collect_list(offset).alias("offsets"))
    offsets = offsets.join(numbers.select("number", F.col("print_key").alias("query_key")), "number").select("query_key", "print_key", "offsets")
    offsets = materialize(offsets, "offsets", batch=256)
    both = offsets.join(classes.select("print_key", F.col("prints").alias("x")), "print_key").join(wanted.select("query_key", F.col("prints").alias("y")), "query_key")

    def verify(batches):
        for batch in batches:
            prints_of = lambda name: [v.values.to_numpy(zero_copy_only=False).astype(np.uint32) for v in batch.column(name)]  # noqa: B023, E731
            found = [best_offset(x, y, o.as_py(), least_overlap, most_error) for x, y, o in zip(prints_of("x"), prints_of("y"), batch.column("offsets"), strict=True)]
            at = [k for k, f in enumerate(found) if f]
            rows = [found[k] for k in at]
            sides = [batch.column(n).take(pa.array(at, pa.int64())) for n in ("query_key", "print_key")]
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*sides, *numbers, pa.array([round(r[3], 6) for r in rows], pa.float64())], names=["query_key", "print_key", "offset", "votes", "overlap", "error"])

    matches = both.mapInArrow(verify, "query_key binary, print_key binary, offset bigint, votes bigint, overlap bigint, error double")
    return matches, asked.select("query_id", "query_key"), keyed.select("rec_id", "print_key")


def notes_of(vector: np.ndarray, rate: int = 4000, seconds: float = 0.128) -> np.ndarray:
    """A recording that plays a vector: each value is a note of equal length, one of the twelve of an octave by its size
    relative to the vector's root mean square, from -3 to 3 of it."""
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64), posinf=0.0, neginf=0.0)
    scale = float(np.sqrt((v**2).mean())) if len(v) else 0.0
    pitch = np.round((np.clip(v / (3 * scale or 1.0), -1, 1) + 1) * 5.5)
    t = np.arange(int(rate * seconds)) / rate
    hz = 440.0 * 2 ** (pitch / 12)
    return np.sin(2 * np.pi * hz[:, None] * t[None, :]).reshape(-1)


def op7_chroma_alignment(spark, sf_dir: str) -> DataFrame:
    """Recordings that align with each recording whose id is divisible by 50.

    There is no table of sound: each vector of `embeddings` is played as 64 notes, and that is its recording.
    Recordings with equal fingerprints are a class, named by its smallest id. Rows of kind `match` hold a query (the
    smallest of those that are equal) and a class that aligns with it; rows of kind `member` name each recording's class.
    Odd rows as in `fingerprints` and `align`.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = materialize(fingerprints(vectors, "vec_id", ("embedding", notes_of), 4000), "prints", batch=256)
    matches, asked, keyed = align(prints, prints.where("rec_id % 50 = 0"))
    classes = keyed.groupBy("print_key").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_size"))
    queries = asked.groupBy("query_key").agg(F.min("query_id").alias("rec_id"))
    match = matches.join(queries, "query_key").join(classes, "print_key").select(F.lit("match").alias("kind"), "rec_id", "class_id", "class_size", "offset", "votes", "overlap", "error")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("offset", "bigint"), ("votes", "bigint"), ("overlap", "bigint"), ("error", "double"))]
    member = keyed.join(classes, "print_key").select(F.lit("member").alias("kind"), "rec_id", "class_id", "class_size", *none)
    return match.unionByName(member)
