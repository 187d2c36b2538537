from collections import defaultdict

import numpy as np
import pytest

from suffixloom.llm import media

RATE = 4000


def melody(seed, n=64):
    return media.notes_of(np.random.default_rng(seed).normal(size=n), RATE)


def test_chroma_of_a_tone():
    frames = media.chroma(np.sin(2 * np.pi * 440 * np.arange(8000) / RATE), RATE)
    assert (frames.argmax(axis=1) == 0).all() and np.allclose((frames**2).sum(axis=1), 1)
    assert not media.chroma(np.zeros(3000), RATE).any()


def test_responses_against_direct_sums():
    frames = np.random.default_rng(0).random((20, 12))
    got = media.responses(frames)
    wide = np.hstack([frames, frames])
    for k, (kind, c, high, width) in enumerate(media.FILTERS):
        if kind == 2:
            t = width // 2
            for p in range(len(got)):
                assert got[p, k] == pytest.approx(wide[p : p + t, c : c + high].mean() - wide[p + t : p + width, c : c + high].mean())


def test_short_and_missing_recordings():
    for x in (None, np.zeros(0), np.zeros(10), np.array([np.nan] * 10)):
        assert len(media.fingerprint(x, RATE)) == 0


def frame_of(spark, recordings):
    rows = [(i, None if x is None else [float(v) for v in x], "x") for i, x in recordings.items()]
    df = spark.createDataFrame(rows, "vec_id long, samples array<double>, prints string")
    return media.fingerprints(df, "vec_id", "samples", RATE)


def test_noisy_shifted_copies_align(spark):
    a, b = melody(1), melody(2)
    rng = np.random.default_rng(3)
    late = np.concatenate([rng.normal(size=256 * 9) * 0.1, a[: len(a) - 256 * 9]]) + rng.normal(size=len(a)) * 0.03
    recordings = {0: a, 1: b, 2: late, 3: a, 4: None, 5: np.zeros(5), 6: np.zeros(len(a)), 50: a[256 * 20 :], 7: np.zeros(len(a))}
    prints = frame_of(spark, recordings)
    rows, asked, keyed = media.align(prints, prints.where("rec_id in (0, 6, 50)"))
    got = {(r["query_id"], r["rec_id"]): r["offset"] for r in rows.join(asked, "query_key").join(keyed, "print_key").collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 0): 0, (0, 3): 0, (0, 2): 9, (0, 50): -20}
    assert {k: v for k, v in got.items() if k[0] == 50} == {(50, 50): 0, (50, 0): 20, (50, 3): 20, (50, 2): 29}
    assert not [k for k in got if k[0] == 6]  # silence has one value
    keys = {r["rec_id"]: r["print_key"] for r in prints.collect()}
    assert keys[6] == keys[7] != keys[0] and keys[4] is None and keys[5] is None
    assert frame_of(spark, {1: a}).limit(0).count() == 0


def test_query_against_all_pairs(spark):
    """Every pair whose prints coincide in enough places, by counting offsets directly."""
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    prints = {r["vec_id"]: media.fingerprint(media.notes_of(np.array(r["embedding"])), RATE) for r in vectors}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i].tobytes(), i)
    expected = set()
    for q in [i for i in prints if i % 50 == 0]:
        for r in set(first.values()):
            x, y = prints[r], prints[q]
            equal = defaultdict(list)
            for v in set(x.tolist()) & set(y.tolist()):
                for i in np.flatnonzero(x == v).tolist():
                    for j in np.flatnonzero(y == v).tolist():
                        equal[i - j].append((i, v))
            near = lambda e: any(v != w and media.NEAR <= k - i <= media.FAR for i, v in e for k, w in e)
            for offset in [o for o, e in equal.items() if len(e) > 1 and near(e)]:
                a, b = max(offset, 0), max(-offset, 0)
                n = min(len(prints[r]) - a, len(prints[q]) - b)
                if n >= media.LEAST_OVERLAP and np.bitwise_count(prints[r][a : a + n] ^ prints[q][b : b + n]).sum() / (32 * n) <= media.MOST_ERROR:
                    expected.add((q, r))
    got = media.op7_chroma_alignment(spark, sf).collect()
    assert {(r["rec_id"], r["class_id"]) for r in got if r["kind"] == "match"} == expected
    assert {r["rec_id"]: r["class_id"] for r in got if r["kind"] == "member"} == {i: first[p.tobytes()] for i, p in prints.items()}


@pytest.mark.parametrize("most_keys", [0, 10**6])
def test_noisy_vectors_are_found_and_others_are_not(spark, most_keys):
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=64) for i in range(150)}
    for i in range(0, 150, 50):
        vectors[1000 + i] = vectors[i] + rng.normal(size=64) * 0.15
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    prints = media.fingerprints(df, "vec_id", ("embedding", media.notes_of), RATE)
    rows, asked, keyed = media.align(prints, prints.where("rec_id % 50 = 0 and rec_id < 1000"), most_keys=most_keys)
    got = {(r["query_id"], r["rec_id"]) for r in rows.join(asked, "query_key").join(keyed, "print_key").collect()}
    assert got == {(i, j) for i in (0, 50, 100) for j in (i, 1000 + i)}


def test_landmarks_in_parts():
    x = np.random.default_rng(5).integers(0, 9, 700).astype(np.uint32)
    expected = sorted((int(x[i]), int(x[j]), j - i, i) for i in range(700) for j in range(i + media.NEAR, min(700, i + media.FAR + 1)) if x[i] != x[j])
    for at_once in (64, 300, 4096):
        keys, places = media.landmarks(x, at_once)
        assert sorted(places.tolist()) == sorted(i for *_, i in expected)
        assert len(set(keys.tolist())) == len({e[:3] for e in expected})
    assert len(media.landmarks(x[:5])[0]) == 0


@pytest.mark.parametrize("noise,least", [(0.05, 0.95), (0.15, 0.9), (0.25, 0.6)])
def test_recall_at_noise(noise, least):
    """Of noisy copies whose bits differ by at most MOST_ERROR, the share that has a landmark at offset 0."""
    rng = np.random.default_rng(11)
    close = met = 0
    for _ in range(150):
        v = rng.normal(size=64)
        x, y = (media.fingerprint(media.notes_of(u), RATE) for u in (v, v + rng.normal(size=64) * noise))
        if np.bitwise_count(x ^ y).sum() <= media.MOST_ERROR * 32 * len(x):
            close += 1
            met += bool({*zip(*(z.tolist() for z in media.landmarks(x)))} & {*zip(*(z.tolist() for z in media.landmarks(y)))})
    print(noise, close, met)
    assert close >= 20 and met >= least * close


def test_families_are_found_by_a_sample(spark):
    """Noisy copies of one recording, against all pairs: nine in ten are found, by far fewer rows than they share landmarks."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=64)
    vectors = {i: base + rng.normal(size=64) * 0.1 if i % 2 else rng.normal(size=64) for i in range(400)} | {25: base, 75: base + 0.05}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    prints = media.fingerprints(df, "vec_id", ("embedding", media.notes_of), RATE)
    rows, asked, keyed = media.align(prints, prints.where("rec_id % 50 = 25"))
    got = {(r["query_id"], r["rec_id"]) for r in rows.join(asked, "query_key").join(keyed, "print_key").collect()}
    x = {i: media.fingerprint(media.notes_of(np.float32(v)), RATE) for i, v in vectors.items()}
    close = {(q, i) for q in x if q % 50 == 25 for i in x if np.bitwise_count(x[q] ^ x[i]).sum() <= media.MOST_ERROR * 32 * len(x[q])}
    print(len(close), len(got & close), len(got - close))
    assert len(close) > 500 and len(got & close) >= 0.9 * len(close)


@pytest.mark.parametrize("together", [1, 3, 256])
def test_every_landmark_of_a_family_is_used(spark, together):
    """All pairs of a family with a landmark in common, and what their best offset is, against plain Python."""
    rng = np.random.default_rng(22)
    base = rng.normal(size=64)
    vectors = {i: base + rng.normal(size=64) * 0.15 if i % 2 else rng.normal(size=64) for i in range(240)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    prints = media.fingerprints(df, "vec_id", ("embedding", media.notes_of), RATE)
    rows, asked, keyed = media.align(prints, prints.where("rec_id % 20 = 5"), together=together)
    got = {(r["query_id"], r["rec_id"]): (r["offset"], r["votes"], r["overlap"], r["error"]) for r in rows.join(asked, "query_key").join(keyed, "print_key").collect()}
    x = {i: media.fingerprint(media.notes_of(np.float32(v)), RATE) for i, v in vectors.items()}
    places = {i: defaultdict(list) for i in x}
    for i in x:
        for key, at in zip(*(z.tolist() for z in media.landmarks(x[i])), strict=True):
            places[i][key].append(at)
    expected = {}
    for q in (i for i in x if i % 20 == 5):
        for i in x:
            offsets = {a - b for key in places[q].keys() & places[i].keys() for a in places[i][key] for b in places[q][key]}
            if best := media.best_offset(x[i], x[q], offsets, media.LEAST_OVERLAP, media.MOST_ERROR):
                expected[q, i] = (*best[:3], round(best[3], 6))
    assert len(expected) > 500 and got == expected
