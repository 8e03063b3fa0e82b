"""Near-duplicates: planted copies of stated similarity, and brute force over all pairs."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from retrospect.llm import near_dedup

WORDS = [f"w{k}" for k in range(20_000)]


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_force(docs):
    """Smallest id of each group, from all pairs."""
    sets, root = {i: shingle_set(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(WORDS)
    return " ".join(words)


def planted(seed):
    rng, docs = random.Random(seed), []
    for size in (60, 300, 2_000):
        for share in (0.004, 0.01, 0.015, 0.02, 0.022, 0.03, 0.06):
            for _ in range(2):
                text = " ".join(rng.choices(WORDS, k=size))
                docs += [text, edited(rng, text, max(1, round(share * size)))]
    docs += ["", " \n", "one two", "One  two", "one two three", "one two three four five", "one two three four five six"]
    return [(k + 1, t) for k, t in enumerate(docs)]


def test_planted_copies_of_a_similarity_from_08_to_095_go(spark):
    docs = planted(5)
    pairs = [jaccard(shingle_set(docs[k][1]), shingle_set(docs[k + 1][1])) for k in range(0, 84, 2)]
    for low, high in ((0.6, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.96)):
        assert any(low <= x < high for x in pairs)
    want = {i for i, r in brute_force(docs).items() if i == r}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, frame, "").collect()} == want


@pytest.mark.parametrize("tile, most", [(4096, 1 << 20), (7, 1 << 20), (4096, 500)])
def test_large_groups_and_chains_in_tiles(spark, monkeypatch, tile, most):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", most)
    rng = random.Random(6)
    base = " ".join(rng.choices(WORDS, k=200))
    docs = [base] + [edited(rng, base, rng.choice([1, 2, 5, 12])) for _ in range(60)]
    chain = " ".join(rng.choices(WORDS, k=300))
    for _ in range(15):
        docs.append(chain)
        chain = edited(rng, chain, 2)
    docs = [(k, t) for k, t in enumerate(docs)]
    rng.shuffle(docs)
    got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_force(docs) and len(got) == len(docs)


def test_rows_that_repeat_and_null_ids(spark):
    docs = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "A b c d e f g"), (9, None), (8, ""), (None, "x y"), (1, "y x")]
    got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 4), (4, 4), (None, 4), (9, 8), (8, 8), (None, None), (1, 1)], key=str)
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_threshold_is_exact():
    import numpy as np

    a = np.arange(10, dtype=np.uint64)
    assert near_dedup.spanning_pairs([a, a[:8]], Fraction(4, 5)) == [(0, 1)]
    assert near_dedup.spanning_pairs([a, a[:7]], Fraction(4, 5)) == []
    assert sorted(near_dedup.spanning_pairs([a[:7], a, a[:8]], Fraction(4, 5))) == [(0, 2), (2, 1)]


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    """Planted pairs of Jaccard 0.8 exactly, from 5 hashes to 1,000: misses stay near the stated chance."""
    import numpy as np

    radius, rng = near_dedup.plan_radius(0.8), np.random.default_rng(8)
    assert near_dedup.plan_radius(1.0) == 0 and 15 < radius < 32
    far = n = 0
    for shared, one, two in ((4, 1, 0), (4, 0, 1), (8, 1, 1), (20, 5, 0), (40, 5, 5), (200, 25, 25), (800, 100, 100)):
        for _ in range(300):
            h = rng.integers(0, 1 << 63, shared + one + two, np.uint64) * np.uint64(2) + rng.integers(0, 2, shared + one + two, np.uint64)
            a, b = near_dedup.set_fingerprint(h[: shared + one]), near_dedup.set_fingerprint(np.concatenate([h[:shared], h[shared + one :]]))
            far, n = far + ((a ^ b) % (1 << 64)).bit_count().__gt__(radius), n + 1
    assert far <= 0.004 * n
    bits = np.array([0b1011, 0b0011, 0b0110], np.uint64)
    assert near_dedup.set_fingerprint(bits) == 0b0011 and near_dedup.set_fingerprint(bits[:2]) == 0b0011
