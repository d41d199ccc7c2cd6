"""The near-duplicate stage against brute force over whole shingle sets."""

import itertools
import random

import numpy as np
import pytest

from trabecula.llm import similar_sets, simhash
from tests.llm.test_ten_operators import docs, prose


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_hand(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def block_edits(base, n, rnd):
    """Copies with one passage appended, taken out or replaced, so that the similarity lies at about 0.72 to 0.92."""
    out = []
    for k in range(n):
        w = base.split()
        size = rnd.randrange(len(w) // 12, len(w) // 4)
        at = rnd.randrange(len(w) - size)
        fresh = prose(1, size, seed=rnd.random())[0].split()
        out.append(" ".join([w + fresh, w[:at] + w[at + size:], w[:at] + fresh[:size // 2] + w[at + size // 2:]][k % 3]))
    return out


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_block_edits_are_found(spark, block_rows):
    rnd = random.Random(2)
    texts = [*prose(30, 120, seed=3), "", None, "a b", "A  b"]
    for t in prose(30, 160, seed=4):
        texts += [t, *block_edits(t, 1, rnd), *block_edits(t, 2, rnd)[1:]]
    line = " ".join(prose(1, 25, seed=6))
    texts += [line + " " + t for t in prose(25, 60, seed=7)] + [line + " " + t for t in prose(25, 4, seed=8)]
    rows = similar_sets.similar_groups(docs(spark, texts), block_rows=block_rows).collect()
    assert {r.doc_id for r in rows if r.doc_id == r.keep.doc_id} == kept_by_hand(texts)
    assert len(kept_by_hand(texts)) < len(texts) - 30


def test_near_stage_keeps_what_brute_force_keeps(spark):
    rnd = random.Random(5)
    texts = [x for t in prose(40, 200, seed=14) for x in (t, *block_edits(t, 2, rnd))]
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, docs(spark, texts), "").collect()} == kept_by_hand(texts)


def test_keys_and_sketches_lose_no_pair():
    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(400):
        n = int(rnd.integers(1, 300))
        pool = np.unique(rnd.integers(0, 2**63, 2 * n + 2).astype(np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[(s := int(rnd.integers(0, n // 6 + 1))):n + int(rnd.integers(0, n // 6 + 1))])
        common = np.sort(rnd.permutation(pool)[:n // 2])
        rank = rnd.permutation(len(common))
        o = len(np.intersect1d(a, b))
        if 9 * o >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(similar_sets.first_keys(a, common, rank), similar_sets.first_keys(b, common, rank)))
            x = np.bitwise_count(similar_sets.sketch(a) ^ similar_sets.sketch(b)).sum()
            assert 9 * x <= len(a) + len(b)


def test_repeated_filler_does_not_join_texts(spark):
    filler = " ".join(["filler line of five words"] * 200)
    texts = [filler + " " + t for t in prose(8, 200, seed=21)] + ["word " * 900 + t for t in prose(8, 200, seed=22)]
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, docs(spark, texts), "").collect()} == set(range(16)) == kept_by_hand(texts)


def test_an_id_that_repeats_with_another_text_stays(spark):
    base, other, third = prose(3, 200, seed=23)
    rows = docs(spark, [base]).unionByName(docs(spark, [base + " more", other], 7)).unionByName(docs(spark, [third], 7))
    kept = sorted((r.doc_id, r.text) for r in simhash.near_dedup_stage(spark, rows, "").collect())
    assert kept == sorted([(0, base), (8, other), (7, third)])


def test_wide_sketches_keep_similar_sets_and_part_others():
    rng = np.random.default_rng(4)
    for n in (3, 200, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share, kept in ((0.0, True), (0.09, True), (0.5, False)):
            b = np.unique(np.r_[a[int(len(a) * share):], rng.integers(0, 1 << 63, int(len(a) * share)).astype(np.uint64)])
            apart = similar_sets.sketches_differ(similar_sets.wide_sketch(a).tobytes(), similar_sets.wide_sketch(b).tobytes())
            assert apart <= len(np.setxor1d(a, b)) and (9 * apart <= len(a) + len(b)) == kept, (n, share)
        longer = np.unique(np.r_[a, rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])
        assert similar_sets.sketches_differ(similar_sets.wide_sketch(a).tobytes(), similar_sets.wide_sketch(longer).tobytes()) <= len(np.setxor1d(a, longer))


def test_fingerprints_find_near_copies_ahead_of_the_keys(spark, monkeypatch):
    texts = [x for t in prose(12, 1500, seed=31) for x in (t, t + " tail")] + prose(6, 300, seed=32)
    monkeypatch.setattr(similar_sets, "candidate_pairs", lambda shared, facts, spanning, block_rows: spark.createDataFrame([], "a long, b long"))
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, docs(spark, texts), "").collect()} == kept_by_hand(texts)


def test_fingerprint_pairs_join_what_brute_force_joins(spark):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(62) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(62), rnd.randrange(6))) for p in prints]
    pairs = similar_sets.fingerprint_pairs(spark.createDataFrame(list(enumerate(prints)), "node long, fp long")).collect()
    near = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert {(r.a, r.b) for r in pairs} == near
