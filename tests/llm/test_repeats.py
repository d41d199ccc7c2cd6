"""Removal of repeated strings against a version that looks at every start."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trabecula.llm import repeats

SCHEMA = "doc_id long, text string, data string, t1 long, spans string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], SCHEMA)


def by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = True
        gone = gone[:len(d)]
        edges = np.diff(np.r_[0, gone.astype(np.int8), 0])
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def compare(spark, texts, length, spread):
    repeats_of = repeats.repeated_spans(docs(spark, texts), length, spread=spread)
    named = {}
    for r in repeats_of.collect():
        named.setdefault(r.doc_id, []).append([(s["first"], s["end"]) for s in r.spans])
    want = by_hand([t for _, t in texts], length)
    for (i, _), (_, spans, _, _) in zip(texts, want):
        assert (spans in named.get(i, [])) if spans else True, i
    assert sum(len(v) for v in named.values()) == len({x for x, w in zip(texts, want) if w[1]})


def noise(rnd, n, letters="abcdefgh "):
    return "".join(rnd.choices(letters, k=n))


def mixed(seed, copies=12):
    rnd = random.Random(seed)
    passages = [noise(rnd, rnd.randrange(30, 260)) for _ in range(5)]
    texts = []
    for _ in range(40):
        t = noise(rnd, rnd.randrange(0, 150))
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, len(p) // 2)
            t += p[a:rnd.randrange(a, len(p)) + 1] + noise(rnd, rnd.randrange(0, 9))
        texts.append(t)
    texts += [texts[3]] * copies + [texts[4] + texts[4]] + [texts[5][:-1] + "é", "naïve ÉTÉ 日本語" * 20, "日本語" * 30]
    texts += ["a" * 300, "ab" * 200, "a" * 40, "word " * 90, "", None, "x", "\n" * 61]
    for k in range(10):  # near copies
        w = list(texts[3] or "")
        if w:
            w[rnd.randrange(len(w))] = "Z"
        texts.append("".join(w))
    return texts


@pytest.mark.parametrize("length,spread,seed", [(40, 16, 1), (40, 4, 2), (73, 64, 3)])
def test_spans_equal_a_look_at_every_start(spark, length, spread, seed):
    compare(spark, list(enumerate(mixed(seed))), length, spread)


def test_default_length_and_digests(spark):
    rnd = random.Random(9)
    p = noise(rnd, 900)
    texts = [noise(rnd, 700), p, noise(rnd, 300) + p[100:500] + noise(rnd, 50), p[200:599], noise(rnd, 10) + p[501:900], p[:420] + noise(rnd, 300), p[30:450],
             "word " * 3000, noise(rnd, 500) * 2, None, "", noise(rnd, 399), noise(rnd, 400)]
    want = by_hand(texts, 400)
    rows = {r.doc_id: r for r in repeats.without_repeats(docs(spark, list(enumerate(texts)))).collect()}
    assert len(rows) == len(texts)
    for i, (n, spans, digest, kept) in enumerate(want):
        r = rows[i]
        assert (r.n_bytes, [(s["first"], s["end"]) for s in r.spans], r.kept_sha256, bytes(r.kept)) == (n, spans, digest, kept), i
    assert sum(bool(w[1]) for w in want) >= 6


def test_repeated_ids_nulls_and_nothing(spark):
    rnd = random.Random(4)
    a, b = noise(rnd, 600), noise(rnd, 500)
    got = sorted((str(r.doc_id), r.n_bytes, len(r.spans)) for r in repeats.without_repeats(docs(spark, [(1, a), (1, a), (1, b), (None, b), (None, None), (2, "short")])).collect())
    assert got == sorted([("1", 600, 1), ("1", 600, 1), ("1", 500, 1), ("None", 500, 1), ("None", 0, 0), ("2", 5, 0)])
    assert repeats.without_repeats(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_a_text_read_in_parts_has_the_same_anchors(monkeypatch):
    rnd = random.Random(8)
    data = (noise(rnd, 5000) + "a" * 900 + noise(rnd, 3000)).encode()
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "STARTS_AT_ONCE", 777)
    for x, y in zip(whole, repeats.anchors(data)):
        assert np.array_equal(x, y)
    at, first, last = whole
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all() and ((at >= last) & (at - first < 256)).all()
