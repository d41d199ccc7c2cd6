"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trabecula.llm import collocations

SCHEMA = "doc_id long, text string, lang string, shard long, words string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "w", 2) for i, (g, t) in enumerate(rows)], SCHEMA)


def by_hand(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for g, t in rows:
        g = g or "und"
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        n[g] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 5):
                f[g].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out, counts = [], {}
    for g, own in f.items():
        counts |= {(g, " ".join(p)): c for p, c in own.items() if c >= least}
        cands = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        longer = defaultdict(int)
        for p, c in cands.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s:s + m]] = max(longer[p[s:s + m]], c)
        rows_of = []
        for p, a in cands.items():
            score, k, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < share * a:
                rows_of.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((g, rank, p.decode(), -a, l, r, n[g], -s))
    return sorted(out), counts


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["The", "of", "é", "naïve", "a", "b", "c", "日本", "x-y", "z\x1c", "new", "york"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", ";", "!", " ?"]
    rows = []
    for _ in range(n):
        t = "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randrange(0, 60)))
        if rnd.random() < 0.5:
            t += " New York city hall was" + rnd.choice([" built", " old", "."])
        rows.append((rnd.choice(["en", "en", "en", "de", None]), t))
    return [*rows, ("en", None), ("en", ""), (None, " . ,"), ("fr", "one"), ("fr", "...")]


@pytest.mark.parametrize("seed,shard_words,least,share,top", [(1, 1 << 21, 5, 80, 2000), (2, 70, 4, 80, 2000), (3, 1, 6, 50, 15)])
def test_equal_to_plain_counting(spark, seed, shard_words, least, share, top):
    rows = corpus(seed)
    want, counts = by_hand(rows, least, share, top)
    assert len(want) > 20
    got = collocations.collocations(docs(spark, rows), least, share, top, shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    if shard_words == 70:
        found, totals = collocations.phrase_counts(docs(spark, rows), least, shard_words)
        assert {(r.lang, r.phrase): r.f for r in found.collect()} == counts
        assert {r.lang: r.n for r in totals.collect()}["fr"] == 1


def test_no_rows_and_no_phrases(spark):
    assert collocations.collocations(docs(spark, [("en", "a b")]).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [("en", "a b c")]), least=2).count() == 0
    repeated = [("en", "a a a a a")] * 3
    assert sorted(tuple(r) for r in collocations.collocations(docs(spark, repeated), least=2).collect()) == by_hand(repeated, 2, 80, 2000)[0]


def test_parts_of_a_text_and_intervals(monkeypatch):
    rnd = random.Random(5)
    text = " ".join(rnd.choice(["aa", "b", "cc.", "d,e", "\n"]) for _ in range(900)).encode()
    whole = np.concatenate(list(collocations.word_ids(text, collocations._Ids({b".": 0}))))
    monkeypatch.setattr(collocations, "TEXT_BYTES", 17)
    assert np.array_equal(whole, np.concatenate(list(collocations.word_ids(text, collocations._Ids({b".": 0})))))
    ids = np.r_[0, whole, 0].astype(np.int32)
    index = collocations.Index(collocations._transform(ids), collocations._transform(ids[::-1]), int(ids.max()) + 1)
    for sides in ((True, True, True), (False, True, False), (True, False, True)):
        got = index.single(np.arange(1, index.symbols))
        for k, left in enumerate(sides, 2):
            got = index.extend(got, left)
            want = Counter(t for t in zip(*[ids[i:len(ids) - k + 1 + i].tolist() for i in range(k)]) if 0 not in t)
            assert dict(zip(zip(*got.words.tolist()), got.count.tolist())) == want


def test_phrases_are_packed_in_few_bytes(spark):
    """A phrase goes through the shuffle as a few bytes, and comes back the same; buckets share out all phrases whatever their number."""
    rnd = np.random.default_rng(7)
    keys = np.unique(rnd.integers(0, 20000, (2, 100000)), axis=1)
    count = rnd.integers(1, 4, keys.shape[1])
    for buckets in (1, 20):
        order, met, ends = collocations._dealt(keys, buckets)
        assert len(met) == buckets and sorted(order) == list(range(keys.shape[1]))
        back, size = [], 0
        for a, b in zip(ends, ends[1:]):
            data = collocations._packed_phrases(keys[:, order[a:b]], count[order[a:b]])
            size += len(data)
            back.append(collocations._unpacked_phrases(data, 2))
        assert np.array_equal(np.hstack(back), np.vstack([keys, count])[:, order]) and size < 6 * keys.shape[1]
    rows = corpus(4)
    few, many = ({tuple(r) for r in collocations.phrase_counts(docs(spark, rows), 4, 70, bucket_words=n)[0].collect()} for n in (1 << 21, 8))
    assert few == many == {(*k, c) for k, c in by_hand(rows, 4, 80, 2000)[1].items()}
