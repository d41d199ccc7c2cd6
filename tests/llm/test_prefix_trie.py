"""The prefix trie against a tree built by hand."""

import hashlib
import random
import re
import zlib

import pytest

from trabecula.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA)


def by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        yield n
        for k in kids.get(n, []):
            yield from below(k)

    out = []
    for n, m in members.items():
        sub = list(below(n))
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, deep):
    rnd = random.Random(seed)
    stock = [[("user", rnd.choice(["hi", "hi  there\n", "é", "a b c", ""])) for _ in range(deep)] for _ in range(4)]
    rows = []
    for c in rnd.sample(range(200), n):
        base = rnd.choice(stock)
        v = base[:rnd.randrange(0, deep)] + [(rnd.choice(["user", "assistant", None]), rnd.choice(["x y", "z", None, "hi"])) for _ in range(rnd.randrange(0, 4))]
        turns = list(range(len(v)))
        if rnd.random() < 0.2:
            turns = [t * 10 for t in turns]
        rows += [(c, t, r, x) for t, (r, x) in zip(turns, v)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,deep,band", [(1, 60, 5, 8), (2, 80, 9, 2), (3, 40, 30, 3)])
def test_equal_to_a_tree_by_hand(spark, seed, n, deep, band):
    rows = conversations(seed, n, deep)
    got = prefix_trie.prefix_trie(table(spark, rows), band)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, "user", "a"), (5, 0, None, None), (5, 0, None, None), (5, 1, "user", "w " * 50000), (25, None, "user", "a"), (45, 0, "user", "a")]
    assert sorted(map(tuple, prefix_trie.prefix_trie(table(spark, rows)).collect()), key=str) == by_hand(rows)
    assert prefix_trie.prefix_trie(table(spark, rows).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_turnless_conversations_and_copies(spark):
    few = [(c, 0, "user", "only") for c in range(1, 90) if c % 20]  # heads without a base take the only turn away
    rows = few + [(100 + c, t, "user", f"turn {t}") for c in range(30) for t in range(6)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(table(spark, rows)).collect()), key=str) == by_hand(rows)
