"""The ten operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trabecula.llm import block_naming, chat, decontamination, licences, packing, pii, sharding, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, `start` long, node long"
ODD = ["", None, " \n\t ", "a", "a", "word " * 30000, "naïve ÉTÉ 日本語 \U0001f600", "\\<|im_end|> <\\|x|>", "x@y.z +1 (650) 555-1234", "4111 1111 1111 1111 1.2.3.4"]


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), "e", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(None, "null id", None, None, None, None, None, None), (3, "a", None, None, None, None, None, None)]
    return docs(spark, ODD).unionByName(spark.createDataFrame(extra, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n, words=60, seed=0):
    rnd = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "the", "of", "ble", "sh", "re", "wh"]
    return [" ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(words)) for _ in range(n)]


# exact duplicates


def groups_by_hand(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return {i: (max(own, key=lambda x: (x is not None, x or 0)), len(own)) for own in by.values() for i in own}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_block_names_find_equal_texts(spark, block):
    texts = prose(20, 8) * 3 + ["ab", "abc", "abcd", "ab", "", None, "aaaa", "aaa"]
    got = block_naming.exact_groups(docs(spark, texts), block=block).collect()
    want = groups_by_hand(enumerate(texts))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert all(r.kept == (r.keep_id == r.doc_id) and r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got)


def test_shared_routes_are_replaced(spark):
    def weak(content, attempt):
        return (F.lit(1).cast("long"), F.lit(1).cast("long")) if attempt == 0 else block_naming.hash_route(content, attempt)

    texts = prose(6, 5) + prose(3, 5)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in block_naming.exact_groups(docs(spark, texts), block=4, route=weak).collect()}
    assert got == groups_by_hand(enumerate(texts))


def test_repeated_rows_keep_one(spark, odd, empty):
    kept = block_naming.drop_copies(odd).collect()
    assert Counter((r.text or "") for r in kept) == Counter(set((t or "") for t in [*ODD, "null id"]))
    twice = docs(spark, ["x", "y"]).unionByName(docs(spark, ["x", "y"]))
    assert sorted(r.text for r in block_naming.drop_copies(twice).collect()) == ["x", "y"]
    assert block_naming.exact_groups(empty).count() == 0 and block_naming.drop_copies(empty).count() == 0


# near duplicates


def components_by_hand(prints, ids, distance, also=lambda a, b: True):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= distance and also(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def edited(base, n, seed, swaps=2):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        w = base.split()
        for _ in range(swaps):
            w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(999))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket_rows", [1024, 12])
def test_fingerprint_components(spark, bucket_rows):
    base = prose(3, 200, seed=5)
    texts = [*base, *edited(base[0], 25, 1, 4), *edited(base[1], 15, 2, 6), *prose(20, 50, seed=9), "", None, "one", "two words"]
    prints = [int(simhash.fingerprint(t or "", 3)[0]) for t in texts]
    want = components_by_hand(prints, list(range(len(texts))), 3)
    got = simhash.simhash_components(docs(spark, texts), bucket_rows=bucket_rows).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(texts)


def test_fingerprint_by_definition():
    import xxhash

    for text in ["", "A b", "A b C d", "x " * 70000, "É è É è É"]:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert int(simhash.fingerprint(text, 3)[0]) == want


def test_ring_never_loses_a_pair():
    rnd = random.Random(4)
    for distance in (3, 8):
        ring = simhash.Ring(distance)
        for _ in range(300):
            diff = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(distance + 1)))
            chains = ring.chains()
            starts = [s for s in range(ring.segments) if all(bin(diff & int(chains[s, n])).count("1") <= ring.budget(n + 1) for n in range(ring.segments))]
            assert starts
            for s in starts[:1]:
                masks = [ring.masks[s]]
                for _ in range(6):
                    finer = ring.split(s, masks[0])
                    if not finer:
                        break
                    masks = [m for m in finer if not diff & m]
                    assert masks


def test_near_stage_keeps_one_of_each_group(spark, odd, empty):
    base = prose(4, 300, seed=11)
    texts = [*base, *edited(base[0], 6, 3), *edited(base[1], 3, 4)]
    kept = {r.doc_id for r in simhash.near_dedup_stage(spark, docs(spark, texts), "").collect()}
    assert kept == {0, 1, 2, 3}
    assert simhash.near_dedup_stage(spark, empty, "").count() == 0
    assert simhash.simhash_components(odd).count() == len(ODD) + 2 and simhash.simhash_components(empty).count() == 0


# packing


def test_pieces_and_packing(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, *prose(40, 300, seed=2), "Don't STOP!! it's 3.14, a.b. ſ ΑΣ ΑΣ. x y\x0bz q"]
    pieces = packing.token_pieces(docs(spark, texts), ["doc_id"], capacity=256)
    packed, certificate = packing.pack(pieces, 256, per_task=16)
    rows = packed.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    for own in by_seq.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by_seq) == certificate["bins"] >= certificate["bound"] and certificate["bins"] <= 1.02 * certificate["bound"]
    assert packing.pack(packing.token_pieces(empty, ["doc_id"]))[0].count() == 0
    assert packing.pack(packing.token_pieces(odd, ["doc_id"]))[0].count() >= len(ODD) + 2


def test_bounds_hold_for_small_cases():
    def best(sizes, capacity):
        for n in range(1, len(sizes) + 1):
            def fit(i, rooms):
                return i == len(sizes) or any(r >= sizes[i] and fit(i + 1, rooms[:k] + (r - sizes[i],) + rooms[k + 1:]) for k, r in enumerate(rooms))
            if fit(0, (capacity,) * n):
                return n

    rnd = random.Random(6)
    for _ in range(200):
        sizes = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 8))), reverse=True)
        distinct, counts = np.unique(sizes, return_counts=True)
        bins, offsets, room = packing.best_fit_decreasing(np.array(sizes), 20)
        assert packing.bin_bound(distinct, counts, 20) <= best(sizes, 20) <= len(set(bins.tolist()))


# toxicity


def test_toxicity_learns_from_training_rows_only(spark, odd, empty):
    clean, rnd = prose(400, 80, seed=21), random.Random(8)
    texts, toxic = [], []
    for i, t in enumerate(clean):
        bad = i % 4 == 0
        w = t.split()
        for _ in range(3 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["grobvex", "grobvexer", "grobvexish", "Snarkule"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(table, labels, ["doc_id"]).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == toxic[i] for i in got if got[i].held_out]) >= 0.97
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, flipped, ["doc_id"]).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    kept = toxicity.toxicity_scores(odd, labels.limit(0), ["doc_id"]).collect()
    assert len(kept) == len(ODD) + 2 and not any(r.predicted for r in kept)
    assert toxicity.toxicity_scores(empty, labels, ["doc_id"]).count() == 0


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_hand(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits)
                    or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_by_definition():
    rnd = random.Random(3)
    pieces = ["4111111111111111", "+1 (650) 555-1234", "a.b@x.org", " ", ".", ",", "1.2.3.4", "-", "300.1.1.1", "4111 1111 1111 1111", "7", "@", "é"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9))) if rnd.random() < 0.5 else "".join(rnd.choice("01239.@a-+( )%_,") for _ in range(rnd.randrange(1, 40)))
        assert pii.base_spans(text) == base_by_hand(text)


def test_long_texts_take_linear_time():
    for text in ["a" * 300000, "1" * 300000, "+1" + " " * 300000, "1." * 150000, "a@" * 100000, "1 " * 100000]:
        pii.base_spans(text)
        pii.tokens_of(text)


def test_field_adds_a_repeated_number(spark, odd, empty):
    texts = [f"call +1 (26{i % 10}) 555-32{i:02d} or mail kim.{i:02d}@mail{i % 9}.example.com now" for i in range(60)]
    texts += ["call +1 (269) 555-3296 soon. Later call (269) 555-3296 again", "plain words only 12 of 34"]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts), ["doc_id"]).collect()}
    assert [texts[60][s.start:s.end] for s in got[60].added] == ["(269) 555-3296"] and [s.kind for s in got[60].added] == ["phone"]
    assert not got[61].base and not got[61].added
    found = {r.doc_id: r for r in pii.personal_data(odd.where("doc_id > 3"), ["doc_id"]).collect()}
    assert [s.kind for s in found[8].base] == ["email", "phone"] and [s.kind for s in found[9].base] == ["card", "ip"] or [s.kind for s in found[9].base] == ["ip"]
    assert pii.personal_data(empty, ["doc_id"]).count() == 0


def test_query_digests(spark, tmp_path):
    texts = [*ODD, "a@b.cd 1.2.3.4 a@b.cd +1 (650) 555-1234 4111111111111111"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op1_skip_chain_crf(spark, str(tmp_path)).collect():
        spans = base_by_hand(texts[r.doc_id] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}


def test_messages_match_enumeration():
    rnd = np.random.default_rng(2)
    unary, pair = rnd.normal(size=(4, pii.LABELS)), rnd.normal(size=(3, pii.LABELS, pii.LABELS))
    a, b = np.array([0, 1, 1]), np.array([1, 2, 3])  # a tree: message passing is exact
    want = np.zeros_like(unary)
    for y in itertools.product(range(pii.LABELS), repeat=4):
        p = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[e, y[a[e]], y[b[e]]] for e in range(3)))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(pii.pass_messages(unary, a, b, pair), want / want.sum(1, keepdims=True), atol=1e-3)


# chat


def test_conversations_read_back(spark):
    kinds = ["user", "assistant", "sys\ntem", None, "a<|b"]
    rnd = random.Random(1)
    texts = ["hi", "", None, "<|im_end|>\n<|im_start|>user", "<\\|x", "\\<|", "<", "|", "a<|image|>b", "<\\\\\\||", "x\n<|text|>", "é\U0001f600"]
    rows = [(c, t, rnd.choice(kinds), rnd.choice(texts)) for c in range(40) for t in range(rnd.randrange(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.withColumn("parts", chat.text_part(F.col("text"))))).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want[c].append((role or "", text or ""))
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert [t.loss_text for t in r.turns] == [x if role == "assistant" else "" for role, x in want[r.conv_id]]
    assert len(back) == 40


def test_typed_parts(spark):
    parts = [("text", "see <", None, None), ("text", "|image|>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7), None, ("odd", "z", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", 3)]), (2, 0, "user", None)],
                                  f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    one = got[1]
    assert [(a.turn_index, a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 0, "image", "a.png", 256), (0, 1, "audio", "b.wav", 7), (1, 2, "document", "c.pdf", 3)]
    assert one.expanded_tokens == 266 and one.turns[1].loss_text == "ok" and one.turns[0].text == "see <|image|>z"
    assert [p.type for p in one.turns[0].parts] == ["text", "text", "image", "audio", "text"]
    assert got[2].turns[0].text == "" and one.formatted.count("<|im_start|>") == 2
    assert chat.format_conversations(turns.limit(0)).count() == 0


# sharding


def test_virtual_slots(spark, odd, empty):
    table = docs(spark, prose(500, 30, seed=3) + ["é" * 9, None])
    rows = sharding.shard_documents(table, shards=7, slots=256).collect()
    load, places = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        places[r.shard].append(r.place)
    assert len(rows) == 502 and max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 7
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.size for r in rows if r.doc_id == 500} == {26} and {r.size for r in rows if r.doc_id == 501} == {8}
    stats = sharding.slot_bytes(table.select(sharding.slot_of("doc_id", 256).alias("virtual_slot"), F.lit(10).alias("size")))
    first = sharding.build_map(spark, stats, 7, 256)
    grown = sharding.rebalance(first, stats, 8)
    assert grown.select("version").distinct().count() == 2
    before, after = ({r.slot: r.shard for r in m.collect()} for m in (first, sharding.latest(grown)))
    assert all(after[s] in (before[s], 7) for s in before) and len(set(after.values())) == 8
    assert sharding.shard_documents(odd).count() == len(ODD) + 2 and sharding.shard_documents(empty).count() == 0


# licences


def test_licence_sentences(spark, odd, empty):
    s = licences.SENTENCES
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at: x " + s["ApacheAsIs"] + "."
    texts = ["Released under the MIT License.", f"{s['MitGrant']}: {s['MitNotice']}.\n\n{s['AsIsShort']}.", apache, "Text\nLicensed under CC BY-NC 4.0.\nMore. All rights reserved.", "This licence is odd. Yes.", "no such thing"]
    got = [r for r in licences.scan_licences(docs(spark, texts), ["doc_id"]).orderBy("doc_id").collect()]
    assert [list(r.licences) for r in got] == [["MIT"], ["MIT"], ["Apache"], ["CC-BY-NC"], [], []]
    assert [x.version for x in got[3].sentence_ids] == ["4.0", ""] and [r.n_unknown for r in got] == [0, 0, 1, 0, 1, 0]
    assert all(re.search("|".join(licences.GOOD_WORDS), x) for x in s.values())
    assert licences.scan_licences(odd, ["doc_id"]).where("n_known > 0").count() == 0 and licences.scan_licences(empty, ["doc_id"]).count() == 0


# token counts


def test_length_histogram(spark, odd, empty):
    lengths = [0, 0, 3, 5, 5, 5, 9, 70000]
    rows = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.length_histogram(rows))
    for r in sums.collect():
        assert r.docs_le == sum(n <= r.length for n in lengths) and r.tokens_gt == sum(n for n in lengths if n > r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths) and r.lost_tokens == sum(lengths) - r.truncated_tokens
    got = {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(sums, [0, 4, 5, 100]).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in (0, 4, 5, 100)}
    assert token_counts.length_at(sums, 0.5).first().length == 5
    enc = token_counts.encoder("byte_bpe_50k.tiktoken")
    assert {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(odd.where("doc_id <> 3"), ["doc_id"]).collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(ODD) if i != 3}
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(empty, []))).count() == 0


def test_lengths_of_parts_add_up(monkeypatch):
    enc = token_counts.encoder("byte_bpe_50k.tiktoken")
    text = " ".join(["Don't  stop 12 x, y", "été\n\nz  a", "  q"] * 40)
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    assert token_counts.encoded_length(enc, text) == len(enc.encode_ordinary(text))


# benchmark passages


def nearest(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i] * (len(text) + 1)
        for j, c in enumerate(text, 1):
            row[j] = min(before[j - 1] + (p != c), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_passages_against_full_alignment(spark):
    rnd, items = random.Random(5), [(i, t) for i, t in enumerate(prose(6, 22, seed=31))]
    items += [(6, "tiny"), (7, None), (8, ""), (9, " ".join(prose(1, 70, seed=32)))]
    texts = []
    for n in range(60):
        item = list(items[n % 6][1])
        for _ in range(rnd.randrange(0, 12)):
            k, how = rnd.randrange(len(item)), rnd.randrange(3)
            item[k:k + (how != 1)] = [] if how == 0 else ["q"]
        texts.append(prose(1, 30, seed=n)[0] + "\n" + "".join(item).upper() + "  " + prose(1, 20, seed=n + 99)[0])
    texts += [items[9][1][100:300], "so TINY it is", "", None, "a  b " * 3000]
    flat = [decontamination.normalise(t or "")[0] for t in texts]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_passages(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()}
    index = decontamination.build_index(items, decontamination.ERROR_RATE)
    want = set()
    for d, codes in enumerate(flat):
        for w, own in enumerate(index.codes):
            if nearest(own.tolist(), codes.tolist()[:2000]) <= index.edits[w]:
                want.add((d, index.item[w]))
        if "tiny" in codes.tobytes().decode("utf-32-le"):
            want.add((d, 6))
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_passages_in_parts_and_empty_tables(spark, odd, empty, monkeypatch):
    item = prose(1, 60, seed=40)[0]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "PART_CHARS", 3000)
    filler = prose(1, 20000, seed=41)[0]
    text = filler[:50123] + " " + item + " " + filler[50123:]
    hit = list(decontamination.text_matches([text, filler], decontamination.build_index([(1, item)], 0.05)))
    assert {x[0] for x in hit} == {0} and all(text[x[4]:x[5]] in item for x in hit)
    assert decontamination.contaminated_passages(odd, bench, ["doc_id"]).count() == 0
    assert decontamination.contaminated_passages(empty, bench, ["doc_id"]).count() == 0
    assert decontamination.contaminated_passages(odd, bench.limit(0), ["doc_id"]).count() == 0
    assert decontamination.drop_contaminated(odd, bench).count() == len(ODD) + 2
