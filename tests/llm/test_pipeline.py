"""The pipeline against a brute-force version, and the registered queries' shape."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from trabecula.llm import queries, toxicity

SYLLABLES = ["an", "er", "ti", "on", "the", "of", "ble", "sh", "re", "wh", "ou", "nd"]


def prose(n, rnd):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randrange(1, 4))) for _ in range(n))


def corpus():
    """Texts with what is planted in each: toxic words, copies, near copies, benchmark passages."""
    rnd = random.Random(12)
    bench = [prose(40, rnd) for _ in range(5)]
    texts, toxic = [], {}
    for i in range(260):
        t, bad = prose(rnd.randrange(60, 160), rnd), i % 5 == 0
        if bad:
            w = t.split()
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["grobvexer", "grobvexish", "Snarkule"])
            t = " ".join(w)
        toxic[i] = bad
        texts.append(t)
    clean = [i for i in range(260) if not toxic[i]]
    copies = [texts[clean[3]]] * 9 + [texts[clean[4]]]
    near = []
    for k in range(6):
        w = texts[clean[5]].split()
        w[10 + k] = "zzq"
        near.append(" ".join(w))
    leaks = [texts[clean[20]] + "\n" + bench[1].upper(), bench[2] + " " + texts[clean[21]]]
    return texts + copies + near + leaks + ["", None, ""], toxic, bench, clean


def write(spark, folder, texts, toxic, bench):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    texts, toxic, bench, clean = corpus()
    write(spark, str(tmp_path), texts, toxic, bench)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    by_text = {}
    for i, t in enumerate(texts):  # of equal texts the largest id stays
        if not toxic.get(i):
            by_text[t or ""] = i
    want = set(by_text.values())
    near = {clean[5], *range(270, 276)}
    want -= near - {min(near)}
    want -= {276, 277}
    assert kept == want
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tok.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in kept}


def test_stages_keep_the_document_columns(spark, tmp_path):
    texts, toxic, bench, _ = corpus()
    write(spark, str(tmp_path), texts[:60], {i: y for i, y in toxic.items() if i < 60}, bench)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("h1", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None), (1, "b", None, None, None)], docs.select(*toxicity.DOCUMENT_COLUMNS).schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).count() == (3 if name == "exact_dedup" else 4), name


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
