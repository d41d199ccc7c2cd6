"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters are lexicon groups (words and word beginnings that set toxic training rows apart) and patterns. The label model estimates, per
class, how often each voter fires and which voters fire together (a tree of dependencies), by expectation maximisation over the counts
of all vote patterns. A logistic regression on lexicon entries and patterns then learns its posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import DOCUMENT_COLUMNS, cut, table

#: Labelled rows read for the lexicon and the classifier, about; labels beyond it only enter the label model.
MAX_LABELLED = 20_000
#: Lexicon entries kept at most, and the least G statistic and precision of an entry.
MAX_ENTRIES, MIN_G, MIN_PRECISION = 256, 18.0, 0.5
#: Lexicon groups of precise and of weaker entries; a group votes at one find and again at several.
STRONG, WEAK, PRECISE = 4, 2, 0.9
GROUPS = STRONG + WEAK
VOTERS = 2 * GROUPS + 4
STEM, DENSE, DENSE_FEATURES = 4, 5, 5
#: Chance that a training label is right, as the label model takes it.
LABEL_TRUST = 0.98
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[!?*#$%&]{2,}")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
CHUNK = 1 << 20


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by five; such rows, and rows without an id, teach nothing."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) == 0


def parts(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut at spaces."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.find(" ", at + CHUNK)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def beginnings(word: str) -> list[str]:
    """Lexicon keys of a word: the word and its first four to six letters."""
    return [f"={word}", *(f"{word[:n]}-" for n in range(STEM, STEM + 3) if len(word) > n)]


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int | None) -> DataFrame:
    """Training rows with their label, at most about `limit` of them, picked by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    if limit:
        share = min(1.0, limit / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        return docs.join(F.broadcast(known), "doc_id")  # about `limit` ids and labels: the texts stay where they are
    return docs.join(known, "doc_id")


def learn_lexicon(train: DataFrame) -> list[tuple[str, float]]:
    """Entries that mark toxic rows and their precision, best first; documents are counted, not repeats."""
    def run(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = set()
                for part in parts((text or "").lower()):
                    words.update(WORD.findall(part))
                seen[y].update({k for w in words for k in beginnings(w)})
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["entry", "t", "c"])

    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return []
    n, base = n_t + n_c, n_t / (n_t + n_c)
    seen = train.select("text", "y").mapInArrow(run, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    df = F.col("t") + F.col("c")

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g = 2 * (term(F.col("t"), df * base) + term(F.col("c"), df * (1 - base)) + term(n_t - F.col("t"), (n - df) * base) + term(n_c - F.col("c"), (n - df) * (1 - base)))
    best = seen.withColumn("g", g).where((F.col("t") >= df * MIN_PRECISION) & (F.col("t") > df * base) & (F.col("g") >= MIN_G))
    return [(r["entry"], r["t"] / (r["t"] + r["c"])) for r in best.orderBy(F.col("g").desc(), "entry").limit(MAX_ENTRIES).collect()]


def group_of(lexicon: list[tuple[str, float]]) -> list[int]:
    """Entries with one stem share a group; stems are dealt by rank, precise ones apart from weaker ones."""
    stems: dict[str, int] = {}
    for e, precision in lexicon:
        stem = e.strip("=-")[:STEM]
        if stem not in stems:
            strong = precision >= PRECISE
            n = sum((g < STRONG) == strong for g in stems.values())
            stems[stem] = n % STRONG if strong else STRONG + n % WEAK
    return [stems[e.strip("=-")[:STEM]] for e, _ in lexicon]


def evidence(docs: DataFrame, keys: list[str], lexicon: list[tuple[str, float]]) -> DataFrame:
    """`keys`, votes (bits), entries (lexicon positions found) with their counts, dense (pattern features) of each whole text; null: empty."""
    rows = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = rows.drop("__text").select("*", F.lit(0).alias("votes"), F.array(F.lit(0)).alias("entries"), F.array(F.lit(0)).alias("counts"), F.array(F.lit(0.0)).alias("dense")).schema
    at, groups = {e: i for i, (e, _) in enumerate(lexicon)}, group_of(lexicon)
    stems = frozenset(e.strip("=-")[:STEM] for e in at)

    def one(text: str) -> tuple[int, list[int], list[int], list[float]]:
        words, marks, upper = Counter(), 0, 0
        for part in parts(text):
            words.update(WORD.findall(part.lower()))
            marks += sum(1 for _ in MARKS.finditer(part))
            upper += len(CAPITAL.findall(part))
        n, upper = max(words.total(), 1), upper / max(len(text), 1)
        found, per_group, hits = Counter(), [0] * GROUPS, 0
        for w in words:
            if w[:STEM] in stems and (own := [at[k] for k in beginnings(w) if k in at]):
                hits += words[w]
                per_group[groups[own[0]]] += words[w]
                for e in own:
                    found[e] += words[w]
        votes = 0
        for g, c in enumerate(per_group):
            votes |= (c > 0) << 2 * g | (c > 1 and 1000 * c >= DENSE * n) << 2 * g + 1
        for i, fires in enumerate((hits > 3, 1000 * hits >= 2 * n, upper > 0.3, 1000 * marks > 50 * n)):
            votes |= fires << 2 * GROUPS + i
        entries = sorted(found)
        dense = [hits, 1000 * hits / n, n, 1000 * marks / n]
        return votes, entries, [found[e] for e in entries], [*map(float, np.log1p(dense)), upper]

    def run(batches):
        for b in batches:
            out = list(zip(*map(one, b.column("__text").to_pylist()))) or [(), (), (), ()]
            kinds = pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *[pa.array(x, t) for x, t in zip(out, kinds)]], names=[*keys, "votes", "entries", "counts", "dense"])

    return rows.mapInArrow(run, schema)


@dataclass
class LabelModel:
    """Class prior, the voters' firing rates given class and parent, and the tree of correlated voters."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray  # [voter, class, parent fires]

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        bits = (votes[:, None] >> np.arange(VOTERS)) & 1
        up = np.where(self.parent >= 0, bits[:, self.parent], 0)
        total = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for i in range(VOTERS):
            p = self.rate[i][:, up[:, i]]
            p = np.where(bits[:, i], p, 1 - p)
            total += np.log(p[1] / p[0])
        return total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))


def _maximise(bits: np.ndarray, weight: np.ndarray) -> LabelModel:
    """Prior, dependency tree (largest conditional mutual information) and smoothed rates for weighted patterns; weight: [pattern, class]."""
    per_class = weight.sum(0) + 1e-9
    joint = np.zeros((2, VOTERS, VOTERS, 2, 2))
    sides = (1 - bits, bits)
    for y in (0, 1):
        for a in (0, 1):
            for b in (0, 1):
                joint[y, :, :, a, b] = (sides[a] * weight[:, y:y + 1]).T @ sides[b]
    joint += 0.05
    total = joint.sum((3, 4), keepdims=True)
    p = joint / total
    information = (p * np.log(p / (p.sum(4, keepdims=True) * p.sum(3, keepdims=True)))).sum((3, 4))
    score = np.tensordot(per_class / per_class.sum(), information, 1)
    parent, inside = np.full(VOTERS, -1), [0]
    while len(inside) < VOTERS:
        rest = [i for i in range(VOTERS) if i not in inside]
        i, j = max(((i, j) for i in rest for j in inside), key=lambda x: (score[x], -x[0], -x[1]))
        parent[i] = j
        inside.append(i)
    rate = np.zeros((VOTERS, 2, 2))
    for i in range(VOTERS):
        for y in (0, 1):
            if parent[i] < 0:
                rate[i, y, :] = joint[y, i, i, 1, 1] / (joint[y, i, i, 1, 1] + joint[y, i, i, 0, 0])
            else:
                own = joint[y, parent[i], i]
                rate[i, y, :] = (own[:, 1] + 0.5 * own[:, 1].sum() / own.sum()) / (own.sum(1) + 0.5)
    return LabelModel(float(np.clip(per_class[1] / per_class.sum(), 1e-4, 0.5)), parent, np.clip(rate, 1e-6, 1 - 1e-6))


def fit_label_model(counts: DataFrame, rounds: int = 12) -> LabelModel:
    """From the counts `n` of vote patterns `votes` with known label `y` or -1. At most 3 * 2^VOTERS rows are read."""
    pdf = counts.toPandas()
    votes, y, n = pdf["votes"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64), pdf["n"].to_numpy(float)
    bits = ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    sure = np.where(y == 1, LABEL_TRUST, 1 - LABEL_TRUST)
    known = n * (y >= 0)
    if not known[y == 1].sum() or not known[y == 0].sum():  # no labels of both kinds: begin with what the lexicon says
        known, sure = n, np.where(bits[:, :2 * GROUPS].any(1), 0.7, 0.02)
    model = _maximise(bits, known[:, None] * np.stack([1 - sure, sure], 1))
    for _ in range(rounds):
        odds = model.log_odds(votes) + np.where(y >= 0, np.log(sure / (1 - sure)), 0)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        model = _maximise(bits, n[:, None] * np.stack([1 - p, p], 1))
    return model


def _design(entries: list, counts: list, dense: list, size: int) -> np.ndarray:
    x = np.zeros((len(entries), size + DENSE_FEATURES + 1))
    for i, (own, c) in enumerate(zip(entries, counts)):
        x[i, own] = np.log1p(c)
    x[:, size:size + DENSE_FEATURES] = np.stack(dense)
    x[:, -1] = 1
    return x


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column is the constant and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (target - p) - shrink * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, keys: list[str], max_labelled: int) -> tuple[list[tuple[str, float]], np.ndarray, DataFrame]:
    """Lexicon, weights of the classifier, and the evidence of all texts (written)."""
    lexicon = learn_lexicon(labelled_rows(docs.select("doc_id", "text"), labels, max_labelled))
    seen = cut(evidence(docs, keys, lexicon))
    known = cut(labelled_rows(seen.select("doc_id").distinct(), labels, None))
    with_y = seen.join(known, "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    model = fit_label_model(with_y.groupBy("votes", "y").agg(F.count(F.lit(1)).alias("n")))
    sample = labelled_rows(seen, labels, max_labelled).select("votes", "entries", "counts", "dense", "y").toPandas()
    if lexicon and len(sample):
        sure = np.where(sample["y"] == 1, LABEL_TRUST, 1 - LABEL_TRUST)
        odds = model.log_odds(sample["votes"].to_numpy(np.int64)) + np.log(sure / (1 - sure))
        w = fit_linear(_design(list(sample["entries"]), list(sample["counts"]), list(sample["dense"]), len(lexicon)), 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    else:
        w = np.zeros(len(lexicon) + DENSE_FEATURES + 1)
        w[-1] = -3.0
    return lexicon, w, seen


def scored(seen: DataFrame, w: np.ndarray, keys: list[str]) -> DataFrame:
    """`keys`, held_out, score and predicted from the evidence of texts."""
    n = len(w) - DENSE_FEATURES - 1
    entry_w = F.array(*[F.lit(float(x)) for x in w[:n]], F.lit(0.0))
    odds = F.lit(float(w[-1])) + F.aggregate(F.arrays_zip("entries", "counts"), F.lit(0.0), lambda s, e: s + F.get(F.col("__w"), e["entries"]) * F.log1p(e["counts"].cast("double")))
    for i in range(DENSE_FEATURES):
        odds = odds + F.lit(float(w[n + i])) * F.get("dense", F.lit(i))
    score = 1 / (1 + F.exp(-odds))
    return seen.withColumn("__w", entry_w).select(*keys, held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, keys: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """`keys` (doc_id among them), held_out, score, predicted for each row of `docs`.

    Labels are used of training rows only (see `held_out`), texts whole. Without any usable label of both kinds the lexicon is empty and
    every text gets one low score. Null texts are empty; repeated rows are scored alike; an empty table gives an empty result.
    """
    _, w, seen = fitted(docs.select(*dict.fromkeys(["doc_id", "text", *keys])), labels, keys, max_labelled)
    return scored(seen, w, keys)


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go. The fitted classifier reads each row once more where it lies, so no text is shuffled and repeats share a fate."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    lexicon, w, _ = fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"], MAX_LABELLED)
    return scored(evidence(docs, list(DOCUMENT_COLUMNS), lexicon), w, list(DOCUMENT_COLUMNS)).where("predicted = 0").select(*DOCUMENT_COLUMNS)
