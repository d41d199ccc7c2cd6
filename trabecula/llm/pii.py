"""Personal data by rules and a skip-chain conditional random field.

Rules find the base spans. The field then labels every token with a digit or an at sign (no kind has tokens without one, so all others are
certainly outside): neighbouring tokens are chained, and distant tokens of a document with equal or similar letters and digits share skip edges.
Token and transition potentials are estimated from counts over all documents, with the base spans as labels; loopy message passing makes
labels of a document agree, which adds spans that the rules miss, such as a number written again without its prefix.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import table

#: Kinds in the order that breaks ties between spans of one start. Fixed values.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is outside
#: Buckets of token shapes; counts of shapes and labels stay this small at any input size.
SHAPES = 4096
#: Weight of a label that a rule gave, of agreement over an equal and over a similar token, and the belief that adds a span.
CLAMP, EQUAL, SIMILAR, SURE = 8.0, 3.0, 1.5, 0.9
SMOOTH, ROUNDS = 5.0, 30

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
REST = re.compile(r"[0-9A-Za-z@._%+()-]*")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+()-")
RUN = re.compile(r"[0-9]+|[A-Za-z]+|.")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and kind. Each kind is scanned on its own, in time linear in the text."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each token with a digit or at sign, without closing dots and hyphens."""
    out, end = [], 0
    m = SEED.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in TOKEN:
            start -= 1
        end = REST.match(text, m.start()).end()
        stop = end
        while text[stop - 1] in ".-":
            stop -= 1
        out.append((start, stop))
        m = SEED.search(text, end)
    return out


def shape_of(token: str) -> int:
    """Bucket of the token's shape: digit runs by length, letter runs as one sign, other signs as they are."""
    runs = [f"9{min(len(r), 20)}" if r[0].isdigit() else "a" if r.isalpha() else r for r in RUN.findall(token[:200])[:24]]
    return zlib.crc32(" ".join(runs).encode("utf-8", "surrogatepass")) % SHAPES


def labels_of(tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Label of each token: the first span that covers at least half of it."""
    out, i = [], 0
    for start, end in tokens:
        while i < len(spans) and spans[i][2] <= start:
            i += 1
        label, k = 0, i
        while k < len(spans) and spans[k][0] < end:
            if 2 * (min(end, spans[k][2]) - max(start, spans[k][0])) >= end - start:
                label = spans[k][1] + 1
                break
            k += 1
        out.append(label)
    return out


def _texts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Whole texts; those without digit and at sign hold no token and go to Python as empty."""
    return docs.select(*keys, F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise(F.lit("")).alias("__text"))


def count_potentials(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all documents: [shape, label] and [label, next label] of neighbouring tokens. At most SHAPES * LABELS + LABELS^2 rows are read."""
    def run(batches):
        for b in batches:
            seen = np.zeros(SHAPES * LABELS + LABELS * LABELS, np.int64)
            for text in b.column("__text").to_pylist():
                if text:
                    tokens = tokens_of(text)
                    labels = labels_of(tokens, base_spans(text))
                    for i, ((start, end), y) in enumerate(zip(tokens, labels)):
                        seen[shape_of(text[start:end]) * LABELS + y] += 1
                        if i and start - tokens[i - 1][1] <= 2:
                            seen[SHAPES * LABELS + labels[i - 1] * LABELS + y] += 1
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    cells = _texts(docs, []).where("__text <> ''").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(SHAPES * LABELS + LABELS * LABELS)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return flat[:SHAPES * LABELS].reshape(SHAPES, LABELS), flat[SHAPES * LABELS:].reshape(LABELS, LABELS)


def potentials(shapes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials: label given shape, drawn towards the overall shares; and how much likelier than apart two labels follow each other."""
    prior = (shapes.sum(0) + [SMOOTH, *[0.1] * (LABELS - 1)]) / (shapes.sum() + SMOOTH + 0.1 * (LABELS - 1))
    unary = np.log((shapes + SMOOTH * prior) / (shapes.sum(1, keepdims=True) + SMOOTH))
    joint = (pairs + 1) / (pairs + 1).sum()
    return unary, np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))


def skip_edges(keys: list[list[str]]) -> list[tuple[int, int, bool]]:
    """(earlier, later, equal) for each token and the last before it with a common key: linear in the tokens however often one repeats."""
    last: dict[str, tuple[int, bool]] = {}
    out = []
    for i, own in enumerate(keys):
        linked = set()
        for k, key in enumerate(own):
            if key in last and last[key][0] not in linked:
                linked.add(last[key][0])
                out.append((last[key][0], i, k == 0 and last[key][1]))
            last[key] = (i, k == 0)
    return out


def keys_of(token: str) -> list[str]:
    """Letters and digits of the token; as similar forms, an address's part before the at sign and a long number's last seven digits."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in token if c.isdigit())
    out = [plain] if len(plain) >= 4 else []
    if "@" in token and len(local := "".join(c for c in token.split("@")[0].lower() if c.isalnum())) >= 4:
        out.append(local)
    if len(digits) >= 7 and digits[-7:] not in out:
        out.append(digits[-7:])
    return out


def pass_messages(unary: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Beliefs [token, label] by damped loopy sum-product over the edges a-b with log potentials pair [edge, label a, label b]."""
    m_ab, m_ba = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))

    def total() -> np.ndarray:
        t = unary.copy()
        np.add.at(t, b, m_ab)
        np.add.at(t, a, m_ba)
        return t

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for _ in range(ROUNDS if len(a) else 0):
        t = total()
        to_b = soft((t[a] - m_ba)[:, :, None] + pair, 1)
        to_a = soft((t[b] - m_ab)[:, None, :] + pair, 2)
        new_ab, new_ba = to_b - soft(to_b, 1)[:, None], to_a - soft(to_a, 1)[:, None]
        change = max(np.abs(new_ab - m_ab).max(), np.abs(new_ba - m_ba).max())
        m_ab, m_ba = (m_ab + new_ab) / 2, (m_ba + new_ba) / 2
        if change < 1e-4:
            break
    t = total()
    return np.exp(t - soft(t, 1)[:, None])


def added_spans(texts: list[str], bases: list[list[Span]], unary: np.ndarray, chain: np.ndarray) -> list[list[Span]]:
    """Spans that the field adds to each text; one message passing serves all texts, whose graphs are apart."""
    where, shape, given, a, b, kind = [], [], [], [], [], []
    for row, (text, base) in enumerate(zip(texts, bases)):
        tokens = tokens_of(text) if text else []
        first = len(where)
        labels = labels_of(tokens, base)
        for i, (start, end) in enumerate(tokens):
            where.append((row, start, end)), shape.append(shape_of(text[start:end])), given.append(labels[i])
            if i and start - tokens[i - 1][1] <= 2:
                a.append(first + i - 1), b.append(first + i), kind.append(0)
        for i, j, equal in skip_edges([keys_of(text[s:e]) for s, e in tokens]):
            a.append(first + i), b.append(first + j), kind.append(1 if equal else 2)
    out: list[list[Span]] = [[] for _ in texts]
    if not where:
        return out
    own, given = unary[shape].copy(), np.array(given)
    fixed = np.flatnonzero(given)
    own[fixed, given[fixed]] += CLAMP
    agree = np.eye(LABELS)
    belief = pass_messages(own, np.array(a, np.int64), np.array(b, np.int64), np.stack([chain, EQUAL * agree, SIMILAR * agree])[np.array(kind, np.int64)])
    label = belief.argmax(1)
    found = (given == 0) & (label > 0) & (belief.max(1) >= SURE)
    last = -1
    for i in np.flatnonzero(found).tolist():
        row, start, end = where[i]
        if any(s < end and start < e for s, _, e in bases[row]):
            continue
        if i and last == i - 1 and label[i - 1] == label[i] and where[i - 1][0] == row and start - where[i - 1][2] <= 2:
            out[row][-1] = (out[row][-1][0], out[row][-1][1], end)
        else:
            out[row].append((start, int(label[i]) - 1, end))
        last = i
    return out


def personal_data(docs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, base and added: arrays of (kind, start, end) by start and kind, in code points of the whole text, end exclusive.

    Null and empty texts have none; repeated rows are found alike; an empty table gives an empty result.
    """
    unary, chain = potentials(*count_potentials(docs))
    rows = _texts(docs, keys)
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = rows.drop("__text").select("*", F.lit(None).cast(span).alias("base"), F.lit(None).cast(span).alias("added")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            bases = [base_spans(t) if t else [] for t in texts]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in side], kind) for side in (bases, added_spans(texts, bases, unary, chain))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *cols], names=[*keys, "base", "added"])

    return rows.mapInArrow(run, schema)


def spans_text(spans, kinds=KINDS):
    """kind:start:end of each span by start and kind, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    rank = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(rank, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda s: F.when(s["kind"] == kind, True)


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.array_compact(F.transform("base", _is(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
