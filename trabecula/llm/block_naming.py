"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size blocks. Distinct blocks are sorted into integer names, then adjacent pairs of names are named the same
way, level by level, until each document has one name. Names come from comparing contents, so different texts can't share one; a
128-bit route only decides where rows meet, and a route that two contents share is found and replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trabecula.llm.common import DOCUMENT_COLUMNS, cut, table, without_texts

BLOCK_BYTES = 8192
#: Buckets in which distinct contents are sorted; a name is the bucket and the rank in it.
BUCKETS = 1 << 16
Route = Callable[[Column, int], tuple[Column, Column]]


def hash_route(content: Column, attempt: int) -> tuple[Column, Column]:
    return F.xxhash64(content, F.lit(2 * attempt)), F.xxhash64(F.lit(2 * attempt + 1), content)


def _blocks(data: Column, block: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / F.lit(block))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def name_contents(rows: DataFrame, content: list[str]) -> DataFrame:
    """Distinct contents of `rows` (columns `content`, ra, rb) as ra, rb, name, clash.

    The contents of a route are combined before the one shuffle they take part in, so a content that a third of the rows share costs no more than
    another. `clash` marks routes that differing contents share.
    """
    differ = F.lit(False) if not content else F.min(F.struct(*content)) != F.max(F.struct(*content))
    each = rows.groupBy("ra", "rb").agg(differ.alias("clash"))
    each = each.withColumn("__b", F.pmod(F.xxhash64("ra", "rb"), F.lit(BUCKETS)))
    by = Window.partitionBy("__b").orderBy("ra", "rb")
    return each.select("ra", "rb", (F.shiftleft("__b", 40) + F.row_number().over(by)).alias("name"), "clash")


def block_names(docs: DataFrame, keys: list[str], block: int, route: Route) -> tuple[DataFrame, DataFrame]:
    """Heads (row_id, keys, n, routes of the row's blocks) and the names of all distinct blocks.

    Block contents travel once, to be compared; afterwards rows are known by 16-byte routes. If contents share a route, all are
    routed anew, so the names hold for contents and not for hashes.
    """
    attempt = 0
    while True:
        pairs = F.transform("blocks", lambda b: F.struct(*[c.alias(n) for c, n in zip(route(b, attempt), ("ra", "rb"))]))
        blocks = docs.select(F.explode("blocks").alias("block"))
        ra, rb = route(F.col("block"), attempt)
        names = cut(name_contents(blocks.select(ra.alias("ra"), rb.alias("rb"), "block"), ["block"]))
        if names.where("clash").isEmpty():
            break
        attempt += 1
    heads = docs.select(*keys, F.size("blocks").alias("n"), pairs.alias("routes")).withColumn("row_id", F.monotonically_increasing_id())
    return cut(heads), names.drop("clash")


def identities(docs: DataFrame, keys: list[str], text: str = "text", block: int = BLOCK_BYTES, route: Route = hash_route) -> DataFrame:
    """`keys`, row_id, level, name: rows have equal (level, name) exactly if their texts are equal. Null texts count as empty."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(*[F.col(k) for k in keys], data.alias("data")).select(*keys, _blocks(F.col("data"), block).alias("blocks"))
    heads, names = block_names(source, keys, block, route)
    rows = heads.select("row_id", "n", F.posexplode("routes").alias("pos", "r")).select("row_id", "n", "pos", F.col("r.ra").alias("ra"), F.col("r.rb").alias("rb"))
    found, level = cut(rows.join(names, ["ra", "rb"]).select("row_id", "n", "pos", "name")), 0
    most = heads.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ready = [found.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")]
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = (F.col("pos") / 2).cast("int")
        pairs = (found.where("n > 1").groupBy("row_id", half.alias("pos")).agg(F.first(F.expr("cast((n + 1) / 2 as int)")).alias("n"), F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("left"),
                 F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("right")))
        # a pair of names is its own route: no hash is needed above the blocks
        pairs = cut(pairs.select("row_id", "n", "pos", F.col("left").alias("ra"), F.col("right").alias("rb")))
        found = cut(pairs.join(cut(name_contents(pairs, [])), ["ra", "rb"]).select("row_id", "n", "pos", "name"))
        ready.append(found.where("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    named = ready[0]
    for part in ready[1:]:
        named = named.unionByName(part)
    return heads.drop("n", "routes").join(named, "row_id")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES, route: Route = hash_route) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group (null counts as empty); of each the row with the largest doc_id stays, one row if ids repeat, and a null id is
    smaller than any other. An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = cut(identities(base.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)), ["doc_id", "text_sha256"], "text", block, route))
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = ids.join(cut(groups), ["level", "name"], "left")
    single = F.col("group_size").isNull()
    return out.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (single | (F.col("best.row_id") == F.col("row_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **named) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept."""
    groups = cut(exact_groups(docs, **named))
    keys = groups.where("kept").select("doc_id", "text_sha256")
    gone = cut(groups.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    twice = gone.join(keys, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__sha") == F.col("text_sha256")), "left_semi")  # rows repeated with id and text
    twice = cut(twice)
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    left = without_texts(docs, gone)
    return left.unionByName(docs.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])) if not twice.isEmpty() else left


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs.select(*DOCUMENT_COLUMNS))
