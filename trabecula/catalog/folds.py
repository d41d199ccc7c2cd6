"""Fold and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.operators import folds


def _greedy(key: str, table: str) -> str:
    return f"""WITH RECURSIVE g AS (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1), o AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS i FROM g),
r(i, k, n, fold, loads) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::INT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
 SELECT o.i, o.k, o.n, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INT), list_transform(range(1, 6), lambda j: r.loads[j] + CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN o.n ELSE 0 END)
 FROM r JOIN o ON o.i = r.i + 1)"""


@query("fold_map", _greedy("c_mktsegment || '|' || CAST(trunc(c_acctbal / 200) AS INT)", "customer") + " SELECT k AS group_key, n AS n_rows, fold FROM r WHERE i > 0")
def fold_map(t):
    key = F.concat_ws("|", "c_mktsegment", (F.col("c_acctbal") / 200).cast("int").cast("string"))
    return folds.fold_map(t.customer.withColumn("group_key", key), "group_key", 5)


@query("fold_map_skewed", _greedy("CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'c' || o_custkey END", "orders") + " SELECT k AS group_key, n AS n_rows, fold FROM r WHERE i > 0")
def fold_map_skewed(t):
    """One group holds a third of all rows."""
    key = F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return folds.fold_map(t.orders.withColumn("group_key", key), "group_key", 5)


@query("fold_row_counts", _greedy("c_mktsegment || '|' || CAST(trunc(c_acctbal / 200) AS INT)", "customer") + " SELECT fold, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups FROM r WHERE i > 0 GROUP BY 1")
def fold_row_counts(t):
    key = F.concat_ws("|", "c_mktsegment", (F.col("c_acctbal") / 200).cast("int").cast("string"))
    c = t.customer.withColumn("group_key", key)
    placed = folds.apply_folds(c, "group_key", folds.fold_map(c, "group_key", 5))
    return placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_key").alias("n_groups"))


@query("ungrouped_folds", "SELECT f AS fold, count(*) AS n_rows FROM (SELECT CAST((row_number() OVER () - 1) % 5 AS INT) AS f FROM orders) GROUP BY 1")
def ungrouped_folds(t):
    return folds.row_folds(t.orders, "o_orderkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stratified_holdout", """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, n, CAST(CASE WHEN n >= 2 THEN least(greatest(round_even(n * 0.2, 0), 1), n - 1) ELSE 0 END AS BIGINT) AS n_test FROM s""")
def stratified_holdout(t):
    out = folds.stratified_holdout(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.2, 42)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("stratified_small_strata", """WITH s AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, n, CAST(CASE WHEN n >= 2 THEN least(greatest(round_even(n * 0.2, 0), 1), n - 1) ELSE 0 END AS BIGINT) AS n_test FROM s""")
def stratified_small_strata(t):
    out = folds.stratified_holdout(t.events.where("event_type = 'purchase'").select("event_id", "user_id"), "user_id", "event_id", 0.2, 42)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("validation_groups", "SELECT true AS enough, true AS needed, count(DISTINCT c_nationkey) > 1 AS leaves_some FROM customer")
def validation_groups(t):
    """Whole groups reach the wanted rows, and without the last one they would not."""
    v = folds.validation_groups(t.customer, "c_nationkey", 0.15, 42)
    n = t.customer.agg(F.count(F.lit(1))).scalar()
    groups = t.customer.agg(F.count_distinct("c_nationkey")).scalar()
    one = v.agg(F.sum("n_rows").alias("got"), F.max("n_rows").alias("biggest"), F.count(F.lit(1)).alias("taken"))
    want = F.greatest(F.lit(2), F.rint(n * 0.15))
    return one.select((F.col("got") >= want).alias("enough"), (F.col("got") - F.col("biggest") < want).alias("needed"), (F.col("taken") < groups).alias("leaves_some"))


@query("long_targets", "SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS target, l_discount AS y_true FROM lineitem WHERE l_discount > 0.03 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem WHERE l_tax > 0.03")
def long_targets(t):
    li = t.lineitem.withColumns({c: F.when(F.col(c) > 0.03, F.col(c)) for c in ("l_discount", "l_tax")})
    return folds.long_targets(li, ["l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("row_guards", """WITH p AS (SELECT p_brand AS target, p_partkey % 5 AS fold, count(*) AS n_test FROM part WHERE p_size > 40 GROUP BY 1, 2), s AS (SELECT target, CAST(sum(n_test) AS BIGINT) AS n_target FROM p GROUP BY 1)
SELECT p.target, fold, n_test, n_target, n_target - n_test AS n_train, CASE WHEN n_target < 14 THEN 'too few rows' WHEN n_target - n_test < 13 THEN 'too few training rows' END AS skipped FROM p JOIN s USING (target)""")
def row_guards(t):
    p = t.part.where("p_size > 40").select(F.col("p_brand").alias("target"), (F.col("p_partkey") % 5).alias("fold"))
    return folds.row_guards(p, 14, 13).select("target", "fold", "n_test", "n_target", "n_train", "skipped")


@query("group_counts", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def group_counts(t):
    return folds.group_counts(t.orders, "o_custkey")
