"""Version and duplicate queries: orders per customer stand for reruns of a simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions.core import order_bucket
from trabecula.operators import dedupe
from trabecula.operators.ordered import exact_quantiles, neighbours, running_total


def _runs(t):
    return t.orders.select(F.concat(F.lit("run_"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".STL").otherwise("")).alias("Run"),
                           F.concat(F.lit("v"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("Version"), F.col("o_orderkey").alias("seq"), "o_totalprice", "o_custkey")


@query("latest_version", """
SELECT 'run_' || o_custkey AS Run, max(o_orderkey % 3 + 1) AS version, arg_max(o_orderkey, (o_orderkey % 3) * 1000000000 + o_orderkey) AS seq
FROM orders GROUP BY o_custkey
""")
def latest_version(t):
    out = dedupe.latest_version(_runs(t))
    return out.select("Run", dedupe.version_number("Version").cast("long").alias("version"), "seq")


@query("seed_twins", """
WITH r AS (SELECT l_partkey, l_linenumber, l_orderkey, l_quantity, CASE l_linenumber WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 1 THEN 4 ELSE 99 END AS pr FROM lineitem)
SELECT l_partkey, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY pr, l_orderkey, l_linenumber) AS rn FROM r) WHERE rn = 1
""")
def seed_twins(t):
    rows = t.lineitem.select("l_partkey", "l_linenumber", "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return dedupe.seed_twins(rows, ["l_partkey"], "l_linenumber", [2, 3, 5, 1], "seq").select("l_partkey", "l_linenumber", "l_orderkey")


@query("highest_version", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 3) * 1000000000 + o_orderkey) AS seq FROM orders GROUP BY o_custkey
""")
def highest_version(t):
    return dedupe.highest_version(_runs(t), ["o_custkey"]).select("o_custkey", "seq")


@query("highest_version_by_variant", """
SELECT o_orderpriority AS variant, o_custkey, arg_max(o_orderkey, (o_orderkey % 3) * 1000000000 + o_orderkey) AS seq FROM orders GROUP BY 1, 2
""")
def highest_version_by_variant(t):
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("variant"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("Version"), F.col("o_orderkey").alias("seq"))
    return dedupe.highest_version(rows, ["o_custkey"], variant="variant").select("variant", "o_custkey", "seq")


@query("distinct_results", """
SELECT o_custkey, CAST(floor(o_totalprice / 50000) AS BIGINT) AS sig, o_orderstatus, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2, 3
""")
def distinct_results(t):
    rows = t.orders.select("o_custkey", F.floor(F.col("o_totalprice") / 50000).alias("sig"), "o_orderstatus", F.col("o_orderkey").alias("seq"))
    return dedupe.distinct_results(rows, ["o_custkey"], ["sig", "o_orderstatus"])


@query("number_versions", """
WITH m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' GROUP BY 1)
SELECT o_orderkey, 'v' || (coalesce(m.n, 0) + row_number() OVER (PARTITION BY orders.o_custkey ORDER BY o_orderdate, o_orderkey)) AS Version
FROM orders LEFT JOIN m ON m.o_custkey = orders.o_custkey WHERE o_orderpriority <> '1-URGENT'
""")
def number_versions(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("Run"), "o_orderdate", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("OK (no shear CSV)").alias("Status"))
    new, master = o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderpriority = '1-URGENT'")
    out = dedupe.number_versions(new, master, "Run", ["o_orderdate", "o_orderkey"], F.date_format("o_orderdate", "yyyyMM"))
    return out.select("o_orderkey", "Version")


@query("prior_run_counts", """
SELECT o_custkey AS Run, count(*) AS n_prior FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1
""")
def prior_run_counts(t):
    o = t.orders.select(F.col("o_custkey").alias("Run"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("OK").alias("Status"))
    return dedupe.prior_runs(o)


@query("even_sample", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
w AS (SELECT DISTINCT CAST(round_even(j * (n - 1) / 499.0, 0) AS BIGINT) AS p FROM range(500) g(j), (SELECT count(*) AS n FROM orders))
SELECT o_orderkey FROM r WHERE p IN (SELECT p FROM w)
""")
def even_sample(t):
    return dedupe.evenly_spaced(t.orders, 500, ["o_totalprice", "o_orderkey"], order_bucket("o_totalprice")).select("o_orderkey")


@query("first_per_value", """
SELECT l_quantity, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS price FROM lineitem GROUP BY 1
""")
def first_per_value(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"))
    return dedupe.first_per_value(rows, "l_quantity", "seq").select("l_quantity", F.col("l_extendedprice").alias("price"))


@query("unique_seed_labels", """
WITH r AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '_Seed' || (o_orderkey % 4) END AS run FROM orders),
l AS (SELECT run, CASE WHEN contains(run, 'Seed') THEN 'seed ' || regexp_extract(run, 'Seed([0-9]+)', 1) ELSE 'seed 1' END AS lab FROM r)
SELECT run, lab || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS label FROM l WINDOW w AS (PARTITION BY lab ORDER BY run)
""")
def unique_seed_labels(t):
    tail = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("_Seed"), (F.col("o_orderkey") % 4).cast("string")))
    return dedupe.unique_labels(t.orders.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), tail).alias("run")), "run")


@query("repeated_names", "SELECT p_name, count(*) AS n_files FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_names(t):
    return dedupe.repeated_names(t.part, "p_name")


@query("running_total_exact", """
SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS position, round(sum(o_totalprice) OVER w, 2) AS upto FROM orders
WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def running_total_exact(t):
    order, b = ["o_totalprice", "o_orderkey"], order_bucket("o_totalprice", 64)
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    rows = running_total(o, ["o_orderstatus"], order, b, out="position")
    rows = running_total(rows, ["o_orderstatus"], order, b, "v", out="upto")
    return rows.select("o_orderkey", "position", F.round(F.col("upto").cast("double"), 2).alias("upto"))


@query("consecutive_rows", """
SELECT * FROM (SELECT o_custkey, o_orderkey AS cur_key, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS next_key FROM orders) WHERE next_key IS NOT NULL
""")
def consecutive_rows(t):
    p = neighbours(t.orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_orderkey"], order_bucket("o_totalprice", 8))
    return p.select("o_custkey", F.col("cur.o_orderkey").alias("cur_key"), F.col("nxt.o_orderkey").alias("next_key"))


@query("exact_quantiles", """
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
  round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type
""")
def quantiles(t):
    names = ["q1", "q2", "q3", "p99"]
    q = exact_quantiles(t.events, ["event_type"], "value", [0.25, 0.5, 0.75, 0.99], names, "n")
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in names])
