"""Linkage queries: customers and parts stand for geometries, orders and line items for result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions import names
from trabecula.operators import link, setops
from trabecula.operators.folds import miss_counts
from trabecula.operators.ordered import running_total


def _features(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit(".STL")).alias("file"), "c_mktsegment", "c_acctbal")


def _labels(t):
    run = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return t.orders.select("o_orderkey", run.alias("Run"), "o_totalprice", "o_orderstatus")


@query("link_by_stem", """
SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c
JOIN orders o ON c.c_name = 'Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0')
""")
def link_by_stem(t):
    return link.link_by_stem(_features(t), _labels(t)).select("c_custkey", "o_orderkey", "o_totalprice")


@query("link_unmatched", """
SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND c.c_name = 'Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0'))
""")
def link_unmatched(t):
    labels = _labels(t).where("o_orderstatus = 'P'")
    return link.link_by_stem(_features(t), labels, how="left_anti").select("c_custkey", "c_mktsegment")


@query("link_match_guard", """
WITH j AS (SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_totalprice > 400000 AND o.o_custkey = c_custkey) AS hit FROM customer),
g AS (SELECT count(*) AS total, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS unmatched FROM j)
SELECT *, CASE WHEN total = 0 THEN 'empty input' WHEN matched = 0 THEN 'nothing joined'
  WHEN unmatched / total > 0.2 THEN 'too many unmatched' ELSE 'ok' END AS verdict FROM g
""")
def link_match_guard(t):
    labels = _labels(t).where("o_orderstatus = 'P' AND o_totalprice > 400000").select("Run").distinct()
    linked = link.link_by_stem(_features(t), labels, how="left")
    return link.match_guard(linked, F.col("Run").isNotNull())


def _stem(t, cond):
    p = t.part.where(cond)
    key = F.col("p_partkey")
    stem = names.build_stem(F.concat(F.lit("LAT_"), F.when(key % 7 == 0, "flow").otherwise("df")), F.col("p_size"), F.col("p_retailprice") / 10,
                            (key % 5) * 0.1 + 0.2, key % 4, F.lit(1.6))
    return p.select("p_partkey", stem.alias("stem"))


PARAMS = ["variant", "inner", "density", "t", "seed", "size_multi"]


def _with_params(df, col):
    return df.withColumn("__p", names.parse_stem(col, "LAT")).select("*", "__p.*").drop("__p")


_STEMS = """
s AS (SELECT p_partkey, p_partkey % 7 = 0 AS flow, CAST(p_size AS VARCHAR) || 'p0' AS i_tag,
        regexp_replace(regexp_replace(printf('%.2f', p_retailprice / 10), '0+$', ''), '[.]$', '.0') AS d_txt,
        printf('%.1f', (p_partkey % 5) * 0.1 + 0.2) AS t_txt, p_partkey % 4 AS seed FROM part),
st AS (SELECT p_partkey, 'LAT_' || CASE WHEN flow THEN 'flow' ELSE 'df' END || '_i' || i_tag || '_d' || replace(d_txt, '.', 'p')
        || '_t' || replace(t_txt, '.', 'p') || '_s' || seed || '_m1p6' AS stem FROM s)
"""


@query("link_by_params", "WITH " + _STEMS + """,
f AS (SELECT * FROM st WHERE p_partkey % 2 = 0),
l AS (SELECT p_partkey AS seq, stem, stem || CASE WHEN p_partkey % 5 = 0 THEN '_rerun' ELSE '' END AS run FROM st WHERE p_partkey % 3 = 0),
ex AS (SELECT f.p_partkey, l.run AS matched_run, l.seq AS label_seq, 'exact' AS match_kind FROM f JOIN l ON f.stem = l.run),
rest AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.run = f.stem)),
best AS (SELECT stem, arg_max(run, seq) AS run, max(seq) AS seq FROM l GROUP BY stem)
SELECT * FROM ex UNION ALL SELECT r.p_partkey, b.run, b.seq, CASE WHEN b.run IS NULL THEN 'none' ELSE 'params' END
FROM rest r LEFT JOIN best b ON r.stem = b.stem
""")
def link_by_params(t):
    f = _with_params(_stem(t, "p_partkey % 2 = 0"), "stem")
    l = _stem(t, "p_partkey % 3 = 0")
    l = l.select(F.col("p_partkey").alias("label_seq"),
                 F.concat("stem", F.when(F.col("p_partkey") % 5 == 0, "_rerun").otherwise("")).alias("run_name"))
    out = link.link_by_params(f, _with_params(l, "run_name"), "stem", "run_name", PARAMS, "label_seq")
    return out.select("p_partkey", "matched_run", "label_seq", "match_kind")


def _tensor_index(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("s_suppkey") % 3 == 0, F.concat("n_name", F.lit(" Generator"))).otherwise(F.col("n_name")).alias("topology"),
        (F.floor(F.col("s_suppkey") / 3) % 4 * 0.05 + 0.1).alias("density"), "s_suppkey")


_INDEX = """
ix AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' Generator' ELSE n_name END AS topology,
         CAST(round((s_suppkey // 3) % 4 * 0.05 + 0.1, 2) AS DECIMAL(12,2)) AS dkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
al AS (SELECT topology, dkey, s_suppkey, 0 AS pr FROM ix UNION ALL
       SELECT topology || ' Generator', dkey, s_suppkey, 1 FROM ix WHERE topology NOT LIKE '% Generator'),
best AS (SELECT topology, dkey, arg_min(s_suppkey, pr * 1000000000 + s_suppkey) AS s_suppkey, min(pr) AS alias_rank FROM al GROUP BY topology, dkey)
"""


@query("tensor_alias_index", "WITH " + _INDEX + " SELECT topology, CAST(dkey AS DOUBLE) AS density, s_suppkey, alias_rank FROM best")
def tensor_alias_index(t):
    ix = _tensor_index(t).withColumn("dkey", link.density_key("density")).drop("density")
    out = link.with_aliases(ix, "topology", ["dkey"], ["s_suppkey"])
    return out.select("topology", F.col("dkey").cast("double").alias("density"), "s_suppkey", "alias_rank")


@query("tensor_link", "WITH " + _INDEX + """,
f AS (SELECT c_custkey, n_name || CASE WHEN c_custkey % 2 = 0 THEN ' Generator' ELSE '' END AS topology,
        CAST(round((c_custkey % 6) * 0.05 + 0.1, 2) AS DECIMAL(12,2)) AS dkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, f.topology, s_suppkey FROM f LEFT JOIN best b ON f.topology = b.topology AND f.dkey = b.dkey
""")
def tensor_link(t):
    ix = _tensor_index(t).withColumn("dkey", link.density_key("density"))
    ix = link.with_aliases(ix, "topology", ["dkey"], ["s_suppkey"]).select("topology", "density", "s_suppkey")
    topo = F.concat("n_name", F.when(F.col("c_custkey") % 2 == 0, " Generator").otherwise(""))
    f = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", topo.alias("topology"), (F.col("c_custkey") % 6 * 0.05 + 0.1).alias("density"))
    return link.link_tensors(f, ix).select("c_custkey", "topology", "s_suppkey")


@query("tensor_miss_counts", "WITH " + _INDEX + """,
f AS (SELECT n_name AS topology, CAST(round((c_custkey % 6) * 0.05 + 0.1, 2) AS DECIMAL(12,2)) AS dkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT topology, count(*) AS n_missing FROM f WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.topology = f.topology AND b.dkey = f.dkey) GROUP BY topology
""")
def tensor_miss_counts(t):
    ix = _tensor_index(t).withColumn("dkey", link.density_key("density"))
    ix = link.with_aliases(ix, "topology", ["dkey"], ["s_suppkey"]).select("topology", "density")
    f = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("topology"), (F.col("c_custkey") % 6 * 0.05 + 0.1).alias("density"))
    return miss_counts(link.link_tensors(f, ix, "left_anti"), "topology")


@query("prefer_source", """
SELECT p_partkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'own' WHEN b.v IS NOT NULL THEN 'partner' END AS source FROM part
LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON b.l_partkey = p_partkey
""")
def prefer_source(t):
    def src(flag):
        return t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("v"))
    return link.prefer_first(t.part.select("p_partkey"), [("own", src("R")), ("partner", src("A"))], ["p_partkey"], "v")


@query("link_contained", """
WITH f AS (SELECT DISTINCT p_name || '_' || (p_partkey % 3) AS stem FROM part),
n AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_1_' || p_type END AS name FROM part WHERE p_size > 25),
m AS (SELECT stem, min(name) AS matched_name FROM f JOIN n ON contains(name, stem) OR contains(stem, name) GROUP BY stem)
SELECT f.stem, matched_name, CASE WHEN matched_name IS NULL THEN 'none' ELSE 'contains' END AS match_kind FROM f LEFT JOIN m USING (stem)
""")
def link_contained(t):
    f = t.part.select(F.concat_ws("_", "p_name", (F.col("p_partkey") % 3).cast("string")).alias("stem")).distinct()
    n = t.part.where("p_size > 25").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("_1_"), "p_type"))).alias("name"))
    return link.link_contained(f, "stem", n, "name").select("stem", "matched_name", "match_kind")


@query("attach_density", """
SELECT l_orderkey, l_linenumber, l_partkey, p_size AS VF FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def attach_density(t):
    key = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("VF"), F.lit(0).alias("l_linenumber"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return link.attach_missing(rows, key, "l_partkey", ["VF", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "VF")


@query("reconcile_master", """
WITH d AS (SELECT DISTINCT l_orderkey AS run_key, l_linenumber AS batch_key FROM lineitem),
h AS (SELECT *, run_key % 11 <> 0 AS has_result, run_key % 7 <> 0 AS has_metadata FROM d)
SELECT run_key, batch_key, CASE WHEN NOT has_result THEN 'no result' WHEN NOT has_metadata THEN 'no metadata' ELSE 'missing' END AS gap FROM h
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag <> 'R' AND l.l_orderkey = run_key AND l.l_linenumber = batch_key)
""")
def reconcile_master(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("run_key"), F.col("l_linenumber").alias("batch_key"), "l_returnflag")
    disk = li.select("run_key", "batch_key").distinct().withColumns(
        {"has_result": F.col("run_key") % 11 != 0, "has_metadata": F.col("run_key") % 7 != 0})
    out = link.reconcile(disk, li.where("l_returnflag <> 'R'"), ["run_key", "batch_key"])
    return out.select("run_key", "batch_key", "gap")


@query("summary_completeness", """
WITH r AS (SELECT event_id, nullif(event_type, 'error') AS kind, CASE WHEN value > 100 THEN value END AS v FROM events),
p AS (SELECT event_id, list_filter([CASE WHEN kind IS NULL THEN 'kind EMPTY' END, CASE WHEN v IS NULL THEN 'v EMPTY' END, 'column onset not in summary'], lambda x: x IS NOT NULL) AS problems FROM r)
SELECT event_id, array_to_string(problems, '; ') AS problem_text, len(problems) AS n_problems, len(problems) = 0 AS complete FROM p
""")
def summary_completeness(t):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") > 100, F.col("value")).alias("v"))
    out = link.completeness(rows, ["event_id"], ["kind", "v", "onset"])
    return out.select("event_id", F.array_join("problems", "; ").alias("problem_text"), "n_problems", "complete")


@query("nearest_lookup", """
WITH t AS (SELECT c_custkey, 900 + abs(c_acctbal) / 80 AS x FROM customer),
lk AS (SELECT DISTINCT p_retailprice AS d FROM part WHERE p_size % 5 = 0),
lo AS (SELECT c_custkey, x, d AS below FROM t ASOF LEFT JOIN lk ON x >= d),
hi AS (SELECT c_custkey, d AS above FROM t ASOF LEFT JOIN lk ON x <= d)
SELECT lo.c_custkey, round(CASE WHEN above IS NULL THEN below WHEN below IS NULL THEN above WHEN x - below <= above - x THEN below ELSE above END, 4) AS near_density
FROM lo JOIN hi USING (c_custkey)
""")
def nearest_lookup(t):
    targets = t.customer.select("c_custkey", (F.lit(900) + F.abs("c_acctbal") / 80).alias("x"))
    lookup = t.part.where("p_size % 5 = 0").select(F.col("p_retailprice").alias("density"))
    return link.nearest(targets, "x", lookup, "density").select("c_custkey", F.round("near_density", 4).alias("near_density"))


@query("invert_calibration", """
WITH c AS (SELECT n_regionkey AS topo, s_suppkey * 1.0 AS t, sum(2.5 + s_suppkey % 5) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS vf
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
iv AS (SELECT topo, t AS t0, lead(t) OVER w AS t1, vf AS v0, lead(vf) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY topo ORDER BY vf)),
p AS (SELECT c_custkey, n_regionkey AS topo, 5 + abs(c_acctbal) / 70 AS rho FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT c_custkey, max(t0 + (rho - v0) / (v1 - v0) * (t1 - t0)) AS ts FROM p JOIN iv ON p.topo = iv.topo AND rho >= v0 AND rho <= v1 GROUP BY c_custkey)
SELECT p.c_custkey, round(ts, 5) AS t_solved, ts IS NOT NULL AS in_range FROM p LEFT JOIN m USING (c_custkey)
""")
def invert_calibration(t):
    c = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("topo"), "s_suppkey", F.col("s_suppkey").cast("double").alias("t"), (F.lit(2.5) + F.col("s_suppkey") % 5).alias("step"))
    curve = running_total(c, ["topo"], ["s_suppkey"], F.floor(F.col("s_suppkey") / 4096), "step", out="vf")
    pts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("topo"), (F.lit(5) + F.abs("c_acctbal") / 70).alias("rho"))
    out = link.invert_curve(pts, "rho", curve, keys=["topo"])
    return out.select("c_custkey", F.round("t_solved", 5).alias("t_solved"), "in_range")


@query("invert_calibration_outlier", """
WITH c0 AS (SELECT n_regionkey AS topo, s_suppkey * 1.0 AS t, sum(2.5 + s_suppkey % 5) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS vf
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT * FROM c0 UNION ALL SELECT topo, max(t) + 1, 1e9 FROM c0 GROUP BY topo),
iv AS (SELECT topo, t AS t0, lead(t) OVER w AS t1, vf AS v0, lead(vf) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY topo ORDER BY vf)),
p AS (SELECT c_custkey, n_regionkey AS topo, 5 + abs(c_acctbal) / 7 AS rho FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT c_custkey, max(t0 + (rho - v0) / (v1 - v0) * (t1 - t0)) AS ts FROM p JOIN iv ON p.topo = iv.topo AND rho >= v0 AND rho <= v1 GROUP BY c_custkey)
SELECT p.c_custkey, round(ts, 5) AS t_solved, ts IS NOT NULL AS in_range FROM p LEFT JOIN m USING (c_custkey)
""")
def invert_calibration_outlier(t):
    """One curve point far away from all others widens nothing: the sweep is a sort."""
    c = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("topo"), "s_suppkey", F.col("s_suppkey").cast("double").alias("t"), (F.lit(2.5) + F.col("s_suppkey") % 5).alias("step"))
    curve = running_total(c, ["topo"], ["s_suppkey"], None, "step", out="vf").select("topo", "t", "vf")
    far = curve.groupBy("topo").agg((F.max("t") + 1).alias("t"), F.lit(1e9).alias("vf"))
    pts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("topo"), (F.lit(5) + F.abs("c_acctbal") / 7).alias("rho"))
    out = link.invert_curve(pts, "rho", curve.unionByName(far), keys=["topo"])
    return out.select("c_custkey", F.round("t_solved", 5).alias("t_solved"), "in_range")


@query("link_contained_whole", """
WITH f AS (SELECT DISTINCT p_brand || '_' || p_size AS stem FROM part UNION SELECT DISTINCT substr(p_type, 1, 2) FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT 'no such part'),
n AS (SELECT DISTINCT p_type || ' ' || p_brand || '_' || p_size || '/' || p_name AS name FROM part UNION SELECT DISTINCT substr(p_brand, 1, 7) FROM part UNION SELECT 'PRO'),
m AS (SELECT stem, min(name) AS matched_name FROM f JOIN n ON contains(name, stem) OR contains(stem, name) GROUP BY stem)
SELECT f.stem, matched_name, CASE WHEN matched_name IS NULL THEN 'none' ELSE 'contains' END AS match_kind FROM f LEFT JOIN m USING (stem)
""")
def link_contained_whole(t):
    """All parts on both sides; stems of one gram that very many names have, and names of one gram."""
    code = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_size").cast("string"))
    one = t.part.limit(1)
    f = t.part.select(code.alias("stem")).union(t.part.select(F.substring("p_type", 1, 2))).union(t.part.select("p_name")).union(one.select(F.lit("no such part"))).distinct()
    n = t.part.select(F.concat("p_type", F.lit(" "), code, F.lit("/"), "p_name").alias("name")).union(t.part.select(F.substring("p_brand", 1, 7))).union(one.select(F.lit("PRO")))
    return link.link_contained(f, "stem", n, "name").select("stem", "matched_name", "match_kind")


@query("design_grid", """
WITH b AS (SELECT p_brand, min(p_size) * 1.0 AS lo, max(p_size) * 1.0 AS hi, min(p_retailprice) AS plo, max(p_retailprice) AS phi FROM part GROUP BY p_brand),
c AS (SELECT p_partkey, greatest(lo, least(p_size * 0.9, hi)) AS a0, greatest(lo, least(p_size * 1.1, hi)) AS a1,
        greatest(plo, least(p_retailprice * 0.99, phi)) AS b0, greatest(plo, least(p_retailprice * 1.01, phi)) AS b1 FROM part JOIN b USING (p_brand) WHERE p_type = 'PROMO'),
g AS (SELECT DISTINCT p_partkey, round(a0 + (a1 - a0) * i / 3, 2) AS size_plan, round(b0 + (b1 - b0) * j / 2, 2) AS price_plan FROM c, range(4) r(i), range(3) q(j))
SELECT p_partkey, count(*) AS n_points, count(DISTINCT size_plan) AS n_sizes, count(DISTINCT price_plan) AS n_prices FROM g GROUP BY p_partkey
""")
def design_grid(t):
    b = t.part.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_retailprice").alias("plo"), F.max("p_retailprice").alias("phi"))
    c = t.part.where("p_type = 'PROMO'").join(b, "p_brand")
    grid = link.parameter_grid(c, {"size_plan": (*link.clipped_span("p_size", 0.1, "lo", "hi"), 4), "price_plan": (*link.clipped_span("p_retailprice", 0.01, "plo", "phi"), 3)})
    return grid.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("size_plan").alias("n_sizes"), F.count_distinct("price_plan").alias("n_prices"))


@query("novelty_exact", """
WITH plan AS (SELECT p_partkey, p_size AS D, round(p_retailprice, 1) AS t FROM part WHERE p_partkey % 2 = 0),
built AS (SELECT DISTINCT p_size AS D, round(p_retailprice, 1) AS t FROM part WHERE p_partkey % 2 = 1 OR p_type = 'ECONOMY')
SELECT p_partkey FROM plan WHERE NOT EXISTS (SELECT 1 FROM built WHERE built.D = plan.D AND abs(built.t - plan.t) < 0.001)
""")
def novelty_exact(t):
    def grid(cond):
        return t.part.where(cond).select("p_partkey", F.col("p_size").alias("D"), F.round("p_retailprice", 1).alias("t"))
    return link.novel_exact(grid("p_partkey % 2 = 0"), grid("p_partkey % 2 = 1 OR p_type = 'ECONOMY'"), ["D", "t"]).select("p_partkey")


@query("novelty_range", """
WITH plan AS (SELECT c_custkey, c_nationkey AS topo, abs(c_acctbal) / 20000 + 0.05 AS rho FROM customer),
built AS (SELECT DISTINCT s_nationkey AS topo, round(abs(s_acctbal) / 20000 + 0.05, 4) AS x FROM supplier)
SELECT c_custkey FROM plan WHERE NOT EXISTS (SELECT 1 FROM built WHERE built.topo = plan.topo AND abs(rho - x) <= 0.005)
""")
def novelty_range(t):
    plan = t.customer.select("c_custkey", F.col("c_nationkey").alias("topo"), (F.abs("c_acctbal") / 20000 + 0.05).alias("rho"))
    built = t.supplier.select(F.col("s_nationkey").alias("topo"), (F.abs("s_acctbal") / 20000 + 0.05).alias("rho"))
    return link.novel_range(plan, built, "rho", 0.01, ["topo"]).select("c_custkey")


@query("reference_ratio", """
SELECT s_suppkey, round(s_acctbal / nullif(a, 0), 4) AS ratio FROM supplier LEFT JOIN
(SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS a FROM customer WHERE c_custkey % 3 <> 0) r ON s_suppkey = k
""")
def reference_ratio(t):
    ref = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("a"))
    out = link.reference_ratio(t.supplier, ref, "s_suppkey", {"ratio": ("s_acctbal", "a")})
    return out.select("s_suppkey", F.round("ratio", 4).alias("ratio"))


@query("pair_folders", """
WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size < 3), b AS (SELECT DISTINCT p_name FROM part WHERE p_size > 48)
SELECT coalesce(a.p_name, b.p_name) AS p_name, CASE WHEN b.p_name IS NULL THEN 'left only' WHEN a.p_name IS NULL THEN 'right only' ELSE 'paired' END AS pairing
FROM a FULL JOIN b ON a.p_name = b.p_name
""")
def pair_folders(t):
    return link.pair_by_name(t.part.where("p_size < 3"), t.part.where("p_size > 48"), "p_name")


@query("recover_files", """
WITH f AS (SELECT lower(p_name) AS s, arg_min(p_partkey, p_size * 1000000000::BIGINT + p_partkey) AS k FROM part GROUP BY 1)
SELECT p_partkey, k AS found_path FROM part LEFT JOIN f ON lower(replace(p_name, 'red', 'RED')) = s
""")
def recover_files(t):
    rows = t.part.select("p_partkey", F.replace("p_name", F.lit("red"), F.lit("RED")).alias("stem"))
    inv = t.part.select(F.col("p_name").alias("file_stem"), F.col("p_size").alias("folder_rank"), F.col("p_partkey").alias("path"))
    return link.recover_files(rows, "stem", inv, "file_stem", "folder_rank", "path").select("p_partkey", "found_path")


@query("finalist_lookup", """
WITH f AS (SELECT s_nationkey AS family, min(s_suppkey) AS stem FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey + 100, -1 FROM nation)
SELECT f.family, f.stem, s_acctbal, s_suppkey IS NOT NULL AS found FROM f LEFT JOIN supplier ON s_nationkey = family AND s_suppkey = stem
""")
def finalist_lookup(t):
    f = t.supplier.groupBy(F.col("s_nationkey").alias("family")).agg(F.min("s_suppkey").alias("stem"))
    f = f.unionByName(t.nation.select((F.col("n_nationkey") + 100).alias("family"), F.lit(-1).cast("long").alias("stem")))
    cand = t.supplier.select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("stem"), "s_acctbal")
    return link.lookup_finalists(f, cand).select("family", "stem", "s_acctbal", "found")


@query("union_shared_columns", """
SELECT c_custkey AS k, c_acctbal AS bal, 'customer' AS family FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier
""")
def union_shared_columns(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), "c_mktsegment", F.lit("customer").alias("family"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), "s_name", F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("family"))
    return setops.union_shared(a, b)


@query("union_carry_columns", """
SELECT c_custkey AS k, c_mktsegment, NULL AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier
""")
def union_carry_columns(t):
    return setops.union_carry(t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"))


@query("union_keep_first", """
WITH a AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v, 'into' AS from_run FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
b AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v, 'other' AS from_run FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus)
""")
def union_keep_first(t):
    def best(cond):
        return t.orders.where(cond).groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    return setops.union_keep_first(best("o_orderpriority = '1-URGENT'"), best("o_orderpriority <> '1-URGENT'"), ["o_custkey", "o_orderstatus"], "into", "other")


@query("holdout_score_union", """
SELECT split, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'Grouped5foldCV' ELSE 'holdout_' || l_linestatus END AS split FROM lineitem
UNION ALL SELECT 'grouped' || o_orderstatus FROM orders) WHERE lower(split) NOT LIKE '%grouped%' GROUP BY split
""")
def holdout_score_union(t):
    a = t.lineitem.select(F.when(F.col("l_returnflag") == "A", F.lit("Grouped5foldCV")).otherwise(F.concat(F.lit("holdout_"), "l_linestatus")).alias("split"))
    b = t.orders.select(F.concat(F.lit("grouped"), "o_orderstatus").alias("split"))
    return setops.holdout_scores(a, b).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("union_candidate_families", """
SELECT c_custkey AS k, 'customer' AS family, 'NEW' AS source, c_acctbal AS density FROM customer UNION ALL
SELECT s_suppkey, 'supplier', 'NEW', s_acctbal FROM supplier
""")
def union_candidate_families(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("p_rel"), F.lit(0.0).alias("vf"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("vf"))
    return setops.union_families([("customer", a), ("supplier", b)], ["p_rel", "vf"], "NEW").select("k", "family", "source", "density")


@query("group_column_check", """
WITH c AS (SELECT count(*) AS n, count(nullif(trim(lang), '')) AS lang, count(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source END), '')) AS source, 0 AS dead FROM documents)
SELECT u.column, u.known, CASE WHEN u.known = 0 THEN 'dead' WHEN u.known < n THEN 'partial' ELSE 'full' END AS state
FROM (SELECT n, 'lang' AS "column", lang AS known FROM c UNION ALL SELECT n, 'source', source FROM c UNION ALL SELECT n, 'dead', CAST(dead AS BIGINT) FROM c) u
""")
def group_column_check(t):
    d = t.documents.select("lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"), F.lit(None).cast("string").alias("dead"))
    return setops.group_column_check(d, ["lang", "source", "dead"])
