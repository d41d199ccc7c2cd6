"""Ordered work that never sorts a whole group in one task.

Each helper splits a group into value buckets that depend on the row alone, sums the buckets
(pre-aggregated before the shuffle), and adds bucket offsets back. A group that holds a third of
all rows is therefore spread over many tasks, and the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trabecula.functions.core import any_of, col, null_safe_join, order_bucket, spread_join
from trabecula.session import cut_lineage, written


#: Rows that one ordered bucket should hold.
BUCKET_ROWS = 1 << 16


def keep_one(df: DataFrame, keys: list[str], order: list[str | Column], prefer: str = "min") -> DataFrame:
    """One whole row per key: the smallest (or largest) by `order`. Combines before the shuffle."""
    pick = F.min_by if prefer == "min" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("__row")
    )
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def running_total(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column | None,
                  value: str | Column | None = None, out: str = "running", total: str | None = None, spread: bool = False) -> DataFrame:
    """Inclusive running sum of `value` per key in `order`; `bucket` must not decrease along `order`.

    With the default value it is the row position 1..n. `total` adds the whole-group sum. Give a bucket where
    one is known to spread the rows (hashes, ids, stamps). Without one the rows are range-partitioned on keys and
    order and checkpointed, which also splits a group whose leading order value is the same for most rows.
    `spread` is for rows that come out of an explode (`spread_join`).
    """
    if bucket is None:
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *[col(c) for c in order])
        rows = cut_lineage(ranged.withColumn("__b", F.spark_partition_id()))
    else:
        rows = df.withColumn("__b", bucket)
    rows = rows.withColumn("__v", F.lit(1) if value is None else col(value))
    bk = [*keys, "__b"]
    by_bucket = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*bk).agg(F.sum("__v").alias("__s"))
    sums = sums.select(*bk, (F.sum("__s").over(by_bucket) - F.col("__s")).alias("__off"),
                       F.sum("__s").over(Window.partitionBy(*keys)).alias("__tot"))
    inside = Window.partitionBy(*bk).orderBy(*[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum("__v").over(inside))
    res = (spread_join if spread else null_safe_join)(rows, sums, bk).withColumn(out, F.col("__off") + F.col("__in"))
    if total:
        res = res.withColumn(total, F.col("__tot"))
    return res.drop("__b", "__v", "__in", "__off", "__tot")


def with_bucket(df: DataFrame, value: str | Column, out: str = "__b") -> DataFrame:
    """Adds a bucket number that does not decrease with `value` and holds about BUCKET_ROWS rows.

    Logarithmic buckets are cut by their own extremes and row counts, so values in a narrow band (time stamps) are spread as well. The counts are
    combined before the shuffle; the join with them is null-safe, which leaves its skew to adaptive execution.
    """
    rows = df.withColumn("__v", col(value).cast("double")).withColumn("__c", order_bucket("__v"))
    ends = rows.groupBy("__c").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("__n"))
    rows = spread_join(rows, ends, ["__c"])
    part = F.least(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * F.col("__n")), F.col("__n") - 1)
    return rows.withColumn(out, F.col("__c") * (1 << 31) + F.coalesce(part, F.lit(0))).drop("__v", "__c", "__lo", "__hi", "__n")


def neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column | None = None) -> DataFrame:
    """Consecutive row pairs per key: columns `cur` and `nxt` are structs of `cols`. Without a bucket the first order value is spread by `with_bucket`."""
    if bucket is None:
        df, bucket = with_bucket(df, order[0], "__own"), F.col("__own")
    rows = df.select(*keys, bucket.alias("__b"), F.struct(*[F.col(c) for c in order]).alias("__o"),
                     F.struct(*[F.col(c) for c in cols]).alias("cur"))
    bk = [*keys, "__b"]
    inside = rows.withColumn("nxt", F.lead("cur").over(Window.partitionBy(*bk).orderBy("__o")))
    ends = rows.groupBy(*bk).agg(F.max_by("cur", "__o").alias("cur"), F.min_by("cur", "__o").alias("first"))
    across = ends.withColumn("nxt", F.lead("first").over(Window.partitionBy(*keys).orderBy("__b")))
    pick = [*keys, "cur", "nxt"]
    return inside.select(*pick).unionByName(across.select(*pick)).where(F.col("nxt").isNotNull())


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float],
                    names: list[str], count: str | None = None, many: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    First pass: bucket histogram. Second pass: only the rows of the buckets that hold a wanted rank. `many` is for a great many keys, most of few
    rows: keys of up to BUCKET_ROWS rows are sorted whole, which shuffles rows once, and only the larger ones take the passes.
    """
    base = df.select(*keys, col(value).cast("double").alias("__v"))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if not many:
        return _by_histogram(base, keys, probs, names, count)
    large = written(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BUCKET_ROWS).select(*keys))
    if large.isEmpty():
        return _by_sorting(base, keys, probs, names, count)
    few, rest = (null_safe_join(base, large.hint("merge"), keys, how) for how in ("left_anti", "left_semi"))
    return _by_sorting(few, keys, probs, names, count).unionByName(_by_histogram(rest, keys, probs, names, count))


def _rank(p: float) -> Column:
    return F.floor(F.lit(p) * (F.col("__tot") - 1)).cast("long")


def _next(p: float) -> Column:
    return F.least(_rank(p) + 1, F.col("__tot") - 1)


def _interpolated(keys: list[str], probs: list[float], names: list[str], count: str | None) -> list[Column]:
    """From __tot and, per wanted quantile i, the values __a{i} and __z{i} around it."""
    out = [F.col(k) for k in keys]
    for i, (p, name) in enumerate(zip(probs, names)):
        frac = F.lit(p) * (F.col("__tot") - 1) - _rank(p)
        out.append((F.col(f"__a{i}") + (F.col(f"__z{i}") - F.col(f"__a{i}")) * frac).alias(name))
    return [*out, F.col("__tot").alias(count)] if count else out


def _by_sorting(base: DataFrame, keys: list[str], probs: list[float], names: list[str], count: str | None) -> DataFrame:
    own = Window.partitionBy(*keys)
    at = base.withColumn("__at", F.row_number().over(own.orderBy("__v")) - 1).withColumn("__tot", F.count(F.lit(1)).over(own))
    aggs = [F.max("__tot").alias("__tot")]
    for i, p in enumerate(probs):
        aggs += [F.max(F.when(F.col("__at") == r, F.col("__v"))).alias(f"__{n}{i}") for n, r in (("a", _rank(p)), ("z", _next(p)))]
    return at.groupBy(*keys).agg(*aggs).select(*_interpolated(keys, probs, names, count))


def _by_histogram(base: DataFrame, keys: list[str], probs: list[float], names: list[str], count: str | None) -> DataFrame:
    base = with_bucket(base.withColumnRenamed("__v", "__q"), "__q").withColumnRenamed("__q", "__v")
    bk = [*keys, "__b"]
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = base.groupBy(*bk).agg(F.count(F.lit(1)).alias("__n")).select(
        *bk, F.sum("__n").over(upto).alias("__hi"), "__n",
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__tot"))
    hist = hist.withColumn("__lo", F.col("__hi") - F.col("__n"))

    def holds(r: Column, lo: str, hi: str) -> Column:
        return (r >= F.col(lo)) & (r < F.col(hi))

    want = hist.where(any_of([holds(r(p), "__lo", "__hi") for p in probs for r in (_rank, _next)]))
    hit = spread_join(base, want.select(*bk, "__lo", "__tot"), bk)
    hit = hit.groupBy(*bk, "__lo", "__tot", "__v").agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*bk).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("__e", F.col("__lo") + F.sum("__n").over(inside)).withColumn("__s", F.col("__e") - F.col("__n"))
    aggs = [F.max("__tot").alias("__tot")]
    for i, p in enumerate(probs):
        aggs.append(F.max(F.when(holds(_rank(p), "__s", "__e"), F.col("__v"))).alias(f"__a{i}"))
        aggs.append(F.max(F.when(holds(_next(p), "__s", "__e"), F.col("__v"))).alias(f"__z{i}"))
    got = hit.groupBy(*keys).agg(*aggs)
    return got.select(*_interpolated(keys, probs, names, count))


def bracket(points: DataFrame, x: str | Column, knots: DataFrame, at: str, keys: list[str] = ()) -> DataFrame:
    """Adds to each point the structs `before`, the last knot of its key at or below x, and `after`, the first one above (null: none, or x is null).

    A sweep: the distinct values of the points and the knots (unique per key and `at`) are cut into ranges together, each range looks at its own rows, and
    what a range lacks comes over its border from the nearest range that has a knot. The work is one sort whatever the distances between knots, and a
    value that many points share is looked up once.
    """
    keys, row = list(keys), F.struct(*knots.columns)
    at_x = col(x).cast("double")
    wanted = points.select(*keys, at_x.alias("__x")).where(F.col("__x").isNotNull()).distinct()
    given = knots.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("__x"), row.alias("__k"))
    both = given.unionByName(wanted, allowMissingColumns=True).withColumn("__point", F.col("__k").isNull())
    rows = written(both.repartitionByRange(*[F.col(k) for k in keys], F.col("__x"), F.col("__point")).withColumn("__b", F.spark_partition_id()))
    bk = [*keys, "__b"]
    up, down = (Window.partitionBy(*bk).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ([F.asc("__x"), F.asc("__point")], [F.desc("__x"), F.desc("__point")]))
    inside = rows.withColumns({"__lo": F.last("__k", True).over(up), "__hi": F.last("__k", True).over(down)}).where("__point").drop("__k", "__point")
    ends = rows.groupBy(*bk).agg(F.min_by("__k", F.when(~F.col("__point"), F.col("__x"))).alias("__first"), F.max_by("__k", F.when(~F.col("__point"), F.col("__x"))).alias("__last"))
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__b"), F.desc("__b")))
    ends = ends.select(*bk, F.last("__last", True).over(back).alias("__left"), F.last("__first", True).over(ahead).alias("__right"))
    found = null_safe_join(inside, ends, bk).select(*keys, "__x", F.coalesce("__lo", "__left").alias("before"), F.coalesce("__hi", "__right").alias("after"))
    return null_safe_join(points.withColumn("__x", at_x), found, [*keys, "__x"], "left").drop("__x")


def interval_join(points: DataFrame, x: str | Column, spans: DataFrame, lo: str, hi: str, width: float | Column,
                  keys: list[str] = (), closed: str = "left", how: str = "inner") -> DataFrame:
    """Join points to the spans that hold them through equal bucket numbers, not a nested loop.

    closed: 'left' is lo <= x < hi, 'both' is lo <= x <= hi. Spans should be of bounded length / width.
    """
    w = width if isinstance(width, Column) else F.lit(float(width))
    p = points.withColumn("__x", col(x).cast("double")).withColumn("__pb", F.floor(F.col("__x") / w))
    s = spans.select([F.col(c).alias(f"__k_{c}" if c in keys else c) for c in spans.columns])
    s = s.withColumn("__sb", F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor(F.col(hi) / w))))
    upper = F.col("__x") < F.col(hi) if closed == "left" else F.col("__x") <= F.col(hi)
    cond = (F.col("__pb") == F.col("__sb")) & (F.col("__x") >= F.col(lo)) & upper
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return p.join(s, cond, how).drop("__x", "__pb", "__sb", *[f"__k_{k}" for k in keys])
