"""Record linkage between features, labels, tensors and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import col, null_safe_join, number, ratio, spread_join
from trabecula.functions.names import strip_suffix
from trabecula.operators.ordered import bracket, keep_one

# Share of unmatched rows above which a join is refused, slack of a measured range, suffix an alias may carry.
MAX_UNMATCHED = 0.20
RANGE_SLACK = 1e-9
#: Characters of the grams that contains-matching looks names up by.
GRAM = 3
ALIAS_SUFFIX = " Generator"


def link_by_stem(features: DataFrame, labels: DataFrame, file_col: str = "file", run_col: str = "Run",
                 how: str = "inner") -> DataFrame:
    """Features and labels whose file stem equals the run name ('left_anti': features without a label)."""
    f = features.withColumn("__stem", strip_suffix(file_col))
    l = labels.withColumn("__run", strip_suffix(run_col))
    return f.join(l, F.col("__stem") == F.col("__run"), how).drop("__stem", "__run")


def link_by_params(features: DataFrame, labels: DataFrame, stem: str, run: str, params: list[str],
                   seq: str) -> DataFrame:
    """Exact stem first; the rest by parsed parameters, where nulls are equal and the last label wins.

    Both tables carry the parameter columns. Adds `match_kind` (exact | params | none).
    """
    other = [c for c in labels.columns if c not in params and c != run]
    names = labels.select(F.col(run).alias("__run"), *other)
    exact = features.join(names.hint("merge"), F.col(stem) == F.col("__run"), "inner").withColumn("match_kind", F.lit("exact"))
    rest = features.join(labels.select(F.col(run).alias("__run")).hint("merge"), F.col(stem) == F.col("__run"), "left_anti")
    by_key = keep_one(labels.select(*params, F.col(run).alias("__run"), *other), params, [seq], "max")
    loose = spread_join(rest, by_key, params, "left")
    loose = loose.withColumn("match_kind", F.when(F.col("__run").isNotNull(), F.lit("params")).otherwise(F.lit("none")))
    return exact.unionByName(loose).withColumnRenamed("__run", "matched_run")


def match_guard(linked: DataFrame, matched: str | Column, max_unmatched: float = MAX_UNMATCHED) -> DataFrame:
    """One row (total, matched, unmatched, verdict); the caller decides whether to stop."""
    m = F.coalesce(col(matched), F.lit(False))
    one = linked.agg(F.count(F.lit(1)).alias("total"), F.count_if(m).alias("matched"), F.count_if(~m).alias("unmatched"))
    share = ratio("unmatched", "total")
    verdict = (F.when(F.col("total") == 0, "empty input").when(F.col("matched") == 0, "nothing joined")
               .when(share > max_unmatched, "too many unmatched").otherwise("ok"))
    return one.withColumn("verdict", verdict)


def density_key(c: str | Column, digits: int = 2) -> Column:
    """Density rounded for equality, as a decimal."""
    return F.bround(number(c), digits).cast(f"decimal(12,{digits})")


def link_tensors(features: DataFrame, tensors: DataFrame, how: str = "left") -> DataFrame:
    """Tensors by (topology, density at two decimals). Both sides carry `topology` and `density`."""
    f = features.withColumn("__d", density_key("density"))
    t = tensors.withColumn("__d", density_key("density")).drop("density")
    t = t.withColumnRenamed("topology", "__topo")
    cond = (F.col("topology") == F.col("__topo")) & (f["__d"] == t["__d"])
    out = f.join(t, cond, how)
    return out.drop("__topo").drop(f["__d"]).drop(t["__d"]) if how not in ("left_anti", "left_semi") else out.drop("__d")


def with_aliases(index: DataFrame, name: str, keys: list[str], order: list[str], suffix: str = ALIAS_SUFFIX) -> DataFrame:
    """Each name also answers to its alias; an entry stored under the exact name always wins."""
    alias = F.concat(F.col(name), F.lit(suffix))
    spelled = F.array(F.struct(F.col(name).alias("n"), F.lit(0).alias("p")),
                      F.struct(F.when(~F.col(name).endswith(suffix), alias).alias("n"), F.lit(1).alias("p")))
    rows = index.withColumn("__a", F.explode(spelled)).where(F.col("__a.n").isNotNull())
    rows = rows.withColumns({name: F.col("__a.n"), "alias_rank": F.col("__a.p")}).drop("__a")
    return keep_one(rows, [name, *keys], ["alias_rank", *order], "min")


def prefer_first(rows: DataFrame, sources: list[tuple[str, DataFrame]], keys: list[str], value: str,
                 out: str = "source") -> DataFrame:
    """The value from the first source that has one, and which source that was."""
    picks = []
    for name, table in sources:
        t = table.select(*keys, F.col(value).alias(f"__v_{name}")).where(F.col(f"__v_{name}").isNotNull())
        rows = null_safe_join(rows, keep_one(t, keys, [f"__v_{name}"]), keys, "left")
        picks.append((name, F.col(f"__v_{name}")))
    rows = rows.withColumn(value, F.coalesce(*[v for _, v in picks]))
    rows = rows.withColumn(out, F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in picks]))
    return rows.drop(*[f"__v_{n}" for n, _ in picks])


def _grams(df: DataFrame, c: str, sizes: Column) -> DataFrame:
    """`df` with one row per distinct gram of column c, of each length in the array `sizes`."""
    def cut(k: Column) -> Column:
        return F.when(k <= F.length(c), F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, k))).otherwise(F.array().cast("array<string>"))

    return df.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.transform(sizes, cut)))))


def contained_pairs(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """(needle, hay) for distinct needles that lie inside distinct hays, by an inverted table of the hays' grams.

    A needle looks up its rarest gram only, and meets just the hays that have it. A needle no longer than a gram is a gram itself: it never meets
    the hays, but takes the smallest hay that its gram has, which stands for all of them. A gram that the hays lack ends its needle.
    """
    size = F.least(F.length(needle), F.lit(GRAM))
    sizes = [r[0] for r in needles.select(size.alias("k")).where("k IS NOT NULL").distinct().collect()]  # at most GRAM + 1 of them
    listed = _grams(hays, hay, F.array(*[F.lit(k) for k in sizes]) if sizes else F.array().cast("array<int>"))
    known = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min(hay).alias("least"))
    own = _grams(needles, needle, F.array(size)).join(known, "gram", "left")
    rarest = own.groupBy(needle).agg(F.count_if(F.col("df").isNull()).alias("missing"), F.min(F.struct("df", "gram", "least")).alias("pick")).where("missing = 0")
    whole = rarest.where(F.length(needle) <= GRAM).select(needle, F.col("pick.least").alias(hay))
    probe = rarest.where(F.length(needle) > GRAM).select(needle, F.col("pick.gram").alias("gram"))
    met = probe.join(listed, "gram").where(F.contains(F.col(hay), F.col(needle))).select(needle, hay)
    return whole.unionByName(met)


def link_contained(rows: DataFrame, stem: str, names: DataFrame, name: str) -> DataFrame:
    """For the rows left over by the exact joins, the first name that contains the stem or lies inside it.

    A short name is met by every stem that has it as a gram; other pairs only by the rarest gram of the shorter side. Minima are taken before the shuffle.
    """
    probe = rows.select(F.col(stem).alias("__s")).where(F.col("__s").isNotNull()).distinct()
    index = names.select(F.col(name).alias("__n")).where(F.col("__n").isNotNull()).distinct()
    around = contained_pairs(probe, "__s", index, "__n")
    short, long = index.where(F.length("__n") <= GRAM), index.where(F.length("__n") > GRAM)
    inside = contained_pairs(long, "__n", probe, "__s").select("__s", "__n")
    tiny = _grams(probe, "__s", F.sequence(F.lit(0), F.lit(GRAM))).join(short, F.col("gram") == F.col("__n")).select("__s", "__n")
    best = around.unionByName(inside).unionByName(tiny).groupBy("__s").agg(F.min("__n").alias("matched_name"))
    out = rows.join(best, F.col(stem) == F.col("__s"), "left").drop("__s")
    return out.withColumn("match_kind", F.when(F.col("matched_name").isNotNull(), F.lit("contains")).otherwise(F.lit("none")))


def attach_missing(df: DataFrame, key_table: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Left join the wanted columns the table does not have yet; one row per key."""
    add = [c for c in wanted if c in key_table.columns and c not in df.columns]
    if not add:
        return df
    return df.join(keep_one(key_table.select(key, *add), [key], add), key, "left")


def compare_full(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer comparison with `<m>_before`, `<m>_after`, `<m>_delta`."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in measures])
    a = after.select(*keys, *[F.col(m).alias(f"{m}_after") for m in measures])
    out = b.join(a, keys, "full")
    return out.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def reconcile(on_disk: DataFrame, master: DataFrame, keys: list[str] = ("Run", "Batch")) -> DataFrame:
    """Runs on disk that the master lacks, by class (no result | no metadata | missing)."""
    keys = list(keys)
    gone = null_safe_join(on_disk, master.select(*keys).distinct(), keys, "left_anti")
    kind = (F.when(~F.coalesce(F.col("has_result"), F.lit(False)), "no result")
            .when(~F.coalesce(F.col("has_metadata"), F.lit(False)), "no metadata").otherwise("missing"))
    return gone.withColumn("gap", kind)


def completeness(rows: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """One row per run with its problems: columns the table lacks and values that are empty."""
    have = set(rows.columns)
    probs = [F.lit(f"column {c} not in summary") if c not in have else
             F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull(), F.lit(f"{c} EMPTY")) for c in required]
    listed = F.array_compact(F.array(*probs)) if probs else F.array().cast("array<string>")
    out = rows.select(*key, listed.alias("problems"))
    return out.withColumn("n_problems", F.size("problems").cast("long")).withColumn("complete", F.size("problems") == 0)


def novel_exact(plan: DataFrame, built: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """J13 (gate 5): planned points that do not exist yet, compared at `digits` decimals."""
    b = built.select(*[F.bround(number(k), digits).alias(f"__{k}") for k in keys]).distinct()
    cond = [F.bround(F.col(k), digits) == F.col(f"__{k}") for k in keys]
    out = cond[0]
    for c in cond[1:]:
        out = out & c
    return plan.join(b, out, "left_anti")


def novel_range(plan: DataFrame, built: DataFrame, x: str, step: float, keys: list[str] = (), digits: int = 4) -> DataFrame:
    """J14 (gate 5): planned points with nothing built within half a step."""
    half, keys = step / 2.0, list(keys)
    b = built.select(*[F.col(k).alias(f"__{k}") for k in keys], F.bround(number(x), digits).alias("__x")).distinct()
    b = b.where(F.col("__x").isNotNull())
    b = b.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__x") / half) - 1, F.floor(F.col("__x") / half) + 1)))
    cond = (F.floor(F.col(x) / half) == F.col("__b")) & (F.abs(F.col(x) - F.col("__x")) <= half)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return plan.join(b, cond, "left_anti")


def nearest(targets: DataFrame, x: str, lookup: DataFrame, value: str, carry: list[str] = ()) -> DataFrame:
    """Closest lookup row per target, the smaller value on a tie. A sweep over targets and lookup values together."""
    names = [value, *carry]
    uniq = keep_one(lookup.select(*names).where(F.col(value).isNotNull()), [value], [value])
    got = bracket(targets.withColumn("__at", F.col(x).cast("double")), "__at", uniq, value)
    low, high = F.col("before"), F.col("after")
    closer = F.col("__at") - low[value] <= high[value] - F.col("__at")
    pick = F.when(F.col("__at").isNull(), None).when(low.isNull(), high).when(high.isNull() | closer, low).otherwise(high)
    return got.withColumn("__pick", pick).select(*targets.columns, *[F.col(f"__pick.{n}").alias(f"near_{n}") for n in names])


def invert_curve(points: DataFrame, rho: str, curve: DataFrame, t: str = "t", vf: str = "vf", keys: list[str] = ()) -> DataFrame:
    """T at which the measured curve reaches rho, linear between neighbours, by a sweep over requests and curve points together.

    Of curve points with one vf the largest t ends the step before a request above it and the smallest t the step behind a request below it. Requests outside
    the measured range (beyond RANGE_SLACK) keep a null t and in_range = false. Curve points without vf or t don't count.
    """
    keys = list(keys)
    usable = curve.where(F.col(vf).isNotNull() & F.col(t).isNotNull()).select(*keys, F.col(vf).cast("double").alias("v"), F.col(t).cast("double").alias("t"))
    knots = usable.groupBy(*keys, "v").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    got = bracket(points.withColumn("__rho", F.col(rho).cast("double")), "__rho", knots, "v", keys)
    lo, hi, at = F.col("before"), F.col("after"), F.col("__rho")
    between = lo["t_last"] + (at - lo["v"]) / (hi["v"] - lo["v"]) * (hi["t_first"] - lo["t_last"])
    solved = (F.when(lo.isNotNull() & hi.isNotNull(), between).when(lo.isNotNull() & (at - lo["v"] < RANGE_SLACK), lo["t_last"])
              .when(hi.isNotNull() & (hi["v"] - at <= RANGE_SLACK), hi["t_first"]))
    return got.withColumn("t_solved", solved).select(*points.columns, "t_solved").withColumn("in_range", F.col("t_solved").isNotNull())


def parameter_grid(centres: DataFrame, axes: dict[str, tuple[Column, Column, int]], digits: int = 2) -> DataFrame:
    """Grid of evenly spaced, rounded, distinct values around each centre row.

    axes: output name -> (low, high, points); the bounds are columns of `centres`, already clipped.
    """
    for name, (lo, hi, n) in axes.items():
        steps = F.sequence(F.lit(0), F.lit(n - 1))
        line = F.transform(steps, lambda i: F.bround(lo + (hi - lo) * i / F.lit(float(max(n - 1, 1))), digits))
        centres = centres.withColumn(name, F.explode(F.array_distinct(line)))
    return centres


def clipped_span(centre: str | Column, fraction: float, lo: str | Column, hi: str | Column) -> tuple[Column, Column]:
    """Centre -/+ a fraction, kept inside the sampled range."""
    c, lo, hi = col(centre), col(lo), col(hi)
    def clip(v):
        return F.least(F.greatest(v, lo), hi)
    return clip(c * (1 - fraction)), clip(c * (1 + fraction))


def reference_ratio(ours: DataFrame, reference: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratio columns (name -> our column, reference column) by left join."""
    out = ours.join(reference, key, "left")
    return out.withColumns({n: ratio(a, b) for n, (a, b) in pairs.items()})


def lookup_finalists(finalists: DataFrame, candidates: DataFrame, keys: list[str] = ("family", "stem")) -> DataFrame:
    """Finalists back to their full candidate rows; `found` is false when one has vanished."""
    return finalists.join(candidates.withColumn("__hit", F.lit(True)), list(keys), "left") \
        .withColumn("found", F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


def pair_by_name(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Full join of two inventories; `pairing` says paired, left only or right only."""
    l, r = left.select(name).distinct().withColumn("__l", F.lit(1)), right.select(name).distinct().withColumn("__r", F.lit(1))
    state = (F.when(F.col("__r").isNull(), "left only").when(F.col("__l").isNull(), "right only").otherwise("paired"))
    return l.join(r, name, "full").select(name, state.alias("pairing"))


def recover_files(rows: DataFrame, stem: str, inventory: DataFrame, file_stem: str, folder_rank: str, path: str) -> DataFrame:
    """Path of each row's file; the first folder that holds it wins, case ignored."""
    inv = inventory.select(F.lower(F.col(file_stem)).alias("__s"), F.col(folder_rank).alias("__r"), F.col(path).alias("found_path"))
    inv = keep_one(inv, ["__s"], ["__r", "found_path"]).drop("__r")
    return rows.join(inv, F.lower(F.col(stem)) == F.col("__s"), "left").drop("__s")

