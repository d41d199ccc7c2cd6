"""Unions that keep or drop columns on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import text
from trabecula.operators.ordered import keep_one

# Fixed value: solid Poisson ratios further apart than this cannot share a model.
NU_TOLERANCE = 0.01


def column_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column, side (shared | left only | right only), from the two schemas."""
    left, right = set(a.columns), set(b.columns)
    rows = [(c, "shared" if c in right else "left only") for c in a.columns] + [(c, "right only") for c in b.columns if c not in left]
    return a.sparkSession.createDataFrame(rows, "column string, side string")


def union_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared columns only, in the left table's order."""
    shared = [c for c in a.columns if c in set(b.columns)]
    return a.select(*shared).unionByName(b.select(*shared))


def union_carry(a: DataFrame, b: DataFrame) -> DataFrame:
    """No column is ever dropped; the side that lacks one gets nulls."""
    return a.unionByName(b, allowMissingColumns=True)


def union_keep_first(into: DataFrame, other: DataFrame, keys: list[str], into_name: str, other_name: str,
                     provenance: str = "from_run") -> DataFrame:
    """One row per key, the `into` table wins; the row says where it came from."""
    both = into.withColumns({"__p": F.lit(0), provenance: F.lit(into_name)}).unionByName(
        other.withColumns({"__p": F.lit(1), provenance: F.lit(other_name)}), allowMissingColumns=True)
    return keep_one(both, keys, ["__p"]).drop("__p")


def holdout_scores(*tables: DataFrame, split: str = "split") -> DataFrame:
    """U4: all score rows except those of grouped cross-validation."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.where(~F.coalesce(F.lower(F.col(split)).contains("grouped"), F.lit(False)))


def union_families(frames: list[tuple[str, DataFrame]], density_columns: list[str], source: str) -> DataFrame:
    """Candidate tables of several families with one `density` column.

    Per table the first density column that exists is used for all its rows.
    """
    out = None
    for family, d in frames:
        pick = next(c for c in density_columns if c in d.columns)
        d = d.withColumns({"family": F.lit(family), "source": F.lit(source), "density": F.col(pick)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def merge_guard(a: DataFrame, b: DataFrame, targets: list[str], nu_a: float | None, nu_b: float | None,
                order_a: str | None, order_b: str | None) -> DataFrame:
    """One row per guard with severity ok | warn | fail; the caller decides what to do with it."""
    missing = [t for t in targets if t not in a.columns or t not in b.columns]
    rows = [("shared targets", "fail" if missing else "ok", ", ".join(missing))]
    if nu_a is None or nu_b is None:
        rows.append(("poisson ratio", "fail", "not recorded"))
    else:
        off = abs(nu_a - nu_b) > NU_TOLERANCE
        rows.append(("poisson ratio", "fail" if off else "ok", f"{nu_a} vs {nu_b}"))
    known = bool(order_a and order_b)
    mixed = known and order_a.lower() != order_b.lower()
    rows.append(("element order", "ok" if known and not mixed else "warn", f"{order_a} vs {order_b}"))
    return a.sparkSession.createDataFrame(rows, "guard string, severity string, detail string")


def group_column_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per grouping column: dead (no value at all), partial or full."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(text(c)).alias(c) for c in cols])
    long = one.unpivot(["__n"], cols, "column", "known")
    state = F.when(F.col("known") == 0, "dead").when(F.col("known") < F.col("__n"), "partial").otherwise("full")
    return long.select("column", "known", state.alias("state"))


def row_key(cols: list[str]):
    """Grouping key of a row; missing parts read 'NA'."""
    return F.concat_ws("|", *[F.coalesce(text(c), F.lit("NA")) for c in cols])
