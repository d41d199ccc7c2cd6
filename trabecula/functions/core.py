"""Column helpers shared by every operator: missing values, safe arithmetic, order buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text or number to double; text that is no number, NaN and blanks become null (the cast trims text)."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def text(c: str | Column) -> Column:
    """Trimmed text with blanks as null."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def finite(c: str | Column) -> Column:
    """Null out NaN in a double column."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero or either side is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent_diff(a: str | Column, b: str | Column) -> Column:
    """100 (a - b) / b."""
    return ratio(col(a) - col(b), b) * 100.0


def is_close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def order_bucket(c: str | Column, per_octave: int = 1024) -> Column:
    """Non-decreasing bucket number of a finite double: `per_octave` buckets per power of two.

    It depends on the value alone, so both branches of a plan and every retry agree on it.
    """
    c = col(c).cast("double")
    size = F.floor(F.log2(F.abs(c)) * per_octave) + 1100 * per_octave
    return F.when(c == 0, F.lit(0).cast("long")).when(c > 0, size).otherwise(-size)


def hash_order(seed: int, *cols: str | Column) -> Column:
    """Seeded pseudo-random order that every run and every executor repeats."""
    return F.xxhash64(F.lit(seed), *[col(c) for c in cols])


def hash_bucket(h: str | Column) -> Column:
    """Leading 16 bits of a 64-bit hash order (65 536 buckets, non-decreasing)."""
    return F.shiftright(col(h), 48)


def hash_uniform(seed: int, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) from a hash: 52 bits."""
    return F.shiftrightunsigned(hash_order(seed, *cols), 12).cast("double") / float(1 << 52)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right key columns are dropped."""
    r = right.select([F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    cond = all_of([F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`null_safe_join` that shuffles both sides whatever their estimated size.

    Rows that come out of an explode are estimated at the size of the rows that went in, so the planner would send millions of them through the
    driver as a broadcast.
    """
    return null_safe_join(left, right.hint("merge"), keys, how)


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Texts whose condition holds, joined with '; ' (empty text when none does)."""
    texts = [F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]
    return F.concat_ws("; ", *texts)
