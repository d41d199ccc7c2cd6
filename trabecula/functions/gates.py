"""Row gates and predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import all_of, any_of, col, is_close, number, ratio, reasons

#: The holdout language: a bound (>x, >=x, <x, <=x), a range (x..y, ends included), or one value.
_VALUE = re.compile(r"(?P<side>[<>])(?P<closed>=?)(?P<bound>.*)|(?P<low>.*?)\.\.(?P<high>.*)|(?P<one>.*)", re.DOTALL)


def usable(status: str | Column, exact: bool = False) -> Column:
    """Status starts with 'OK' (missing counts as OK); `exact` asks for 'OK' alone."""
    s = F.coalesce(col(status), F.lit("OK"))
    return F.upper(s) == "OK" if exact else s.startswith("OK")


@dataclass(frozen=True)
class Holdout:
    """One 'name|column|value' spec."""

    name: str
    column: str
    value: str


def parse_holdouts(specs: list[str]) -> list[Holdout]:
    """Specs that do not have three fields are ignored."""
    split = [[p.strip() for p in s.split("|")] for s in specs if s]
    return [Holdout(*p) for p in split if len(p) == 3]


class Limits(NamedTuple):
    """Numbers between two ends (null: no end); `open` leaves the ends out, equal ends stand for one number."""

    low: float | None
    high: float | None
    open: bool = False


def holdout_limits(value: str) -> Limits | str | None:
    """The numbers a holdout value stands for, its text when it is no number, or None when a bound or range has no numbers."""
    part = _VALUE.fullmatch(value.strip()).groupdict()
    try:
        if part["side"]:
            end = float(part["bound"])
            return Limits(end, None, not part["closed"]) if part["side"] == ">" else Limits(None, end, not part["closed"])
        if part["low"] is not None:
            return Limits(float(part["low"]), float(part["high"]))
    except ValueError:
        return None
    try:
        return Limits(float(part["one"]), float(part["one"]))
    except ValueError:
        return part["one"]


def _holds(value: Column, limits: Limits) -> Column:
    if limits.low is not None and limits.low == limits.high:
        return is_close(value, F.lit(limits.low))
    beyond = [value > limits.low if limits.open else value >= limits.low] if limits.low is not None else []
    below = [value < limits.high if limits.open else value <= limits.high] if limits.high is not None else []
    return all_of(beyond + below)


def holdout_filter(df: DataFrame, spec: Holdout) -> Column | None:
    """The rows a holdout hides as a filter, or None when the spec cannot apply to this table."""
    limits = holdout_limits(spec.value)
    if limits is None or spec.column not in df.columns:
        return None
    hidden = F.trim(F.col(spec.column).cast("string")) == limits if isinstance(limits, str) else _holds(number(spec.column), limits)
    return F.coalesce(hidden, F.lit(False))


def in_band(c: str | Column, lo: float, hi: float) -> Column:
    """Lo <= c < hi."""
    return (col(c) >= lo) & (col(c) < hi)


def family_filter(df: DataFrame, family: str | None, column: str = "family") -> DataFrame:
    """P5: case-insensitive; unfiltered when no family is asked for or the column is absent."""
    if family is None or column not in df.columns:
        return df
    return df.where(F.lower(F.col(column)) == family.lower())


def family_filter_report(df: DataFrame, family: str, column: str = "family") -> DataFrame:
    """P5: rows kept and dropped by the filter."""
    hit = F.lower(F.col(column)) == family.lower()
    return df.agg(F.count_if(hit).alias("kept"), F.count_if(~F.coalesce(hit, F.lit(False))).alias("dropped"))


def step_multiple(x: str | Column, start: str | Column, step: float, tol: float = 1e-6) -> Column:
    """X lies a whole number of steps from the start."""
    k = (col(x) - col(start)) / F.lit(float(step))
    return F.abs(k - F.rint(k)) < tol


def select_densities(df: DataFrame, x: str, lo: float | None = None, hi: float | None = None,
                     step: float | None = None, start: float | None = None) -> DataFrame:
    """Closed range, then multiples of the step from the given or the smallest value."""
    if lo is not None:
        df = df.where(F.col(x) >= lo)
    if hi is not None:
        df = df.where(F.col(x) <= hi)
    if step:
        first = F.lit(float(start)) if start is not None else df.agg(F.min(x).alias("m")).scalar()
        df = df.where(step_multiple(x, first, step))
    return df


def has_any(*targets: str) -> Column:
    """At least one of the targets is known."""
    return any_of([F.col(t).isNotNull() for t in targets])


def range_guard(value: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """P8 (gate 4): inclusive range; null when the target has no known range."""
    return F.when(col(lo).isNotNull() & col(hi).isNotNull(), F.coalesce(col(value).between(col(lo), col(hi)), F.lit(False)))


def mesh_gate(watertight="watertight", winding="winding_ok", bodies="bodies", euler="euler") -> Column:
    """P9 (gate 2): struct(ok, detail)."""
    def counted(c: str | Column, before: str, behind: str) -> Column:
        return F.concat(F.lit(before), col(c).cast("string"), F.lit(behind))

    why = reasons((col(euler) % 2 != 0, counted(euler, "V - E + F = ", " is odd")), (col(bodies) != 1, counted(bodies, "", " parts instead of one")),
                  (~col(watertight), "surface has open edges"), (~col(winding), "faces turn both ways"))
    return F.struct((why == "").alias("ok"), why.alias("detail"))


def generation_gate(vf: str | Column, asked: str | Column, tol: float = 0.05) -> Column:
    """P10 (gate 3): struct(ok, err); both null when nothing was asked."""
    err = ratio(col(vf) - col(asked), asked)
    return F.struct((F.abs(err) <= tol).alias("ok"), err.alias("err"))


def eligible(gate2="gate2", gate3="gate3", gate4="gate4") -> Column:
    """Gates 2 and 4 pass and gate 3 did not fail; an unknown gate 3 passes."""
    return F.coalesce(col(gate2), F.lit(False)) & F.coalesce(col(gate4), F.lit(False)) & F.coalesce(col(gate3), F.lit(True))


def not_excluded(topology: str | Column, excluded: list[str]) -> Column:
    """P12."""
    return ~F.coalesce(col(topology).isin(excluded), F.lit(False))


def standard_family(variant: str | None = "df", inner: float = 15.0, multi: float = 1.6) -> Column:
    """Rows the quotable scaling laws are fitted on."""
    base = (F.col("Inner_Size") == inner) & (F.abs(F.col("Size_Multi") - multi) < 0.01)
    return base & (F.col("variant") == variant.lower()) if variant is not None else base


def on_slice(baseline: dict[str, float]) -> Column:
    """Every held parameter is at its baseline."""
    return all_of([F.col(k) == v for k, v in baseline.items()])


def name_ratio_gate(vf: str | Column, name_density: str | Column, lo: float = 0.85, hi: float = 1.15) -> Column:
    """Measured value agrees with the name; unknown ratios are kept."""
    r = ratio(number(vf), F.nullif(number(name_density), F.lit(0.0)))
    return F.coalesce((r > lo) & (r < hi), F.lit(True))


def split_by(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the rejected side output."""
    k = F.coalesce(keep, F.lit(False))
    return df.where(k), df.where(~k)


def final_gate(predicted: str | Column, measured: str | Column, tol_pct: float = 15.0) -> Column:
    """P18 (gate 7): struct(diff_pct, ok)."""
    d = ratio(col(predicted) - col(measured), measured) * 100.0
    return F.struct(d.alias("diff_pct"), F.coalesce(F.abs(d) <= tol_pct, F.lit(False)).alias("ok"))

