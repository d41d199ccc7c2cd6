"""Design parameters, keys and labels parsed from names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trabecula.functions.core import col, number, text

# Name grammar, legacy defaults and spellings the stored names use.
NUMBER_TOKEN = r"(\d+p?\d*)"
SLOT_TOKENS = {"inner": "_i", "density": "_d", "t": "_t", "size_multi": "_m"}
SEED_TOKEN = r"_s(\d+)\b"
VARIANTS = ("DF", "raw", "flow")
DEFAULT_VARIANT = "df"
LEGACY_MARK = "5cube"
LEGACY_DEFAULTS = {"inner": 15.0, "size_multi": 1.6, "t": 0.4, "seed": 2}
SLOTS = ("inner", "density", "t", "seed", "multi")
DEFAULT_SLOT_SPEC = r"inner:i(\d+)p(\d+); density:d(\d+)p(\d+); t:t(\d+)p(\d+); seed:_s(\d+); multi:m(\d+)p(\d+)"
STAMP_FORMAT = "yyyyMMdd_HH-mm"


def strip_suffix(name: str | Column, suffix: str = "stl") -> Column:
    """File stem: drop a trailing '.stl' in any case."""
    return F.regexp_replace(col(name), rf"(?i)\.{suffix}$", "")


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def parse_slots(stem: str | Column, spec: str = DEFAULT_SLOT_SPEC) -> Column:
    """user-supplied 'slot:regex; ...' spec. Two groups read as 'a.b', one group literally.

    Returns a struct with one nullable text field per slot; unknown slots and bad patterns are ignored.
    """
    c, found = col(stem), {}
    for part in (spec or DEFAULT_SLOT_SPEC).split(";"):
        slot, _, pattern = (s.strip() for s in part.partition(":"))
        if slot not in SLOTS or not pattern:
            continue
        try:
            groups = re.compile(pattern).groups
        except re.error:
            continue
        parts = F.array_compact(F.array(*[_group(c, pattern, g + 1) for g in range(groups)])) if groups else F.array()
        joined = F.when(F.size(parts) >= 2, F.concat_ws(".", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))))
        found[slot] = joined.otherwise(F.try_element_at(parts, F.lit(1))) if groups else F.lit(None).cast("string")
    return F.struct(*[found.get(s, F.lit(None).cast("string")).alias(s) for s in SLOTS])


def variant_of(stem: str | Column, prefix: str) -> Column:
    """variant token after the name prefix, lower case; names without one belong to the default."""
    token = _group(col(stem), rf"(?i){re.escape(prefix)}[_ ]?({'|'.join(VARIANTS)})")
    return F.coalesce(F.lower(token), F.lit(DEFAULT_VARIANT))


def parse_stem(stem: str | Column, prefix: str) -> Column:
    """struct(variant, inner, density, t, seed, size_multi) with the legacy defaults."""
    c = col(stem)
    legacy = c.contains(LEGACY_MARK)

    def slot(name: str) -> Column:
        v = F.replace(_group(c, SLOT_TOKENS[name] + NUMBER_TOKEN), F.lit("p"), F.lit(".")).try_cast("double")
        return F.coalesce(v, F.when(legacy, F.lit(LEGACY_DEFAULTS[name]))) if name in LEGACY_DEFAULTS else v

    seed = F.coalesce(_group(c, SEED_TOKEN).try_cast("int"), F.when(legacy, F.lit(LEGACY_DEFAULTS["seed"])))
    return F.struct(variant_of(c, prefix).alias("variant"), slot("inner").alias("inner"),
                    slot("density").alias("density"), slot("t").alias("t"), seed.alias("seed"),
                    slot("size_multi").alias("size_multi"))


def number_tag(v: str | Column, letter: str, digits: int, keep_zeros: bool = False) -> Column:
    """22.85 -> d22p85. Trailing zeros are trimmed down to one decimal ('p0' stays) unless kept."""
    fixed = F.format_string(f"%.{digits}f", col(v).cast("double"))
    if not keep_zeros and digits > 0:
        fixed = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ".0")
    return F.when(col(v).isNotNull(), F.concat(F.lit(letter), F.replace(fixed, F.lit("."), F.lit("p"))))


def build_stem(prefix: str | Column, inner, density, t, seed, multi, digits: dict | None = None,
               keep_zeros: bool = False) -> Column:
    """run name from its parameters; missing ones are left out."""
    d = {"inner": 2, "density": 2, "t": 2, "multi": 2, **(digits or {})}
    head = prefix if isinstance(prefix, Column) else F.lit(prefix)
    seed_tag = F.when(col(seed).isNotNull(), F.concat(F.lit("s"), col(seed).cast("int").cast("string")))
    return F.concat_ws("_", head, number_tag(inner, "i", d["inner"], keep_zeros),
                       number_tag(density, "d", d["density"], keep_zeros), number_tag(t, "t", d["t"], keep_zeros),
                       seed_tag, number_tag(multi, "m", d["multi"], keep_zeros))


def last_number(s: str | Column) -> Column:
    """last number in a text."""
    found = F.regexp_extract_all(col(s), F.lit("[0-9]*[.]?[0-9]+"), 0)
    return F.get(found, F.size(found) - 1).try_cast("double")


def topology_of(variant: str | Column, topology: str | Column) -> Column:
    """variant when given, else topology, else '?'."""
    return F.coalesce(text(variant), text(topology), F.lit("?"))


def density_band(rho: str | Column, vf: str | Column, width: float) -> Column:
    """whole-number band of the measured density (solver value first, 0 when neither is known)."""
    r, v = number(rho), number(vf)
    d = F.coalesce(F.nullif(r, F.lit(0.0)), F.nullif(v, F.lit(0.0)), F.lit(0.0))
    return (d / F.lit(float(width))).cast("int") if width > 0 else F.lit(0)


def group_key(family: str | Column, topology: str | Column, band: str | Column) -> Column:
    """'family|topology|band'."""
    return F.concat_ws("|", col(family), col(topology), col(band).cast("string"))


def expected_wall(t: str | Column, convention: str) -> Column:
    """wall thickness the name promises (total: t, double: 2t, none: null)."""
    t = F.nullif(number(t), F.lit(0.0))
    return {"total": t, "double": t * 2.0}.get(convention, F.lit(None).cast("double"))


def search_cap(expected: Column, cap_factor: float, cap_fallback: float, cell: float) -> Column:
    """search radius for the opposite wall."""
    return F.coalesce(expected * cap_factor, F.lit(cap_fallback * cell))


def inner_size(stem: str | Column, bbox: str | Column) -> Column:
    """inner size from the name, else the box edge rounded to the nearest half."""
    parsed = F.replace(_group(col(stem), "_i" + NUMBER_TOKEN), F.lit("p"), F.lit(".")).try_cast("double")
    return F.coalesce(parsed, F.rint(number(bbox) * 2) / 2)


def seed_label(run: str | Column) -> Column:
    """'seed N' from a run folder; a folder without a seed is the first run."""
    n = _group(col(run), r"(?i)seed[_-]?(\d+)").try_cast("int")
    return F.concat(F.lit("seed "), F.coalesce(n, F.lit(1)).cast("string"))


def batch_time(batch: str | Column) -> Column:
    """timestamp at the head of a batch folder name."""
    return F.try_to_timestamp(_group(col(batch), r"^(\d{8}_\d{2}-\d{2})"), F.lit(STAMP_FORMAT))


def fold_name(name: str | Column) -> Column:
    """comparable output name: lower case, Greek rho spelled out, letters and digits only."""
    folded = F.replace(F.lower(col(name)), F.lit("ρ"), F.lit("rho"))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")
