"""Elastic stiffness tensors as array<double> of 36 numbers, row by row.

The 6x6 inverse, the rotation and the directional modulus run as Arrow batches of numpy matrix
products; everything else is a plain column expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trabecula.functions.core import col, ratio

TENSOR = T.ArrayType(T.DoubleType())
CHUNK = 256


def at(c: str | Column, i: int, j: int) -> Column:
    """Entry (i, j), zero-based."""
    return F.get(col(c), F.lit(6 * i + j))


def symmetrise(c: str | Column) -> Column:
    """0.5 (C + C^T)."""
    return F.array(*[(at(c, i, j) + at(c, j, i)) * 0.5 for i in range(6) for j in range(6)])


def scale(c: str | Column, factor: float | Column) -> Column:
    """every entry times a factor, e.g. unit / Es."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(col(c), lambda x: x * f)


def _stack(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Valid tensors of a batch as (k, 6, 6), and their positions."""
    good = [i for i, v in enumerate(s) if v is not None and len(v) == 36]
    m = np.array([s.iloc[i] for i in good], dtype=float).reshape(-1, 6, 6)
    keep = np.isfinite(m).all(axis=(1, 2))
    return m[keep], np.array(good, dtype=int)[keep]


def _spread(n: int, where: np.ndarray, rows) -> pd.Series:
    out = [None] * n
    for i, r in zip(where, rows):
        out[i] = r
    return pd.Series(out)


def _safe_inverse(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batched inverse of the well-conditioned tensors; the mask says which they are."""
    if not len(m):
        return m, np.zeros(0, dtype=bool)
    sv = np.linalg.svd(m, compute_uv=False)
    ok = sv[:, -1] > 1e-13 * np.maximum(sv[:, 0], 1e-300)
    return np.linalg.inv(m[ok]), ok


@F.pandas_udf(TENSOR)
def inverse(c: pd.Series) -> pd.Series:
    """Compliance; null for singular or malformed tensors."""
    m, where = _stack(c)
    inv, ok = _safe_inverse(m)
    return _spread(len(c), where[ok], inv.reshape(-1, 36))


def voigt_bulk(c) -> Column:
    return (at(c, 0, 0) + at(c, 1, 1) + at(c, 2, 2) + (at(c, 0, 1) + at(c, 0, 2) + at(c, 1, 2)) * 2) / 9.0


def voigt_shear(c) -> Column:
    return ((at(c, 0, 0) + at(c, 1, 1) + at(c, 2, 2)) - (at(c, 0, 1) + at(c, 0, 2) + at(c, 1, 2))
            + (at(c, 3, 3) + at(c, 4, 4) + at(c, 5, 5)) * 3) / 15.0


def reuss_bulk(s) -> Column:
    d = (at(s, 0, 0) + at(s, 1, 1) + at(s, 2, 2)) + (at(s, 0, 1) + at(s, 0, 2) + at(s, 1, 2)) * 2
    return F.try_divide(F.lit(1.0), d)


def reuss_shear(s) -> Column:
    d = ((at(s, 0, 0) + at(s, 1, 1) + at(s, 2, 2)) * 4 - (at(s, 0, 1) + at(s, 0, 2) + at(s, 1, 2)) * 4
         + (at(s, 3, 3) + at(s, 4, 4) + at(s, 5, 5)) * 3)
    return F.try_divide(F.lit(15.0), d)


def add_averages(df: DataFrame, c: str = "c", compliance: str = "s") -> DataFrame:
    """F8: K_V, K_R, G_V, G_R, K_H, G_H, E_iso, nu_iso. Singular tensors keep only the Voigt part."""
    df = df.withColumn(compliance, inverse(c))
    df = df.withColumns({"K_V": voigt_bulk(c), "G_V": voigt_shear(c), "K_R": reuss_bulk(compliance),
                         "G_R": reuss_shear(compliance)})
    df = df.withColumns({"K_H": (F.col("K_V") + F.col("K_R")) * 0.5, "G_H": (F.col("G_V") + F.col("G_R")) * 0.5})
    den = F.col("K_H") * 3 + F.col("G_H")
    return df.withColumns({"E_iso": F.try_divide(F.col("K_H") * F.col("G_H") * 9, den),
                           "nu_iso": F.try_divide(F.col("K_H") * 3 - F.col("G_H") * 2, den * 2)})


def anisotropy_index(c, k: str | Column, g: str | Column, notation: str = "voigt") -> Column:
    """Frobenius distance to the nearest isotropic tensor over the norm of the tensor.

    'voigt' works on the 36 numbers as stored; 'mandel' weights shear rows so that rotation does not matter.
    """
    k, g = col(k), col(g)
    lam = k - g * (2.0 / 3.0)
    dist, size = F.lit(0.0), F.lit(0.0)
    for i in range(6):
        for j in range(6):
            w = 1.0 if notation == "voigt" else (2.0 if i > 2 else 1.0) * (2.0 if j > 2 else 1.0)
            if i < 3 and j < 3:
                iso = lam + g * 2 if i == j else lam
            else:
                iso = g if i == j else F.lit(0.0)
            e = at(c, i, j)
            dist = dist + (e - iso) * (e - iso) * w
            size = size + e * e * w
    return F.try_divide(F.sqrt(dist), F.sqrt(size))


def zener(c, mode: str = "single") -> Column:
    """2 C44 / (C11 - C12), or the mean over the three axes."""
    def one(p, q, r):
        d = at(c, *q) - at(c, *r)
        return F.when(F.abs(d) > 1e-12, at(c, *p) * 2 / d)

    if mode == "single":
        return one((3, 3), (0, 0), (0, 1))
    three = [one((3, 3), (0, 0), (0, 1)), one((4, 4), (1, 1), (1, 2)), one((5, 5), (2, 2), (0, 2))]
    return (three[0] + three[1] + three[2]) / 3.0


def universal_anisotropy() -> Column:
    """F11, over the columns that `add_averages` adds."""
    return ratio("G_V", "G_R") * 5.0 + ratio("K_V", "K_R") - 6.0


def solid_shear(es: float | Column, nu: float | Column) -> Column:
    es, nu = (x if isinstance(x, Column) else F.lit(float(x)) for x in (es, nu))
    return es / ((nu + 1.0) * 2.0)


def add_labels(df: DataFrame, c: str, factor: float, es_gpa: float, nu: float, zener_mode: str = "single",
               notation: str = "voigt") -> DataFrame:
    """the whole label set from a raw tensor (`factor` turns its unit into GPa)."""
    df = add_averages(df.withColumn("c_gpa", scale(c, factor)), "c_gpa", "s_gpa")
    return df.withColumns({
        "C11_n": at("c_gpa", 0, 0) / es_gpa, "C12_n": at("c_gpa", 0, 1) / es_gpa, "C44_n": at("c_gpa", 3, 3) / es_gpa,
        "TAI": anisotropy_index("c_gpa", "K_H", "G_H", notation), "E_over_Es": F.col("E_iso") / es_gpa,
        "G_over_Gs": F.col("G_H") / solid_shear(es_gpa, nu), "Zener_Z": zener("c_gpa", zener_mode),
        "A_U": universal_anisotropy(),
    })


def sphere_points(n: int) -> np.ndarray:
    """Evenly spread unit directions on a golden-angle spiral."""
    i = np.arange(n)
    z = 1.0 - (2.0 * i + 1.0) / n
    r, a = np.sqrt(1.0 - z * z), np.pi * (3.0 - np.sqrt(5.0)) * i
    return np.column_stack([r * np.cos(a), r * np.sin(a), z])


def directional_modulus(n: int = 8000):
    """UDF giving struct(e_min, e_max) of Young's modulus over n directions.

    1/E(n) is a quadratic form of the six products of direction components, so a chunk of tensors
    is one matrix product.
    """
    x, y, z = sphere_points(n).T
    v = np.column_stack([x * x, y * y, z * z, y * z, x * z, x * y])
    quad = np.einsum("pa,pb->pab", v, v).reshape(n, 36)

    @F.pandas_udf("e_min double, e_max double")
    def run(c: pd.Series) -> pd.DataFrame:
        lo, hi = np.full(len(c), np.nan), np.full(len(c), np.nan)
        m, where = _stack(c)
        inv, ok = _safe_inverse(m)
        where = where[ok]
        for a in range(0, len(where), CHUNK):
            e = 1.0 / (quad @ inv[a:a + CHUNK].reshape(-1, 36).T)
            lo[where[a:a + CHUNK]], hi[where[a:a + CHUNK]] = e.min(axis=0), e.max(axis=0)
        return pd.DataFrame({"e_min": pd.array(lo), "e_max": pd.array(hi)}).where(lambda d: d.notna(), None)

    return run


def _strain_rotation(r: np.ndarray) -> np.ndarray:
    """6x6 stress transformation for each rotation in (k, 3, 3): C' = M C M^T."""
    pairs = [(0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    m = np.empty((len(r), 6, 6))
    for a, (i, j) in enumerate(pairs):
        for b, (k, l) in enumerate(pairs):
            m[:, a, b] = r[:, i, k] * r[:, j, l] + (r[:, i, l] * r[:, j, k] if k != l else 0.0)
    return m


@F.pandas_udf(TENSOR)
def rotate(c: pd.Series, r: pd.Series) -> pd.Series:
    """tensor turned by a rotation (array of 9, row by row)."""
    m, where = _stack(c)
    rot = np.array([r.iloc[i] for i in where], dtype=float).reshape(-1, 3, 3)
    k = _strain_rotation(rot)
    return _spread(len(c), where, np.einsum("nab,nbc,ndc->nad", k, m, k).reshape(-1, 36))


def quaternion_rotation(u1: Column, u2: Column, u3: Column) -> Column:
    """uniform proper rotation (array of 9) from three uniform numbers."""
    two_pi = 2.0 * np.pi
    a, b = F.sqrt(F.lit(1.0) - u1), F.sqrt(u1)
    q = F.array(a * F.sin(u2 * two_pi), a * F.cos(u2 * two_pi), b * F.sin(u3 * two_pi), b * F.cos(u3 * two_pi))
    x, y, z, w = (F.get(q, F.lit(i)) for i in range(4))
    return F.array(1 - (y * y + z * z) * 2, (x * y - z * w) * 2, (x * z + y * w) * 2,
                   (x * y + z * w) * 2, 1 - (x * x + z * z) * 2, (y * z - x * w) * 2,
                   (x * z - y * w) * 2, (y * z + x * w) * 2, 1 - (x * x + y * y) * 2)


def frame_label(target: str, c: str, es_gpa: float, original: str | Column, tai: str | Column,
                has_tensor: str | Column | None = None, mask_missing: bool = True) -> Column:
    """label after a rotation. Frame-dependent targets are recomputed (null without a tensor when masked)."""
    entry = {"C11_n": at(c, 0, 0) / es_gpa, "C12_n": at(c, 0, 1) / es_gpa, "C44_n": at(c, 3, 3) / es_gpa,
             "TAI": col(tai)}.get(target)
    if entry is None:
        return col(original)
    known = F.lit(True) if has_tensor is None else col(has_tensor)
    return F.when(known, entry).otherwise(F.lit(None).cast("double") if mask_missing else col(original))


def drift(a: str | Column, b: str | Column) -> Column:
    """struct(max_term_pct, c11_pct) between a tensor and its reference."""
    terms = F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-9)))
    return F.struct((F.array_max(terms) * 100).alias("max_term_pct"),
                    (F.abs(ratio(at(a, 0, 0) - at(b, 0, 0), F.abs(at(b, 0, 0)))) * 100).alias("c11_pct"))


def unit_sanity(e_over_es: str | Column) -> Column:
    """struct(ok, factor): 0 < E/Es < 1, else the suspected power of ten."""
    e = col(e_over_es)
    ok = F.coalesce((e > 0) & (e < 1), F.lit(False))
    power = F.when(~ok & (e != 0), F.pow(F.lit(10.0), F.rint(F.log10(F.abs(e)))))
    return F.struct(ok.alias("ok"), power.alias("factor"))
