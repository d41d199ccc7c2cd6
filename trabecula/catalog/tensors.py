"""Tensor queries. Full tensors come from embeddings, orthotropic ones (closed-form inverse in SQL) from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.catalog.shapes import dealt
from trabecula.functions import tensor
from trabecula.functions.core import hash_uniform

_SYM = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT vec_id, list_transform(range(36), lambda k: 0.5 * (v[k + 1] + v[6 * (k % 6) + k // 6 + 1]) + CASE WHEN k % 7 = 0 THEN 10.0 ELSE 0.0 END) AS c FROM e)"""


def _full(t):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 36)
    e = t.embeddings.select("vec_id", v.alias("v")).withColumn("c", tensor.symmetrise("v"))
    eye = F.array(*[F.lit(10.0 if i % 7 == 0 else 0.0) for i in range(36)])
    return e.select("vec_id", F.zip_with("c", eye, lambda a, b: a + b).alias("c"))


# Orthotropic stiffness of a part: upper block a1 a2 a3 / b12 b13 b23, shear g4 g5 g6.
_ORTHO = """o AS (SELECT p_partkey, 8.0 + p_size * 0.1 AS a1, 9.0 + p_partkey % 5 AS a2, 10.0 + p_partkey % 7 * 0.5 AS a3, 2.0 + p_partkey % 3 * 0.4 AS b12, 1.5 + p_partkey % 4 * 0.3 AS b13, 1.0 + p_size * 0.02 AS b23,
 3.0 + p_partkey % 6 * 0.2 AS g4, 2.5 + p_size * 0.03 AS g5, 4.0 - p_partkey % 8 * 0.1 AS g6 FROM part),
dt AS (SELECT *, a1 * (a2 * a3 - b23 * b23) - b12 * (b12 * a3 - b23 * b13) + b13 * (b12 * b23 - a2 * b13) AS det FROM o),
s AS (SELECT *, (a2 * a3 - b23 * b23) / det AS s11, (a1 * a3 - b13 * b13) / det AS s22, (a1 * a2 - b12 * b12) / det AS s33, (b13 * b23 - b12 * a3) / det AS s12, (b12 * b23 - b13 * a2) / det AS s13, (b12 * b13 - a1 * b23) / det AS s23 FROM dt),
m AS (SELECT *, (a1 + a2 + a3 + 2 * (b12 + b13 + b23)) / 9 AS K_V, (a1 + a2 + a3 - (b12 + b13 + b23) + 3 * (g4 + g5 + g6)) / 15 AS G_V, 1 / (s11 + s22 + s33 + 2 * (s12 + s13 + s23)) AS K_R,
 15 / (4 * (s11 + s22 + s33) - 4 * (s12 + s13 + s23) + 3 * (1 / g4 + 1 / g5 + 1 / g6)) AS G_R FROM s),
h AS (SELECT *, (K_V + K_R) / 2 AS K_H, (G_V + G_R) / 2 AS G_H FROM m),
x AS (SELECT *, 9 * K_H * G_H / (3 * K_H + G_H) AS E_iso, (3 * K_H - 2 * G_H) / (2 * (3 * K_H + G_H)) AS nu_iso, K_H - 2 * G_H / 3 AS lam FROM h)"""


def _ortho(t, *carry):
    k, s = F.col("p_partkey"), F.col("p_size")
    a1, a2, a3 = F.lit(8.0) + s * 0.1, F.lit(9.0) + k % 5, F.lit(10.0) + k % 7 * 0.5
    b12, b13, b23 = F.lit(2.0) + k % 3 * 0.4, F.lit(1.5) + k % 4 * 0.3, F.lit(1.0) + s * 0.02
    g4, g5, g6 = F.lit(3.0) + k % 6 * 0.2, F.lit(2.5) + s * 0.03, F.lit(4.0) - k % 8 * 0.1
    z = F.lit(0.0)
    rows = [a1, b12, b13, z, z, z, b12, a2, b23, z, z, z, b13, b23, a3, z, z, z, z, z, z, g4, z, z, z, z, z, z, g5, z, z, z, z, z, z, g6]
    return dealt(t.part).select("p_partkey", *carry, F.array(*rows).alias("c"))


def _round(df, key, cols, d=6):
    return df.select(key, *[F.round(c, d).alias(c) for c in cols])


@query("tensor_symmetrise", f"WITH {_SYM} SELECT vec_id, round(c[2], 9) AS c12, round(c[7], 9) AS c21, round(c[36], 9) AS c66 FROM c")
def tensor_symmetrise(t):
    return _full(t).select("vec_id", F.round(tensor.at("c", 0, 1), 9).alias("c12"), F.round(tensor.at("c", 1, 0), 9).alias("c21"), F.round(tensor.at("c", 5, 5), 9).alias("c66"))


@query("tensor_voigt_average", f"WITH {_SYM} SELECT vec_id, round((c[1] + c[8] + c[15] + 2 * (c[2] + c[3] + c[9])) / 9, 8) AS \"K_V\", round((c[1] + c[8] + c[15] - (c[2] + c[3] + c[9]) + 3 * (c[22] + c[29] + c[36])) / 15, 8) AS \"G_V\" FROM c")
def tensor_voigt_average(t):
    return _full(t).select("vec_id", F.round(tensor.voigt_bulk("c"), 8).alias("K_V"), F.round(tensor.voigt_shear("c"), 8).alias("G_V"))


@query("tensor_hill_average", f"WITH {_ORTHO} SELECT p_partkey, round(K_V, 6) AS \"K_V\", round(K_R, 6) AS \"K_R\", round(G_V, 6) AS \"G_V\", round(G_R, 6) AS \"G_R\", round(K_H, 6) AS \"K_H\", round(G_H, 6) AS \"G_H\", round(E_iso, 6) AS \"E_iso\", round(nu_iso, 6) AS nu_iso FROM x")
def tensor_hill_average(t):
    return _round(tensor.add_averages(_ortho(t)), "p_partkey", ["K_V", "K_R", "G_V", "G_R", "K_H", "G_H", "E_iso", "nu_iso"])


_TAI = """sqrt(pow(a1 - lam - 2 * G_H, 2) + pow(a2 - lam - 2 * G_H, 2) + pow(a3 - lam - 2 * G_H, 2) + 2 * (pow(b12 - lam, 2) + pow(b13 - lam, 2) + pow(b23 - lam, 2)) + {w} * (pow(g4 - G_H, 2) + pow(g5 - G_H, 2) + pow(g6 - G_H, 2)))
 / sqrt(a1 * a1 + a2 * a2 + a3 * a3 + 2 * (b12 * b12 + b13 * b13 + b23 * b23) + {w} * (g4 * g4 + g5 * g5 + g6 * g6))"""


@query("tensor_anisotropy", f"WITH {_ORTHO} SELECT p_partkey, round({_TAI.format(w=1)}, 6) AS tai, round({_TAI.format(w=4)}, 6) AS tai_mandel, round(5 * G_V / G_R + K_V / K_R - 6, 6) AS a_u FROM x")
def tensor_anisotropy(t):
    o = tensor.add_averages(_ortho(t))
    return o.select("p_partkey", F.round(tensor.anisotropy_index("c", "K_H", "G_H"), 6).alias("tai"), F.round(tensor.anisotropy_index("c", "K_H", "G_H", "mandel"), 6).alias("tai_mandel"),
                    F.round(tensor.universal_anisotropy(), 6).alias("a_u"))


@query("tensor_zener", f"WITH {_ORTHO} SELECT p_partkey, round(2 * g4 / (a1 - b12), 8) AS single, round((2 * g4 / (a1 - b12) + 2 * g5 / (a2 - b23) + 2 * g6 / (a3 - b13)) / 3, 8) AS mean3 FROM x")
def tensor_zener(t):
    return _ortho(t).select("p_partkey", F.round(tensor.zener("c"), 8).alias("single"), F.round(tensor.zener("c", "mean3"), 8).alias("mean3"))


@query("tensor_labels", f"WITH {_ORTHO} SELECT p_partkey, round(a1 * 0.001 / 1.8, 8) AS \"C11_n\", round(b12 * 0.001 / 1.8, 8) AS \"C12_n\", round(g4 * 0.001 / 1.8, 8) AS \"C44_n\", round(E_iso * 0.001 / 1.8, 8) AS \"E_over_Es\", round(G_H * 0.001 / (1.8 / 2.6), 8) AS \"G_over_Gs\", round({_TAI.format(w=1)}, 6) AS \"TAI\", round(2 * g4 / (a1 - b12), 8) AS \"Zener_Z\" FROM x")
def tensor_labels(t):
    out = tensor.add_labels(_ortho(t), "c", 1e-3, 1.8, 0.3)
    cols = ["C11_n", "C12_n", "C44_n", "E_over_Es", "G_over_Gs", "Zener_Z"]
    return out.select("p_partkey", *[F.round(c, 8).alias(c) for c in cols], F.round("TAI", 6).alias("TAI"))


@query("tensor_directional_modulus", f"""WITH {_ORTHO}, n AS (SELECT i, 1 - (2 * i + 1) / 8000.0 AS z, pi() * (3 - sqrt(5)) * i AS a FROM range(8000) g(i)),
d AS (SELECT pow(sqrt(1 - z * z) * cos(a), 2) AS xx, pow(sqrt(1 - z * z) * sin(a), 2) AS yy, z * z AS zz FROM n),
e AS (SELECT p_partkey, 1 / (s11 * xx * xx + s22 * yy * yy + s33 * zz * zz + 2 * (s12 * xx * yy + s13 * xx * zz + s23 * yy * zz) + yy * zz / g4 + xx * zz / g5 + xx * yy / g6) AS e FROM s, d)
SELECT p_partkey, round(min(e), 6) AS e_min, round(max(e), 6) AS e_max FROM e GROUP BY 1""")
def tensor_directional_modulus(t):
    out = _ortho(t).withColumn("e", tensor.directional_modulus(8000)("c"))
    return out.select("p_partkey", F.round("e.e_min", 6).alias("e_min"), F.round("e.e_max", 6).alias("e_max"))


@query("tensor_quarter_turn", f"WITH {_ORTHO} SELECT p_partkey, round(a2::DOUBLE, 8) AS c11, round(a1::DOUBLE, 8) AS c22, round(b23::DOUBLE, 8) AS c13, round(g5::DOUBLE, 8) AS c44, round(g4::DOUBLE, 8) AS c55 FROM x")
def tensor_quarter_turn(t):
    quarter = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    r = _ortho(t).withColumn("r", tensor.rotate("c", quarter))
    at = {"c11": (0, 0), "c22": (1, 1), "c13": (0, 2), "c44": (3, 3), "c55": (4, 4)}
    return r.select("p_partkey", *[F.round(tensor.at("r", i, j), 8).alias(n) for n, (i, j) in at.items()])


@query("tensor_rotation_invariants", f"""WITH {_SYM} SELECT vec_id, round((c[1] + c[8] + c[15] + 2 * (c[2] + c[3] + c[9])) / 9, 7) AS k_turned, round((c[1] + c[8] + c[15] - (c[2] + c[3] + c[9]) + 3 * (c[22] + c[29] + c[36])) / 15, 7) AS g_turned FROM c""")
def tensor_rotation_invariants(t):
    u = [hash_uniform(7, "vec_id", F.lit(s)) for s in "abc"]
    r = _full(t).withColumn("q", tensor.quaternion_rotation(*u)).withColumn("r", tensor.rotate("c", "q"))
    return r.select("vec_id", F.round(tensor.voigt_bulk("r"), 7).alias("k_turned"), F.round(tensor.voigt_shear("r"), 7).alias("g_turned"))


@query("tensor_frame_labels", f"WITH {_ORTHO} SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN round(a2 / 200, 9) END AS c11_n, p_size * 1.0::DOUBLE AS e_kept FROM x JOIN part USING (p_partkey)")
def tensor_frame_labels(t):
    quarter = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    r = _ortho(t, "p_size").withColumn("r", tensor.rotate("c", quarter))
    has = F.col("p_partkey") % 3 != 0
    c11 = tensor.frame_label("C11_n", "r", 200.0, F.lit(1.0), F.lit(0.0), has)
    kept = tensor.frame_label("E_over_Es", "r", 200.0, F.col("p_size").cast("double"), F.lit(0.0), has)
    return r.select("p_partkey", F.round(c11, 9).alias("c11_n"), kept.alias("e_kept"))


@query("tensor_cache", f"WITH {_SYM} SELECT vec_id, round(list_sum(list_transform(c, lambda x: x * 1e-6 / 1.8)), 12) AS total FROM c")
def tensor_cache(t):
    c = _full(t).withColumn("n", tensor.scale("c", 1e-6 / 1.8))
    return c.select("vec_id", F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 12).alias("total"))


@query("tensor_full_labels")
def tensor_full_labels(t):
    out = tensor.add_labels(_full(t), "c", 1.0, 200.0, 0.3, "mean3", "mandel")
    return _round(out, "vec_id", ["E_over_Es", "G_over_Gs", "TAI", "Zener_Z", "A_U", "nu_iso"])
