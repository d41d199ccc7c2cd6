"""Triangle meshes derived from the part table, in Spark and in SQL.

Every part becomes a box whose face centres are pushed in or out dy `h`, so meshes have convex and
concave edges and interior vertices. By part number some lose a triangle, some get one flipped, and
some get a second, separate box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACES_PER_BODY, SHIFT = 24, 20.0
#: Parts whose triangles or tensors one task makes.
PARTS_PER_TASK = 4096


def _template() -> list[list[tuple[float, float]]]:
    """24 triangles; each of the nine coordinates as (base, factor of h)."""
    out = []
    for axis in range(3):
        for side in (0, 1):
            u, w = (axis + 1) % 3, (axis + 2) % 3
            square = [(0, 0), (1, 0), (1, 1), (0, 1)] if side else [(0, 0), (0, 1), (1, 1), (1, 0)]
            ring = []
            for a, b in square:
                p = [0.0, 0.0, 0.0]
                p[axis], p[u], p[w] = float(side), float(a), float(b)
                ring.append([(c, 0.0) for c in p])
            mid = [(0.5, 0.0)] * 3
            mid[axis] = (float(side), 1.0 if side else -1.0)
            out += [[*ring[i], *ring[(i + 1) % 4], *mid] for i in range(4)]
    return out


TEMPLATE = _template()
_NAMES = [f"{v}{a}" for v in "adc" for a in "xyz"]


def dealt(part: DataFrame) -> DataFrame:
    """The parts dealt out by their number: a small file is one task's input, but much is made of each of its rows."""
    tasks = -(-part.count() // PARTS_PER_TASK)
    return part.repartition(tasks, "p_partkey") if tasks > 1 else part


def meshes(part: DataFrame) -> DataFrame:
    """(mesh_id, tri_id, v0, v1, v2) for every part.

    Parts are dealt out first, so a mesh lies together, and sums per mesh need no shuffle.
    """
    part = dealt(part)
    k, size = F.col("p_partkey"), F.col("p_size")
    p = part.select(k.alias("mesh_id"), (F.lit(1.0) + size % 7 * 0.5).alias("sx"), (F.lit(1.0) + k % 5 * 0.3).alias("sy"), (F.lit(0.8) + k % 3 * 0.7).alias("sz"),
                    ((size % 9 - 4) * 0.05 + 0.01).alias("h"), (k % 10).alias("kind"))
    p = p.withColumn("body", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = F.array(*[F.struct(F.lit(i).alias("n"), *[F.lit(b).alias(f"{c}0") for c, (b, _) in zip(_NAMES, t)],
                              *[F.lit(f).alias(f"{c}1") for c, (_, f) in zip(_NAMES, t)]) for i, t in enumerate(TEMPLATE)])
    t = p.select("*", F.inline(rows)).where(~((F.col("kind") == 1) & (F.col("n") == 23)))

    def point(v):
        def at(a):
            x = (F.col(f"{v}{a}0") + F.col(f"{v}{a}1") * F.col("h")) * F.col(f"s{a}")
            return (x + F.col("body") * SHIFT if a == "x" else x).alias(a)
        return F.struct(*[at(a) for a in "xyz"])
    flip = (F.col("kind") == 2) & (F.col("n") == 0)
    t = t.withColumns({"pa": point("a"), "pb": point("d"), "pc": point("c")})
    tri = (F.col("body") * FACES_PER_BODY + F.col("n")).cast("long").alias("tri_id")
    t = t.select("mesh_id", tri, F.col("pa").alias("v0"), F.when(flip, F.col("pc")).otherwise(F.col("pb")).alias("v1"),
                 F.when(flip, F.col("pb")).otherwise(F.col("pc")).alias("v2"))
    return t


def _sql() -> str:
    rows = ", ".join("(" + ", ".join([str(i), *[f"{b}::DOUBLE" for b, _ in t], *[f"{f}::DOUBLE" for _, f in t]]) + ")" for i, t in enumerate(TEMPLATE))
    cols = ", ".join(["n", *[f"{c}0" for c in _NAMES], *[f"{c}1" for c in _NAMES]])
    def at(v, a):
        x = f"({v}{a}0 + {v}{a}1 * h) * s{a}"
        return f"{x} + body * 20.0::DOUBLE" if a == "x" else x
    plain = ", ".join(f"{at(v, a)} AS {v}{a}" for v in "adc" for a in "xyz")
    swap = ", ".join([*[f"a{a}" for a in "xyz"], *[f"CASE WHEN flip THEN c{a} ELSE d{a} END AS d{a}" for a in "xyz"], *[f"CASE WHEN flip THEN d{a} ELSE c{a} END AS c{a}" for a in "xyz"]])
    return f"""tm({cols}) AS (VALUES {rows}),
pm AS (SELECT p_partkey AS mesh_id, 1.0::DOUBLE + p_size % 7 * 0.5::DOUBLE AS sx, 1.0::DOUBLE + p_partkey % 5 * 0.3::DOUBLE AS sy, 0.8::DOUBLE + p_partkey % 3 * 0.7::DOUBLE AS sz, (p_size % 9 - 4) * 0.05::DOUBLE + 0.01::DOUBLE AS h, p_partkey % 10 AS kind FROM part),
t0 AS (SELECT mesh_id, body * 24 + n AS tri_id, kind = 2 AND n = 0 AS flip, {plain} FROM pm JOIN (VALUES (0), (1)) b(body) ON body = 0 OR kind = 3, tm WHERE NOT (kind = 1 AND n = 23)),
tri AS (SELECT mesh_id, CAST(tri_id AS BIGINT) AS tri_id, {swap} FROM t0)"""


TRI = _sql()
# Faces with area and unit normal; corners with their angle; boxes.
FACE = """f0 AS (SELECT *, (dy - ay) * (cz - az) - (dz - az) * (cy - ay) AS rx, (dz - az) * (cx - ax) - (dx - ax) * (cz - az) AS ry, (dx - ax) * (cy - ay) - (dy - ay) * (cx - ax) AS rz FROM tri),
f AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) / 2 AS area, rx / sqrt(rx * rx + ry * ry + rz * rz) AS nx, ry / sqrt(rx * rx + ry * ry + rz * rz) AS ny, rz / sqrt(rx * rx + ry * ry + rz * rz) AS nz FROM f0)"""


def _corner(s, n, p):
    u, w = [f"({n}{a} - {s}{a})" for a in "xyz"], [f"({p}{a} - {s}{a})" for a in "xyz"]
    dot = " + ".join(f"{x} * {y}" for x, y in zip(u, w))
    lu, lw = (f"sqrt({' + '.join(f'{x} * {x}' for x in v)})" for v in (u, w))
    return f"SELECT mesh_id, tri_id, {s}x AS px, {s}y AS py, {s}z AS pz, {n}x AS ex, {n}y AS ey, {n}z AS ez, {p}x AS ox, {p}y AS oy, {p}z AS oz, area, nx, ny, nz, acos(greatest(-1, least(1, ({dot}) / ({lu} * {lw})))) AS ang FROM f"


CORNER = "cr AS (" + " UNION ALL ".join(_corner(*c) for c in ("adc", "dca", "cad")) + ")"
BOX = "box AS (SELECT mesh_id, " + ", ".join(f"min(least(a{a}, d{a}, c{a})) AS lo{a}, max(greatest(a{a}, d{a}, c{a})) AS hi{a}" for a in "xyz") + " FROM tri GROUP BY 1)"
VERTEX = """vx AS (SELECT mesh_id, px, py, pz, sum(area) / 3 AS dual, (2 * pi() - sum(ang)) / (sum(area) / 3) AS gauss, sum(nx * ang) AS wx, sum(ny * ang) AS wy, sum(nz * ang) AS wz FROM cr GROUP BY 1, 2, 3, 4),
vt AS (SELECT *, wx / sqrt(wx * wx + wy * wy + wz * wz) AS ux, wy / sqrt(wx * wx + wy * wy + wz * wz) AS uy, wz / sqrt(wx * wx + wy * wy + wz * wz) AS uz FROM vx)"""
EDGE = """eh AS (SELECT *, CASE WHEN (px, py, pz) < (ex, ey, ez) THEN (px, py, pz) ELSE (ex, ey, ez) END AS lo, CASE WHEN (px, py, pz) < (ex, ey, ez) THEN (ex, ey, ez) ELSE (px, py, pz) END AS hi, CASE WHEN (px, py, pz) < (ex, ey, ez) THEN 1 ELSE -1 END AS way FROM cr),
e2 AS (SELECT mesh_id, lo, hi FROM eh GROUP BY 1, 2, 3 HAVING count(*) = 2),
ej AS (SELECT a.mesh_id, a.lo, a.hi, (a.area + b.area) / 3 AS w, acos(greatest(-1, least(1, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))) AS th, sqrt(pow(a.px - a.ex, 2) + pow(a.py - a.ey, 2) + pow(a.pz - a.ez, 2)) AS len,
 CASE WHEN a.nx * (b.ox - a.px) + a.ny * (b.oy - a.py) + a.nz * (b.oz - a.pz) < 1e-8 THEN 1 ELSE -1 END AS sg
 FROM eh a JOIN eh b ON a.mesh_id = b.mesh_id AND a.lo = b.lo AND a.hi = b.hi AND a.tri_id < b.tri_id JOIN e2 ON a.mesh_id = e2.mesh_id AND a.lo = e2.lo AND a.hi = e2.hi),
ed AS (SELECT *, sg * 0.5 * th * len / w AS H FROM ej)"""
