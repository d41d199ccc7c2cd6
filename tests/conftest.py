import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trabecula.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


CUBE = [((0, 0, 0), (0, 1, 0), (1, 1, 0)), ((0, 0, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1)), ((0, 0, 1), (1, 1, 1), (0, 1, 1)),
        ((0, 0, 0), (1, 0, 0), (1, 0, 1)), ((0, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (0, 1, 1), (1, 1, 1)), ((0, 1, 0), (1, 1, 1), (1, 1, 0)),
        ((0, 0, 0), (0, 0, 1), (0, 1, 1)), ((0, 0, 0), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1)), ((1, 0, 0), (1, 1, 1), (1, 0, 1))]
TRI_SCHEMA = ("mesh_id string, tri_id long, v0 struct<x:double,y:double,z:double>, v1 struct<x:double,y:double,z:double>, "
              "v2 struct<x:double,y:double,z:double>")


def triangles(spark, **named):
    rows = [(name, i, *[tuple(map(float, p)) for p in t]) for name, tris in named.items() for i, t in enumerate(tris)]
    return spark.createDataFrame(rows, TRI_SCHEMA)


def moved(tris, dx):
    return [tuple((x + dx, y, z) for x, y, z in t) for t in tris]


def grid_surface(point, nu, nv, wrap_u=True, wrap_v=True):
    """Triangles of a closed surface given by point(i, j) on a wrapped grid."""
    out = []
    for i in range(nu):
        for j in range(nv):
            a, b = point(i, j), point((i + 1) % nu, j)
            c, d = point((i + 1) % nu, (j + 1) % nv if wrap_v else j + 1), point(i, (j + 1) % nv if wrap_v else j + 1)
            out += [(a, b, c), (a, c, d)]
    return out


def sphere(r, nu=48, nv=24):
    def p(i, j):
        if j in (0, nv):
            return (0.0, 0.0, -r if j == 0 else r)
        u, v = 2 * math.pi * i / nu, math.pi * j / nv - math.pi / 2
        return (r * math.cos(v) * math.cos(u), r * math.cos(v) * math.sin(u), r * math.sin(v))
    return [t for t in grid_surface(p, nu, nv, wrap_v=False) if len(set(t)) == 3]


def torus(R, r, nu=64, nv=32):
    def p(i, j):
        u, v = 2 * math.pi * i / nu, 2 * math.pi * j / nv
        return ((R + r * math.cos(v)) * math.cos(u), (R + r * math.cos(v)) * math.sin(u), r * math.sin(v))
    return grid_surface(p, nu, nv)
