"""STL files to triangle rows (S4, S5), and triangles to ASCII files.

Files of either kind are cut into byte ranges that separate tasks read. In a binary file a range knows its triangles' numbers; in an ASCII file each range
numbers its own vertices, and the counts of the ranges before it are added.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trabecula.session import written

# Binary layout and size limits.
HEADER, RECORD = 84, 50
MIN_STL_BYTES = 2000
RECORD_TYPE = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")])
CHUNK_TRIANGLES = 1_000_000
#: A corner in an ASCII file, and how far behind a range its last corner may reach.
_CORNER = re.compile(rb"(?<!\S)vertex\s+(\S+)\s+(\S+)\s+(\S+)")
REACH = 4096
#: Bytes of ranges that one task reads, and rows that a task hands on at once.
TASK_BYTES, OUT_ROWS = 16_000_000, 100_000


def list_stl(spark: SparkSession, folder: str, max_mb: float | None = None, names: str = "*.[sS][tT][lL]") -> DataFrame:
    """Every STL below a folder with topology (its parent folder) and status; file contents are not read.

    Files of any size are usable; `max_mb` marks larger ones as SKIPPED.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    parts = F.split(F.col("path"), "/")
    status = F.lit("OK") if max_mb is None else F.when(F.col("length") > max_mb * 1e6, F.lit(f"SKIPPED >{max_mb}MB")).otherwise("OK")
    return df.select("path", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("topology"), "length", status.alias("status"))


def check_stl(spark: SparkSession, folder: str, names: str = "*.[sS][tT][lL]") -> DataFrame:
    """(ok, reason) per STL from its size and its first 84 bytes; no more of a file is read."""
    files = list_stl(spark, folder, names=names).select("path", "length")
    df = files.repartition("path").mapInPandas(_heads, "path string, length long, head binary")
    n, ascii_file = _stated(), _solid()
    reason = (F.when(F.col("length") <= MIN_STL_BYTES, "too small").when(F.col("length") < HEADER, "short header")
              .when(ascii_file, "OK (ascii)").when(n == 0, "no triangles").otherwise("OK (binary)"))
    return df.select("path", "length", reason.alias("reason"), F.when(~ascii_file, n).alias("n_tris"), reason.startswith("OK").alias("ok"))


def _stated() -> Column:
    """Triangles that a binary header promises."""
    swapped = F.concat(*[F.hex(F.substring("head", 81 + i, 1)) for i in (3, 2, 1, 0)])
    return F.conv(swapped, 16, 10).cast("long")


def _solid() -> Column:
    return F.lower(F.substring("head", 1, 5).cast("string")) == "solid"


def _open(path: str):
    """File opened on whatever store its path names; Spark gives paths unescaped."""
    from pyarrow import fs
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(unquote(name))


def _heads(batches):
    for pdf in batches:
        heads = []
        for path in pdf["path"]:
            with _open(path) as f:
                heads.append(f.read(HEADER))
        yield pdf.assign(head=heads)


def _read_part(path: str, length: int, first: int, count: int) -> np.ndarray | None:
    """Triangles of one range of a binary file."""
    with _open(path) as f:
        head = f.read(HEADER)
        stated = int.from_bytes(head[80:84], "little") if len(head) == HEADER else -1
        if length != HEADER + RECORD * stated:
            if first:
                return None
            raise ValueError("length does not fit the triangle count")
        f.seek(HEADER + RECORD * first)
        return np.frombuffer(f.read(RECORD * min(count, max(stated - first, 0))), dtype=RECORD_TYPE)["v"].astype(float)


def _corners(path: str, start: int, end: int) -> np.ndarray:
    """Corners of an ASCII file whose keyword starts in the bytes [start, end), in order."""
    with _open(path) as f:
        f.seek(max(0, start - 1))
        raw = f.read(end - max(0, start - 1) + REACH)
    skip = start - max(0, start - 1)
    found = [m.groups() for m in _CORNER.finditer(raw) if skip <= m.start() < skip + end - start]
    return np.array(found, dtype="S").astype(float).reshape(-1, 3) if found else np.zeros((0, 3))


def _tasks(files: DataFrame, ranges: Column, size: int) -> int:
    """Tasks that the byte ranges of all files are dealt to; adaptive execution would take the few bytes that name them for little work."""
    n = files.agg(F.sum(ranges).alias("n")).first()["n"] or 0
    return max(1, -(-n // max(1, TASK_BYTES // size)))


def _decode_corners(batches):
    held, rows = [], 0
    for pdf in batches:
        for path, part, start, end in zip(pdf["path"], pdf["part"], pdf["start"], pdf["end"]):
            try:
                v, error = _corners(path, int(start), int(end)), None
            except Exception as ex:  # one broken file must not stop the scan
                yield pd.DataFrame({"path": [path], "part": [part], "seq": [-1], "x": [np.nan], "y": [np.nan], "z": [np.nan], "error": [f"ERROR {ex}"]})
                continue
            for a in range(0, len(v), OUT_ROWS):
                own = v[a:a + OUT_ROWS]
                held.append(pd.DataFrame({"path": path, "part": part, "seq": np.arange(a, a + len(own)), "x": own[:, 0], "y": own[:, 1], "z": own[:, 2], "error": error}))
                rows += len(own)
                if rows >= OUT_ROWS:
                    yield pd.concat(held, ignore_index=True)
                    held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _ascii_rows(files: DataFrame, size: int) -> DataFrame:
    """(path, tri_id, v0, v1, v2, error) of ASCII files, by byte ranges of `size`."""
    zero = F.lit(0).cast("long")
    last = F.greatest(F.floor((F.col("length") - 1) / size), zero).cast("long")
    parts = files.select("path", "length", F.explode(F.sequence(zero, last)).alias("part"))
    parts = parts.select("path", "part", (F.col("part") * size).alias("start"), F.least(F.col("length"), (F.col("part") + 1) * size).alias("end")).repartition(_tasks(files, last + 1, size), "path", "part")
    corners = written(parts.mapInPandas(_decode_corners, "path string, part long, seq long, x double, y double, z double, error string"))
    counts = corners.where("error IS NULL").groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), zero))
    number = F.col("before") + F.col("seq")
    rows = corners.where("error IS NULL").join(counts, ["path", "part"]).withColumns({"tri_id": F.floor(number / 3), "corner": number % 3})
    def point(i: int) -> Column:
        return F.struct(*[F.max(F.when(F.col("corner") == i, F.col(a))).alias(a) for a in "xyz"]).alias(f"v{i}")
    tri = rows.groupBy("path", "tri_id").agg(*[point(i) for i in range(3)], F.count(F.lit(1)).alias("__n"))
    whole = F.col("__n") == 3
    tri = tri.select("path", F.when(whole, F.col("tri_id")).otherwise(F.lit(-1)).alias("tri_id"), *[F.when(whole, F.col(f"v{i}")).alias(f"v{i}") for i in range(3)],
                     F.when(~whole, F.lit("ERROR corners do not come in threes")).alias("error"))
    nothing = F.lit(None).cast("struct<x:double,y:double,z:double>")
    broken = corners.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error")).select("path", F.lit(-1).cast("long").alias("tri_id"), *[nothing.alias(f"v{i}") for i in range(3)], "error")
    return tri.unionByName(broken)


def _decode(batches):
    for pdf in batches:
        for path, length, first, count in zip(pdf["path"], pdf["length"], pdf["first"], pdf["count"]):
            try:
                v = _read_part(path, int(length), int(first), int(count))
            except Exception as ex:  # one broken file must not stop the scan
                yield pd.DataFrame({"path": [path], "tri_id": [-1], "v": [[]], "error": [f"ERROR {ex}"]})
                continue
            if v is None or not len(v):
                continue
            for a in range(0, len(v), 100_000):
                part = v[a:a + 100_000]
                yield pd.DataFrame({"path": path, "tri_id": np.arange(first + a, first + a + len(part)),
                                    "v": list(part.reshape(-1, 9)), "error": None})


def read_triangles(files: DataFrame, chunk: int = CHUNK_TRIANGLES) -> DataFrame:
    """(path, tri_id, v0, v1, v2, error) of the usable files. A file is cut into ranges of `chunk` binary triangles, or as many bytes, that separate tasks read."""
    ok = files.where(F.col("status") == "OK").select("path", "length")
    heads = written(ok.repartition("path").mapInPandas(_heads, "path string, length long, head binary"))
    text = heads.where(_solid() & (F.col("length") != HEADER + RECORD * F.coalesce(_stated(), F.lit(-1)))).select("path", "length")
    ok = heads.select("path", "length").join(text, ["path", "length"], "left_anti")
    last = F.greatest(F.floor((F.col("length") - HEADER - 1) / (RECORD * chunk)), F.lit(0)).cast("long")
    parts = ok.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.select("path", "length", (F.col("part") * chunk).alias("first"), F.lit(chunk).cast("long").alias("count"))
    parts = parts.repartition(_tasks(ok, last + 1, RECORD * chunk), "path", "first")
    rows = parts.mapInPandas(_decode, "path string, tri_id long, v array<double>, error string")
    def point(i: int) -> Column:
        return F.struct(*[F.get("v", F.lit(3 * i + j)).alias(a) for j, a in enumerate("xyz")])
    rows = rows.select("path", "tri_id", *[F.when(F.col("error").isNull(), point(i)).alias(f"v{i}") for i in range(3)], "error")
    return rows.unionByName(_ascii_rows(text, RECORD * chunk))


def write_ascii(tri: DataFrame, folder: str, name: str = "mesh") -> None:
    """Triangles as ASCII facets, one file per partition of `tri`, in the order of the rows."""
    def corner(v: str) -> Column:
        return F.concat_ws(" ", F.lit("      vertex"), *[F.col(f"{v}.{a}").cast("string") for a in "xyz"])
    facet = F.concat_ws("\n", F.lit("solid " + name), F.lit("  facet normal 0 0 0"), F.lit("    outer loop"), corner("v0"), corner("v1"), corner("v2"), F.lit("    endloop"), F.lit("  endfacet"), F.lit("endsolid"))
    tri.select(facet.alias("value")).write.text(folder)
