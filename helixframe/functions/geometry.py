"""Vector geometry as column expressions over structs of x, y and z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x, y, z) -> Column:
    """A point of three numbers, in double precision."""
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for v, n in zip((x, y, z), "xyz", strict=True)])


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[k] - b[k]).alias(k) for k in "xyz"])


def scaled(a: Column, by: Column) -> Column:
    return F.struct(*[(a[k] * by).alias(k) for k in "xyz"])


def total(*points: Column) -> Column:
    return F.struct(*[sum((p[k] for p in points[1:]), points[0][k]).alias(k) for k in "xyz"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct(
        (a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
        (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
        (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"),
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; null where one has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def bond_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at b in degrees; null where two points coincide."""
    return F.degrees(F.acos(cosine(minus(a, b), minus(c, b))))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _signed_torsion(cos: Column, side: Column) -> Column:
    size = F.when(cos >= 1, 0.0).when(cos <= -1, 180.0).otherwise(F.coalesce(F.degrees(F.acos(cos)), F.lit(0.0)))
    return F.when(side < 0, -size).otherwise(size)


def torsion(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Torsion of four points in degrees, in (-180, 180]; 0 where three lie on a line. Null points give null."""
    steps = F.struct(minus(b, a).alias("p"), minus(c, b).alias("q"), minus(d, c).alias("r"))
    normals = lambda s: F.struct(cross(s["p"], s["q"]).alias("u"), cross(s["q"], s["r"]).alias("v"), s["q"].alias("q"))
    parts = lambda n: F.struct(cosine(n["u"], n["v"]).alias("c"), dot(n["u"], cross(n["v"], n["q"])).alias("s"))
    angle = let(steps, lambda s: let(normals(s), lambda n: let(parts(n), lambda x: _signed_torsion(x["c"], x["s"]))))
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull(), angle)


def with_torsion(df: DataFrame, points: list[str], name: str = "torsion") -> DataFrame:
    """df with the torsion of four columns of points, in steps of plain numbers, which stay in generated code."""
    a, b, c, d = map(F.col, points)
    vectors = {"_p": (a, b), "_q": (b, c), "_r": (c, d)}
    out = df.withColumns({f"{n}{k}": y[k] - x[k] for n, (x, y) in vectors.items() for k in "xyz"})

    def of(n: str) -> dict[str, Column]:
        return {k: F.col(f"{n}{k}") for k in "xyz"}

    for n, x, y in (("_u", "_p", "_q"), ("_v", "_q", "_r"), ("_w", "_v", "_q")):
        product = cross(of(x), of(y))
        out = out.withColumns({f"{n}{k}": product[k] for k in "xyz"})
    out = out.withColumns({"_c": cosine(of("_u"), of("_v")), "_s": dot(of("_u"), of("_w"))})
    spare = [f"{n}{k}" for n in ("_p", "_q", "_r", "_u", "_v", "_w") for k in "xyz"]
    return out.withColumn(name, _signed_torsion(F.col("_c"), F.col("_s"))).drop(*spare, "_c", "_s")


def place(a: Column, b: Column, c: Column, length: Column, angle: Column, twist: Column) -> Column:
    """The point at a bond length, angle and torsion (degrees) from the three before it."""
    theta, tau = F.radians(angle), F.radians(twist)

    def from_frame(f: Column) -> Column:
        return total(c, scaled(f["axis"], -length * F.cos(theta)), scaled(cross(f["n"], f["axis"]), length * F.cos(tau) * F.sin(theta)), scaled(f["n"], length * F.sin(tau) * F.sin(theta)))

    def unit(v: Column) -> Column:
        return let(v, lambda x: scaled(x, 1 / norm(x)))

    axis = unit(minus(c, b))
    return let(axis, lambda x: let(F.struct(x.alias("axis"), unit(cross(minus(b, a), x)).alias("n")), from_frame))
