"""Scalar expressions over bits, bytes and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_bit(level: Column, inverted: bool) -> Column:
    """The logical bit of a raw level; a level that is neither 0 nor 1 has none."""
    ok = level.isin(0, 1)
    return F.when(ok, (1 - level) if inverted else level).cast("int")


def hex_to_bytes(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.conv(x, 16, 10).cast("int"))


def bytes_to_bits(values: Column) -> Column:
    """Most significant bit first."""
    one = lambda v: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda s: F.call_function("shiftright", v, s).bitwiseAND(F.lit(1)))
    return F.flatten(F.transform(values, one))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_to_bytes(bits: Column) -> Column:
    """Whole bytes of a string of bits, most significant bit first; a partial one at the end is dropped."""
    n = F.floor(F.length(bits) / 8).cast("int")
    byte = lambda k: F.conv(F.substr(bits, k * 8 + 1, F.lit(8)), 2, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))


def bits_to_bytes(bits: Column) -> Column:
    """The same of an array of bits."""
    return let(bit_string(bits), text_to_bytes)


def bit_string(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), "")


def byte_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.bitwiseAND(F.lit(255))), 2, "0")


def bytes_hex(values: Column) -> Column:
    return F.array_join(F.transform(values, byte_hex), " ")


def marker_transitions(bits: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: (i == 0) | (F.get(bits, i) != F.get(bits, i - 1)))


def minus_product(y: Column, a: Column, b: Column) -> Column:
    """y - a * b rounded once, as a fused operation does: the product's and the difference's rounding errors are exact
    doubles, and are put back before the end."""
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    said = F.struct(y.alias("y"), a.alias("a"), b.alias("b"), (a * b).alias("p"), half(a).alias("ah"), half(b).alias("bh"))

    def ends(v: Column) -> Column:
        al, bl = v["a"] - v["ah"], v["b"] - v["bh"]
        lost = ((v["ah"] * v["bh"] - v["p"]) + v["ah"] * bl + al * v["bh"]) + al * bl
        return let(F.struct(v["y"].alias("y"), v["p"].alias("p"), lost.alias("lost"), (v["y"] - v["p"]).alias("d")), rest)

    def rest(v: Column) -> Column:
        back = v["d"] - v["y"]
        return v["d"] + (((v["y"] - (v["d"] - back)) - (v["p"] + back)) - v["lost"])

    return let(said, ends)


def ols(points: Column) -> Column:
    """Least squares over an array of structs (x, y): a struct (n, slope, intercept, max_residual), null with fewer
    than two points or no spread in x. Means and moments are updated point by point in array order, the way DuckDB's
    regr_slope and regr_intercept do, so a slope that lies between two whole numbers is rounded to the same one, and
    the result does not depend on partitions."""
    n, zero = F.size(points).cast("double"), F.lit(0.0)
    state = lambda **v: F.struct(*[c.alias(k) for k, c in v.items()])

    def step(s: Column, p: Column) -> Column:
        x, y, k = p["x"].cast("double"), p["y"].cast("double"), s["k"] + 1.0
        mx, my = s["mx"] + (x - s["mx"]) / k, s["my"] + (y - s["my"]) / k
        return state(k=k, mx=mx, my=my, xy=s["xy"] + (x - s["mx"]) * (y - my), xx=s["xx"] + (x - mx) * (x - s["mx"]), sx=s["sx"] + x, sy=s["sy"] + y)

    def fit(s: Column) -> Column:
        slope = (s["xy"] / n) / F.nullif(s["xx"] / n, zero)
        return let(F.struct(slope.alias("a"), (s["sx"] / n).alias("x"), (s["sy"] / n).alias("y")), lambda f: told(f["a"], minus_product(f["y"], f["a"], f["x"])))

    def told(slope: Column, intercept: Column) -> Column:
        return let(F.struct(slope.alias("a"), intercept.alias("b")), lambda f: F.when(f["a"].isNotNull(), F.struct(
            F.size(points).alias("n"), f["a"].alias("slope"), f["b"].alias("intercept"),
            F.array_max(F.transform(points, lambda p: F.abs(p["y"] - f["b"] - f["a"] * p["x"]))).alias("max_residual"),
        )))

    return F.when(F.size(points) >= 2, let(F.aggregate(points, state(k=zero, mx=zero, my=zero, xy=zero, xx=zero, sx=zero, sy=zero), step), fit))
