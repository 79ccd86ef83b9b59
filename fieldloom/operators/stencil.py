"""Ordered neighbour operators: derivatives on uneven grids, quadrature and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import col, with_neighbours
from .blocks import block_gradient


def _parabola_slope(at: Column, nodes: list[Column]) -> Column:
    """Slope at ``at`` of the parabola through three (x, f) structs: the derivative of its Lagrange form."""
    total = None
    for n in range(3):
        a, b, c = nodes[n], nodes[(n + 1) % 3], nodes[(n + 2) % 3]
        term = a["f"] * (at * 2 - b["x"] - c["x"]) / ((a["x"] - b["x"]) * (a["x"] - c["x"]))
        total = term if total is None else total + term
    return total


def derivatives(df: DataFrame, values: dict[str, Column | str], coord: Column | str, by: Sequence[str], order: str) -> DataFrame:
    """Adds d(value)/d(coord) for each name in ``values``, along ``order`` within ``by``.

    The slope of the parabola through a point and its two neighbours, or at an end
    through the three outermost points: second order on uneven
    spacing and exact for quadratics. Lines of fewer than three points raise
    an error. All values of one axis share an exchange, a sort and a window. Without ``by`` all rows are one line, which goes in blocks of neighbours
    (and looks at the data).
    """
    if not by:
        return derivatives(with_neighbours(df, order), values, coord, ["_block"], order).where("_own").drop("_block", "_own")
    edges = "_own" in df.columns  # a block's borders have too few neighbours, and aren't its own
    w = W.partitionBy(*by).orderBy(order)
    df = df.withColumns({f"_s_{name}": F.struct(col(coord).cast("double").alias("x"), col(v).cast("double").alias("f")) for name, v in values.items()})
    shifted = {f"_{side}{n}_{name}": shift(f"_s_{name}", n).over(w) for name in values for side, shift in (("b", F.lag), ("a", F.lead)) for n in (1, 2)}
    df = df.withColumns(shifted)
    out = {}
    for name in values:
        own, b1, b2, a1, a2 = (F.col(f"_{x}_{name}") for x in ("s", "b1", "b2", "a1", "a2"))
        first, last = b1.isNull(), a1.isNull()
        nodes = [F.when(first, own).otherwise(F.when(last, b2).otherwise(b1)), F.when(first, a1).otherwise(F.when(last, b1).otherwise(own)), F.when(first, a2).otherwise(F.when(last, own).otherwise(a1))]
        short = (first & a2.isNull()) | (last & b2.isNull())
        short = short & F.col("_own") if edges else short
        out[name] = F.when(short, F.raise_error("a derivative needs three points on each line").cast("double")).otherwise(_parabola_slope(own["x"], nodes))
    return df.withColumns(out).drop(*shifted, *[f"_s_{name}" for name in values])


def gradient(df: DataFrame, values: Sequence[str], axes: Sequence[str] = ("x", "y", "z"), indices: dict[str, str] | None = None) -> DataFrame:
    """Adds ``<value>_d<axis>`` on a structured grid with index columns i, j, k and coordinate columns x, y, z, in one exchange for all axes; see blocks.block_gradient."""
    return block_gradient(df, {a: values for a in axes}, indices)


def radial(df: DataFrame, ref: tuple[float, float, float], ep: float = 1e-12) -> DataFrame:
    """Adds r_x, r_y, r_z, r and co_eff = 1 / (4 pi (r + ep)^2), seen from the point ``ref``."""
    df = df.withColumns({f"r_{a}": F.col(a).cast("double") - F.lit(float(v)) for a, v in zip("xyz", ref, strict=True)})
    df = df.withColumn("r", F.sqrt(F.col("r_x") * F.col("r_x") + F.col("r_y") * F.col("r_y") + F.col("r_z") * F.col("r_z")))
    return df.withColumn("co_eff", F.lit(1.0) / (F.lit(4.0) * F.pi() * (F.col("r") + ep) * (F.col("r") + ep)))


def radial_gradient(df: DataFrame, values: dict[str, Column | str], ref: tuple[float, float, float], ep: float = 1e-12, indices: dict[str, str] | None = None) -> DataFrame:
    """Adds (r_x d/dx + r_y d/dy + r_z d/dz) / (r + ep) of each value. The operator is linear: sum terms with constant factors first."""
    names = {f"_v{n}": v for n, v in enumerate(values.values())}
    df = radial(df.withColumns({n: col(v).cast("double") for n, v in names.items()}), ref, ep)
    df = gradient(df, list(names), indices=indices)
    out = {name: (F.col("r_x") * F.col(f"{n}_dx") + F.col("r_y") * F.col(f"{n}_dy") + F.col("r_z") * F.col(f"{n}_dz")) / (F.col("r") + ep) for name, n in zip(values, names, strict=True)}
    return df.withColumns(out).drop(*names, *[f"{n}_d{a}" for n in names for a in "xyz"])


def trapezoid(df: DataFrame, y: Column | str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """integral, x_lo, x_hi of y over x by trapezoids, a row for each group. Without groups the rows go in blocks of neighbours (and are looked at)."""
    keys = list(by)
    part = df.select(*keys, F.col(x).alias("_x"), col(y).alias("_y"))
    part = part if keys else with_neighbours(part, "_x", 1)
    w = W.partitionBy(*(keys or ["_block"])).orderBy("_x")
    part = part.withColumns({"_x1": F.lead("_x").over(w), "_y1": F.lead("_y").over(w)})
    part = part if keys else part.where("_own")
    return part.groupBy(*keys).agg(F.sum(F.lit(0.5) * (F.col("_y") + F.col("_y1")) * (F.col("_x1") - F.col("_x"))).alias("integral"), F.min("_x").alias("x_lo"), F.max("_x").alias("x_hi"))


def interpolate(df: DataFrame, y: Column | str, x: str, at: Column, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Piecewise linear y at x = ``at`` (a column constant in each group), held at the ends: a row for each group. Without groups the rows go in blocks of neighbours (and are looked at)."""
    keys = list(by)
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"), at.cast("double").alias("_at"))
    rows = rows if keys else with_neighbours(rows.withColumnRenamed("_at", "_to"), "_x", 1).withColumnRenamed("_to", "_at")
    w = W.partitionBy(*(keys or ["_block"])).orderBy("_x")
    rows = rows.withColumns({"_x1": F.lead("_x").over(w), "_y1": F.lead("_y").over(w), "_x0": F.lag("_x").over(w)})
    rows = rows if keys else rows.where("_own")
    inside = (F.col("_at") >= F.col("_x")) & (F.col("_at") < F.col("_x1"))
    value = F.when(inside, F.col("_y") + (F.col("_y1") - F.col("_y")) * (F.col("_at") - F.col("_x")) / (F.col("_x1") - F.col("_x")))
    value = value.when(F.col("_x1").isNull() & (F.col("_at") >= F.col("_x")), F.col("_y")).when(F.col("_x0").isNull() & (F.col("_at") < F.col("_x")), F.col("_y"))
    return rows.groupBy(*keys).agg(F.max(value).alias(name))
