"""Heat flux from level means: Nusselt numbers, boundary layers and self-checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import with_neighbours
from .fit import weighted_line
from .mesh import scatter, tet_gradient
from .stencil import derivatives, trapezoid


def _level_means(nodes: DataFrame, slope: Column, t_ref: float, keys: Sequence[str]) -> DataFrame:
    flux = F.col("rho") * F.col("cp") * F.col("w")
    return nodes.groupBy(*keys).agg(
        F.avg(F.col("z").cast("double")).alias("z"), F.avg(flux * (F.col("t_val") - t_ref)).alias("conv"), F.avg(F.col("kappa") * slope).alias("cond"), F.avg("t_val").alias("tm"), F.avg(flux).alias("mflux")
    )


def level_stats(nodes: DataFrame, t_ref: float) -> DataFrame:
    """iter, level_idx, z, conv, cond, tm, mflux of points in columns (iter, col_idx, level_idx, z, w, t_val, rho, cp, kappa)."""
    return _level_means(derivatives(nodes, {"_g": "t_val"}, "z", ["iter", "col_idx"], "level_idx"), F.col("_g"), t_ref, ["iter", "level_idx"])


def level_stats_mesh(nodes: DataFrame, elems: DataFrame, t_ref: float) -> DataFrame:
    """The same on a tetrahedral mesh of one iteration: the slope at a node is the volume-weighted mean of its elements' (nodes: node_id, x, y, z, level_idx, iter, w, t_val, rho, cp, kappa)."""
    g = scatter(tet_gradient(elems, nodes, ["t_val"]), ["t_val_dz"])
    return _level_means(nodes.join(g, "node_id"), F.col("t_val_dz"), t_ref, ["iter", "level_idx"])


def gradient_mode(layout_row: dict, asked: str = "auto") -> str:
    """"columns" where the points stand in columns, else "fe"; a mode that is asked for must fit."""
    if asked == "auto":
        return "columns" if layout_row["is_columns"] else "fe"
    if asked == "columns" and not layout_row["is_columns"]:
        raise ValueError("the points don't stand in columns")
    return asked


def reference_temperature(levels: DataFrame) -> DataFrame:
    """One row: t_ref, half the sum of the first and last level's mean temperature in the first iteration."""
    first = levels.join(F.broadcast(levels.agg(F.min("iter").alias("iter"))), "iter", "left_semi")
    return first.agg((F.lit(0.5) * (F.min_by("tm", "z") + F.max_by("tm", "z"))).alias("t_ref"))


def mean_levels(levels: DataFrame) -> DataFrame:
    """Mean of the level means over iterations, each with the same weight."""
    return levels.groupBy("level_idx").agg(*[F.avg(c).alias(c) for c in ("z", "conv", "cond", "tm", "mflux")])


def scales(levels: DataFrame, by: Sequence[str] = (), k_ref: float = 1.0, delta_t: float | None = None, height: float | None = None) -> DataFrame:
    """by, sgn, z_lo, z_hi, delta_t, height, den, cond_hot, cond_cold: heat goes from the hotter wall; equal walls count as hot at the top."""
    s = levels.groupBy(*by).agg(
        F.min("z").alias("z_lo"), F.max("z").alias("z_hi"), F.min_by("tm", "z").alias("_t0"), F.max_by("tm", "z").alias("_t1"), F.min_by("cond", "z").alias("_c0"), F.max_by("cond", "z").alias("_c1")
    )
    s = s.withColumn("sgn", F.when(F.col("_t0") > F.col("_t1"), 1.0).otherwise(-1.0))
    s = s.withColumn("delta_t", F.coalesce(F.lit(delta_t).cast("double"), F.abs(F.col("_t0") - F.col("_t1")))).withColumn("height", F.coalesce(F.lit(height).cast("double"), F.col("z_hi") - F.col("z_lo")))
    s = s.withColumn("den", F.lit(float(k_ref)) * F.col("delta_t") / F.col("height"))
    up = F.col("sgn") > 0
    s = s.withColumn("cond_hot", F.when(up, F.col("_c0")).otherwise(F.col("_c1"))).withColumn("cond_cold", F.when(up, F.col("_c1")).otherwise(F.col("_c0")))
    return s.drop("_t0", "_t1", "_c0", "_c1")


def _scaled(levels: DataFrame, by: Sequence[str], s: DataFrame) -> DataFrame:
    s = F.broadcast(s) if not by else s  # one row without groups
    return levels.join(s, list(by)) if by else levels.crossJoin(s)


def nu_profile(levels: DataFrame, pe: float, t_ref: float = 0.0, **how) -> DataFrame:
    """level_idx, z, nu, nu_conv, nu_cond, tm, nu_shift of mean levels; nu_shift is what another reference temperature would add."""
    x = _scaled(levels, (), scales(levels, **how))
    sgn, den = F.col("sgn"), F.col("den")
    return x.select(
        "level_idx", "z", (sgn * (F.col("conv") * pe - F.col("cond")) / den).alias("nu"), (sgn * F.col("conv") * pe / den).alias("nu_conv"), (-sgn * F.col("cond") / den).alias("nu_cond"), "tm",
        (sgn * F.col("mflux") * (pe * t_ref) / den).alias("nu_shift"),
    )


def nu_scalars(levels: DataFrame, pe: float, by: Sequence[str] = (), bulk_range: tuple[float, float] = (0.0, 1.0), s: DataFrame | None = None, **how) -> DataFrame:
    """by, nu_hot, nu_cold, nu_bulk, nu_min, nu_max, nu_mean, spread, imbalance. The bulk is the mean of Nu(z) by trapezoids over the levels inside the range; fewer than two raise an error."""
    s = scales(levels, by, **how) if s is None else s
    x = _scaled(levels, by, s).withColumn("nu", F.col("sgn") * (F.col("conv") * pe - F.col("cond")) / F.col("den"))
    reach = F.col("z_hi") - F.col("z_lo")
    inside = x.where((F.col("z") >= F.col("z_lo") + reach * bulk_range[0] - 1e-12) & (F.col("z") <= F.col("z_lo") + reach * bulk_range[1] + 1e-12))
    bulk = trapezoid(inside, "nu", "z", by).select(*by, F.when(F.col("x_hi") > F.col("x_lo"), F.col("integral") / (F.col("x_hi") - F.col("x_lo"))).otherwise(F.raise_error("the bulk range holds fewer than two levels").cast("double")).alias("nu_bulk"))
    walls = s.select(*by, (-F.col("sgn") * F.col("cond_hot") / F.col("den")).alias("nu_hot"), (-F.col("sgn") * F.col("cond_cold") / F.col("den")).alias("nu_cold"))
    nan = F.max(F.isnan("nu"))
    flat = x.groupBy(*by).agg(F.when(nan, F.lit(float("nan"))).otherwise(F.min("nu")).alias("nu_min"), F.max("nu").alias("nu_max"), F.avg("nu").alias("nu_mean"))
    out = walls.join(bulk, list(by)).join(flat, list(by)) if by else walls.crossJoin(F.broadcast(bulk)).crossJoin(F.broadcast(flat))
    out = out.withColumn("spread", (F.col("nu_max") - F.col("nu_min")) / F.abs("nu_mean"))
    return out.withColumn("imbalance", F.abs(F.col("nu_hot") - F.col("nu_cold")) / (F.lit(0.5) * (F.col("nu_hot") + F.col("nu_cold"))))


def nu_series(levels: DataFrame, pe: float, k_ref: float = 1.0, delta_t: float | None = None, height: float | None = None, bulk_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """iter, nu_hot, nu_cold, nu_bulk, flipped: each iteration by the scales of the mean run, but with its own hot wall; flipped says where that differs from the mean's."""
    ref = scales(mean_levels(levels), (), k_ref, delta_t, height).select(F.col("delta_t").alias("_dt"), F.col("height").alias("_h"), F.col("den").alias("_den"), F.col("sgn").alias("_sgn"))
    own = scales(levels, ("iter",)).crossJoin(F.broadcast(ref)).withColumn("den", F.col("_den")).withColumn("delta_t", F.col("_dt")).withColumn("height", F.col("_h"))
    out = nu_scalars(levels, pe, ("iter",), bulk_range, own.drop("_dt", "_h", "_den", "_sgn"))
    return out.join(own.select("iter", (F.col("sgn") != F.col("_sgn")).alias("flipped")), "iter").select("iter", "nu_hot", "nu_cold", "nu_bulk", "flipped")


def thermal_bl(levels: DataFrame, count_wall: bool = True) -> DataFrame:
    """One row: t_center, delta_b, delta_t, n_b, n_t: thickness where the wall's tangent of T(z) meets the temperature at mid-height, and the levels within it."""
    # one deal of the levels in blocks of neighbours serves the slopes and the temperature at mid-height
    x = with_neighbours(levels.select("level_idx", "z", "tm"), "z")
    x = derivatives(x, {"_g": "tm"}, "z", ["_block"], "z")
    w = W.partitionBy("_block").orderBy("z")
    x = x.withColumns({"_z1": F.lead("z").over(w), "_t1": F.lead("tm").over(w)}).where("_own")
    ends = x.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    x = x.crossJoin(F.broadcast(ends))  # one row
    mid = F.lit(0.5) * (F.col("_lo") + F.col("_hi"))
    at_mid = F.when((mid >= F.col("z")) & (mid < F.col("_z1")), F.col("tm") + (F.col("_t1") - F.col("tm")) * (mid - F.col("z")) / (F.col("_z1") - F.col("z")))
    walls = x.agg(F.max(at_mid).alias("t_center"), F.min_by("tm", "z").alias("t0"), F.max_by("tm", "z").alias("t1"), F.min_by("_g", "z").alias("g0"), F.max_by("_g", "z").alias("g1"))
    walls = walls.select("t_center", (F.abs(F.col("t0") - F.col("t_center")) / F.abs("g0")).alias("delta_b"), (F.abs(F.col("t1") - F.col("t_center")) / F.abs("g1")).alias("delta_t"))
    near = x.crossJoin(F.broadcast(walls))
    less = 0 if count_wall else 1
    reach = 1 + 1e-12
    return near.groupBy("t_center", "delta_b", "delta_t").agg(
        (F.count_if(F.col("z") - F.col("_lo") <= F.col("delta_b") * reach) - less).alias("n_b"), (F.count_if(F.col("_hi") - F.col("z") <= F.col("delta_t") * reach) - less).alias("n_t")
    )


def thickness(levels: DataFrame, z: str = "z") -> DataFrame:
    """Adds dz: half the distance between a level's neighbours, at the ends the distance to the only one. Levels go in blocks of neighbours (and are looked at)."""
    rows = with_neighbours(levels, z, 1)
    w = W.partitionBy("_block").orderBy(z)
    before, after = F.lag(z).over(w), F.lead(z).over(w)
    own = F.col(z)
    return rows.withColumn("dz", F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2)).where("_own").drop("_block", "_own")


def pe_self_check(profile: DataFrame) -> DataFrame:
    """One row: f, q, rms_rel. Fits nu_cond = q - f nu_conv over the levels, by their thickness; f is near 1 if the velocity's scale is right."""
    fit = weighted_line(thickness(profile), "nu_conv", "nu_cond", "dz")
    return fit.select((-F.col("slope")).alias("f"), F.col("intercept").alias("q"), (F.col("rms") / F.abs("intercept")).alias("rms_rel"))


def nu_from_dissipation(phi: DataFrame, pr: float) -> DataFrame:
    return phi.select((F.lit(1.0) + F.col("phi_mean") * pr).alias("nu_v"))


def peclet(pe: float | None = None, ra: float | None = None, pr: float | None = None) -> float:
    """pe if given, else sqrt(ra pr)."""
    if pe is not None:
        return float(pe)
    if ra is None or pr is None:
        raise ValueError("give pe, or ra and pr")
    return float((ra * pr) ** 0.5)
