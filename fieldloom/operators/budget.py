"""Budgets of two-point energy and heat flux."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import few
from .blocks import block_gradient
from .stencil import gradient, radial, radial_gradient

PRODUCTS = ["xg", "yg", "zg", "ft_u", "ft_v", "ft_w"]
VELOCITY = ("u", "v", "w")
#: Snapshots up to which the reference point's rows are broadcast.
MOST_SNAPSHOTS = 100_000


def accumulators(fluct: DataFrame, ref: tuple[int, int, int], flux: str = "w") -> DataFrame:
    """Means over snapshots, for each cell, of the products with the reference point's fluctuations (0): (u0 u' + v0 v' + w0 w')(c0 - c') and f0 T'(c0 - c') for c = u, v, w."""
    here = fluct.where((F.col("i") == ref[0]) & (F.col("j") == ref[1]) & (F.col("k") == ref[2])).select("t", *[F.col(f).alias(f"{f}0") for f in VELOCITY])
    rows = fluct.join(few(here, MOST_SNAPSHOTS), "t")
    inner = F.col("u0") * F.col("u") + F.col("v0") * F.col("v") + F.col("w0") * F.col("w")
    gaps = [F.col(f"{c}0") - F.col(c) for c in VELOCITY]
    values = [inner * g for g in gaps] + [F.col(f"{flux}0") * F.col("t_val") * g for g in gaps]
    return rows.groupBy("i", "j", "k").agg(*[F.avg(v).alias(n) for n, v in zip(PRODUCTS, values, strict=True)])


def accumulators_many(fluct: DataFrame, refs: Sequence[tuple[int, int, int]], flux: str = "w") -> DataFrame:
    """ref_i, ref_j, ref_k and what accumulators gives, for several reference points in one pass over the snapshots. Snapshots that lack one of the points don't count."""
    refs = list(dict.fromkeys(refs))
    at = [(F.col("i") == i) & (F.col("j") == j) & (F.col("k") == k) for i, j, k in refs]
    here = fluct.where(reduce(Column.__or__, at)).groupBy("t").agg(*[F.max(F.when(c, F.col(f))).alias(f"{f}0_{m}") for m, c in enumerate(at) for f in VELOCITY]).dropna()
    sums = []
    for m in range(len(refs)):
        first = {f: F.col(f"{f}0_{m}") for f in VELOCITY}
        inner = first["u"] * F.col("u") + first["v"] * F.col("v") + first["w"] * F.col("w")
        gaps = [first[c] - F.col(c) for c in VELOCITY]
        values = [inner * g for g in gaps] + [first[flux] * F.col("t_val") * g for g in gaps]
        sums += [F.avg(v).alias(f"{n}_{m}") for n, v in zip(PRODUCTS, values, strict=True)]
    cells = fluct.join(few(here, MOST_SNAPSHOTS), "t").groupBy("i", "j", "k").agg(*sums)
    each = [F.struct(*[F.lit(x).cast("long").alias(f"ref_{a}") for a, x in zip("ijk", ref, strict=True)], *[F.col(f"{n}_{m}").alias(n) for n in PRODUCTS]) for m, ref in enumerate(refs)]
    return cells.select("i", "j", "k", F.explode(F.array(*each)).alias("s")).select("s.ref_i", "s.ref_j", "s.ref_k", "i", "j", "k", *[f"s.{n}" for n in PRODUCTS])


def wide(corr: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """i, j, k and a column R_<fi>_<fj> for each pair, or those of ``pairs``; the lag takes the place of k."""
    names = ["u", "v", "w", "t_val"]
    pairs = sorted(pairs or [(a, b) for a in names for b in names])
    some = corr.where(F.concat_ws(" ", "fi", "fj").isin([f"{a} {b}" for a, b in pairs]))
    return some.groupBy("i", "j", F.col("lag").alias("k")).agg(*[F.max(F.when((F.col("fi") == a) & (F.col("fj") == b), F.col("r"))).alias(f"R_{a}_{b}") for a, b in pairs])


def _needs(flux: str) -> dict[str, list[tuple[str, str]]]:
    """The pairs whose correlations each term asks for."""
    all_ = [(a, b) for a in VELOCITY for b in VELOCITY]
    with_flux = [(flux, a) for a in VELOCITY]
    return {
        "E_prod_h": all_, "E_prod_I": all_, "E_inter_m": [(a, a) for a in VELOCITY], "E_inter_f": [],
        "H_prod_h": [(a, "t_val") for a in VELOCITY] + with_flux, "H_prod_I": with_flux, "H_inter_m": [(flux, "t_val")], "H_inter_f": [],
    }


def asks(which: Sequence[str] | None, flux: str = "w") -> tuple[set[tuple[str, str]], bool]:
    """The pairs of fields whose correlations the terms (all, if None) need, and whether they need the products of accumulators."""
    wanted = list(which or _needs(flux))
    return {p for n in wanted for p in _needs(flux)[n]}, bool({"E_inter_f", "H_inter_f"} & set(wanted))


def _plane_gradients(mean: DataFrame, coords: DataFrame) -> DataFrame:
    """i, j, each mean and its slopes in x and y. Means along z don't change with z, so there is no third."""
    plane = coords.select("i", "j", "x", "y").distinct()
    return gradient(mean.join(plane, ["i", "j"]), ["u", "v", "w", "t_val"], ("x", "y"), {"x": "i", "y": "j"}).drop("x", "y")


def terms(corr: DataFrame | None, mean: DataFrame, products: DataFrame | None, grid: DataFrame, ref: tuple[int, int, int], ref_xyz: tuple[float, float, float], flux: str = "w", which: Sequence[str] | None = None, weighted: bool = False, ep: float = 1e-12, shift_lag: bool = False) -> DataFrame:
    """i, j, k and the eight budget terms, or those of ``which``.

    corr: fi, fj, i, j, lag, r. mean: the mean along z of the time means (i, j).
    products: see accumulators. Either is None where no term asks for it (see asks). grid: i, j, k, x, y, z. Terms come without the
    weight 1 / (4 pi (r + ep)^2), or with it if ``weighted``. The lag of the
    correlations stands at the place of z though r is taken from the reference
    point's z, as is usual for these terms; ``shift_lag`` rolls it to the
    reference's k first.

    The radial derivative is linear: each term adds up its parts first and takes one.
    """
    wanted = list(which or _needs(flux))
    pairs, with_products = asks(which, flux)
    r = wide(corr, pairs) if pairs else None
    if shift_lag and pairs:
        r = r.crossJoin(F.broadcast(grid.agg((F.max("k") + 1).alias("_nz")))).withColumn("k", F.pmod(F.col("k") + ref[2], F.col("_nz"))).drop("_nz")
    slopes = _plane_gradients(mean, grid)
    names = [c for c in slopes.columns if c not in ("i", "j")]
    at_ref = slopes.where((F.col("i") == ref[0]) & (F.col("j") == ref[1])).select(*[F.col(c).alias(f"{c}_0") for c in names])
    # products cost a pass over all snapshots, correlations another: each is joined where a term asks for it
    base = grid.select("i", "j", "k", "x", "y", "z")
    if pairs:
        base = base.join(r, ["i", "j", "k"]).join(slopes.crossJoin(F.broadcast(at_ref)), ["i", "j"])
    if with_products:
        base = base.join(products, ["i", "j", "k"])

    def at(v: str, a: str) -> Column:
        return F.lit(0.0) if a == "z" else F.col(f"{v}_d{a}_0")

    def change(v: str, a: str) -> Column:
        return F.lit(0.0) if a == "z" else F.col(f"{v}_d{a}") - F.col(f"{v}_d{a}_0")

    axis = dict(zip(VELOCITY, "xyz", strict=True))
    pair = lambda a, b: F.col(f"R_{a}_{b}")
    total = lambda xs: sum(xs[1:], xs[0])
    away = {v: F.col(f"{v}_0") - F.col(v) for v in VELOCITY}
    energy = pair("u", "u") + pair("v", "v") + pair("w", "w")
    half = F.lit(0.5)
    once = {
        # a pair's own gradient and that of its mirror: twice the same for equal components
        "E_prod_h": half * total([pair(a, b) * (at(b, axis[a]) + at(a, axis[b])) for a in VELOCITY for b in VELOCITY]),
        "E_prod_I": half * total([pair(a, b) * change(a, axis[b]) for a in VELOCITY for b in VELOCITY]),
        "H_prod_h": total([pair(a, "t_val") * at(flux, axis[a]) + pair(flux, a) * at("t_val", axis[a]) for a in VELOCITY]),
        "H_prod_I": total([pair(flux, a) * change("t_val", axis[a]) for a in VELOCITY]),
    }
    # sums of slopes along x, y, z, to be taken along r afterwards
    twice = {
        "E_inter_m": (half, [energy * away[v] for v in VELOCITY]),
        "E_inter_f": (half, [F.col(c) for c in PRODUCTS[:3]]),
        "H_inter_m": (F.lit(1.0), [pair(flux, "t_val") * away[v] for v in VELOCITY]),
        "H_inter_f": (F.lit(1.0), [F.col(c) for c in PRODUCTS[3:]]),
    }
    inner = {n: v for n, v in twice.items() if n in wanted}
    if inner:
        base = base.withColumns({f"_{n}_{a}": v[place] for n, (_, v) in inner.items() for place, a in enumerate("xyz")})
        base = block_gradient(base, {a: [f"_{n}_{a}" for n in inner] for a in "xyz"})
    ready = {n: once[n] for n in wanted if n in once} | {n: c * total([F.col(f"_{n}_{a}_d{a}") for a in "xyz"]) for n, (c, _) in inner.items()}
    base = base.select("i", "j", "k", "x", "y", "z", *[v.alias(f"_in_{n}") for n, v in ready.items()])
    out = radial_gradient(base, {n: f"_in_{n}" for n in wanted}, ref_xyz, ep)
    return out.select("i", "j", "k", *[(F.col(n) * F.col("co_eff") if weighted else F.col(n)).alias(n) for n in wanted])


def unweighted(table: DataFrame, names: Sequence[str], ref_xyz: tuple[float, float, float], ep: float = 1e-12) -> DataFrame:
    """Terms divided by their weight again, with r_x, r_y, r_z, and <a>_tot for pairs of halves (<a>_m and <a>_f, <a>_h and <a>_I) that are both there."""
    out = radial(table, ref_xyz, ep)
    out = out.withColumns({n: F.col(n) / F.col("co_eff") for n in names})
    for stem, one, two in (("prod", "h", "I"), ("inter", "m", "f")):
        for kind in "EH":
            a, b = f"{kind}_{stem}_{one}", f"{kind}_{stem}_{two}"
            if a in names and b in names:
                out = out.withColumn(f"{kind}_{stem}_tot", F.col(a) + F.col(b))
    return out.drop("r", "co_eff")
