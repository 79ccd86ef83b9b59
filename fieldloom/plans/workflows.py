"""From native files to results: merged meshes, their mean field and Nusselt numbers, and the spectra and budgets of structured snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..operators import budget, correlation, fit, mesh, moments, nusselt, profile, spectral
from ..streaming import Checkpoint
from ..streaming.spectra import SpectralSums

AXES = {"X": "x", "Y": "y", "Z": "z"}


def _iterations(spark: SparkSession, folder: str, iters: Sequence[int] | None) -> list[int]:
    """The iterations that are there, or those asked for; a missing one raises ValueError."""
    there = sorted(r["iter"] for r in sources.list_partitions(spark, folder).select("iter").collect())  # a number for each iteration
    if iters is not None and (missing := set(iters) - set(there)):
        raise ValueError(f"no files of iterations {sorted(missing)}")
    wanted = there if iters is None else sorted(set(iters))
    if not wanted:
        raise ValueError(f"no iterations in {folder}")
    return wanted


def merged(spark: SparkSession, folder: str, iters: Sequence[int], variables: Sequence[str], tol: float = 1e-6, dtype: str = "float32") -> DataFrame:
    """iter, node_id, x, y, z and the variables of merged meshes. Looks at the data: the text is parsed once, into a table, as numbering nodes reads them several times."""
    nodes = sinks.staged(spark, sources.read_nodes(spark, folder, variables, iters, dtype=dtype).withColumnsRenamed(AXES))
    ids = mesh.canonical_ids(nodes, tol).where("kept").select("iter", "blk", "node_idx", "node_id")
    return nodes.join(ids.hint("merge"), ["iter", "blk", "node_idx"]).select("iter", "node_id", "x", "y", "z", *variables)


def connectivity(spark: SparkSession, folder: str, iteration: int, tol: float = 1e-6) -> DataFrame:
    """elem_idx, n0 to n3 of an iteration's merged mesh, elements in the order of their blocks."""
    nodes = sources.read_nodes(spark, folder, [], [iteration]).withColumnsRenamed(AXES)
    elems = mesh.remap(sources.read_elements(spark, folder, [iteration]), mesh.canonical_ids(nodes, tol))
    counts = elems.groupBy("blk").agg((F.max("elem_idx") + 1).alias("n")).collect()  # a row for each block
    first, base = 0, []
    for r in sorted(counts):
        base.append((r["blk"], first))
        first += r["n"]
    before = spark.createDataFrame(base, "blk int, _first long")
    return elems.join(F.broadcast(before), "blk").select((F.col("elem_idx") + F.col("_first")).alias("elem_idx"), *mesh.CORNERS)


def time_average(spark: SparkSession, folder: str, out: str, variable: str, iters: Sequence[int] | None = None, tol: float = 1e-6, check_tol: float = 1e-5, level_tol: float = 1e-6, dtype: str = "float32", elements: bool = False) -> tuple[DataFrame, DataFrame]:
    """The time mean of a variable on the merged mesh (node_id, x, y, z, variable, n) and its profile by level.

    Merged iterations are kept under ``out``/iterations, so a later call makes only those that are new or whose files have changed. All
    must have the first one's nodes within ``check_tol``. Writes mean.dat and profile.dat to ``out``; ``elements`` adds the tetrahedra.
    """
    wanted = _iterations(spark, folder, iters)
    done = Checkpoint(spark, f"{out}/iterations", {"variable": variable, "dtype": dtype, "tol": tol}, warn_only=("tol",))
    done.run_together(wanted, lambda its: merged(spark, folder, its, [variable], tol, dtype), prints=sources.fingerprints(spark, folder))
    all_ = done.read(wanted)
    first = all_.where(F.col("iter") == wanted[0])
    mesh.check_series(mesh.grid_extents(all_, ["node_id"]), len(wanted), check_tol)
    mean = moments.time_mean(all_, [variable], ["node_id"]).join(first.select("node_id", "x", "y", "z"), "node_id").select("node_id", "x", "y", "z", variable, "n")
    levels = profile.level_profile(mean, "z", {variable: variable}, level_tol, level_z="mean")
    sinks.write_mesh(spark, f"{out}/mean.dat", mean, ["x", "y", "z", variable], connectivity(spark, folder, wanted[0], tol) if elements else None)
    sinks.write_profile(spark, f"{out}/profile.dat", levels, "z", variable)
    return mean, levels


def extract(spark: SparkSession, folder: str, out: str, variables: Sequence[str], iters: Sequence[int] | None = None, tol: float = 1e-6, dtype: str = "float32", elements: bool = False, files: bool = True) -> DataFrame:
    """iter, node_id, x, y, z and some or all variables of the merged meshes, kept under ``out``/nodes; with ``files``, full_iter<n>.dat for each iteration too, with its tetrahedra if ``elements``.

    Iterations that are there already, of unchanged files, are passed over, and so are their text files.
    """
    wanted, prints = _iterations(spark, folder, iters), sources.fingerprints(spark, folder)
    done = Checkpoint(spark, f"{out}/nodes", {"variables": list(variables), "dtype": dtype, "tol": tol}, warn_only=("tol",))
    before = set(done.current(prints))
    done.run_together(wanted, lambda its: merged(spark, folder, its, variables, tol, dtype), prints=prints)
    all_ = done.read(wanted)
    for it in wanted if files else ():
        path = f"{out}/full_iter{it}.dat"
        if it not in before or not sinks.exists(spark, path):
            sinks.write_mesh(spark, path, all_.where(F.col("iter") == it), ["x", "y", "z", *variables], connectivity(spark, folder, it, tol) if elements else None)
    return all_


#: The variables that heat fluxes, and those that dissipation, is computed from.
NEEDED, SHEAR = ["W", "T", "rho", "cp", "kappa"], ["U", "V", "W", "mu"]


def nusselt_numbers(
    spark: SparkSession, folder: str, out: str, pe: float, iters: Sequence[int] | None = None, mode: str = "auto", t_ref: float | str = 0.0, tol: float = 1e-6, level_tol: float = 1e-8, bulk_range: tuple[float, float] = (0.0, 1.0), dtype: str = "float32", pr: float | None = None, **how
) -> dict[str, DataFrame]:
    """levels, profile, scalars, series, statistics, boundary_layer and self_check of a mesh's heat flux.

    ``mode``: columns or fe, or auto, which takes columns if the first iteration's points stand in such. ``t_ref``: a
    number, or "auto" for half the sum of the walls' temperatures in the first iteration. Level means are kept under ``out``/levels, so that a
    later call makes only iterations that are new or whose files have changed; everything else follows from them. Writes profile.dat and summary.txt. With ``pr`` there are dissipation (iter, volume, phi_mean)
    and nu_v too, the Nusselt number of the mean dissipation; the iterations' dissipation is kept under ``out``/dissipation.
    """
    wanted = _iterations(spark, folder, iters)
    names = {"W": "w", "T": "t_val"}

    def nodes(it: int) -> DataFrame:
        return profile.levels(merged(spark, folder, [it], NEEDED, tol, dtype).withColumnsRenamed(names), "z", level_tol)

    mode = nusselt.gradient_mode(profile.layout(nodes(wanted[0]), level_tol).first().asDict(), mode)

    def level_means(it: int) -> DataFrame:
        own = nodes(it)
        means = nusselt.level_stats(profile.column_index(own), 0.0) if mode == "columns" else nusselt.level_stats_mesh(own, connectivity(spark, folder, it, tol), 0.0)
        return means.drop("iter")

    done = Checkpoint(spark, f"{out}/levels", {"mode": mode, "dtype": dtype, "tol": tol}, warn_only=("tol",))
    done.run(wanted, level_means, prints=sources.fingerprints(spark, folder))
    levels = done.read(wanted)
    reference = float(nusselt.reference_temperature(levels).first()["t_ref"] if t_ref == "auto" else t_ref)
    # the flux of another reference temperature differs by that of mass
    levels = levels.withColumn("conv", F.col("conv") - reference * F.col("mflux"))
    mean = nusselt.mean_levels(levels)
    series = nusselt.nu_series(levels, pe, bulk_range=bulk_range, **how)
    results = {
        "levels": levels, "profile": nusselt.nu_profile(mean, pe, reference, **how), "scalars": nusselt.nu_scalars(mean, pe, bulk_range=bulk_range, **how), "series": series,
        "statistics": fit.series_stats(series, ["nu_hot", "nu_cold", "nu_bulk"], "iter"), "boundary_layer": nusselt.thermal_bl(mean),
    }
    if pr is not None:
        shear = Checkpoint(spark, f"{out}/dissipation", {"dtype": dtype, "tol": tol}, warn_only=("tol",))
        velocity = lambda it: merged(spark, folder, [it], SHEAR, tol, dtype).withColumnsRenamed({"U": "u", "V": "v", "W": "w"})
        shear.run(wanted, lambda it: mesh.dissipation(connectivity(spark, folder, it, tol), velocity(it)), prints=sources.fingerprints(spark, folder))
        results["dissipation"] = shear.read(wanted)
        results["nu_v"] = nusselt.nu_from_dissipation(results["dissipation"].agg(F.avg("phi_mean").alias("phi_mean")), pr)
    results["self_check"] = nusselt.pe_self_check(results["profile"])
    sinks.write_profile(spark, f"{out}/profile.dat", results["profile"], "z", "nu")
    sinks.write_summary(spark, f"{out}/summary.txt", results["scalars"].crossJoin(F.broadcast(results["boundary_layer"])))
    return results


def two_point_budgets(spark: SparkSession, folder: str, grid_file: str, out: str, ref: tuple[int, int, int] | Sequence[tuple[int, int, int]], flux: str = "w", which: Sequence[str] | None = None) -> DataFrame | dict[tuple[int, int, int], DataFrame]:
    """i, j, k, x, y, z and the budget terms of structured snapshots, from the mean to the terms; correlations and products are kept as tables under ``out``, and terms.dat has the terms.

    For several reference points, a dict of such tables by point: snapshots are read for all points together, and files are named terms_<i>_<j>_<k>.dat.
    """
    refs = [ref] if isinstance(ref[0], int) else list(dict.fromkeys(map(tuple, ref)))
    snap = sources.read_snapshots(spark, folder).withColumnRenamed("e", "t_val").withColumn("t", F.col("time_num"))
    grid = sources.read_grid(spark, grid_file)
    mesh.check_extent(snap, grid)
    mean = moments.z_mean(moments.time_mean(snap))
    flow = snap.select("t", "i", "j", "k", "u", "v", "w", "t_val")
    pairs, with_products = budget.asks(which, flux)
    lines_ = {r[:2] for r in refs}
    hull = {a: (min(x), max(x)) for a, x in zip("ij", zip(*lines_, strict=True), strict=True)}
    line = sources.read_snapshots(spark, folder, places=hull).withColumnRenamed("e", "t_val").withColumn("t", F.col("time_num"))
    corr = sinks.staged(spark, correlation.two_point_many(flow, sorted(lines_), center="line", line=line), f"{out}/correlations") if pairs else None
    products = sinks.staged(spark, budget.accumulators_many(moments.fluctuations(flow, mean), refs, flux), f"{out}/products") if with_products else None
    results = {}
    for r in refs:
        here = lambda df, names, r=r: None if df is None else df.where(reduce(Column.__and__, [F.col(f"ref_{a}") == x for a, x in zip(names, r, strict=False)])).drop(*[f"ref_{a}" for a in names])
        at = grid.where((F.col("i") == r[0]) & (F.col("j") == r[1]) & (F.col("k") == r[2])).first()
        terms = budget.terms(here(corr, "ij"), mean, here(products, "ijk"), grid, r, (at["x"], at["y"], at["z"]), flux, which).join(grid, ["i", "j", "k"])
        names = [c for c in terms.columns if c not in ("i", "j", "k", "x", "y", "z")]
        sinks.write_structured(spark, f"{out}/terms.dat" if len(refs) == 1 else f"{out}/terms_{'_'.join(map(str, r))}.dat", terms, names, "budget terms")
        results[r] = terms
    return results[refs[0]] if isinstance(ref[0], int) else results


def spectra(spark: SparkSession, folder: str, grid_file: str, out: str, fields: Sequence[str] = ("u", "v", "w"), locations: Sequence[tuple[int, int]] | None = None, center: str = "line", mean: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Spectra (field, k_idx, k, p) along z of structured snapshots, over all lines or, with ``locations``, for each of these (loc_i, loc_j), and their e_total by k_idx if u, v and w are among the fields.

    Fluctuations are about the mean of the snapshots along each line ("line") or at each cell ("cell"); or about ``mean`` (i, j and, if it has it, k, and the fields), of
    whatever snapshots. Sums are kept under ``out``/sums, so a later call reads only new snapshots, of which no more than the asked lines; a call with
    another mean needs another ``out``. Both results are written as tables, spectrum and e_total, under ``out``. A spacing along z that isn't uniform warns.
    """
    grid = sources.read_grid(spark, grid_file)
    size = grid.agg(*[(F.max(a) + 1).alias(a) for a in "ijk"]).first()
    dz = spectral.check_uniform([r["z"] for r in grid.where("i = 0 AND j = 0").orderBy("k").select("z").collect()])  # one line
    mesh.check_extent(sources.read_snapshots(spark, folder, ordinals=[0]), grid)
    places = None
    if locations is not None:
        if bad := [x for x in locations if not (0 <= x[0] < size["i"] and 0 <= x[1] < size["j"])]:
            raise ValueError(f"no such lines: {bad}")
        # the hull of the places is what is read, then the lines themselves
        places = {a: (min(x), max(x)) for a, x in zip("ij", zip(*locations, strict=True), strict=True)}
    snap = sources.read_snapshots(spark, folder, places=places).withColumnRenamed("e", "t_val").withColumn("t", F.col("time_num"))
    if locations is not None:
        snap = snap.join(F.broadcast(spark.createDataFrame(list(locations), "i int, j int")), ["i", "j"], "left_semi")
    flow = snap.select("t", "i", "j", "k", *fields)
    if mean is not None:
        flow, center = moments.fluctuations(flow, mean, fields, [c for c in "ijk" if c in mean.columns]).select("t", "i", "j", "k", *fields), ""
    sums = SpectralSums(spark, f"{out}/sums", fields=fields)
    sums.add(flow)
    found = sums.spectrum(center, locations is not None)
    keys = ["loc_i", "loc_j"] if locations is not None else []
    sinks.write_result(spectral.with_wavenumber(found, size["k"], dz).select(*keys, "field", "k_idx", "k", "p"), out, "spectrum")
    spectrum = sources.read_result(spark, out, "spectrum")
    sinks.write_result(spectral.total_energy(spectrum, [*keys, "k_idx"]), out, "e_total")
    return spectrum, sources.read_result(spark, out, "e_total")
