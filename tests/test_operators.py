import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import budget, correlation, fit, mesh, moments, nusselt, profile, spectral, stencil

FLOW = ["u", "v", "w", "t_val"]


def field(spark, shape=(3, 4, 5), nt=3, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((nt, *shape, 4))
    rows = [(t, i, j, k, *map(float, a[t, i, j, k])) for t in range(nt) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])]
    rng.shuffle(rows)
    return a, spark.createDataFrame([(int(r[0]), int(r[1]), int(r[2]), int(r[3]), *map(float, r[4:])) for r in rows], "t long, i long, j long, k long, u double, v double, w double, t_val double")


def test_slopes_are_exact_for_quadratics(spark):
    rng = np.random.default_rng(1)
    z = np.cumsum(rng.uniform(0.1, 2, 9))
    rows = [(g, n, float(x), float(c[0] + c[1] * x + c[2] * x * x), float(c[1] + 2 * c[2] * x)) for g, c in enumerate(rng.standard_normal((3, 3))) for n, x in enumerate(z)]
    df = spark.createDataFrame(rows, "g int, n int, z double, f double, want double")
    got = stencil.derivatives(df, {"d": "f"}, "z", ["g"], "n").collect()
    assert max(abs(r.d - r.want) for r in got) < 1e-9
    assert all(abs(r.d - w) < 1e-9 for r, w in zip(sorted((r for r in got if r.g == 0), key=lambda r: r.n), np.gradient([r[3] for r in rows[:9]], z, edge_order=2), strict=True))
    with pytest.raises(Exception, match="three points"):
        stencil.derivatives(df.where("n < 2"), {"d": "f"}, "z", ["g"], "n").collect()


def test_radial_gradient_of_a_linear_field(spark):
    df = spark.createDataFrame([(i, j, k, float(i), float(j * j + 1), float(k)) for i in range(3) for j in range(3) for k in range(3)], "i int, j int, k int, x double, y double, z double")
    df = df.withColumn("f", F.col("x") * 2 - F.col("y") + F.col("z") * 3)
    got = stencil.radial_gradient(df, {"g": "f"}, (0.0, 1.0, 0.0)).collect()
    for r in got:
        want = (r.x * 2 - (r.y - 1) + r.z * 3) / (np.sqrt(r.x**2 + (r.y - 1) ** 2 + r.z**2) + 1e-12)
        assert abs(r.g - want) < 1e-9


def test_trapezoid_and_interpolation(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 0.0)], "x double, y double")
    assert stencil.trapezoid(df, "y", "x").first()["integral"] == pytest.approx(2 + 4.5)
    for at in (-1.0, 0.0, 0.5, 3.9, 4.0, 9.0):
        assert stencil.interpolate(df, "y", "x", F.lit(at)).first()["value"] == pytest.approx(np.interp(at, [0, 1, 4], [1, 3, 0]))


def test_kinetic_energy_one_pass_equals_two(spark):
    a, df = field(spark)
    one = {(r.i, r.j, r.k): (r.tke_t, r.tke_tz) for r in moments.tke(df).collect()}
    m = a.mean(0)
    t = ((a - m) ** 2)[..., :3].sum(-1).mean(0)
    z = ((a - m.mean(2, keepdims=True)) ** 2)[..., :3].sum(-1).mean(0)
    for (i, j, k), (x, y) in one.items():
        assert x == pytest.approx(t[i, j, k]) and y == pytest.approx(z[i, j, k])
    mean = moments.z_mean(moments.time_mean(df))
    two = moments.kinetic_energy(df, mean, ("i", "j"), "e").collect()
    assert all(r.e == pytest.approx(z[r.i, r.j, r.k]) for r in two)


@pytest.mark.parametrize("nz", [4, 5])
def test_correlation_by_transform_equals_join_and_sums(spark, nz):
    a, df = field(spark, (2, 2, nz), 3, nz)
    one = {tuple(r)[:5]: r.r for r in correlation.two_point(df, (1, 0)).collect()}
    two = {tuple(r)[:5]: r.r for r in correlation.two_point_join(df, (1, 0), nz).collect()}
    assert one.keys() == two.keys() and len(one) == 16 * 4 * nz
    for (fi, fj, i, j, lag), r in one.items():
        want = np.mean([sum(a[t, 1, 0, k, FLOW.index(fi)] * a[t, i, j, (k + lag) % nz, FLOW.index(fj)] for k in range(nz)) for t in range(3)])
        assert r == pytest.approx(want) and two[fi, fj, i, j, lag] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_spectrum_sums_to_the_mean_square(spark, n):
    f = np.random.default_rng(n).standard_normal((4, n))
    assert spectral.one_sided(f).sum(-1) == pytest.approx((f**2).mean(-1))
    df = spark.createDataFrame([(int(g), int(k), float(f[g, k])) for g in range(4) for k in range(n)], "g int, k int, f double")
    sql = {(r.g, r.k_idx): r.p for r in spectral.line_power_sql(df, ["g"], "f", n).collect()}
    assert all(sql[g, m] == pytest.approx(spectral.one_sided(f)[g, m], abs=1e-12) for g in range(4) for m in range(n // 2 + 1))


def test_plane_spectrum_and_energy(spark):
    a, df = field(spark, (2, 3, 6), 2)
    got = spectral.plane_spectrum(df)
    p = spectral.one_sided(np.moveaxis(a, 3, -1)).mean((0, 1, 2))
    assert all(r.p == pytest.approx(p[FLOW.index(r.field), r.k_idx]) for r in got.collect())
    assert all(r.e_total == pytest.approx(p[:3, r.k_idx].sum() / 2) for r in spectral.total_energy(got).collect())
    assert spectral.total_energy(got.where("field <> 'w'")).count() == 0
    here = spectral.plane_spectrum(df, ["u"], spark.createDataFrame([(1, 2)], "i long, j long")).collect()
    assert {(r.loc_i, r.loc_j) for r in here} == {(1, 2)} and len(here) == 4


def fold(nodes, tol):
    """Block by block: a node goes if its cell came in an earlier block."""
    seen, kept = {}, []
    for blk in sorted({n[0] for n in nodes}):
        new = {}
        for b, idx, *xyz in sorted(n for n in nodes if n[0] == blk):
            key = tuple(np.rint(np.array(xyz) / tol).astype(int))
            if key in seen:
                new_id = seen[key]
            else:
                new_id = len(kept)
                kept.append((b, idx))
                new.setdefault(key, new_id)
            yield (b, idx), new_id, kept[new_id] == (b, idx)
        seen.update({k: v for k, v in new.items() if k not in seen})


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_the_fold_over_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [(int(b), n, *map(float, rng.integers(0, 3, 3))) for b in range(4) for n in range(12)]
    df = spark.createDataFrame([(0, *n) for n in nodes], "iter int, blk int, node_idx int, x double, y double, z double")
    want = {k: (v, kept) for k, v, kept in fold(nodes, 1e-6)}
    got = {(r.blk, r.node_idx): (r.node_id, r.kept) for r in mesh.canonical_ids(df).collect()}
    assert got == want
    assert mesh.merge(df).count() == sum(k for _, k in want.values())
    elems = spark.createDataFrame([(0, 2, 0, 1, 2, 3, 12)], "iter int, blk int, elem_idx int, n0 int, n1 int, n2 int, n3 int")
    r = mesh.remap(elems, mesh.canonical_ids(df)).first()
    assert (r.n0, r.n1, r.n2, r.n3) == tuple(want[2, n][0] for n in (0, 1, 2, 11))


def test_tetrahedra_are_exact_for_linear_fields(spark):
    rng = np.random.default_rng(0)
    xyz = rng.random((6, 3))
    nodes = spark.createDataFrame([(n, *map(float, p), float(1 + 2 * p[0] - p[1] + 4 * p[2]), float(p[0]), float(-p[1]), 1.0) for n, p in enumerate(xyz)], "node_id int, x double, y double, z double, f double, u double, v double, mu double")
    nodes = nodes.withColumn("w", F.lit(0.0))
    elems = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 4, 5)], "elem_idx int, n0 int, n1 int, n2 int, n3 int")
    g = mesh.tet_gradient(elems, nodes, ["f"])
    for r in g.collect():
        assert (r.f_dx, r.f_dy, r.f_dz) == pytest.approx((2, -1, 4))
        e = xyz[[r.n1, r.n2, r.n3]] - xyz[r.n0]
        assert r.vol == pytest.approx(abs(np.linalg.det(e)) / 6)
    assert all(r.f_dz == pytest.approx(4) for r in mesh.scatter(g, ["f_dz"]).collect())
    assert mesh.dissipation(elems, nodes).first()["phi_mean"] == pytest.approx(4.0)  # G = diag(1, -1, 0)
    with pytest.raises(Exception, match="no volume"):
        mesh.tet_gradient(spark.createDataFrame([(0, 0, 1, 2, 2)], elems.schema), nodes, ["f"]).collect()


def test_layout_and_spacing(spark):
    pts = [(float(i), float(j * j), float(k)) for i in range(3) for j in range(3) for k in range(4)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    r = profile.layout(df).first()
    assert (r.n_levels, r.n_columns, r.is_columns) == (4, 9, True)
    assert not profile.layout(df.where("NOT (x = 0 AND z = 1)")).first()["is_columns"]
    assert nusselt.gradient_mode({"is_columns": False}) == "fe"
    s = profile.spacing(df.where("z = 0")).first()
    assert (s.n_x, s.dx_ratio, s.dy_ratio, s.tensor) == (3, 1.0, 3.0, True)


def test_grid_check(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "n int, x double, y double, z double")
    mesh.check_grid(df, df, ["n"])
    for other in (df.where("n = 0"), df.withColumn("x", F.col("x") + 1e-4), df.withColumn("x", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="differ"):
            mesh.check_grid(df, other, ["n"])


def test_grids_of_a_series(spark):
    rows = [(it, n, float(n), 0.0, float(n * n)) for it in range(4) for n in range(5)]
    df = spark.createDataFrame(rows, "iter int, node_id int, x double, y double, z double")
    extents = mesh.grid_extents(df, ["node_id"])
    mesh.check_series(extents, 4)
    halves = [mesh.grid_extents(df.where(c), ["node_id"]) for c in ("iter < 1", "iter >= 1")]
    assert sorted(mesh.merged_extents(halves[1].union(halves[0]), ["node_id"]).collect()) == sorted(extents.collect())
    mesh.check_series(mesh.grid_extents(df.where("iter < 0"), ["node_id"]), 4)
    third = F.col("iter") == 2
    for bad in (df.where(~third | (F.col("node_id") < 4)), df.withColumn("y", F.when(third, 1e-4).otherwise(0.0)), df.withColumn("z", F.when(third, float("nan")).otherwise(F.col("z"))), df.where("iter < 3"), df.union(df.where(third).withColumn("node_id", F.col("node_id") + 9))):
        with pytest.raises(ValueError, match="differ"):
            mesh.check_series(mesh.grid_extents(bad, ["node_id"]), 4)


def test_one_line_in_blocks(spark, monkeypatch):
    from fieldloom import functions

    monkeypatch.setattr(functions, "BLOCK", 7)
    rng = np.random.default_rng(0)
    z = np.cumsum(rng.uniform(0.1, 1, 100))
    f = np.sin(z)
    df = spark.createDataFrame([(int(n), float(z[n]), float(f[n])) for n in rng.permutation(100)], "level_idx int, z double, tm double").repartition(5)
    got = {r.z: r.d for r in stencil.derivatives(df, {"d": "tm"}, "z", [], "z").collect()}
    assert [got[x] for x in z] == pytest.approx(np.gradient(f, z, edge_order=2))
    assert stencil.trapezoid(df, "tm", "z").first()["integral"] == pytest.approx(np.trapezoid(f, z))
    for at in (z[0] - 1, z[6], z[7], 0.5 * (z[13] + z[14]), z[-1], z[-1] + 1):
        assert stencil.interpolate(df, "tm", "z", F.lit(float(at))).first()["value"] == pytest.approx(np.interp(at, z, f))
    assert {r.z: r.dz for r in nusselt.thickness(df).collect()} == {x: pytest.approx(w) for x, w in zip(z, np.gradient(z), strict=True)}
    bl = nusselt.thermal_bl(df).first()
    g, center = np.gradient(f, z, edge_order=2), np.interp((z[0] + z[-1]) / 2, z, f)
    assert (bl.t_center, bl.delta_b, bl.delta_t) == pytest.approx((center, abs(f[0] - center) / abs(g[0]), abs(f[-1] - center) / abs(g[-1])))
    places = {r.z: r._place for r in functions.placed(df, "z").collect()}
    assert [places[x] for x in z] == list(range(100))
    with pytest.raises(Exception, match="three points"):
        stencil.derivatives(df.limit(2), {"d": "tm"}, "z", [], "z").collect()


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e7])
def test_spacing_of_any_unit(spark, scale):
    df = spark.createDataFrame([(scale * 10 * x, scale * 10 * y) for x in (0.0, 1.0, 3.0, 4.5) for y in (2.0,)], "x double, y double")
    s = profile.spacing(df).first()
    assert (s.n_x, s.n_y, s.dy_ratio, s.tensor) == (4, 1, 1.0, True) and s.dx_ratio == pytest.approx(2.0)


def test_heat_flux_of_a_conducting_layer(spark):
    lev = spark.createDataFrame([(it, n, n / 10, 0.0, -1.0, 1 - n / 10, 0.0) for it in range(3) for n in range(11)], "iter int, level_idx int, z double, conv double, cond double, tm double, mflux double")
    m = nusselt.mean_levels(lev)
    r = nusselt.nu_scalars(m, 10.0).first()
    assert (r.nu_hot, r.nu_cold, r.nu_bulk, r.spread) == pytest.approx((1, 1, 1, 0))
    up = m.withColumn("tm", F.col("z")).withColumn("cond", F.lit(1.0))
    assert nusselt.nu_scalars(up, 10.0).first()["nu_hot"] == pytest.approx(1)
    with pytest.raises(Exception, match="fewer than two"):
        nusselt.nu_scalars(m, 10.0, bulk_range=(0.51, 0.52)).collect() or pytest.fail("no row")
        raise ValueError("fewer than two")
    bl = nusselt.thermal_bl(m).first()
    assert (bl.t_center, bl.delta_b, bl.n_b, bl.n_t) == pytest.approx((0.5, 0.5, 6, 6))
    assert nusselt.nu_series(lev, 10.0).where("flipped").count() == 0
    assert nusselt.peclet(ra=4.0, pr=9.0) == 6.0
    with pytest.raises(ValueError):
        nusselt.peclet()


def test_self_check_finds_the_factor(spark):
    z = np.cumsum(np.r_[0, np.random.default_rng(0).uniform(0.1, 1, 8)])
    conv = np.sin(z)
    df = spark.createDataFrame([(float(a), float(b), float(2 - 0.8 * b)) for a, b in zip(z, conv, strict=True)], "z double, nu_conv double, nu_cond double")
    r = nusselt.pe_self_check(df).first()
    assert (r.f, r.q) == pytest.approx((0.8, 2.0)) and r.rms_rel < 1e-6
    w = {r.z: r.dz for r in nusselt.thickness(df).collect()}
    assert [w[x] for x in z] == pytest.approx(np.gradient(z))


def test_series_of_one_and_two(spark):
    one = fit.series_stats(spark.createDataFrame([(1, 2.0)], "iter int, a double"), ["a"], "iter").first()
    assert one["mean"] == 2.0 and one["std"] is None and one["drift"] is None
    r = fit.series_stats(spark.createDataFrame([(5, 1.0), (7, 2.0), (9, 3.0)], "iter int, a double"), ["a"], "iter").first()
    assert (r["drift"], r["std"]) == pytest.approx((2.0, 1.0))


def test_slope_locator(spark):
    k = np.arange(1, 41, dtype=float)
    p = np.where(k < 10, k**-1.0, 10**0.67 * k**-1.67)
    p = np.where(k > 25, p * np.exp(-(k - 25) / 3), p)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(k, p, strict=True)], "k double, p double")
    w = fit.slope_windows(df)
    r = fit.slope_match(w, -5 / 3).first()
    assert r.slope == pytest.approx(-1.67, abs=0.02) and r.r2 > 0.99 and 8 <= r.start <= 22
    scaled = fit.slope_match(fit.slope_windows(df.withColumn("k", F.col("k") * 7)), -5 / 3).first()
    assert (scaled.start, scaled.r2) == (r.start, pytest.approx(r.r2))
    line = fit.guide_line(df, fit.slope_match(w, -5 / 3), -5 / 3, 5).collect()
    assert len(line) > 5
    with pytest.raises(ValueError):
        fit.slope_windows(df.limit(3))


def test_energy_terms_do_not_depend_on_the_flux_direction(spark):
    _, df = field(spark, (3, 3, 4), 2)
    mean = moments.z_mean(moments.time_mean(df))
    fl = moments.fluctuations(df, mean)
    grid = df.select("i", "j", "k").distinct().withColumns({c: F.col(d).cast("double") for c, d in zip("xyz", "ijk", strict=True)})
    corr = correlation.two_point(fl, (1, 1)).cache()

    def energy(flux):
        out = budget.terms(corr, mean, budget.accumulators(fl, (1, 1, 2), flux), grid, (1, 1, 2), (1.0, 1.0, 2.0), flux, ["E_prod_I", "H_prod_I"])
        return {(r.i, r.j, r.k): (r.E_prod_I, r.H_prod_I) for r in out.collect()}

    u, w = energy("u"), energy("w")
    assert all(u[c][0] == w[c][0] for c in u) and any(u[c][1] != w[c][1] for c in u)


def test_levels_are_numbered_in_blocks(spark):
    keys = [0, 1, 5, 1023, 1024, 1025, 70_000, 2**20 - 1, 2**20, 2**20 + 3, 5 * 2**20, -1, -2**21]
    got = {r.z: r.level_idx for r in profile.levels(spark.createDataFrame([(float(k),) for k in [*keys, 5, 70_000]], "z double"), z_tol=1.0).collect()}
    assert got == {float(k): n for n, k in enumerate(sorted(keys))}


def test_extents(spark):
    cube = lambda n: spark.range(n**3).select((F.col("id") % n).alias("i"), (F.col("id") / n % n).cast("long").alias("j"), (F.col("id") / n**2).cast("long").alias("k"))
    mesh.check_extent(cube(3), cube(3))
    with pytest.raises(ValueError, match="doesn't fit"):
        mesh.check_extent(cube(3), cube(4))


def test_lag_rolled_to_the_reference(spark):
    nz = 6
    rng = np.random.default_rng(4)
    rows = [(t, i, j, k, *rng.normal(size=4).tolist()) for t in range(3) for i in range(4) for j in range(4) for k in range(nz)]
    f = spark.createDataFrame(rows, "t long, i long, j long, k long, u double, v double, w double, t_val double")
    mean = moments.z_mean(moments.time_mean(f))
    fl = moments.fluctuations(f, mean)
    grid = f.select("i", "j", "k", (F.col("i") * 1.5).alias("x"), (F.col("j") * 1.0).alias("y"), (F.col("k") * 0.5).alias("z")).distinct()
    corr, ref = correlation.two_point(fl, (1, 2)), (1, 2, 4)
    rolled = corr.withColumn("lag", F.pmod(F.col("lag") + ref[2], F.lit(nz)))
    args = (mean, budget.accumulators(fl, ref), grid, ref, (1.5, 2.0, 2.0))
    one, two = ({(r.i, r.j, r.k): (r.E_prod_h, r.H_inter_m) for r in d.collect()} for d in (budget.terms(corr, *args, which=["E_prod_h", "H_inter_m"], shift_lag=True), budget.terms(rolled, *args, which=["E_prod_h", "H_inter_m"])))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
