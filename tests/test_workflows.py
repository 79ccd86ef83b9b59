import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import nusselt
from fieldloom.plans import workflows
from fieldloom.session import NODE_COLUMNS
from fieldloom.sources import plot3d

NX, NY, NZ = 3, 3, 6


def value(name, t, i, j, k):
    rng = np.random.default_rng((NODE_COLUMNS.index(name), t, i, j, k))
    return {"T": 1 - k / 5 + 0.05 * rng.random(), "W": rng.normal(), "rho": 1 + 0.1 * rng.random(), "cp": 1.0, "kappa": 1 + 0.1 * rng.random()}.get(name, rng.random())


def write_mesh_parts(folder, iterations):
    """Two blocks that share the plane i = 1; cubes cut in six tetrahedra."""
    folder.mkdir(exist_ok=True)
    for t in iterations:
        for blk, columns in ((1, (0, 1)), (2, (1, 2))):
            points = [(i, j, k) for k in range(NZ) for j in range(NY) for i in columns]
            number = {p: n + 1 for n, p in enumerate(points)}
            lines = [" ".join(f"{x:.17g}" for x in (i, j, k + 0.03 * k * k, *(value(c, t, i, j, k) for c in NODE_COLUMNS[3:]))) for i, j, k in points]
            elems = []
            for j in range(NY - 1):
                for k in range(NZ - 1):
                    for a, b in (((1, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 0, 1)), ((0, 1, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 0, 1), (1, 0, 1)), ((0, 0, 1), (0, 1, 1))):
                        corner = lambda d: str(number[columns[0] + d[0], j + d[1], k + d[2]])  # noqa: E731, B023
                        elems.append(" ".join(map(corner, ((0, 0, 0), a, b, (1, 1, 1)))))
            head = ["VARIABLES = " + ",".join(f'"{c}"' for c in NODE_COLUMNS), f"ZONE N={len(points)}, E={len(elems)}", "ZONETYPE=FETetrahedron"]
            (folder / f"tecplot_blk{blk}_iter{t}.dat").write_text("\n".join([*head, *lines, *elems]) + "\n")


def test_time_average_of_files(spark, tmp_path):
    write_mesh_parts(tmp_path / "mesh", [1, 2])
    out = f"file://{tmp_path}/out"
    mean, levels = workflows.time_average(spark, str(tmp_path / "mesh"), out, "T", dtype="float64", elements=True)
    got = {(r.x, r.y, round(r.z, 6)): (r["T"], r.n) for r in mean.collect()}
    want = {(i, j, round(k + 0.03 * k * k, 6)): (np.mean([value("T", t, i, j, k) for t in (1, 2)]), 2) for i in range(NX) for j in range(NY) for k in range(NZ)}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    assert [r.n for r in levels.orderBy("z").collect()] == [NX * NY] * NZ
    lines = (tmp_path / "out/mean.dat").read_text().splitlines()
    assert f"N={NX * NY * NZ}, E={2 * 6 * (NY - 1) * (NZ - 1)}" in lines[1] and len(lines) == 3 + NX * NY * NZ + 2 * 6 * (NY - 1) * (NZ - 1)
    assert len((tmp_path / "out/profile.dat").read_text().splitlines()) == NZ
    write_mesh_parts(tmp_path / "mesh", [3])  # later, only the new iteration is made
    assert {r.n for r in workflows.time_average(spark, str(tmp_path / "mesh"), out, "T", dtype="float64")[0].collect()} == {3}
    with pytest.raises(ValueError, match="no files"):
        workflows.time_average(spark, str(tmp_path / "mesh"), out, "T", [7], dtype="float64")


def test_changed_files_are_made_again(spark, tmp_path, monkeypatch):
    folder, made, merged = tmp_path / "mesh", [], workflows.merged
    monkeypatch.setattr(workflows, "merged", lambda spark, folder, iters, *a: made.extend(iters) or merged(spark, folder, iters, *a))
    write_mesh_parts(folder, [1, 2, 3])
    go = lambda **how: workflows.time_average(spark, str(folder), f"file://{tmp_path}/out", "T", dtype="float64", **how)[0]
    one = go().count()
    go()
    assert made == [1, 2, 3]
    text = (folder / "tecplot_blk1_iter2.dat").read_text().splitlines()
    (folder / "tecplot_blk1_iter2.dat").write_text("\n".join([*text[:3], *(" ".join([*x.split()[:7], "9.5", *x.split()[8:]]) for x in text[3 : 3 + 2 * NY * NZ]), *text[3 + 2 * NY * NZ :]]) + "\n")
    mean = go()
    assert made == [1, 2, 3, 2] and mean.count() == one and mean.where("T > 3").count() == 2 * NY * NZ
    shifted = [*text[:3], *(f"{float(x.split()[0]) + 0.01} {x.split(' ', 1)[1]}" for x in text[3 : 3 + 2 * NY * NZ]), *text[3 + 2 * NY * NZ :]]
    (folder / "tecplot_blk1_iter3.dat").write_text("\n".join(shifted) + "\n")
    with pytest.raises(ValueError, match="grids differ"):
        go()


@pytest.mark.parametrize("mode", ["auto", "fe"])
def test_nusselt_numbers_of_files(spark, tmp_path, mode):
    write_mesh_parts(tmp_path / "mesh", [1, 2, 3])
    got = workflows.nusselt_numbers(spark, str(tmp_path / "mesh"), f"file://{tmp_path}/out", 50.0, mode=mode, t_ref="auto", dtype="float64")
    levels = {(r.iter, r.level_idx): r for r in got["levels"].collect()}
    assert len(levels) == 3 * NZ
    z = np.array([k + 0.03 * k * k for k in range(NZ)])
    cells = [(i, j) for i in range(NX) for j in range(NY)]
    f = lambda c, t: np.array([[value(c, t, i, j, k) for k in range(NZ)] for i, j in cells])
    tm = [f("T", t).mean(0) for t in (1, 2, 3)]
    ref = (tm[0][0] + tm[0][-1]) / 2
    for t in (1, 2, 3):
        conv = (f("rho", t) * f("cp", t) * f("W", t) * (f("T", t) - ref)).mean(0)
        assert [levels[t, k].conv for k in range(NZ)] == pytest.approx(conv) and [levels[t, k].tm for k in range(NZ)] == pytest.approx(tm[t - 1])
        if mode == "auto":
            assert [levels[t, k].cond for k in range(NZ)] == pytest.approx((f("kappa", t) * np.gradient(f("T", t), z, axis=1, edge_order=2)).mean(0))
    assert got["profile"].count() == NZ and got["series"].count() == 3 and got["scalars"].count() == got["boundary_layer"].count() == got["self_check"].count() == 1
    mean = nusselt.mean_levels(got["levels"])
    assert got["scalars"].first() == nusselt.nu_scalars(mean, 50.0).first()
    assert "nu_bulk = " in (tmp_path / "out/summary.txt").read_text() and len((tmp_path / "out/profile.dat").read_text().splitlines()) == NZ


def test_budgets_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y, z = (a.astype(float) for a in np.meshgrid(np.arange(4) * 1.5, np.arange(4) ** 1.2, np.arange(6) * 0.5, indexing="ij"))
    plot3d.write_grid(str(tmp_path / "mesh.xyz"), x, y, z)
    for t in range(3):
        plot3d.write_snapshot(str(tmp_path / f"snaps/grid1.{t}.f"), rng.normal(size=(4, 4, 6, 5)))
    out = workflows.two_point_budgets(spark, str(tmp_path / "snaps"), str(tmp_path / "mesh.xyz"), f"file://{tmp_path}/out", (1, 1, 2))
    assert out.count() == 96 and len(out.columns) == 14 and out.where(F.isnan("E_prod_h") | F.col("H_inter_f").isNull()).count() == 0
    assert len((tmp_path / "out/terms.dat").read_text().splitlines()) == 3 + 96
    both = workflows.two_point_budgets(spark, str(tmp_path / "snaps"), str(tmp_path / "mesh.xyz"), f"file://{tmp_path}/two", [(3, 0, 5), (1, 1, 2)])
    assert list(both) == [(3, 0, 5), (1, 1, 2)] and (tmp_path / "two/terms_3_0_5.dat").exists()
    names = [c for c in out.columns if c not in "ijkxyz"]
    want, got = ({(r.i, r.j, r.k): [r[n] for n in names] for r in df.collect()} for df in (out, both[1, 1, 2]))
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], nan_ok=True) for c in want)
    plot3d.write_grid(str(tmp_path / "other.xyz"), x[:3], y[:3], z[:3])
    with pytest.raises(ValueError, match="doesn't fit"):
        workflows.two_point_budgets(spark, str(tmp_path / "snaps"), str(tmp_path / "other.xyz"), f"file://{tmp_path}/out", (1, 1, 2))


def test_extract_of_files(spark, tmp_path):
    write_mesh_parts(tmp_path / "mesh", [1, 2])
    out = f"file://{tmp_path}/out"
    go = lambda: workflows.extract(spark, str(tmp_path / "mesh"), out, ["T", "rho"], dtype="float64", elements=True)
    got = {(r.iter, r.x, r.y, round(r.z, 6)): (r["T"], r.rho) for r in go().collect()}
    assert got == {(t, i, j, round(k + 0.03 * k * k, 6)): pytest.approx((value("T", t, i, j, k), value("rho", t, i, j, k)), rel=1e-12) for t in (1, 2) for i in range(NX) for j in range(NY) for k in range(NZ)}
    files = [tmp_path / f"out/full_iter{t}.dat" for t in (1, 2)]
    times = [f.stat().st_mtime_ns for f in files]
    assert all(len(f.read_text().splitlines()) == 3 + NX * NY * NZ + 2 * 6 * (NY - 1) * (NZ - 1) for f in files)
    go()
    assert [f.stat().st_mtime_ns for f in files] == times


def test_dissipation_of_files(spark, tmp_path):
    write_mesh_parts(tmp_path / "mesh", [1, 2])
    got = workflows.nusselt_numbers(spark, str(tmp_path / "mesh"), f"file://{tmp_path}/out", 50.0, dtype="float64", pr=0.71)
    points = {(i, j, k): n for n, (i, j, k) in enumerate((i, j, k) for i in range(NX) for j in range(NY) for k in range(NZ))}
    xyz = np.array([(i, j, k + 0.03 * k * k) for i, j, k in points])
    for r in got["dissipation"].collect():
        u = np.array([[value(c, r.iter, *p) for c in "UVW"] for p in points])
        mu = np.array([value("mu", r.iter, *p) for p in points])
        total = volume = 0.0
        for i in range(NX - 1):
            for j in range(NY - 1):
                for k in range(NZ - 1):
                    for a, b in (((1, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 0, 1)), ((0, 1, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 0, 1), (1, 0, 1)), ((0, 0, 1), (0, 1, 1))):
                        c = [points[i + d[0], j + d[1], k + d[2]] for d in ((0, 0, 0), a, b, (1, 1, 1))]
                        e = xyz[c[1:]] - xyz[c[0]]
                        g, vol = np.linalg.solve(e, u[c[1:]] - u[c[0]]), abs(np.linalg.det(e)) / 6
                        total += vol * mu[c].mean() * ((g * g).sum() + (g * g.T).sum() - 2 / 3 * np.trace(g) ** 2)
                        volume += vol
        assert (r.volume, r.phi_mean) == pytest.approx((volume, total / volume))
    assert got["nu_v"].first()["nu_v"] == pytest.approx(1 + 0.71 * np.mean([r.phi_mean for r in got["dissipation"].collect()]))


@pytest.mark.parametrize("center", ["line", "cell", "mean"])
def test_spectra_of_files(spark, tmp_path, center):
    from fieldloom.operators import moments, spectral

    rng = np.random.default_rng(1)
    x, y, z = (a.astype(float) for a in np.meshgrid(np.arange(3) * 1.5, np.arange(4) ** 1.2, np.arange(6) * 0.5, indexing="ij"))
    plot3d.write_grid(str(tmp_path / "mesh.xyz"), x, y, z)
    a = rng.normal(size=(4, 3, 4, 6, 5)).astype("f4") + 3

    def go(n, **how):
        for t in range(n):
            if not (tmp_path / f"snaps/grid1.{t}.f").exists():
                plot3d.write_snapshot(str(tmp_path / f"snaps/grid1.{t}.f"), a[t])
        return workflows.spectra(spark, str(tmp_path / "snaps"), str(tmp_path / "mesh.xyz"), f"file://{tmp_path}/out{len(how.get('locations') or ())}", **how)

    b = np.moveaxis(a.astype(float), -1, -2)[..., :3, :]  # t, i, j, field, k
    if center == "mean":
        from fieldloom import sources

        for t in range(4):
            plot3d.write_snapshot(str(tmp_path / f"snaps/grid1.{t}.f"), a[t])
        snap = sources.read_snapshots(spark, str(tmp_path / "snaps")).where("time_num < 2")
        how = {"mean": moments.z_mean(moments.time_mean(snap, "uvw"), "uvw")}
        f = b - b[:2].mean((0, -1), keepdims=True)
    else:
        how = {"center": center}
        f = b - b.mean((0, -1) if center == "line" else 0, keepdims=True)
    p = spectral.one_sided(f).mean(0)
    go(2, **how)
    spectrum, total = go(4, **how)  # the second call adds two snapshots
    assert {(r.field, r.k_idx): (r.k, r.p) for r in spectrum.collect()} == {(c, m): (pytest.approx(2 * np.pi * m / 3), pytest.approx(p[:, :, n, m].mean(), abs=1e-9)) for n, c in enumerate("uvw") for m in range(4)}
    assert {r.k_idx: r.e_total for r in total.collect()} == {m: pytest.approx(p[:, :, :, m].mean((0, 1)).sum() / 2, abs=1e-9) for m in range(4)}
    points, total = go(4, locations=[(1, 2), (0, 3)], **how)
    assert {(r.loc_i, r.loc_j, r.field, r.k_idx): r.p for r in points.collect()} == {(i, j, c, m): pytest.approx(p[i, j, n, m], abs=1e-9) for i, j in ((1, 2), (0, 3)) for n, c in enumerate("uvw") for m in range(4)}
    assert total.count() == 8
    with pytest.raises(ValueError, match="no such lines"):
        go(4, locations=[(3, 0)], **how)
