"""One query for each operator, over the driver's tables, and the SQL that gives the same rows.

Doubles are cut to some decimals with an odd offset, so that short decimals don't
end on a rounding tie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import cell_key
from ..operators import budget, correlation, fit, mesh, moments, nusselt, profile, sparse, spectral, stencil
from ..session import shared_dir
from ..sources import plot3d
from ..streaming.spectra import SpectralSums
from . import adapters as A
from . import workflows

OFFSET = 0.4142135623731
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def cut(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**n) + OFFSET) / float(10**n)


def cut_all(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.select(*[cut(c, n).alias(c) if c in names else F.col(c) for c in df.columns])


def sql_cut(e: str, n: int, name: str | None = None) -> str:
    return f"floor(({e}) * {float(10**n)!r}::DOUBLE + {OFFSET}::DOUBLE) / {float(10**n)!r}::DOUBLE AS {name or e}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


FLOW = ["u", "v", "w", "t_val"]
flow_cut = lambda n, fmt="{}": ", ".join(sql_cut(fmt.format(c), n, c) for c in FLOW)


def fluct(spark, sf):
    f = A.field(spark, sf)
    return moments.fluctuations(f, moments.z_mean(moments.time_mean(f)))


@query("time_mean", f"WITH {A.FIELD} SELECT i, j, k, {flow_cut(6, 'avg({})')}, count(*) AS n FROM field GROUP BY i, j, k")
def time_mean(spark, sf):
    return cut_all(moments.time_mean(A.field(spark, sf)), 6, *FLOW)


@query("time_sums", f"WITH {A.FIELD} SELECT i, j, k, {', '.join(sql_cut(f'sum({c})', 4, c + '_sum') for c in FLOW)}, count(*) AS n FROM field GROUP BY i, j, k")
def time_sums(spark, sf):
    out = moments.time_mean(A.field(spark, sf), keep_sums=True)
    return cut_all(out.select("i", "j", "k", "n", *[f"{c}_sum" for c in FLOW]), 4, *[f"{c}_sum" for c in FLOW])


@query("mean_z", f"WITH {A.FIELD} SELECT i, j, {flow_cut(6)} FROM mean_tz")
def mean_z(spark, sf):
    return cut_all(moments.z_mean(moments.time_mean(A.field(spark, sf))), 6, *FLOW)


@query("fluctuation_stats", f"WITH {A.FIELD}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS x FROM fluct" for c in FLOW) + f") SELECT field, {sql_cut('avg(x)', 6, 'mean')}, {sql_cut('var_pop(x)', 4, 'variance')} FROM l GROUP BY field")
def fluctuation_stats(spark, sf):
    f = A.field(spark, sf)
    out = moments.fluctuation_stats(f, moments.z_mean(moments.time_mean(f)))
    return out.select("field", cut("mean", 6).alias("mean"), cut("variance", 4).alias("variance"))


@query("tke", f"""WITH {A.FIELD} SELECT i, j, k, {sql_cut('avg(pow(f.u - m.u, 2) + pow(f.v - m.v, 2) + pow(f.w - m.w, 2))', 4, 'tke_t')}, {sql_cut('avg(pow(f.u - z.u, 2) + pow(f.v - z.v, 2) + pow(f.w - z.w, 2))', 4, 'tke_tz')}
FROM field f JOIN mean_t m USING (i, j, k) JOIN mean_tz z USING (i, j) GROUP BY i, j, k""")  # fmt: skip
def tke(spark, sf):
    return cut_all(moments.tke(A.field(spark, sf)), 4, "tke_t", "tke_tz")


@query("tke_two_pass", f"WITH {A.FIELD} SELECT i, j, k, {sql_cut('avg(pow(u, 2) + pow(v, 2) + pow(w, 2))', 4, 'tke_tz')} FROM fluct GROUP BY i, j, k")
def tke_two_pass(spark, sf):
    f = A.field(spark, sf)
    return cut_all(moments.kinetic_energy(f, moments.z_mean(moments.time_mean(f)), ("i", "j"), "tke_tz"), 4, "tke_tz")


@query("level_profile", f"SELECT CAST(round_even(l_quantity / 0.01::DOUBLE, 0) AS BIGINT) AS level_key, {sql_cut('CAST(round_even(l_quantity / 0.01::DOUBLE, 0) AS BIGINT) * 0.01::DOUBLE', 6, 'z')}, count(*) AS n, {sql_cut('avg(l_extendedprice)', 4, 'val')} FROM lineitem GROUP BY 1, 2")
def level_profile(spark, sf):
    out = profile.level_profile(A.cloud(spark, sf), "z", {"val": "val"}, 1e-2)
    return out.select("level_key", cut("z", 6).alias("z"), "n", cut("val", 4).alias("val"))


@query("level_means_by_iter", f"SELECT year(l_shipdate) AS iter, CAST(round_even(l_quantity / 0.01::DOUBLE, 0) AS BIGINT) AS level_key, {sql_cut('avg(l_quantity)', 6, 'z')}, count(*) AS n, {sql_cut('avg(l_extendedprice)', 4, 'val')} FROM lineitem GROUP BY 1, 2")
def level_means_by_iter(spark, sf):
    out = profile.level_profile(A.cloud(spark, sf), "z", {"val": "val"}, 1e-2, ("iter",), "mean")
    return out.select("iter", "level_key", cut("z", 6).alias("z"), "n", cut("val", 4).alias("val"))


@query("level_counts", "WITH p AS (SELECT l_quantity AS z, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS levels, CAST(sum(n) AS BIGINT) AS points, min(n) AS n_min, max(n) AS n_max, " + sql_cut("avg(n)", 4, "n_mean") + ", count(*) <= sum(n) * 0.5 AS shared FROM p")
def level_counts(spark, sf):
    return cut_all(profile.level_counts(profile.level_profile(A.cloud(spark, sf), "z", {}, 1e-2)), 4, "n_mean")


@query("layout_detect", f"""WITH {A.FIELD}, c AS (SELECT z, x, y, count(*) AS n FROM grid GROUP BY ALL), l AS (SELECT z, sum(n) AS n FROM c GROUP BY z), p AS (SELECT x, y, count(*) AS lv FROM c GROUP BY ALL)
SELECT CAST(sum(l.n) AS BIGINT) AS n_points, count(*) AS n_levels, count(*) <= sum(l.n) * 0.5 AS shared_levels, CAST(min(l.n) AS BIGINT) AS n_min, CAST(max(l.n) AS BIGINT) AS n_max, (SELECT count(*) FROM p) AS n_columns,
  count(*) >= 3 AND min(l.n) = max(l.n) AND (SELECT min(lv) FROM p) = count(*) AND count(*) <= sum(l.n) * 0.5 AS is_columns FROM l""")  # fmt: skip
def layout_detect(spark, sf):
    return profile.layout(A.grid(A.field(spark, sf)))


@query("column_index", f"WITH {A.FIELD} SELECT i, j, k, dense_rank() OVER (ORDER BY k) - 1 AS level_idx, row_number() OVER (PARTITION BY k ORDER BY x, y) - 1 AS col_idx FROM grid")
def column_index(spark, sf):
    return profile.column_index(profile.levels(A.grid(A.field(spark, sf)))).select("i", "j", "k", "level_idx", "col_idx")


@query("spacing_ratio", f"""WITH {A.FIELD}, l AS (SELECT x, y FROM grid WHERE k = 0), xs AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT round(x, 10) AS x FROM l)), ys AS (SELECT y, y - lag(y) OVER (ORDER BY y) AS g FROM (SELECT DISTINCT round(y, 10) AS y FROM l))
SELECT (SELECT count(*) FROM xs) AS n_x, {sql_cut('(SELECT max(g) / min(g) FROM xs)', 6, 'dx_ratio')}, (SELECT count(*) FROM ys) AS n_y, {sql_cut('(SELECT max(g) / min(g) FROM ys)', 6, 'dy_ratio')}, (SELECT count(*) FROM xs) * (SELECT count(*) FROM ys) = (SELECT count(*) FROM l) AS tensor""")  # fmt: skip
def spacing_ratio(spark, sf):
    return cut_all(profile.spacing(A.grid(A.field(spark, sf)).where("k = 0")), 6, "dx_ratio", "dy_ratio")


@query("dedup_nodes", f"WITH {A.PARTITIONS} SELECT iter, blk, node_idx, {sql_cut('x', 4)}, {sql_cut('val', 2)} FROM marked WHERE kept")
def dedup_nodes(spark, sf):
    return mesh.merge(A.partitions(spark, sf)).select("iter", "blk", "node_idx", cut("x", 4).alias("x"), cut("val", 2).alias("val"))


@query("dedup_counts", f"WITH {A.PARTITIONS} SELECT iter, blk, count(*) AS n, count_if(kept) AS kept, count_if(NOT kept) AS dropped FROM marked GROUP BY iter, blk")
def dedup_counts(spark, sf):
    return mesh.mark_kept(A.partitions(spark, sf)).groupBy("iter", "blk").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


IDS = f"""{A.PARTITIONS},
numbered AS (SELECT iter, blk, node_idx, row_number() OVER (PARTITION BY iter ORDER BY blk, node_idx) - 1 AS node_id FROM marked WHERE kept),
firsts AS (SELECT iter, qx, blk AS fb, node_idx AS fn FROM marked QUALIFY row_number() OVER (PARTITION BY iter, qx ORDER BY blk, node_idx) = 1),
own AS (SELECT m.iter, m.blk, m.node_idx, m.kept, CASE WHEN m.kept THEN m.blk ELSE fb END AS ob, CASE WHEN m.kept THEN m.node_idx ELSE fn END AS oi FROM marked m JOIN firsts f USING (iter, qx)),
ids AS MATERIALIZED (SELECT o.iter, o.blk, o.node_idx, o.kept, n.node_id FROM own o JOIN numbered n ON n.iter = o.iter AND n.blk = o.ob AND n.node_idx = o.oi)"""


@query("canonical_ids", f"WITH {IDS} SELECT * FROM ids")
def canonical_ids(spark, sf):
    return mesh.canonical_ids(A.partitions(spark, sf))


def block_elements(spark, sf):
    """An element for each node: itself and the three nodes after it in its block."""
    from pyspark.sql import Window as W

    w = W.partitionBy("iter", "blk").orderBy("node_idx")
    p = A.partitions(spark, sf).select("iter", "blk", "node_idx", *[F.lead("node_idx", n).over(w).alias(f"n{n}") for n in (1, 2, 3)]).where("n3 IS NOT NULL")
    return p.select("iter", "blk", F.col("node_idx").alias("elem_idx"), (F.col("node_idx") + 1).alias("n0"), *[(F.col(f"n{n}") + 1).alias(f"n{n}") for n in (1, 2, 3)])


@query("remap_connectivity", f"""WITH {IDS}, el AS (SELECT iter, blk, node_idx AS elem_idx, node_idx AS c0, {', '.join(f'lead(node_idx, {n}) OVER (PARTITION BY iter, blk ORDER BY node_idx) AS c{n}' for n in (1, 2, 3))} FROM parts),
co AS (SELECT iter, blk, elem_idx, unnest([0, 1, 2, 3]) AS c, unnest([c0, c1, c2, c3]) AS node_idx FROM el WHERE c3 IS NOT NULL)
SELECT co.iter, co.blk, elem_idx, {', '.join(f'max(CASE WHEN c = {n} THEN node_id END) AS n{n}' for n in range(4))} FROM co JOIN ids ON ids.iter = co.iter AND ids.blk = co.blk AND ids.node_idx = co.node_idx GROUP BY co.iter, co.blk, elem_idx""")  # fmt: skip
def remap_connectivity(spark, sf):
    return mesh.remap(block_elements(spark, sf), mesh.canonical_ids(A.partitions(spark, sf)))


@query("assemble_columns", f"WITH {IDS} SELECT ids.iter, ids.node_id, {sql_cut('x', 4)}, {sql_cut('val', 2)} FROM ids JOIN parts USING (iter, blk, node_idx) WHERE kept")
def assemble_columns(spark, sf):
    p = A.partitions(spark, sf)
    return mesh.canonical_ids(p).where("kept").join(p, ["iter", "blk", "node_idx"]).select("iter", "node_id", cut("x", 4).alias("x"), cut("val", 2).alias("val"))


@query("cell_keys", "SELECT o_orderkey, CAST(round_even(o_totalprice * (1 / 0.5::DOUBLE), 0) AS BIGINT) AS q FROM orders")
def cell_keys(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", cell_key("o_totalprice", 0.5).alias("q"))


@query("grid_check", f"""WITH {A.FIELD}, b AS (SELECT i, j, k, x + 0.001::DOUBLE AS x, y, z FROM grid WHERE k < 9)
SELECT count(*) AS rows, count_if(b.x IS NULL) AS only_one, count_if(grid.x IS NULL) AS only_other, {sql_cut('max(greatest(abs(grid.x - b.x), abs(grid.y - b.y), abs(grid.z - b.z)))', 7, 'max_diff')} FROM grid FULL JOIN b USING (i, j, k)""")  # fmt: skip
def grid_check(spark, sf):
    g = A.grid(A.field(spark, sf))
    return cut_all(mesh.grid_difference(g, g.where("k < 9").withColumn("x", F.col("x") + 0.001), ["i", "j", "k"]), 7, "max_diff")


@query("series_check", f"""WITH {A.FIELD}, m AS (SELECT f.t, g.i, g.j, g.k, x + CASE WHEN f.t = 3 THEN 0.001::DOUBLE ELSE 0 END AS x FROM (SELECT DISTINCT t FROM field) f CROSS JOIN grid g WHERE NOT (f.t = 2 AND g.k = 9)),
e AS (SELECT i, j, k, count(*) AS n, arg_min(x, t) AS f, min(x) AS lo, max(x) AS hi FROM m GROUP BY i, j, k)
SELECT count(*) AS nodes, max(n) AS iterations, count_if(n < (SELECT max(n) FROM e)) AS partial, {sql_cut('max(greatest(hi - f, f - lo))', 7, 'max_diff')} FROM e""")  # fmt: skip
def series_check(spark, sf):
    """All iterations' grids in one job: one lacks a level, and one is shifted; extents of two halves are merged."""
    f = A.field(spark, sf)
    grids = A.coordinates(f.where("NOT (t = 2 AND k = 9)")).withColumn("x", F.col("x") + F.when(F.col("t") == 3, 0.001).otherwise(0.0))
    halves = [mesh.grid_extents(grids.where(c), ["i", "j", "k"], "t") for c in ("t % 2 = 0", "t % 2 = 1")]
    return cut_all(mesh.series_difference(mesh.merged_extents(halves[0].union(halves[1]), ["i", "j", "k"])), 7, "max_diff")


@query("fd_column", f"WITH {A.COLUMNS} SELECT iter, col_idx, level_idx, {sql_cut('g', 6)} FROM nus_g")
def fd_column(spark, sf):
    return stencil.derivatives(A.columns(spark, sf), {"g": "t_val"}, "z", ["iter", "col_idx"], "level_idx").select("iter", "col_idx", "level_idx", cut("g", 6).alias("g"))


GRAD = f"""{A.FIELD}, pt AS (SELECT * FROM mean_t JOIN grid USING (i, j, k)),
gr AS (SELECT *, {', '.join(A.slope_sql('u', a, f'PARTITION BY {p} ORDER BY {o}') + f' AS u_d{a}' for a, p, o in (('x', 'j, k', 'i'), ('y', 'i, k', 'j'), ('z', 'i, j', 'k')))} FROM pt)"""
RADIUS = f"sqrt(pow(x - {A.REF_XYZ[0]}::DOUBLE, 2) + pow(y - {A.REF_XYZ[1]}::DOUBLE, 2) + pow(z - {A.REF_XYZ[2]}::DOUBLE, 2))"


@query("grad_xyz", f"WITH {GRAD} SELECT i, j, k, {', '.join(sql_cut(f'u_d{a}', 5) for a in 'xyz')} FROM gr")
def grad_xyz(spark, sf):
    m = A.coordinates(moments.time_mean(A.field(spark, sf)))
    return cut_all(stencil.gradient(m, ["u"]).select("i", "j", "k", "u_dx", "u_dy", "u_dz"), 5, "u_dx", "u_dy", "u_dz")


@query("grad_r", f"WITH {GRAD} SELECT i, j, k, {sql_cut(f'((x - 1.1::DOUBLE) * u_dx + (y - 2.2::DOUBLE) * u_dy + (z - 2.5::DOUBLE) * u_dz) / ({RADIUS} + 1e-12)', 5, 'g')} FROM gr WHERE NOT (i = 1 AND j = 2 AND k = 5)")
def grad_r(spark, sf):
    m = A.coordinates(moments.time_mean(A.field(spark, sf)))
    return stencil.radial_gradient(m, {"g": "u"}, A.REF_XYZ).where("NOT (i = 1 AND j = 2 AND k = 5)").select("i", "j", "k", cut("g", 5).alias("g"))


@query("radial_geometry", f"WITH {A.FIELD} SELECT i, j, k, {sql_cut(RADIUS, 8, 'r')}, {sql_cut(f'1 / (4 * pi() * pow({RADIUS} + 1e-12, 2))', 6, 'co_eff')} FROM grid WHERE NOT (i = 1 AND j = 2 AND k = 5)")
def radial_geometry(spark, sf):
    return stencil.radial(A.grid(A.field(spark, sf)), A.REF_XYZ).where("NOT (i = 1 AND j = 2 AND k = 5)").select("i", "j", "k", cut("r", 8).alias("r"), cut("co_eff", 6).alias("co_eff"))


@query("trapz_integral", f"WITH {A.COLUMNS}, p AS (SELECT iter, z, tm, lead(z) OVER w AS z1, lead(tm) OVER w AS t1 FROM lev WINDOW w AS (PARTITION BY iter ORDER BY z)) SELECT iter, {sql_cut('sum(0.5 * (tm + t1) * (z1 - z))', 6, 'integral')}, {sql_cut('min(z)', 6, 'x_lo')}, {sql_cut('max(z)', 6, 'x_hi')} FROM p GROUP BY iter")
def trapz_integral(spark, sf):
    lev = nusselt.level_stats(A.columns(spark, sf), A.T_REF)
    return cut_all(stencil.trapezoid(lev, "tm", "z", ["iter"]), 6, "integral", "x_lo", "x_hi")


@query("interpolate", f"WITH {A.COLUMNS}, p AS (SELECT iter, z, tm, lead(z) OVER w AS z1, lead(tm) OVER w AS t1 FROM lev WINDOW w AS (PARTITION BY iter ORDER BY z)) SELECT iter, {sql_cut('tm + (t1 - tm) * (4.321::DOUBLE - z) / (z1 - z)', 7, 'tm')} FROM p WHERE z <= 4.321 AND z1 > 4.321")
def interpolate(spark, sf):
    return cut_all(stencil.interpolate(nusselt.level_stats(A.columns(spark, sf), A.T_REF), "tm", "z", F.lit(4.321), ["iter"], "tm"), 7, "tm")


LEV = ["z", "conv", "cond", "tm", "mflux"]
lev_cut = ", ".join(sql_cut(c, 6) for c in LEV)


@query("level_stats", f"WITH {A.COLUMNS} SELECT iter, level_idx, {lev_cut} FROM lev")
def level_stats(spark, sf):
    return cut_all(nusselt.level_stats(A.columns(spark, sf), A.T_REF), 6, *LEV)


@query("mean_levels", f"WITH {A.COLUMNS} SELECT level_idx, {lev_cut} FROM levm")
def mean_levels(spark, sf):
    return cut_all(nusselt.mean_levels(nusselt.level_stats(A.columns(spark, sf), A.T_REF)), 6, *LEV)


@query("reference_temperature", f"WITH {A.COLUMNS} SELECT {sql_cut('0.5 * (arg_min(tm, z) + arg_max(tm, z))', 7, 't_ref')} FROM lev WHERE iter = (SELECT min(iter) FROM lev)")
def reference_temperature(spark, sf):
    return cut_all(nusselt.reference_temperature(nusselt.level_stats(A.columns(spark, sf), A.T_REF)), 7, "t_ref")


def levels_of(spark, sf):
    """Small, and read by each of the steps after it."""
    return sinks.staged(spark, nusselt.level_stats(A.columns(spark, sf), A.T_REF))


PROF = ["z", "nu", "nu_conv", "nu_cond", "tm", "nu_shift"]


@query("nusselt_profile", f"WITH {A.COLUMNS} SELECT level_idx, {', '.join(sql_cut(c, 5) for c in PROF)} FROM prof")
def nusselt_profile(spark, sf):
    return cut_all(nusselt.nu_profile(nusselt.mean_levels(levels_of(spark, sf)), A.PE, A.T_REF), 5, *PROF)


@query("nusselt_profile_ra", f"WITH {A.COLUMNS} SELECT level_idx, {', '.join(sql_cut(c, 5) for c in PROF)} FROM prof")
def nusselt_profile_ra(spark, sf):
    """With the velocity's scale from ra and pr."""
    return cut_all(nusselt.nu_profile(nusselt.mean_levels(levels_of(spark, sf)), nusselt.peclet(ra=A.PE * A.PE * 2, pr=0.5), A.T_REF), 5, *PROF)


@query("nusselt_scalars", f"""WITH {A.COLUMNS}, b AS (SELECT z, nu, lead(z) OVER (ORDER BY z) AS z1, lead(nu) OVER (ORDER BY z) AS n1 FROM prof, sc WHERE z >= z0 + 0.1::DOUBLE * (z1 - z0) - 1e-12 AND z <= z0 + 0.9::DOUBLE * (z1 - z0) + 1e-12),
w AS (SELECT CASE WHEN sgn > 0 THEN -c0 / den ELSE c1 / den END AS hot, CASE WHEN sgn > 0 THEN -c1 / den ELSE c0 / den END AS cold FROM sc)
SELECT {sql_cut('hot', 5, 'nu_hot')}, {sql_cut('cold', 5, 'nu_cold')}, {sql_cut('(SELECT sum(0.5 * (nu + n1) * (z1 - z)) / (max(z) - min(z)) FROM b)', 5, 'nu_bulk')}, {sql_cut('(SELECT min(nu) FROM prof)', 5, 'nu_min')}, {sql_cut('(SELECT max(nu) FROM prof)', 5, 'nu_max')},
  {sql_cut('(SELECT avg(nu) FROM prof)', 5, 'nu_mean')}, {sql_cut('(SELECT (max(nu) - min(nu)) / abs(avg(nu)) FROM prof)', 5, 'spread')}, {sql_cut('abs(hot - cold) / (0.5 * (hot + cold))', 5, 'imbalance')} FROM w""")  # fmt: skip
def nusselt_scalars(spark, sf):
    out = nusselt.nu_scalars(nusselt.mean_levels(levels_of(spark, sf)), A.PE, bulk_range=(0.1, 0.9))
    return cut_all(out, 5, *out.columns)


SERIES = f"""{A.COLUMNS}, it AS (SELECT iter, CASE WHEN arg_min(tm, z) > arg_max(tm, z) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, arg_min(cond, z) AS k0, arg_max(cond, z) AS k1 FROM lev GROUP BY iter),
ln AS (SELECT l.iter, l.z, it.s * (l.conv * {A.PE}::DOUBLE - l.cond) / sc.den AS nu FROM lev l JOIN it USING (iter), sc),
lb AS (SELECT iter, sum(0.5 * (nu + n1) * (z1 - z)) / (max(z) - min(z)) AS bulk FROM (SELECT iter, z, nu, lead(z) OVER w AS z1, lead(nu) OVER w AS n1 FROM ln WINDOW w AS (PARTITION BY iter ORDER BY z)) GROUP BY iter),
ser AS (SELECT iter, -s * CASE WHEN s > 0 THEN k0 ELSE k1 END / den AS nu_hot, -s * CASE WHEN s > 0 THEN k1 ELSE k0 END / den AS nu_cold, bulk AS nu_bulk, s <> sgn AS flipped FROM it JOIN lb USING (iter), sc)"""
NUS = ["nu_hot", "nu_cold", "nu_bulk"]


@query("nusselt_series", f"WITH {SERIES} SELECT iter, {', '.join(sql_cut(c, 5) for c in NUS)}, flipped FROM ser")
def nusselt_series(spark, sf):
    return cut_all(nusselt.nu_series(levels_of(spark, sf), A.PE), 5, *NUS)


@query("series_stats", f"WITH {SERIES}, o AS (SELECT *, row_number() OVER (ORDER BY iter) - 1 AS o FROM ser), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, o, {c} AS x FROM o" for c in NUS) + f") SELECT name, count(*) AS n, {sql_cut('avg(x)', 5, 'mean')}, {sql_cut('stddev_samp(x)', 5, 'std')}, {sql_cut('stddev_samp(x) / sqrt(count(*))', 5, 'sem')}, {sql_cut('regr_slope(x, o) * (count(*) - 1)', 4, 'drift')} FROM l GROUP BY name")
def series_stats(spark, sf):
    s = fit.series_stats(nusselt.nu_series(levels_of(spark, sf), A.PE), NUS, "iter")
    return s.select("name", "n", *[cut(c, 5).alias(c) for c in ("mean", "std", "sem")], cut("drift", 4).alias("drift"))


@query("thermal_bl", f"""WITH {A.COLUMNS}, g AS (SELECT z, tm, {A.slope_sql('tm', 'z', 'ORDER BY z')} AS g, lead(z) OVER (ORDER BY z) AS z1, lead(tm) OVER (ORDER BY z) AS t1 FROM levm),
c AS (SELECT tm + (t1 - tm) * (0.5 * (sc.z0 + sc.z1) - z) / (g.z1 - z) AS tc FROM g, sc WHERE z <= 0.5 * (sc.z0 + sc.z1) AND g.z1 > 0.5 * (sc.z0 + sc.z1)),
d AS (SELECT tc, abs(arg_min(tm, z) - tc) / abs(arg_min(g, z)) AS db, abs(arg_max(tm, z) - tc) / abs(arg_max(g, z)) AS dt FROM g, c GROUP BY tc)
SELECT {sql_cut('tc', 7, 't_center')}, {sql_cut('db', 5, 'delta_b')}, {sql_cut('d.dt', 5, 'delta_t')}, (SELECT count(*) FROM levm WHERE z - sc.z0 <= db * (1 + 1e-12)) AS n_b, (SELECT count(*) FROM levm WHERE sc.z1 - z <= d.dt * (1 + 1e-12)) AS n_t FROM d, sc""")  # fmt: skip
def thermal_bl(spark, sf):
    out = nusselt.thermal_bl(nusselt.mean_levels(levels_of(spark, sf)))
    return out.select(cut("t_center", 7).alias("t_center"), cut("delta_b", 5).alias("delta_b"), cut("delta_t", 5).alias("delta_t"), "n_b", "n_t")


@query("pe_self_check", f"""WITH {A.COLUMNS}, w AS (SELECT nu_conv AS x, nu_cond AS y, CASE WHEN lag(z) OVER o IS NULL THEN lead(z) OVER o - z WHEN lead(z) OVER o IS NULL THEN z - lag(z) OVER o ELSE (lead(z) OVER o - lag(z) OVER o) / 2 END AS w FROM prof WINDOW o AS (ORDER BY z)),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w), s AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * pow(x - mx, 2)) AS b, any_value(mx) AS mx, any_value(my) AS my FROM w, m)
SELECT {sql_cut('-any_value(b)', 4, 'f')}, {sql_cut('any_value(my - b * mx)', 4, 'q')}, {sql_cut('sqrt(sum(w * pow(y - (my - b * mx) - b * x, 2)) / sum(w)) / abs(any_value(my - b * mx))', 4, 'rms_rel')} FROM w, s""")  # fmt: skip
def pe_self_check(spark, sf):
    return cut_all(nusselt.pe_self_check(nusselt.nu_profile(nusselt.mean_levels(levels_of(spark, sf)), A.PE)), 4, "f", "q", "rms_rel")


CORR = f"""{A.FIELD}, nsnap AS (SELECT count(DISTINCT t) AS n FROM field),
corr AS (SELECT a.t, b.i, b.j, ((b.k - a.k) % 10 + 10) % 10 AS lag, {', '.join(f'a.{x} * b.{y} AS R_{x}_{y}' for x in FLOW for y in FLOW)} FROM fluct a JOIN fluct b USING (t) WHERE a.i = 1 AND a.j = 2),
cw AS (SELECT i, j, lag, {', '.join(f'sum(R_{x}_{y}) / any_value(n) AS R_{x}_{y}' for x in FLOW for y in FLOW)} FROM corr, nsnap GROUP BY i, j, lag)"""
CORR_SQL = f"WITH {CORR} " + " UNION ALL ".join(f"SELECT '{x}' AS fi, '{y}' AS fj, i, j, lag, {sql_cut(f'R_{x}_{y}', 2, 'r')} FROM cw" for x in FLOW for y in FLOW)


@query("two_point_corr", CORR_SQL)
def two_point_corr(spark, sf):
    return cut_all(correlation.two_point(fluct(spark, sf), A.REF[:2]), 2, "r")


@query("two_point_corr_raw", CORR_SQL)
def two_point_corr_raw(spark, sf):
    """From the snapshots as they are, which are read once."""
    return cut_all(correlation.two_point(A.field(spark, sf), A.REF[:2], center="line"), 2, "r")


CORR3_SQL = CORR_SQL.replace(A.FIELD, f"{A.FIELD}, fluct3 AS (SELECT f.t, f.i, f.j, f.k, f.u - m.u AS u, f.v - m.v AS v, f.w - m.w AS w, f.t_val - m.t_val AS t_val FROM field f JOIN mean_t m USING (i, j, k))").replace("FROM fluct a JOIN fluct b", "FROM fluct3 a JOIN fluct3 b")


@query("two_point_corr_raw_3d", CORR3_SQL)
def two_point_corr_raw_3d(spark, sf):
    """The same about the time mean of each cell."""
    return cut_all(correlation.two_point(A.field(spark, sf), A.REF[:2], center="cell"), 2, "r")


CORR_MANY = " UNION ALL ".join(f"SELECT {i} AS ref_i, {j} AS ref_j, * FROM ({CORR_SQL.replace('a.i = 1 AND a.j = 2', f'a.i = {i} AND a.j = {j}')})" for i, j in ((1, 2), (3, 4)))


@query("two_point_corr_many", CORR_MANY)
def two_point_corr_many(spark, sf):
    """Two reference lines from one reading of the snapshots."""
    return cut_all(correlation.two_point_many(A.field(spark, sf), [(1, 2), (3, 4)]), 2, "r")


@query("two_point_corr_resumed", CORR_SQL)
def two_point_corr_resumed(spark, sf):
    """Two goes, of which the second adds only the snapshots that the first lacked."""
    return cut_all(_two_goes(spark, A.field(spark, sf), A.REF[:2]).correlations(), 2, "r")


def _two_goes(spark, f, ref=None):
    path = f"{shared_dir(spark)}/spectra/{uuid.uuid4().hex}"
    for some in (f.where("t % 3 = 1"), f):
        sums = SpectralSums(spark, path, ref)
        sums.add(some)
    return sums


@query("two_point_corr_join", CORR_SQL)
def two_point_corr_join(spark, sf):
    return cut_all(correlation.two_point_join(fluct(spark, sf), A.REF[:2], A.NZ), 2, "r")


ACC = f"""{CORR}, ref0 AS (SELECT t, u AS u0, v AS v0, w AS w0 FROM fluct WHERE i = 1 AND j = 2 AND k = 5),
acc AS (SELECT i, j, k, {', '.join(f'avg((u0 * u + v0 * v + w0 * w) * ({c}0 - {c})) AS {g}' for c, g in zip('uvw', ('xg', 'yg', 'zg'), strict=True))}, {', '.join(f'avg(w0 * t_val * ({c}0 - {c})) AS ft_{c}' for c in 'uvw')} FROM fluct JOIN ref0 USING (t) GROUP BY i, j, k)"""


@query("budget_accumulators", f"WITH {ACC} SELECT i, j, k, {', '.join(sql_cut(c, 1) for c in budget.PRODUCTS)} FROM acc")
def budget_accumulators(spark, sf):
    return cut_all(budget.accumulators(fluct(spark, sf), A.REF), 1, *budget.PRODUCTS)


_ACC_AT = lambda i, j, k: ACC.replace("i = 1 AND j = 2 AND k = 5", f"i = {i} AND j = {j} AND k = {k}")


@query("budget_accumulators_many", " UNION ALL ".join(f"SELECT * FROM (WITH {_ACC_AT(*r)} SELECT {r[0]} AS ref_i, {r[1]} AS ref_j, {r[2]} AS ref_k, i, j, k, {', '.join(sql_cut(c, 1) for c in budget.PRODUCTS)} FROM acc)" for r in (A.REF, (3, 0, 9))))
def budget_accumulators_many(spark, sf):
    """Two reference points in one pass."""
    return cut_all(budget.accumulators_many(fluct(spark, sf), [A.REF, (3, 0, 9)]), 1, *budget.PRODUCTS)


def _budget_sql(term: str, flux: str = "w", plain: bool = False, lag: str = "g.k") -> str:
    over = {"x": "PARTITION BY j, k ORDER BY i", "y": "PARTITION BY i, k ORDER BY j", "z": "PARTITION BY i, j ORDER BY k"}
    plane = {"x": "PARTITION BY j ORDER BY i", "y": "PARTITION BY i ORDER BY j"}
    slopes = ", ".join(f"{A.slope_sql(v, a, plane[a])} AS {v}_{a}" for v in FLOW for a in "xy")
    sql = f"{ACC}, pl AS (SELECT m.*, x, y FROM mean_tz m JOIN (SELECT DISTINCT i, j, x, y FROM grid) USING (i, j)), ps AS (SELECT *, {slopes} FROM pl), p0 AS (SELECT * FROM ps WHERE i = 1 AND j = 2)"
    joined = f"FROM grid g JOIN cw ON cw.i = g.i AND cw.j = g.j AND cw.lag = {lag} JOIN ps ON ps.i = g.i AND ps.j = g.j JOIN acc ON acc.i = g.i AND acc.j = g.j AND acc.k = g.k, p0"
    at = lambda v, a: "0" if a == "z" else f"p0.{v}_{a}"
    ch = lambda v, a: "0" if a == "z" else f"(ps.{v}_{a} - p0.{v}_{a})"
    ax = dict(zip("uvw", "xyz", strict=True))
    energy = "(R_u_u + R_v_v + R_w_w)"
    simple = {
        "E_prod_h": f"0.5 * (2 * R_u_u * {at('u', 'x')} + 2 * R_v_v * {at('v', 'y')} + (R_u_v + R_v_u) * ({at('v', 'x')} + {at('u', 'y')}) + (R_u_w + R_w_u) * {at('w', 'x')} + (R_v_w + R_w_v) * {at('w', 'y')})",
        "E_prod_I": "0.5 * (" + " + ".join(f"R_{a}_{b} * {ch(a, ax[b])}" for a in "uvw" for b in "uvw") + ")",
        "H_prod_h": f"R_u_t_val * {at('w', 'x')} + R_v_t_val * {at('w', 'y')} + R_w_u * {at('t_val', 'x')} + R_w_v * {at('t_val', 'y')}",
        "H_prod_I": f"R_w_u * {ch('t_val', 'x')} + R_w_v * {ch('t_val', 'y')}",
    }
    if flux != "w":
        simple["H_prod_h"] = " + ".join(f"R_{a}_t_val * {at(flux, ax[a])} + R_{flux}_{a} * {at('t_val', ax[a])}" for a in "uvw")
        simple["H_prod_I"] = " + ".join(f"R_{flux}_{a} * {ch('t_val', ax[a])}" for a in "uvw")
    nested = {
        "E_inter_m": ("0.5", [f"{energy} * (p0.{v} - ps.{v})" for v in "uvw"]), "E_inter_f": ("0.5", ["xg", "yg", "zg"]),
        "H_inter_m": ("1.0", [f"R_{flux}_t_val * (p0.{v} - ps.{v})" for v in "uvw"]), "H_inter_f": ("1.0", ["ft_u", "ft_v", "ft_w"]),
    }
    if term in simple:
        sql += f", b AS (SELECT g.*, {simple[term]} AS q {joined})"
    else:
        factor, parts = nested[term]
        sql += f", b0 AS (SELECT g.*, {', '.join(f'{e} AS q{a}' for a, e in zip('xyz', parts, strict=True))} {joined}), b AS (SELECT *, {factor} * ({' + '.join(f'({A.slope_sql(f'q{a}', a, over[a])})' for a in 'xyz')}) AS q FROM b0)"
    sql += f", s AS (SELECT *, {', '.join(f'{A.slope_sql('q', a, over[a])} AS d{a}' for a in 'xyz')} FROM b)"
    q = f"((x - 1.1::DOUBLE) * dx + (y - 2.2::DOUBLE) * dy + (z - 2.5::DOUBLE) * dz) / ({RADIUS} + 1e-12)"
    return f"WITH {sql} SELECT i, j, k, {q} AS q FROM s" if plain else f"WITH {sql} SELECT i, j, k, {sql_cut(q, 0, term)} FROM s"


def _budget(term: str, flux: str = "w"):
    def run(spark, sf):
        f = A.field(spark, sf)
        mean = moments.z_mean(moments.time_mean(f))
        pairs, products = budget.asks([term], flux)
        corr = correlation.two_point(f, A.REF[:2], center="line") if pairs else None
        acc = budget.accumulators(moments.fluctuations(f, mean), A.REF, flux) if products else None
        return cut_all(budget.terms(corr, mean, acc, A.grid(f), A.REF, A.REF_XYZ, flux, which=[term]), 0, term)

    return run


for _term in ("E_prod_h", "E_prod_I", "E_inter_m", "E_inter_f", "H_prod_h", "H_prod_I", "H_inter_m", "H_inter_f"):
    query(f"budget_{_term}", _budget_sql(_term))(_budget(_term))
for _term, _flux in (("H_prod_h", "u"), ("H_prod_h", "v"), ("H_prod_I", "u"), ("H_prod_I", "v"), ("H_inter_m", "u"), ("H_inter_m", "v")):
    query(f"budget_{_term}_{_flux}", _budget_sql(_term, _flux))(_budget(_term, _flux))


@query("budget_shifted", _budget_sql("E_prod_h", lag=f"(g.k + {A.NZ - A.REF[2]}) % {A.NZ}"))
def budget_shifted(spark, sf):
    """The lag rolled to the reference point's place."""
    f = A.field(spark, sf)
    out = budget.terms(correlation.two_point(f, A.REF[:2], center="line"), moments.z_mean(moments.time_mean(f)), None, A.grid(f), A.REF, A.REF_XYZ, which=["E_prod_h"], shift_lag=True)
    return cut_all(out, 0, "E_prod_h")


@query("budget_unweighted", f"""SELECT h.i, h.j, h.k, {sql_cut('h.q', 0, 'E_prod_h')}, {sql_cut('o.q', 0, 'E_prod_I')}, {sql_cut('h.q + o.q', 0, 'E_prod_tot')}
FROM ({_budget_sql('E_prod_h', plain=True)}) h JOIN ({_budget_sql('E_prod_I', plain=True)}) o ON h.i = o.i AND h.j = o.j AND h.k = o.k""")
def budget_unweighted(spark, sf):
    f = A.field(spark, sf)
    mean = moments.z_mean(moments.time_mean(f))
    halves = ["E_prod_h", "E_prod_I"]
    weighted = budget.terms(correlation.two_point(f, A.REF[:2], center="line"), mean, None, A.grid(f), A.REF, A.REF_XYZ, which=halves, weighted=True)
    out = budget.unweighted(weighted.join(A.grid(f), ["i", "j", "k"]), halves, A.REF_XYZ)
    return cut_all(out.select("i", "j", "k", *halves, "E_prod_tot"), 0, *halves, "E_prod_tot")


def _dft(src: str, keys: str, n: int) -> str:
    double = f"CASE WHEN m >= 1 AND m < {(n + 1) // 2} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"SELECT {keys}, m AS k_idx, {double} * (pow(sum(f * cos(2 * pi() * m * k / {n})), 2) + pow(sum(f * sin(2 * pi() * m * k / {n})), 2)) / {n * n} AS p FROM {src}, (SELECT unnest(generate_series(0, {n // 2})) AS m) GROUP BY {keys}, m"


PSD = f"{A.FIELD}, ll AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, t, i, j, k, {c} AS f FROM fluct" for c in FLOW) + f"), ps AS ({_dft('ll', 'field, t, i, j', A.NZ)})"
PLANE = f"{PSD}, pp AS (SELECT field, k_idx, avg(p) AS p FROM ps GROUP BY field, k_idx)"


@query("psd_plane", f"WITH {PLANE} SELECT field, k_idx, {sql_cut(f'2 * pi() * k_idx / {A.NZ * A.DZ}', 6, 'k')}, {sql_cut('p', 4)} FROM pp")
def psd_plane(spark, sf):
    return cut_all(spectral.with_wavenumber(spectral.plane_spectrum(fluct(spark, sf)), A.NZ, A.DZ).select("field", "k_idx", "k", "p"), 6, "k").withColumn("p", cut("p", 4))


@query("psd_plane_resumed", f"WITH {PLANE} SELECT field, k_idx, {sql_cut('p', 4)} FROM pp")
def psd_plane_resumed(spark, sf):
    return cut_all(_two_goes(spark, A.field(spark, sf)).spectrum(), 4, "p")


@query("psd_point", f"WITH {PSD} SELECT i AS loc_i, j AS loc_j, field, k_idx, {sql_cut('avg(p)', 4, 'p')} FROM ps WHERE (i = 1 AND j = 2) OR (i = 3 AND j = 4) GROUP BY i, j, field, k_idx")
def psd_point(spark, sf):
    f = fluct(spark, sf)
    at = spark.createDataFrame([(1, 2), (3, 4)], "i long, j long")
    return cut_all(spectral.plane_spectrum(f, locations=at).select("loc_i", "loc_j", "field", "k_idx", "p"), 4, "p")


@query("e_total", f"WITH {PLANE} SELECT k_idx, {sql_cut('0.5 * sum(p)', 4, 'e_total')} FROM pp WHERE field IN ('u', 'v', 'w') GROUP BY k_idx")
def e_total(spark, sf):
    return cut_all(spectral.total_energy(spectral.plane_spectrum(fluct(spark, sf))), 4, "e_total")


@query("line_psd", f"WITH l AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings), s AS ({_dft('l', 'vec_id, label', 64)}) SELECT label, k_idx, {sql_cut('avg(p)', 8, 'p')} FROM s GROUP BY label, k_idx")
def line_psd(spark, sf):
    return cut_all(spectral.power(A.vectors(spark, sf), "line", ["label"]), 8, "p")


@query("line_psd_sql", f"WITH l AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings), s AS ({_dft('l', 'vec_id, label', 64)}) SELECT label, k_idx, {sql_cut('avg(p)', 8, 'p')} FROM s GROUP BY label, k_idx")
def line_psd_sql(spark, sf):
    long = A.vectors(spark, sf).select("vec_id", "label", F.posexplode("line").alias("k", "f"))
    return spectral.line_power_sql(long, ["vec_id", "label"], "f", 64).groupBy("label", "k_idx").agg(F.avg("p").alias("p")).withColumn("p", cut("p", 8))


LINE_SPECTRUM = "l AS (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings), s AS (" + _dft("l", "vec_id", 64) + "), sp AS (SELECT k_idx, avg(p) AS p, CAST(k_idx AS DOUBLE) AS k FROM s GROUP BY k_idx)"
WINDOWS = f"{LINE_SPECTRUM}, lg AS (SELECT k, ln(k) AS lk, ln(p) AS lp FROM sp WHERE k > 0 AND p > 0), wn AS (SELECT row_number() OVER (ORDER BY k) - 1 AS start, regr_slope(lp, lk) OVER f AS slope, regr_r2(lp, lk) OVER f AS r2, count(*) OVER f AS c FROM lg WINDOW f AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), wi AS (SELECT start, slope, r2 FROM wn WHERE c = 4)"


def line_spectrum(spark, sf):
    s = spectral.power(A.vectors(spark, sf).withColumn("g", F.lit(0)), "line", ["g"])
    return s.select("k_idx", "p", F.col("k_idx").cast("double").alias("k"))


@query("slope_windows", f"WITH {WINDOWS} SELECT start, {sql_cut('slope', 5)}, {sql_cut('r2', 5)} FROM wi")
def slope_windows(spark, sf):
    return cut_all(fit.slope_windows(line_spectrum(spark, sf)), 5, "slope", "r2")


@query("slope_match", f"""WITH {WINDOWS}, st AS (SELECT start AS steepest FROM wi ORDER BY slope, start LIMIT 1)
SELECT steepest, start, {sql_cut('slope', 5)}, {sql_cut('r2', 5)} FROM wi, st WHERE start <= steepest ORDER BY r2 < 0.9, abs(slope - (-0.05)), start LIMIT 1""")  # fmt: skip
def slope_match(spark, sf):
    return cut_all(fit.slope_match(fit.slope_windows(line_spectrum(spark, sf)), -0.05), 5, "slope", "r2")


@query("guide_line", f"""WITH {WINDOWS}, st AS (SELECT start AS steepest FROM wi ORDER BY slope, start LIMIT 1),
m AS (SELECT start + 2 AS a FROM wi, st WHERE start <= steepest ORDER BY r2 < 0.9, abs(slope - (-0.05)), start LIMIT 1),
r AS (SELECT k, p, row_number() OVER (ORDER BY k) - 1 AS n, count(*) OVER () AS c FROM sp WHERE k > 0 AND p > 0), o AS (SELECT k AS ka, p AS pa FROM r, m WHERE n = a)
SELECT k, {sql_cut('pa * pow(k / ka, -0.05::DOUBLE)', 8, 'p')} FROM r, m, o WHERE n >= greatest(3, a - c // 3) AND n < least(c, a + c // 3)""")  # fmt: skip
def guide_line(spark, sf):
    s = line_spectrum(spark, sf)
    return fit.guide_line(s, fit.slope_match(fit.slope_windows(s), -0.05), -0.05, 4).withColumn("p", cut("p", 8))


@query("field_order", """SELECT field, row_number() OVER (ORDER BY CASE field WHEN 'R' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, field) - 1 AS place FROM (SELECT DISTINCT l_returnflag AS field FROM lineitem WHERE l_returnflag IS NOT NULL)""")
def field_order(spark, sf):
    return correlation.discover_fields(A.table(spark, sf, "lineitem"), "l_returnflag", ["R", "O"])


@query("extent_difference", f"""WITH {A.FIELD}, s AS (SELECT max(i) + 1 AS n_i, max(j) + 1 AS n_j, max(k) + 1 AS n_k FROM field WHERE t = 1), g AS (SELECT max(i) + 1 AS m_i, max(j) + 1 AS m_j, max(k) + 1 AS m_k FROM grid WHERE k < 9)
SELECT *, n_i = m_i AND n_j = m_j AND n_k = m_k AS same FROM s, g""")
def extent_difference(spark, sf):
    f = A.field(spark, sf)
    return mesh.extent_difference(f.where("t = 1"), A.grid(f).where("k < 9"))


NATIVE = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in FLOW)


@query("native_snapshots", f"WITH {A.FIELD}, s AS (SELECT i, j, k, {NATIVE} FROM field) SELECT i, j, k, {flow_cut(4, 'avg({})')}, count(*) AS n FROM s GROUP BY i, j, k")
def native_snapshots(spark, sf):
    """Snapshot files written from the events, read again and averaged."""
    snap = sources.read_snapshots(spark, A.snapshot_files(spark, sf)).withColumnRenamed("e", "t_val")
    return cut_all(moments.time_mean(snap), 4, *FLOW)


@query("native_snapshot_pick", f"WITH {A.FIELD}, s AS (SELECT t, i, j, k, {NATIVE} FROM field), n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM (SELECT DISTINCT t FROM field)) SELECT t, i, j, k, {flow_cut(4)} FROM s JOIN n USING (t) WHERE n.n = 2")
def native_snapshot_pick(spark, sf):
    snap = sources.read_snapshots(spark, A.snapshot_files(spark, sf), ordinals=[2]).withColumnRenamed("e", "t_val")
    return cut_all(snap.select(F.col("time_num").alias("t"), "i", "j", "k", *FLOW), 4, *FLOW)


@query("file_sums", f"WITH {A.FIELD} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {sql_cut(f'sum(CAST(CAST({c} AS FLOAT) AS DOUBLE))', 2, 's')}, count(*) AS n FROM field" for n, c in zip("uvwe", FLOW, strict=True)))
def file_sums(spark, sf):
    """A caller's own accumulators over files."""
    folder = A.snapshot_files(spark, sf)
    paths = sources.files.find(folder, "grid*.f")

    def add(sums, path, extra):
        with sources.files.open_(path) as f:
            plot3d.record(f)
            values = np.frombuffer(plot3d.record(f), "<f4").reshape(5, -1).astype(float)
        for n, name in enumerate("uvwpe"):
            if name in sums:
                sums[name] += values[n]
                sums["count"] += len(values[n]) if name == extra else 0

    sums = sources.accumulate(spark, paths, lambda extra: {**{n: np.zeros(A.NX * A.NY * A.NZ) for n in "uvwe"}, "count": np.zeros(1)}, add, "u")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    flat = sums.select("name", total.alias("s"))
    n = flat.where("name = 'count'").select(F.col("s").cast("long").alias("n"))
    return flat.where("name <> 'count'").crossJoin(F.broadcast(n)).select("name", cut("s", 2).alias("s"), "n")


@query("native_mesh", f"WITH {A.FIELD} SELECT t AS iter, k AS level, {sql_cut('avg(t_val)', 6, 'tm')}, {sql_cut('avg(u)', 6, 'um')}, count(*) AS n FROM field GROUP BY t, k")
def native_mesh(spark, sf):
    """Mesh partitions written from the events, read, merged and averaged by level."""
    nodes = sources.read_nodes(spark, A.mesh_files(spark, sf), ["T", "U"], dtype="float64").withColumnsRenamed({"X": "x", "Y": "y", "Z": "z"})
    levels = mesh.merge(nodes).groupBy("iter", F.round(F.col("z") / A.DZ).cast("long").alias("level"))
    return levels.agg(cut(F.avg("T"), 6).alias("tm"), cut(F.avg("U"), 6).alias("um"), F.count("*").alias("n"))


@query("native_elements", f"WITH {A.FIELD}, f AS (SELECT t, b.blk FROM (SELECT DISTINCT t FROM field WHERE t % 2 = 0) CROSS JOIN (VALUES (1), (2)) AS b(blk)) SELECT t AS iter, blk, CAST(0 AS BIGINT) AS elem_idx, 0 AS n0, 1 AS n1, 4 AS n2, 20 AS n3 FROM f")
def native_elements(spark, sf):
    """Elements of some iterations, in their blocks' numbers from 0."""
    folder = A.mesh_files(spark, sf)
    some = [r["iter"] for r in sources.list_partitions(spark, folder).where("iter % 2 = 0").select("iter").collect()]
    e = sources.read_elements(spark, folder, some)
    return e.select("iter", "blk", "elem_idx", *[(F.col(f"n{c}") - 1).alias(f"n{c}") for c in range(4)])


@query("native_variable", f"WITH {A.FIELD}, b AS (SELECT t, 1 AS blk, t_val FROM field WHERE j <= 2 UNION ALL SELECT t, 2, t_val FROM field WHERE j >= 2) SELECT t AS iter, blk, {sql_cut('avg(t_val)', 6, 'tm')}, count(*) AS n FROM b GROUP BY t, blk")
def native_variable(spark, sf):
    """One variable of mesh files, which are read in parts by an index of their lines."""
    folder = A.mesh_files(spark, sf)
    nodes = sources.read_nodes(spark, folder, ["T"], dtype="float64", index=sources.index_partitions(spark, folder, part=4096))
    return nodes.groupBy("iter", "blk").agg(cut(F.avg("T"), 6).alias("tm"), F.count("*").alias("n"))


@query("native_grid", f"WITH {A.FIELD} SELECT i, j, k, {', '.join(sql_cut(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)', 5, c) for c in 'xyz')} FROM grid")
def native_grid(spark, sf):
    return cut_all(sources.read_grid(spark, A.grid_file(spark, sf)).select("i", "j", "k", *[F.col(c).cast("double").alias(c) for c in "xyz"]), 5, *"xyz")


@query("native_slice", f"WITH {A.FIELD}, s AS (SELECT t, i, j, k, {NATIVE} FROM field WHERE k = 5 AND j >= 2) SELECT t, i, j, {flow_cut(4)} FROM s")
def native_slice(spark, sf):
    """A slice of snapshot files, of which no more is read than its rows."""
    snap = sources.read_snapshots(spark, A.snapshot_files(spark, sf), places={"k": (5, 5), "j": (2, None)}).withColumnRenamed("e", "t_val")
    return cut_all(snap.select(F.col("time_num").alias("t"), "i", "j", *[F.col(c).cast("double").alias(c) for c in FLOW]), 4, *FLOW)


@query("workflow_mean", f"WITH {A.FIELD} SELECT {', '.join(sql_cut(c, 5) for c in 'xyz')}, {sql_cut('t_val', 6)}, (SELECT count(DISTINCT t) FROM field) AS n FROM mean_t JOIN grid USING (i, j, k)")
def workflow_mean(spark, sf):
    """From mesh files to the mean field of all iterations."""
    mean, _ = workflows.time_average(spark, A.mesh_files(spark, sf), f"{shared_dir(spark)}/workflows/{uuid.uuid4().hex}", "T", dtype="float64")
    return cut_all(mean.withColumnRenamed("T", "t_val").select("x", "y", "z", "t_val", "n"), 5, *"xyz").withColumn("t_val", cut("t_val", 6))


FIELD4 = A.FIELD.replace("mean_t AS", f"f4 AS (SELECT t, i, j, k, {NATIVE} FROM field),\nmean_t AS").replace("FROM field GROUP BY i, j, k)", "FROM f4 GROUP BY i, j, k)").replace("FROM field f JOIN mean_tz", "FROM f4 f JOIN mean_tz")


@query("workflow_spectra", f"WITH {PSD.replace(A.FIELD, FIELD4)} SELECT i AS loc_i, j AS loc_j, field, k_idx, {sql_cut(f'2 * pi() * k_idx / {A.NZ * A.DZ}', 6, 'k')}, {sql_cut('avg(p)', 3, 'p')} FROM ps WHERE (i = 1 AND j = 2) OR (i = 3 AND j = 4) GROUP BY i, j, field, k_idx")
def workflow_spectra(spark, sf):
    """From snapshot files to spectra at two lines."""
    out, _ = workflows.spectra(spark, A.snapshot_files(spark, sf), A.grid_file(spark, sf), f"{shared_dir(spark)}/workflows/{uuid.uuid4().hex}", FLOW, [(1, 2), (3, 4)])
    return cut_all(out, 6, "k").withColumn("p", cut("p", 3)).withColumns({c: F.col(c).cast("long") for c in ("loc_i", "loc_j")})


FLUCT3 = "fluct3 AS (SELECT f.t, f.i, f.j, f.k, f.u - m.u AS u, f.v - m.v AS v, f.w - m.w AS w, f.t_val - m.t_val AS t_val FROM field f JOIN mean_t m USING (i, j, k))"


def fluct3(spark, sf):
    """Fluctuations about the time mean of each cell."""
    f = A.field(spark, sf)
    return moments.fluctuations(f, moments.time_mean(f), keys=moments.CELL)


@query("fluctuations_3d", f"WITH {A.FIELD}, {FLUCT3} SELECT t, i, j, k, {flow_cut(5)} FROM fluct3")
def fluctuations_3d(spark, sf):
    return cut_all(fluct3(spark, sf).select("t", "i", "j", "k", *FLOW), 5, *FLOW)


@query("psd_plane_3d", f"WITH {PLANE.replace(A.FIELD, f'{A.FIELD}, {FLUCT3}').replace('FROM fluct)', 'FROM fluct3)').replace('FROM fluct UNION', 'FROM fluct3 UNION')} SELECT field, k_idx, {sql_cut('p', 4)} FROM pp")
def psd_plane_3d(spark, sf):
    return spectral.plane_spectrum(fluct3(spark, sf)).select("field", "k_idx", cut("p", 4).alias("p"))


@query("node_mean", f"WITH {A.FIELD} SELECT i + 4 * j + 20 * k AS node_id, {sql_cut('avg(t_val)', 6, 't_val')}, count(*) AS n FROM field GROUP BY 1")
def node_mean(spark, sf):
    nodes = A.field(spark, sf).withColumn("node_id", F.col("i") + F.col("j") * 4 + F.col("k") * 20)
    return cut_all(moments.time_mean(nodes, ["t_val"], ["node_id"]), 6, "t_val")


@query("checkpoint_read", f"WITH {A.FIELD} SELECT t AS iter, k, {sql_cut('avg(u)', 6, 'u')} FROM field WHERE t < 6 GROUP BY t, k")
def checkpoint_read(spark, sf):
    """Iterations made in two goes, of which the second makes only what is missing, and read again."""
    from ..streaming import Checkpoint

    f, path = A.field(spark, sf), f"{shared_dir(spark)}/checkpoints/{uuid.uuid4().hex}"
    work = lambda it: f.where(F.col("t") == it).groupBy("k").agg(F.avg("u").alias("u"))
    for wanted in ([1, 3, 4], range(6)):
        done = Checkpoint(spark, path, {"field": "u"})
        done.run(list(wanted), work)
    return done.read(list(range(6)), rows=A.NZ).select(F.col("iter").cast("long").alias("iter"), "k", cut("u", 6).alias("u"))


@query("checkpoint_abort", f"WITH {A.FIELD} SELECT t AS iter, k, {sql_cut('avg(u)', 6, 'u')} FROM field WHERE t < 6 AND t <> 4 GROUP BY t, k")
def checkpoint_abort(spark, sf):
    """An iteration that fails is told and left out; the others are made."""
    from ..streaming import Checkpoint

    f, done = A.field(spark, sf), Checkpoint(spark, f"{shared_dir(spark)}/checkpoints/{uuid.uuid4().hex}", {"field": "u"})
    broken = F.when(F.col("t") == 4, F.raise_error("no such iteration").cast("double")).otherwise(F.col("u"))
    failed = done.run(range(6), lambda it: f.where(F.col("t") == it).groupBy("k").agg(F.avg(broken).alias("u")), on_error="collect")
    return done.read([it for it in range(6) if it not in failed]).select(F.col("iter").cast("long").alias("iter"), "k", cut("u", 6).alias("u"))


@query("checkpoint_gate", f"WITH {A.FIELD} SELECT t AS iter, k, {sql_cut('avg(v)', 6, 'v')} FROM field WHERE t < 3 GROUP BY t, k")
def checkpoint_gate(spark, sf):
    """Results made with other settings aren't taken for these: they are wiped and made anew."""
    from ..streaming import Checkpoint

    f, path = A.field(spark, sf), f"{shared_dir(spark)}/checkpoints/{uuid.uuid4().hex}"
    work = lambda c: lambda it: f.where(F.col("t") == it).groupBy("k").agg(F.avg(c).alias(c))
    Checkpoint(spark, path, {"field": "u"}).run(range(2), work("u"))
    try:
        done = Checkpoint(spark, path, {"field": "v"})
    except ValueError:
        done = Checkpoint(spark, path, {"field": "v"}, wipe=True)
    done.run(range(3), work("v"))
    return done.read(list(range(3))).select(F.col("iter").cast("long").alias("iter"), "k", cut("v", 6).alias("v"))


@query("checkpoint_inputs", f"WITH {A.FIELD} SELECT t AS iter, CASE WHEN t % 2 = 0 THEN 2 ELSE 1 END AS go, {sql_cut('avg(u)', 6, 'u')} FROM field WHERE t < 6 GROUP BY t")
def checkpoint_inputs(spark, sf):
    """Iterations whose inputs changed since are made again, and no others: here those of even t, by their fingerprints."""
    from ..streaming import Checkpoint

    f, done = A.field(spark, sf).where("t < 6"), Checkpoint(spark, f"{shared_dir(spark)}/checkpoints/{uuid.uuid4().hex}", {"field": "u"})
    for go in (1, 2):
        changed = F.when(F.col("t") % 2 == 0, go).otherwise(1)
        prints = f.groupBy("t", changed.alias("c")).agg(F.sum("u").alias("s")).select(F.col("t").alias("iter"), F.sha2(F.concat_ws(" ", F.col("c").cast("string"), F.round("s", 2).cast("string")), 256).alias("fingerprint"))
        done.run(range(6), lambda it, go=go: f.where(F.col("t") == it).agg(F.avg("u").alias("u")).withColumn("go", F.lit(go)), prints=prints)
    return done.read(list(range(6))).select(F.col("iter").cast("long").alias("iter"), "go", cut("u", 6).alias("u"))


def lines_of(spark, path, header, names):
    """The numbers of a text file's rows after its header."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("v"), F.monotonically_increasing_id().alias("n")).where(f"n >= {header}")
    return rows.select(*[F.col("v")[k].cast("double").alias(c) for k, c in enumerate(names)])


def text_file(spark):
    return f"{shared_dir(spark)}/text/{uuid.uuid4().hex}.dat"


@query("written_profile", f"SELECT {sql_cut('l_quantity', 4, 'z')}, {sql_cut('avg(l_extendedprice)', 4, 'value')} FROM lineitem GROUP BY l_quantity")
def written_profile(spark, sf):
    path = text_file(spark)
    sinks.write_profile(spark, path, profile.level_profile(A.cloud(spark, sf), "z", {"value": "val"}, 1e-6))
    return cut_all(lines_of(spark, path, 0, ["z", "value"]), 4, "z", "value")


@query("written_grid", f"WITH {A.FIELD} SELECT {sql_cut('x', 5)}, {sql_cut('y', 5)}, {sql_cut('z', 5)}, {sql_cut('u', 3)}, row_number() OVER (ORDER BY k, j, i) - 1 AS place FROM grid JOIN mean_t USING (i, j, k)")
def written_grid(spark, sf):
    """The time mean as a structured zone, and each row's place in it."""
    path = text_file(spark)
    sinks.write_structured(spark, path, A.coordinates(moments.time_mean(A.field(spark, sf))), ["u"])
    rows = spark.read.text(path).coalesce(1).select(F.split(F.trim("value"), " +").alias("v"), F.monotonically_increasing_id().alias("n")).where("n >= 3")
    return rows.select(*[cut(F.col("v")[k].cast("double"), p).alias(c) for k, (c, p) in enumerate((("x", 5), ("y", 5), ("z", 5), ("u", 3)))], (F.col("n") - 3).alias("place"))


@query("written_mesh", f"WITH {A.TETS} SELECT n0 + 1 AS n0, n1 + 1 AS n1, n2 + 1 AS n2, n3 + 1 AS n3, row_number() OVER (ORDER BY elem_idx) - 1 AS place FROM tets")
def written_mesh(spark, sf):
    """The elements of a mesh written with its nodes, in their order, counted from 1."""
    path, nodes = text_file(spark), A.mesh_points(spark, sf)
    sinks.write_mesh(spark, path, nodes, ["x", "y", "z", "u"], A.tets(spark, sf))
    first = 3 + A.NX * A.NY * A.NZ
    rows = spark.read.text(path).coalesce(1).select(F.split(F.trim("value"), " +").alias("v"), F.monotonically_increasing_id().alias("n")).where(f"n >= {first}")
    return rows.select(*[F.col("v")[k].cast("long").alias(f"n{k}") for k in range(4)], (F.col("n") - first).alias("place"))


@query("written_mesh_nodes", f"WITH {A.TETS} SELECT {', '.join(sql_cut(c, 5) for c in 'xyz')}, {sql_cut('u', 3)}, row_number() OVER (ORDER BY node_id) - 1 AS place FROM pts")
def written_mesh_nodes(spark, sf):
    """The nodes of a written mesh, in their order."""
    path = text_file(spark)
    sinks.write_mesh(spark, path, A.mesh_points(spark, sf), ["x", "y", "z", "u"], A.tets(spark, sf))
    rows = spark.read.text(path).coalesce(1).select(F.split(F.trim("value"), " +").alias("v"), F.monotonically_increasing_id().alias("n")).where(f"n >= 3 AND n < {3 + A.NX * A.NY * A.NZ}")
    return rows.select(*[cut(F.col("v")[k].cast("double"), p).alias(c) for k, (c, p) in enumerate((("x", 5), ("y", 5), ("z", 5), ("u", 3)))], (F.col("n") - 3).alias("place"))


@query("written_mesh_from_0", f"WITH {A.TETS} SELECT n0, n1, n2, n3, row_number() OVER (ORDER BY elem_idx) - 1 AS place FROM tets")
def written_mesh_from_0(spark, sf):
    """Elements counted from 0, in a file that takes the place of an earlier one."""
    path, nodes, elems = text_file(spark), A.mesh_points(spark, sf), A.tets(spark, sf)
    for some, first in ((elems.where("elem_idx % 2 = 0"), True), (elems, False)):
        sinks.write_mesh(spark, path, nodes, ["x", "y", "z", "u"], some, one_based=first)
    first = 3 + A.NX * A.NY * A.NZ
    rows = spark.read.text(path).coalesce(1).select(F.split(F.trim("value"), " +").alias("v"), F.monotonically_increasing_id().alias("n")).where(f"n >= {first}")
    return rows.select(*[F.col("v")[k].cast("long").alias(f"n{k}") for k in range(4)], (F.col("n") - first).alias("place"))


@query("written_npy", f"WITH {A.FIELD} SELECT row_number() OVER (ORDER BY k, j, i) - 1 AS row, i, k, {sql_cut('u', 6)} FROM mean_t")
def written_npy(spark, sf):
    """A NumPy file of the time mean, by place, read again."""
    path = f"{shared_dir(spark)}/text/{uuid.uuid4().hex}.npy"
    sinks.write_npy(path, moments.time_mean(A.field(spark, sf)), ["i", "k", "u"], ["k", "j", "i"])
    return cut_all(sinks.read_npy(spark, path, rows=64), 6, "u")


@query("written_once", f"SELECT {sql_cut('l_quantity', 4, 'z')}, {sql_cut('avg(l_extendedprice)', 4, 'value')} FROM lineitem GROUP BY l_quantity")
def written_once(spark, sf):
    """An output that is there already is passed over."""
    path = text_file(spark)
    for value in ("val", "z"):
        if not sinks.exists(spark, path):
            sinks.write_profile(spark, path, profile.level_profile(A.cloud(spark, sf), "z", {"value": value}, 1e-6))
    return cut_all(lines_of(spark, path, 0, ["z", "value"]), 4, "z", "value")


@query("written_summary", "SELECT 'rows = ' || count(*) AS value FROM lineitem UNION ALL SELECT 'parts = ' || count(DISTINCT l_partkey) FROM lineitem")
def written_summary(spark, sf):
    path = text_file(spark)
    sinks.write_summary(spark, path, A.table(spark, sf, "lineitem").agg(F.count("*").alias("rows"), F.count_distinct("l_partkey").alias("parts")))
    return spark.read.text(path)


@query("read_result", f"WITH {A.FIELD} SELECT i, j, k, {sql_cut('avg(w)', 6, 'w')} FROM field GROUP BY i, j, k")
def read_result(spark, sf):
    """An earlier step's table, found by name and tag."""
    folder = f"{shared_dir(spark)}/results/{uuid.uuid4().hex}"
    sinks.write_result(moments.time_mean(A.field(spark, sf), ["w"]).drop("n"), folder, "mean", "run1")
    return cut_all(sources.read_result(spark, folder, "mean", "run1"), 6, "w")


@query("normalized_k", f"WITH {PLANE}, d AS (SELECT field, k_idx, 2 * pi() * k_idx / 5.0::DOUBLE AS k, p FROM pp), l AS (SELECT 2 * pi() / (max(CASE WHEN k_idx = 1 THEN k END) - max(CASE WHEN k_idx = 0 THEN k END)) AS len FROM d) SELECT field, k_idx, {sql_cut('len * k / 2', 6, 'k')}, {sql_cut('p', 4)} FROM d, l WHERE k > 0 AND p > 0")
def normalized_k(spark, sf):
    s = spectral.with_wavenumber(spectral.plane_spectrum(fluct(spark, sf)), A.NZ, A.DZ)
    length = s.agg((F.lit(2.0) * F.pi() / (F.max(F.when(F.col("k_idx") == 1, F.col("k"))) - F.max(F.when(F.col("k_idx") == 0, F.col("k"))))).alias("len"))
    out = fit.positive(s).crossJoin(F.broadcast(length)).withColumn("k", F.col("len") * F.col("k") / 2)
    return out.select("field", "k_idx", cut("k", 6).alias("k"), cut("p", 4).alias("p"))


@query("tet_gradient", f"WITH {A.TETS} SELECT elem_idx, {sql_cut('vol', 6)}, {', '.join(sql_cut(f't_val_d{a}', 5) for a in 'xyz')} FROM tg")
def tet_gradient(spark, sf):
    g = mesh.tet_gradient(A.tets(spark, sf), A.mesh_points(spark, sf), ["t_val"])
    return cut_all(g.select("elem_idx", "vol", "t_val_dx", "t_val_dy", "t_val_dz"), 5, "t_val_dx", "t_val_dy", "t_val_dz").withColumn("vol", cut("vol", 6))


@query("node_scatter", f"WITH {A.TETS} SELECT node_id, {sql_cut('sum(vol * t_val_dz) / sum(vol)', 5, 't_val_dz')} FROM (SELECT unnest([n0, n1, n2, n3]) AS node_id, vol, t_val_dz FROM tg) GROUP BY node_id")
def node_scatter(spark, sf):
    return cut_all(mesh.scatter(mesh.tet_gradient(A.tets(spark, sf), A.mesh_points(spark, sf), ["t_val"]), ["t_val_dz"]), 5, "t_val_dz")


NODE_GRADIENT = f"""WITH {A.TETS}, pi AS MATERIALIZED (SELECT t * 100000 + i + 4 * j + 20 * k AS place, t_val FROM field WHERE t < 2),
t2 AS MATERIALIZED (SELECT it.iter, tg.* FROM tg CROSS JOIN (VALUES (0), (1)) AS it(iter)),
e2 AS (SELECT t2.*, {', '.join(f'p{c}.t_val - p0.t_val AS d{c}' for c in (1, 2, 3))} FROM t2 {' '.join(f'JOIN pi p{c} ON p{c}.place = t2.iter * 100000 + t2.n{c}' for c in range(4))}),
g2 AS (SELECT iter, unnest([n0, n1, n2, n3]) AS node_id, vol, ((y2 * z3 - z2 * y3) * d1 + (y3 * z1 - z3 * y1) * d2 + (y1 * z2 - z1 * y2) * d3) / det AS gx,
  ((z2 * x3 - x2 * z3) * d1 + (z3 * x1 - x3 * z1) * d2 + (z1 * x2 - x1 * z2) * d3) / det AS gy, ((x2 * y3 - y2 * x3) * d1 + (x3 * y1 - y3 * x1) * d2 + (x1 * y2 - y1 * x2) * d3) / det AS gz FROM e2)
SELECT iter, node_id, {', '.join(sql_cut(f'sum(vol * g{a}) / sum(vol)', 5, f't_val_d{a}') for a in 'xyz')} FROM g2 GROUP BY iter, node_id"""


@query("node_gradient_stored", NODE_GRADIENT)
def node_gradient_stored(spark, sf):
    """Gradients at the nodes of two iterations by weights that are kept."""
    weights = sparse.store(sparse.gradient_weights(A.tets(spark, sf), A.mesh_points(spark, sf)), f"{shared_dir(spark)}/weights/{uuid.uuid4().hex}")
    values = A.field(spark, sf).where("t < 2").select(F.col("t").alias("iter"), (F.col("i") + F.col("j") * 4 + F.col("k") * 20).alias("node_id"), "t_val")
    return cut_all(sparse.apply(weights, values, ["t_val"]), 5, *[f"t_val_d{a}" for a in "xyz"])


_GG = " + ".join(f"{a}_d{x} * {a}_d{x} + {a}_d{x} * {b}_d{y}".replace(f"{b}_d{y}", f"{b}_d{y}") for a, y in zip("uvw", "xyz", strict=True) for b, x in zip("uvw", "xyz", strict=True))
DISS = f"{A.TETS}, ph AS (SELECT vol, mu * ({_GG} - 2.0::DOUBLE / 3 * pow(u_dx + v_dy + w_dz, 2)) AS phi FROM tg), di AS (SELECT sum(vol) AS volume, sum(vol * phi) / sum(vol) AS phi_mean FROM ph)"


@query("dissipation", f"WITH {DISS} SELECT {sql_cut('volume', 6)}, {sql_cut('phi_mean', 3)}, {sql_cut('1 + 0.71::DOUBLE * phi_mean', 3, 'nu_v')} FROM di")
def dissipation(spark, sf):
    d = mesh.dissipation(A.tets(spark, sf), A.mesh_points(spark, sf))
    nu = nusselt.nu_from_dissipation(d, 0.71)
    return d.crossJoin(F.broadcast(nu)).select(cut("volume", 6).alias("volume"), cut("phi_mean", 3).alias("phi_mean"), cut("nu_v", 3).alias("nu_v"))


@query("level_stats_mesh", f"""WITH {A.TETS}, ng AS (SELECT node_id, sum(vol * t_val_dz) / sum(vol) AS g FROM (SELECT unnest([n0, n1, n2, n3]) AS node_id, vol, t_val_dz FROM tg) GROUP BY node_id)
SELECT 0 AS iter, level_idx, {sql_cut('avg(z)', 6, 'z')}, {sql_cut('avg(mu * w * (t_val - 50))', 4, 'conv')}, {sql_cut('avg(mu * g)', 5, 'cond')}, {sql_cut('avg(t_val)', 5, 'tm')}, {sql_cut('avg(mu * w)', 5, 'mflux')} FROM pts JOIN ng USING (node_id) GROUP BY level_idx""")  # fmt: skip
def level_stats_mesh(spark, sf):
    nodes = A.mesh_points(spark, sf).withColumns({"rho": F.col("mu"), "kappa": F.col("mu"), "cp": F.lit(1.0), "iter": F.lit(0)})
    out = nusselt.level_stats_mesh(nodes, A.tets(spark, sf), 50.0)
    return out.select("iter", "level_idx", cut("z", 6).alias("z"), cut("conv", 4).alias("conv"), *[cut(c, 5).alias(c) for c in ("cond", "tm", "mflux")])


@query("zslice", f"WITH {A.FIELD} SELECT t, i, j, {flow_cut(6)} FROM field WHERE k = 5")
def zslice(spark, sf):
    return cut_all(A.field(spark, sf).where(F.col("k") == A.NZ // 2).select("t", "i", "j", *FLOW), 6, *FLOW)


@query("slice_minmax", f"WITH {A.FIELD} SELECT {sql_cut('min(u)', 6, 'lo')}, {sql_cut('max(u)', 6, 'hi')} FROM (SELECT u FROM field WHERE t = 1 AND k = 5 UNION ALL SELECT u FROM mean_t WHERE k = 5)")
def slice_minmax(spark, sf):
    f = A.field(spark, sf)
    both = f.where("t = 1 AND k = 5").select("u").unionByName(moments.time_mean(f).where("k = 5").select("u"))
    return both.agg(cut(F.min("u"), 6).alias("lo"), cut(F.max("u"), 6).alias("hi"))


@query("snapshot_pick", f"WITH {A.FIELD}, n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM (SELECT DISTINCT t FROM field)) SELECT f.t, i, j, k, {sql_cut('u', 6)} FROM field f JOIN n USING (t) WHERE n.n = 3")
def snapshot_pick(spark, sf):
    f = A.field(spark, sf)
    at = f.select("t").distinct().orderBy("t").offset(3).limit(1)
    return f.join(F.broadcast(at), "t", "left_semi").select("t", "i", "j", "k", cut("u", 6).alias("u"))


@query("pending_iters", f"WITH {A.FIELD} SELECT DISTINCT t FROM field WHERE t NOT IN (SELECT t FROM field WHERE t % 3 = 0)")
def pending_iters(spark, sf):
    from ..streaming import pending

    f = A.field(spark, sf).select("t").distinct()
    return pending(f, f.where("t % 3 = 0"), "t")


@query("stream_mean")
def stream_mean(spark, sf):
    from ..streaming import stream_means

    return cut_all(stream_means(spark, f"{sf}/events.parquet", lambda e: e.select((F.col("event_id") % 200).alias("cell"), "value"), ["cell"], ["value"]), 6, "value")


SQL["stream_mean"] = f"SELECT event_id % 200 AS cell, {sql_cut('avg(value)', 6, 'value')}, count(*) AS n FROM events GROUP BY 1"


@query("stream_tke", SQL["tke"])
def stream_tke(spark, sf):
    """Snapshots in two goes of several triggers, whose moments are folded into few folders."""
    from ..streaming import stream_tke

    own, f = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}", A.field(spark, sf)
    for some in (f.where("t % 2 = 0"), f.where("t % 2 = 1")):
        some.select("i", "j", "k", "u", "v", "w").repartition(3).write.mode("append").parquet(f"{own}/in")
        out = stream_tke(spark, f"{own}/in", lambda df: df, checkpoint=f"{own}/checkpoint", table=f"{own}/moments", files=1, most=4)
    return cut_all(out, 4, "tke_t", "tke_tz")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the time mean of each field, its mean along z, and the level profile of the temperature."""
    mean = moments.time_mean(A.field(spark, sf_dir))
    return profile.level_profile(A.coordinates(mean), "z", {c: c for c in FLOW}, 1e-6).orderBy("level_key")
