"""The driver's tables as gridded fields, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import NODE_COLUMNS, shared_dir
from ..sources import files, plot3d

NX, NY, NZ, DZ = 4, 5, 10, 0.5
REF, REF_XYZ = (1, 2, 5), (1.1, 2.2, 2.5)
T_REF, PE = 0.55, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(df: DataFrame) -> DataFrame:
    i, j, k = (F.col(c).cast("double") for c in "ijk")
    return df.withColumns({"x": i + i * i * 0.1, "y": j + j * j * 0.05, "z": k * DZ})


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, i, j, k, u, v, w, t_val on a dense 4 x 5 x 10 grid, a snapshot for each 200 events."""
    ev, p = table(spark, sf_dir, "events"), F.expr("event_id % 200")
    return ev.select(
        F.expr("event_id div 200").alias("t"), (p % 4).alias("i"), (F.expr("(event_id % 200) div 4") % 5).alias("j"), F.expr("(event_id % 200) div 20").alias("k"),
        F.col("value").alias("u"), F.col("user_id").cast("double").alias("v"), F.minute("ts").cast("double").alias("w"), F.get_json_object("props", "$.k").cast("double").alias("t_val"),
    )


FIELD = f"""field AS (
  SELECT event_id // 200 AS t, (event_id % 200) % 4 AS i, ((event_id % 200) // 4) % 5 AS j, (event_id % 200) // 20 AS k,
    value AS u, CAST(user_id AS DOUBLE) AS v, CAST(minute(ts) AS DOUBLE) AS w, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS t_val FROM events),
grid AS (SELECT i, j, k, i + 0.1::DOUBLE * i * i AS x, j + 0.05::DOUBLE * j * j AS y, {DZ}::DOUBLE * k AS z FROM (SELECT DISTINCT i, j, k FROM field)),
mean_t AS (SELECT i, j, k, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(t_val) AS t_val FROM field GROUP BY i, j, k),
mean_tz AS (SELECT i, j, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(t_val) AS t_val FROM mean_t GROUP BY i, j),
fluct AS (SELECT f.t, f.i, f.j, f.k, f.u - m.u AS u, f.v - m.v AS v, f.w - m.w AS w, f.t_val - m.t_val AS t_val FROM field f JOIN mean_tz m USING (i, j))"""


def grid(df: DataFrame) -> DataFrame:
    return coordinates(df.select("i", "j", "k").distinct())


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iter, col_idx, level_idx, z, w, t_val, rho, cp, kappa: columns of 10 uneven levels."""
    k = F.col("k").cast("double")
    f = field(spark, sf_dir)
    return f.select(
        F.col("t").alias("iter"), (F.col("i") + F.col("j") * 4).alias("col_idx"), F.col("k").alias("level_idx"), (k + k * k * 0.03).alias("z"), (F.col("w") / 60 - 0.5).alias("w"),
        (F.lit(1.0) - k * 0.1 + F.col("t_val") / 1000).alias("t_val"), (F.col("v") / 1000 + 1).alias("rho"), F.lit(1.0).alias("cp"), (F.col("u") / 1000 + 1).alias("kappa"),
    )


def slope_sql(v: str, x: str, over: str) -> str:
    """The three-point slope, written by spacings."""
    b = lambda e, n=1: f"lag({e}, {n}) OVER ({over})"
    a = lambda e, n=1: f"lead({e}, {n}) OVER ({over})"

    def mid(x0, x1, x2, f0, f1, f2, at):
        p, q = f"({x1} - {x0})", f"({x2} - {x1})"
        w = {0: (f"-(2 * {p} + {q}) / ({p} * ({p} + {q}))", f"({p} + {q}) / ({p} * {q})", f"-{p} / ({q} * ({p} + {q}))"), 1: (f"-{q} / ({p} * ({p} + {q}))", f"({q} - {p}) / ({p} * {q})", f"{p} / ({q} * ({p} + {q}))"), 2: (f"{q} / ({p} * ({p} + {q}))", f"-({p} + {q}) / ({p} * {q})", f"({p} + 2 * {q}) / ({q} * ({p} + {q}))")}[at]
        return f"{w[0]} * {f0} + {w[1]} * {f1} + {w[2]} * {f2}"

    return f"CASE WHEN {b(x)} IS NULL THEN {mid(x, a(x), a(x, 2), v, a(v), a(v, 2), 0)} WHEN {a(x)} IS NULL THEN {mid(b(x, 2), b(x), x, b(v, 2), b(v), v, 2)} ELSE {mid(b(x), x, a(x), b(v), v, a(v), 1)} END"


COLUMNS = f"""{FIELD},
nus AS (SELECT t AS iter, i + 4 * j AS col_idx, k AS level_idx, k + 0.03::DOUBLE * k * k AS z, w / 60 - 0.5 AS w, 1.0::DOUBLE - k * 0.1::DOUBLE + t_val / 1000 AS t_val, v / 1000 + 1 AS rho, 1.0::DOUBLE AS cp, u / 1000 + 1 AS kappa FROM field),
nus_g AS (SELECT *, {slope_sql('t_val', 'z', 'PARTITION BY iter, col_idx ORDER BY level_idx')} AS g FROM nus),
lev AS (SELECT iter, level_idx, avg(z) AS z, avg(rho * cp * w * (t_val - {T_REF}::DOUBLE)) AS conv, avg(kappa * g) AS cond, avg(t_val) AS tm, avg(rho * cp * w) AS mflux FROM nus_g GROUP BY iter, level_idx),
levm AS (SELECT level_idx, avg(z) AS z, avg(conv) AS conv, avg(cond) AS cond, avg(tm) AS tm, avg(mflux) AS mflux FROM lev GROUP BY level_idx),
sc AS (SELECT CASE WHEN t0 > t1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn, z0, z1, abs(t0 - t1) AS dt, z1 - z0 AS h, abs(t0 - t1) / (z1 - z0) AS den, c0, c1
  FROM (SELECT min(z) AS z0, max(z) AS z1, arg_min(tm, z) AS t0, arg_max(tm, z) AS t1, arg_min(cond, z) AS c0, arg_max(cond, z) AS c1 FROM levm)),
prof AS (SELECT level_idx, z, sgn * (conv * {PE}::DOUBLE - cond) / den AS nu, sgn * conv * {PE}::DOUBLE / den AS nu_conv, -sgn * cond / den AS nu_cond, tm, sgn * mflux * {PE * T_REF}::DOUBLE / den AS nu_shift FROM levm, sc)"""


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iter, blk, node_idx, x, y, z, val: mesh partitions with nodes that occur in several blocks, and inside one."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.year("o_orderdate").alias("iter"), (F.col("o_orderkey") % 3).alias("blk"), F.col("o_orderkey").alias("node_idx"), (F.col("o_custkey") * F.lit(0.01)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.col("o_totalprice").alias("val"))


PARTITIONS = """parts AS (SELECT year(o_orderdate) AS iter, o_orderkey % 3 AS blk, o_orderkey AS node_idx, o_custkey * 0.01::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, o_totalprice AS val FROM orders),
keyed AS (SELECT *, CAST(round_even(x * 1000000::DOUBLE, 0) AS BIGINT) AS qx FROM parts),
marked AS (SELECT *, blk = min(blk) OVER (PARTITION BY iter, qx) AS kept FROM keyed)"""

#: Six tetrahedra in each grid cell, by the corners between the lowest and the highest.
KUHN = [(0, 1, 0, 0, 1, 1, 0), (1, 1, 0, 0, 1, 0, 1), (2, 0, 1, 0, 1, 1, 0), (3, 0, 1, 0, 0, 1, 1), (4, 0, 0, 1, 1, 0, 1), (5, 0, 0, 1, 0, 1, 1)]


def tets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elem_idx, n0 to n3: a tetrahedral mesh on the points of ``field``, node i + 4 j + 20 k."""
    cells = field(spark, sf_dir).select("i", "j", "k").distinct().where("i < 3 AND j < 4 AND k < 9")
    six = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("q", "a", "b", "c", "d", "e", "f"), row, strict=True)]) for row in KUHN])).alias("s")
    node = lambda a, b, c: (F.col("i") + a) + (F.col("j") + b) * 4 + (F.col("k") + c) * 20
    s = F.col
    return cells.select("i", "j", "k", six).select(
        ((F.col("i") + F.col("j") * 3 + F.col("k") * 12) * 6 + s("s.q")).alias("elem_idx"), node(0, 0, 0).alias("n0"), node(s("s.a"), s("s.b"), s("s.c")).alias("n1"), node(s("s.d"), s("s.e"), s("s.f")).alias("n2"), node(1, 1, 1).alias("n3")
    )


TETS = f"""{FIELD},
tets AS (SELECT (c.i + 3 * c.j + 12 * c.k) * 6 + p.q AS elem_idx, c.i + 4 * c.j + 20 * c.k AS n0, (c.i + p.a) + 4 * (c.j + p.b) + 20 * (c.k + p.c) AS n1,
    (c.i + p.d) + 4 * (c.j + p.e) + 20 * (c.k + p.f) AS n2, (c.i + 1) + 4 * (c.j + 1) + 20 * (c.k + 1) AS n3
  FROM (SELECT DISTINCT i, j, k FROM field WHERE i < 3 AND j < 4 AND k < 9) c CROSS JOIN (VALUES {', '.join(map(str, KUHN))}) AS p(q, a, b, c, d, e, f)),
pts AS (SELECT i + 4 * j + 20 * k AS node_id, k AS level_idx, x, y, z, u, v, w, t_val, 1 + u / 1000 AS mu FROM grid JOIN mean_t USING (i, j, k)),
ed AS (SELECT t.*, {', '.join(f'p{c}.{a} - p0.{a} AS {a}{c}' for c in (1, 2, 3) for a in ('x', 'y', 'z', 'u', 'v', 'w', 't_val'))}, (p0.mu + p1.mu + p2.mu + p3.mu) / 4 AS mu
  FROM tets t {' '.join(f'JOIN pts p{c} ON p{c}.node_id = t.n{c}' for c in range(4))}),
tg0 AS (SELECT *, x1 * (y2 * z3 - z2 * y3) - y1 * (x2 * z3 - z2 * x3) + z1 * (x2 * y3 - y2 * x3) AS det FROM ed),
tg AS (SELECT *, abs(det) / 6 AS vol, {', '.join(f"((y2 * z3 - z2 * y3) * {v}1 + (y3 * z1 - z3 * y1) * {v}2 + (y1 * z2 - z1 * y2) * {v}3) / det AS {v}_dx, ((z2 * x3 - x2 * z3) * {v}1 + (z3 * x1 - x3 * z1) * {v}2 + (z1 * x2 - x1 * z2) * {v}3) / det AS {v}_dy, ((x2 * y3 - y2 * x3) * {v}1 + (x3 * y1 - y3 * x1) * {v}2 + (x1 * y2 - y1 * x2) * {v}3) / det AS {v}_dz" for v in ('u', 'v', 'w', 't_val'))} FROM tg0)"""


def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import moments

    m = coordinates(moments.time_mean(field(spark, sf_dir)))
    return m.select((F.col("i") + F.col("j") * 4 + F.col("k") * 20).alias("node_id"), F.col("k").alias("level_idx"), "x", "y", "z", "u", "v", "w", "t_val", (F.lit(1.0) + F.col("u") / 1000).alias("mu"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, line: periodic lines of 64 points."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("line"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.year("l_shipdate").alias("iter"), F.col("l_quantity").alias("z"), F.col("l_extendedprice").alias("val"))


def _files(rows: DataFrame, keys: list[str], order: list[str], write) -> None:
    """Calls write(arrays of the group's rows by column, in ``order``) for each group, in tasks: rows are dealt by key and sorted, so that a task's groups follow one another."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = dealt.columns

    def run(batches):
        held = None
        for last, batch in _and_last(b for b in batches if b.num_rows):
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            now = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in names}
            n = len(now[names[0]])
            edges = [0, *(np.flatnonzero(np.any([now[c][1:] != now[c][:-1] for c in keys], axis=0)) + 1).tolist(), n]
            for a, b in zip(edges[:-1], edges[1:] if last else edges[1:-1], strict=False):
                write({c: x[a:b] for c, x in now.items()})
            held = {c: x[edges[-2] :] for c, x in now.items()}
            yield pa.RecordBatch.from_pydict({"rows": [n if last else edges[-2]]})

    dealt.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def _and_last(items):
    """(whether it is the last, item)."""
    items = iter(items)
    for one in items:
        for following in items:
            yield False, one
            one = following
        yield True, one


def snapshot_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of structured snapshots (u, v, w, p = 0, e = t_val) of ``field``, one for each t, in the shared folder."""
    folder = f"{shared_dir(spark)}/native/{uuid.uuid4().hex}"

    def write(rows):
        values = np.zeros((NX, NY, NZ, 5))
        for n, c in ((0, "u"), (1, "v"), (2, "w"), (4, "t_val")):
            values[rows["i"], rows["j"], rows["k"], n] = rows[c]
        plot3d.write_snapshot(f"{folder}/grid1.{rows['t'][0]}.f", values)

    _files(field(spark, sf_dir), ["t"], [], write)
    return folder


def mesh_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of mesh partitions of ``field``: iteration t; two blocks that share the plane j = 2, each with one tetrahedron."""
    folder = f"{shared_dir(spark)}/native/{uuid.uuid4().hex}"
    f = coordinates(field(spark, sf_dir)).withColumn("blk", F.explode(F.expr("CASE WHEN j < 2 THEN array(1) WHEN j > 2 THEN array(2) ELSE array(1, 2) END")))
    own = {"X": "x", "Y": "y", "Z": "z", "U": "u", "V": "v", "W": "w", "T": "t_val"}
    line = " ".join("%.17g" if c in own else "1" for c in NODE_COLUMNS) + "\n"

    def write(rows):
        n = len(rows["t"])
        head = "VARIABLES = " + ",".join(f'"{c}"' for c in NODE_COLUMNS) + f"\nZONE N={n}, E=1\nDATAPACKING=POINT, ZONETYPE=FETETRAHEDRON\n"
        text = line * n % tuple(np.stack([rows[own[c]] for c in NODE_COLUMNS if c in own], 1).ravel().tolist())
        with files.create(f"{folder}/tecplot_blk{rows['blk'][0]}_iter{rows['t'][0]}.dat") as out:
            out.write((head + text + "1 2 5 21\n").encode())

    _files(f, ["t", "blk"], ["k", "j", "i"], write)
    return folder


def grid_file(spark: SparkSession, sf_dir: str) -> str:
    """The grid of ``field`` as a structured file."""
    path = f"{shared_dir(spark)}/native/{uuid.uuid4().hex}/grid.xyz"

    def write(rows):
        values = np.zeros((3, NX, NY, NZ))
        for n, c in enumerate("xyz"):
            values[n, rows["i"], rows["j"], rows["k"]] = rows[c]
        plot3d.write_grid(path, *values)

    _files(grid(field(spark, sf_dir)).withColumn("one", F.lit(1)), ["one"], [], write)
    return path
