"""Level profiles and the layout of a point cloud."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import col, level_key, numbered


def level_profile(points: DataFrame, z: str, values: dict[str, Column | str], tol: float, by: Sequence[str] = (), level_z: str = "key") -> DataFrame:
    """by, level_key, z, n and the mean of each value over the points of a level; z is the key's place ("key") or the level's mean ("mean")."""
    zc = (F.col("level_key") * F.lit(tol)) if level_z == "key" else None
    rows = points.withColumn("level_key", level_key(z, tol))
    aggs = [F.avg(F.col(z).cast("double")).alias("z")] if zc is None else []
    out = rows.groupBy(*by, "level_key").agg(*aggs, F.count("*").alias("n"), *[F.avg(col(v).cast("double")).alias(name) for name, v in values.items()])
    return out if zc is None else out.withColumn("z", zc)


def level_counts(profile: DataFrame) -> DataFrame:
    """levels, points, n_min, n_max, n_mean, and shared: at most half as many levels as points."""
    out = profile.agg(F.count("*").alias("levels"), F.sum("n").alias("points"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.avg("n").alias("n_mean"))
    return out.withColumn("shared", F.col("levels") <= F.col("points") * 0.5)


def levels(points: DataFrame, z: str = "z", z_tol: float = 1e-8) -> DataFrame:
    """Adds level_key and level_idx (0 for the lowest level). Levels are numbered on their distinct keys, not on the points; there may be as many as points."""
    rows = points.withColumn("level_key", level_key(z, z_tol))
    return rows.join(numbered(rows.select("level_key").distinct(), "level_key", "level_idx"), "level_key")


def layout(points: DataFrame, z_tol: float = 1e-8, xy_tol: float = 1e-6) -> DataFrame:
    """One row: n_points, n_levels, shared_levels, n_min, n_max, n_columns, is_columns.

    Points stand in columns if levels are shared, there are three at least, all
    hold as many points, and each (x, y) cell occurs on every level. A level that
    has a cell twice or lacks one breaks it.
    """
    keyed = points.select(level_key("z", z_tol).alias("lev"), level_key("x", xy_tol).alias("kx"), level_key("y", xy_tol).alias("ky"))
    cells = keyed.groupBy("lev", "kx", "ky").agg(F.count("*").alias("n"))
    per_level = cells.groupBy("lev").agg(F.sum("n").alias("n"))
    per_column = cells.groupBy("kx", "ky").agg(F.count("*").alias("levels"), F.min("n").alias("least"), F.max("n").alias("most"))
    a = per_level.agg(F.sum("n").alias("n_points"), F.count("*").alias("n_levels"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    b = per_column.agg(F.count("*").alias("n_columns"), F.min("levels").alias("_lv"), F.min("least").alias("_least"), F.max("most").alias("_most"), F.min(F.expr("least = most")).alias("_same"))
    out = a.crossJoin(F.broadcast(b))  # one row each
    out = out.withColumn("shared_levels", F.col("n_levels") <= F.col("n_points") * 0.5)
    full = F.col("shared_levels") & (F.col("n_levels") >= 3) & (F.col("n_min") == F.col("n_max")) & (F.col("_lv") == F.col("n_levels")) & F.col("_same")
    return out.select("n_points", "n_levels", "shared_levels", "n_min", "n_max", "n_columns", full.alias("is_columns"))


def column_index(points: DataFrame, xy_tol: float = 1e-6) -> DataFrame:
    """Adds col_idx: the rank of a point's (x, y) on its level (level_idx), from 0."""
    w = W.partitionBy("level_idx").orderBy(level_key("x", xy_tol), level_key("y", xy_tol))
    return points.withColumn("col_idx", F.row_number().over(w) - 1)


#: Parts of an axis whose places are sorted apart.
STRIPS = 4096


def spacing(points: DataFrame) -> DataFrame:
    """One row of a level's points (x, y): n_x, dx_ratio, n_y, dy_ratio, tensor. A ratio is the largest spacing over the smallest, 1 with fewer than three places."""
    out = None
    for axis in "xy":
        places = points.select(F.round(F.col(axis).cast("double"), 10).alias("c")).distinct()
        # gaps inside a strip, and between the strips' ends: no task sorts all places. Strips divide the extent, whatever its unit
        extent = places.agg(F.min("c").alias("_lo"), F.greatest(F.max("c") - F.min("c"), F.lit(1e-300)).alias("_wide"))
        strips = places.crossJoin(F.broadcast(extent)).select("c", F.least(F.floor((F.col("c") - F.col("_lo")) / F.col("_wide") * STRIPS), F.lit(STRIPS - 1)).alias("strip"))
        inside = strips.select("c", (F.col("c") - F.lag("c").over(W.partitionBy("strip").orderBy("c"))).alias("gap"))
        ends = strips.groupBy("strip").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).select(F.lit(None).cast("double").alias("c"), (F.col("lo") - F.lag("hi").over(W.orderBy("strip"))).alias("gap"))
        gaps = inside.unionByName(ends)
        row = gaps.agg(F.count("c").alias(f"n_{axis}"), F.when(F.count("c") > 2, F.max("gap") / F.min("gap")).otherwise(F.lit(1.0)).alias(f"d{axis}_ratio"))
        out = row if out is None else out.crossJoin(F.broadcast(row))
    n = points.agg(F.count("*").alias("_n"))
    return out.crossJoin(F.broadcast(n)).select("n_x", "dx_ratio", "n_y", "dy_ratio", (F.col("n_x") * F.col("n_y") == F.col("_n")).alias("tensor"))
