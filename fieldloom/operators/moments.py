"""Means, fluctuations and second moments over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import FLOW

CELL = ["i", "j", "k"]


def time_mean(snap: DataFrame, fields: Sequence[str] = tuple(FLOW), keys: Sequence[str] = tuple(CELL), keep_sums: bool = False) -> DataFrame:
    """Mean of each field over the snapshots of a cell, in double precision, and their number n; optionally the sums too."""
    aggs = [F.avg(F.col(f).cast("double")).alias(f) for f in fields] + [F.count("*").alias("n")]
    if keep_sums:
        aggs += [F.sum(F.col(f).cast("double")).alias(f"{f}_sum") for f in fields]
    return snap.groupBy(*keys).agg(*aggs)


def z_mean(mean: DataFrame, fields: Sequence[str] = tuple(FLOW)) -> DataFrame:
    """Mean of a time mean along z: a row for each (i, j)."""
    return mean.groupBy("i", "j").agg(*[F.avg(f).alias(f) for f in fields])


def fluctuations(snap: DataFrame, mean: DataFrame, fields: Sequence[str] = tuple(FLOW), keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """Snapshot minus mean for each field, under the field's name. ``keys`` says which mean: ("i", "j") or ("i", "j", "k")."""
    named = mean.select(*keys, *[F.col(f).alias(f"_m_{f}") for f in fields])
    out = snap.join(named, list(keys))
    return out.withColumns({f: F.col(f).cast("double") - F.col(f"_m_{f}") for f in fields}).drop(*[f"_m_{f}" for f in fields])


def kinetic_energy(snap: DataFrame, mean: DataFrame, keys: Sequence[str], name: str, fields: Sequence[str] = ("u", "v", "w")) -> DataFrame:
    """Mean over snapshots of u'^2 + v'^2 + w'^2 (without a factor 1/2) about the given mean."""
    f = fluctuations(snap, mean, fields, keys)
    square = sum((F.col(x) * F.col(x) for x in fields[1:]), F.col(fields[0]) * F.col(fields[0]))
    return f.groupBy(*CELL).agg(F.avg(square).alias(name))


def tke(snap: DataFrame) -> DataFrame:
    """tke_t and tke_tz of each cell: about the time mean, and about its mean along z.

    One pass over the snapshots: both follow from the cell's first and second
    moments, taken about a value near the mean so that no digits are lost.
    """
    fields = ("u", "v", "w")
    return tke_of(snap.groupBy(*CELL).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in fields], *[F.var_pop(F.col(f).cast("double")).alias(f"_v_{f}") for f in fields]))


def tke_of(moments: DataFrame) -> DataFrame:
    """The same from each cell's means u, v, w and variances _v_u, _v_v, _v_w."""
    fields = ("u", "v", "w")
    tz = z_mean(moments, fields).select("i", "j", *[F.col(f).alias(f"_z_{f}") for f in fields])
    both = moments.join(tz, ["i", "j"])
    var = F.col("_v_u") + F.col("_v_v") + F.col("_v_w")
    shift = sum(((F.col(f) - F.col(f"_z_{f}")) * (F.col(f) - F.col(f"_z_{f}")) for f in ("v", "w")), (F.col("u") - F.col("_z_u")) * (F.col("u") - F.col("_z_u")))
    return both.select(*CELL, var.alias("tke_t"), (var + shift).alias("tke_tz"))


def fluctuation_stats(snap: DataFrame, mean: DataFrame, fields: Sequence[str] = tuple(FLOW)) -> DataFrame:
    """field, mean and variance of the fluctuations about ``mean`` (i, j)."""
    f = fluctuations(snap, mean, fields)
    long = f.select(F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in fields])).alias("s")).select("s.*")
    return long.groupBy("field").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
