"""Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks import staged


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell_key(coord: Column | str, tol: float) -> Column:
    """Tolerance key of a coordinate: its grid cell, rounded half to even in double precision. Two points nearer than tol may fall in two cells."""
    return F.rint(col(coord).cast("double") * F.lit(1.0 / tol)).cast("long")


def checked(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``df`` as a staged table, and whether it has at most ``most`` rows. Looks at the data: it is made once, counted and read as a table."""
    table = staged(df.sparkSession, df)
    return table, table.count() <= most


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a staged table, to be broadcast if it has at most ``most`` rows; see checked."""
    table, small = checked(df, most)
    return F.broadcast(table) if small else table


#: Rows of a block of neighbours.
BLOCK = 65_536


def placed(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a staged table with _place: each row's rank from 0 by ``by`` and ``order``. Looks at the data.

    Rows are range-partitioned and sorted; a rank is a row's place in its partition and what the partitions before hold, so no task sorts all.
    """
    keys = [*by, order]
    table = staged(df.sparkSession, df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    held = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = held.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row for each partition
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return table.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("_place", F.col("_first") + inside).drop("_part", "_first", "_at")


def with_neighbours(df: DataFrame, order: str, reach: int = 2, size: int | None = None) -> DataFrame:
    """``df`` in blocks of neighbours by ``order`` (_block), each with the ``reach`` rows before and after it; _own marks a row's own block. Looks at the data.

    A window over a block sees what one over all rows would, within ``reach``; drop the rows that aren't _own after it.
    """
    size = size or BLOCK
    table, one = checked(df, size)
    if one:  # one block holds all, as of most runs' levels: there is nothing to deal
        return table.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    rows = placed(table, order)
    own = F.expr(f"_place div {size}")
    at = F.pmod(F.col("_place"), F.lit(size))
    to = F.array(own, F.when(at < reach, own - 1), F.when(at >= size - reach, own + 1))
    rows = rows.withColumn("_block", F.explode(F.filter(to, lambda b: b >= 0)))
    return rows.withColumn("_own", F.col("_block") == own).drop("_place")


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct whole numbers ``key`` with their rank from 0 as ``name``.

    In three levels of 1024 neighbours, so that no task sorts all: a rank
    is the rank inside the smallest block, and what stands before it.
    """
    rows = keys.withColumn("_b", F.shiftright(key, 10)).withColumn("_c", F.shiftright(key, 20))
    small = rows.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = small.groupBy("_c").agg(F.sum("_n").alias("_n")).select("_c", before(W.orderBy("_c")).alias("_first"))  # a row for each 2^20 neighbours
    small = small.withColumn("_inside", before(W.partitionBy("_c").orderBy("_b"))).join(large, "_c").select("_b", (F.col("_first") + F.col("_inside")).alias("_first"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    return rows.withColumn(name, rank).join(small, "_b").withColumn(name, F.col(name) + F.col("_first")).drop("_b", "_c", "_first")


def level_key(z: Column | str, tol: float) -> Column:
    return F.rint(col(z).cast("double") / F.lit(tol)).cast("long")


def wavenumber(m: Column | str, nz: int, dz: float) -> Column:
    return F.lit(2.0) * F.pi() * col(m) / F.lit(float(nz * dz))


def circular_lag(k: Column, k0: Column, nz: int) -> Column:
    return F.pmod(k - k0, F.lit(nz))
