"""Merging mesh partitions: tolerance keys, canonical ids, connectivity, gather and scatter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cell_key


def keyed(nodes: DataFrame, tol: float = 1e-6, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return nodes.withColumns({f"_q{n}": cell_key(c, tol) for n, c in enumerate(coords)})


def mark_kept(nodes: DataFrame, tol: float = 1e-6, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Adds kept: whether a merge in block order keeps the node.

    A node goes if its cell occurs in an earlier block of the same iteration;
    repeats inside the first block that has the cell all stay. The first block of
    a cell is one window minimum, whatever the number of blocks.
    """
    cell = ["iter", *[f"_q{n}" for n in range(len(coords))]]
    return keyed(nodes, tol, coords).withColumn("kept", F.col("blk") == F.min("blk").over(W.partitionBy(*cell))).drop(*cell[1:])


def merge(nodes: DataFrame, tol: float = 1e-6, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The nodes that stay, in one table."""
    return mark_kept(nodes, tol, coords).where("kept").drop("kept")


def canonical_ids(nodes: DataFrame, tol: float = 1e-6, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """iter, blk, node_idx, kept, node_id: the merged table's id (from 0, in block order) that stands for each node.

    A node that goes takes the id of the first node of its cell. Ids are
    numbered in two levels: within a strip of a block, and from the counts of the strips
    before it, so neither an iteration nor a block is in a single task.
    """
    cell = ["iter", *[f"_q{n}" for n in range(len(coords))]]
    w = W.partitionBy(*cell)
    rows = keyed(nodes, tol, coords).select(*cell, "blk", "node_idx")
    rows = rows.withColumn("first", F.min(F.struct("blk", "node_idx")).over(w)).withColumn("kept", F.col("blk") == F.col("first.blk"))
    kept = rows.where("kept").select("iter", "blk", "node_idx")
    # strips of 65,536 node numbers: ranks inside a strip, and what the strips before it hold
    kept = kept.withColumn("_strip", F.shiftright("node_idx", 16))
    counts = kept.groupBy("iter", "blk", "_strip").agg(F.count("*").alias("n"))
    before = counts.select("iter", "blk", "_strip", (F.sum("n").over(W.partitionBy("iter").orderBy("blk", "_strip")) - F.col("n")).alias("_base"))
    numbered = kept.withColumn("_nth", F.row_number().over(W.partitionBy("iter", "blk", "_strip").orderBy("node_idx")) - 1).join(before, ["iter", "blk", "_strip"])
    ids = numbered.select("iter", F.col("blk").alias("_b"), F.col("node_idx").alias("_n"), (F.col("_base") + F.col("_nth")).alias("node_id"))
    own = F.when(F.col("kept"), F.struct("blk", "node_idx")).otherwise(F.col("first"))
    rows = rows.select("iter", "blk", "node_idx", "kept", own.alias("own")).select("iter", "blk", "node_idx", "kept", F.col("own.blk").alias("_b"), F.col("own.node_idx").alias("_n"))
    return rows.join(ids.hint("merge"), ["iter", "_b", "_n"]).select("iter", "blk", "node_idx", "kept", "node_id")  # a row for each node: a table of well-packed files looks small enough to be broadcast


CORNERS = ["n0", "n1", "n2", "n3"]


def corners(elems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, corner (0 to 3), node: a row for each corner of an element."""
    return elems.select(*keys, F.posexplode(F.array(*CORNERS)).alias("corner", "node"))


def remap(elems: DataFrame, ids: DataFrame, base: int = 1) -> DataFrame:
    """Connectivity in merged ids: iter, blk, elem_idx, n0 to n3. ``elems`` holds block-local node numbers counted from ``base``."""
    long = corners(elems, ["iter", "blk", "elem_idx"]).withColumn("node_idx", F.col("node") - base)
    found = long.join(ids.select("iter", "blk", "node_idx", "node_id"), ["iter", "blk", "node_idx"])
    return found.groupBy("iter", "blk", "elem_idx").agg(*[F.max(F.when(F.col("corner") == c, F.col("node_id"))).alias(n) for c, n in enumerate(CORNERS)])


def gather(elems: DataFrame, nodes: DataFrame, values: Sequence[str], key: str = "node_id", keys: Sequence[str] = ("elem_idx",)) -> DataFrame:
    """Element rows with ``<value>0`` to ``<value>3`` of their corners, and n0 to n3: one join in long form, one aggregate."""
    long = corners(elems, keys).join(nodes.select(F.col(key).alias("node"), *values), "node")
    aggs = [F.max(F.when(F.col("corner") == c, F.col(v))).alias(f"{v}{c}") for v in values for c in range(4)]
    return long.groupBy(*keys).agg(*aggs, *[F.max(F.when(F.col("corner") == c, F.col("node"))).alias(n) for c, n in enumerate(CORNERS)])


def _edge(v: str, c: int) -> Column:
    return F.col(f"{v}{c}") - F.col(f"{v}0")


def tet_geometry(gathered: DataFrame) -> DataFrame:
    """Adds det, vol and the gradient's weights a<axis><corner> from corner coordinates; a flat element raises an error.

    The gradient of a linear field is the sum of its edge differences times the
    cross products of the other two edges, over the determinant.
    """
    e = [[_edge(a, c) for a in "xyz"] for c in (1, 2, 3)]

    def cross(p, q):
        return [p[(n + 1) % 3] * q[(n + 2) % 3] - p[(n + 2) % 3] * q[(n + 1) % 3] for n in range(3)]

    normals = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    det = e[0][0] * normals[0][0] + e[0][1] * normals[0][1] + e[0][2] * normals[0][2]
    out = gathered.withColumn("det", det)
    out = out.withColumn("det", F.when(F.col("det") == 0, F.raise_error("an element has no volume").cast("double")).otherwise(F.col("det")))
    out = out.withColumn("vol", F.abs("det") / 6)
    return out.withColumns({f"a{axis}{c + 1}": normals[c][n] / F.col("det") for n, axis in enumerate("xyz") for c in range(3)})


def tet_gradient(elems: DataFrame, nodes: DataFrame, values: Sequence[str], key: str = "node_id", extra: Sequence[str] = ()) -> DataFrame:
    """elem_idx, n0 to n3, vol and ``<value>_d<axis>`` of each element; ``nodes`` has x, y, z and the values. ``extra`` values are gathered too."""
    g = tet_geometry(gather(elems, nodes, ["x", "y", "z", *values, *extra], key))
    grads = {f"{v}_d{axis}": sum((F.col(f"a{axis}{c}") * _edge(v, c) for c in (2, 3)), F.col(f"a{axis}1") * _edge(v, 1)) for v in values for axis in "xyz"}
    return g.withColumns(grads)


def scatter(elements: DataFrame, values: Sequence[str], weight: str = "vol") -> DataFrame:
    """node_id and the weighted mean of each element value over the elements around a node."""
    long = elements.select(F.explode(F.array(*CORNERS)).alias("node_id"), F.col(weight).alias("_w"), *values)
    return long.groupBy("node_id").agg(*[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values])


def dissipation(elems: DataFrame, nodes: DataFrame, velocity: Sequence[str] = ("u", "v", "w"), mu: str = "mu") -> DataFrame:
    """One row: volume, phi_mean, the volume mean of mu (G:G + G:G^T - 2/3 (tr G)^2), G the velocity gradient and mu the corners' mean."""
    g = tet_gradient(elems, nodes, velocity, extra=[mu])
    d = [[F.col(f"{v}_d{a}") for a in "xyz"] for v in velocity]
    full = sum((d[n][m] * d[n][m] + d[n][m] * d[m][n] for n in range(3) for m in range(3)), F.lit(0.0))
    trace = d[0][0] + d[1][1] + d[2][2]
    viscosity = (F.col(f"{mu}0") + F.col(f"{mu}1") + F.col(f"{mu}2") + F.col(f"{mu}3")) / 4
    phi = viscosity * (full - trace * trace * F.lit(2.0 / 3.0))
    return g.agg(F.sum("vol").alias("volume"), (F.sum(F.col("vol") * phi) / F.sum("vol")).alias("phi_mean"))


def grid_difference(one: DataFrame, other: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row: rows, only_one, only_other, max_diff (NaN if a coordinate is)."""
    b = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in coords], F.lit(1).alias("_there"))
    both = one.select(*keys, *coords, F.lit(1).alias("_here")).join(b, list(keys), "full")
    diff = F.greatest(*[F.abs(F.col(c).cast("double") - F.col(f"_{c}").cast("double")) for c in coords])
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("_there").isNull()).alias("only_one"), F.count_if(F.col("_here").isNull()).alias("only_other"), F.max(diff).alias("max_diff"))


def check_grid(one: DataFrame, other: DataFrame, keys: Sequence[str], tol: float = 1e-5, coords: Sequence[str] = ("x", "y", "z")) -> None:
    """Looks at the data: raises ValueError unless both grids have the same keys and coordinates within tol."""
    r = grid_difference(one, other, keys, coords).first()
    if r["only_one"] or r["only_other"] or (r["max_diff"] is not None and not r["max_diff"] <= tol):
        raise ValueError(f"the grids differ: {r.asDict()}")


def grid_extents(nodes: DataFrame, keys: Sequence[str], by: str = "iter", coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """keys, n (iterations that have the node), first (the least), and for each coordinate a struct (first, low, high), NaN counting as highest: one aggregate over all iterations."""
    value = lambda c: F.col(c).cast("double")
    places = [F.struct(F.min_by(value(c), by).alias("first"), F.min(value(c)).alias("low"), F.max(value(c)).alias("high")).alias(c) for c in coords]
    return nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(by).alias("first"), *places)


def merged_extents(parts: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Extents of further iterations together with stored ones."""
    places = [F.struct(F.min_by(f"{c}.first", "first").alias("first"), F.min(f"{c}.low").alias("low"), F.max(f"{c}.high").alias("high")).alias(c) for c in coords]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), *places)


def series_difference(extents: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row: nodes, iterations (the most that have a node), partial (nodes that some lack) and max_diff, the largest distance of a coordinate from the first iteration's (NaN if one is)."""
    far = F.greatest(*[F.greatest(F.col(f"{c}.high") - F.col(f"{c}.first"), F.col(f"{c}.first") - F.col(f"{c}.low")) for c in coords])
    most = extents.agg(F.max("n").alias("_most"))
    return extents.crossJoin(F.broadcast(most)).agg(F.count("*").alias("nodes"), F.max("_most").alias("iterations"), F.count_if(F.col("n") < F.col("_most")).alias("partial"), F.max(far).alias("max_diff"))


def check_series(extents: DataFrame, iterations: int, tol: float = 1e-5, coords: Sequence[str] = ("x", "y", "z")) -> None:
    """Looks at the data, in one job: raises ValueError unless all ``iterations`` have the same nodes, with coordinates within tol of the first one's."""
    r = series_difference(extents, coords).first()
    if r["nodes"] and (r["iterations"] != iterations or r["partial"] or not (r["max_diff"] is None or r["max_diff"] <= tol)):
        raise ValueError(f"the grids differ: {r.asDict()}")


def extent_difference(one: DataFrame, other: DataFrame, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """One row: n_<axis> of each grid (other's as m_<axis>), and same: whether all agree."""
    size = lambda df, name: df.agg(*[(F.max(a) + 1).alias(f"{name}_{a}") for a in axes])
    both = size(one, "n").crossJoin(F.broadcast(size(other, "m")))
    same = F.lit(True)
    for a in axes:
        same = same & F.col(f"n_{a}").eqNullSafe(F.col(f"m_{a}"))
    return both.withColumn("same", same)


def check_extent(one: DataFrame, other: DataFrame, axes: Sequence[str] = ("i", "j", "k")) -> None:
    """Looks at the data: raises ValueError unless a snapshot has the extent of its grid."""
    r = extent_difference(one, other, axes).first()
    if not r["same"]:
        raise ValueError(f"the snapshot doesn't fit its grid: {r.asDict()}")
