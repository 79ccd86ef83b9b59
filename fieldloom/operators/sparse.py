"""Derivatives on a tetrahedral mesh as a stored sparse operator.

The gradient at a node, the volume-weighted mean of its elements' gradients, is a
weighted sum of the values at the nodes around it. The weights follow from the
mesh alone; once they are stored by the node that gives the value, a gradient of any field and
iteration is one join and one sum, without elements or coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Bucketed
from .mesh import CORNERS, gather, tet_geometry

AXES = "xyz"


def gradient_weights(elems: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """node_id, from_id, wx, wy, wz: the gradient at node_id is the sum over from_id of w times the value there.

    ``elems``: elem_idx, n0 to n3. ``nodes``: ``key``, x, y, z. Weights of elements that share both nodes are added up, in each task first; flat elements raise an error.
    """
    g = tet_geometry(gather(elems, nodes, ["x", "y", "z"], key))
    # the first corner takes what the edges take from it
    first = [-(F.col(f"a{a}1") + F.col(f"a{a}2") + F.col(f"a{a}3")) for a in AXES]
    givers = [F.struct(F.col(n).alias("from_id"), *[(F.col(f"a{a}{c}") if c else first[m]).alias(f"g{a}") for m, a in enumerate(AXES)]) for c, n in enumerate(CORNERS)]
    pairs = g.select("vol", F.explode(F.array(*CORNERS)).alias("node_id"), F.array(*givers).alias("givers")).select("vol", "node_id", F.explode("givers").alias("s"))
    sums = pairs.groupBy("node_id", F.col("s.from_id").alias("from_id")).agg(*[F.sum(F.col("vol") * F.col(f"s.g{a}")).alias(f"w{a}") for a in AXES])
    volume = g.select(F.explode(F.array(*CORNERS)).alias("node_id"), "vol").groupBy("node_id").agg(F.sum("vol").alias("_v"))
    return sums.join(volume, "node_id").select("node_id", "from_id", *[(F.col(f"w{a}") / F.col("_v")).alias(f"w{a}") for a in AXES])


def store(weights: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Keeps weights at ``path``, bucketed by the node that gives the value, in place of earlier ones; see load."""
    kept = Bucketed(weights.sparkSession, path, "from_id", "node_id long, from_id long, wx double, wy double, wz double", buckets)
    kept.replace(weights)
    return kept.table()


def load(spark: SparkSession, path: str) -> DataFrame:
    return Bucketed(spark, path, "from_id").table()


def apply(weights: DataFrame, values: DataFrame, fields: Sequence[str], by: Sequence[str] = ("iter",), key: str = "node_id", axes: str = AXES) -> DataFrame:
    """by, node_id and ``<field>_d<axis>`` of nodal values (by, ``key``, fields), for all iterations at once.

    Values go to the stored weights, which stay where they are; products are summed in each task before they go to their nodes.
    A node without a value counts as zero there: give all of them.
    """
    rows = values.select(*by, F.col(key).alias("from_id"), *[F.col(f).cast("double").alias(f) for f in fields]).hint("merge").join(weights, "from_id")
    sums = [F.sum(F.col(f"w{a}") * F.col(f)).alias(f"{f}_d{a}") for f in fields for a in axes]
    return rows.groupBy(*by, "node_id").agg(*sums)
