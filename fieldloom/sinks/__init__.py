"""Ordered text files and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import result_path, shared_dir
from .arrays import read_npy, write_npy, write_npz

__all__ = ["exists", "read_npy", "staged", "write_mesh", "write_npy", "write_npz", "write_profile", "write_result", "write_structured", "write_summary"]


def _lines(df: DataFrame, columns: Sequence[str], fmt: str, order: Sequence[str], section: int) -> DataFrame:
    """section, keys, value: a line of text for each row, formatted where the rows are."""
    keys = [F.col(o).cast("double").alias(f"_k{n}") for n, o in enumerate(order)]
    names = [f"_k{n}" for n in range(len(order))]
    rows = df.select(*keys, *[F.col(c).alias(f"_c{n}") for n, c in enumerate(columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            out["value"] = [" ".join(fmt % x for x in row) for row in pdf[[f"_c{n}" for n in range(len(columns))]].itertuples(index=False, name=None)]
            yield out

    text = rows.mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", value string")
    return text.select(F.lit(section).alias("section"), F.array(*names).alias("keys"), "value")


def _save(spark: SparkSession, header: str, parts: Sequence[DataFrame], path: str) -> None:
    """One file, as its format asks for: rows are formatted in parallel, and one task sorts (spilling) and writes them."""
    out = spark.createDataFrame([(0, [0.0], header)], "section int, keys array<double>, value string") if header else None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    folder = f"{path}.parts"
    out.repartition(1).sortWithinPartitions("section", "keys").select("value").write.mode("overwrite").text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-"))
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), over)
    fs.delete(root, True)


def write_mesh(spark: SparkSession, path: str, nodes: DataFrame, variables: Sequence[str], elems: DataFrame | None = None, order: str = "node_id", elem_order: str = "elem_idx", one_based: bool = True, zonetype: str = "FETETRAHEDRON") -> None:
    """ASCII zone of nodes and tetrahedra (n0 to n3, from 0; written from 1 unless ``one_based`` is off), or of points. Looks at the data for its sizes."""
    # Fixed values, here and below: the words of a zone's header and the formats of its numbers
    head = " VARIABLES = " + ",".join(f'"{v}"' for v in variables) + "\n"
    n = nodes.count()
    parts = [_lines(nodes, variables, "%.12g", [order], 1)]
    if elems is None:
        head += f' ZONE T="points", I={n}, F=POINT'
    else:
        head += f" ZONE N={n}, E={elems.count()}\n DATAPACKING=POINT, ZONETYPE={zonetype}"
        shifted = elems.select(elem_order, *[(F.col(f"n{c}") + int(one_based)).alias(f"n{c}") for c in range(4)])
        parts.append(_lines(shifted, ["n0", "n1", "n2", "n3"], "%d", [elem_order], 2))
    _save(spark, head, parts, path)


def write_structured(spark: SparkSession, path: str, table: DataFrame, variables: Sequence[str], title: str = "3D data") -> None:
    """ASCII zone of a grid (i, j, k, x, y, z and the variables), i fastest. Looks at the data for its extent."""
    d = table.agg(*[(F.max(c) + 1).alias(c) for c in "ijk"], F.count("*").alias("n")).first()
    if d["n"] != d["i"] * d["j"] * d["k"]:
        raise ValueError("the grid isn't complete")
    names = " ".join(f'"{v}"' for v in ["X", "Y", "Z", *variables])
    head = f'TITLE = "{title}"\nVARIABLES = {names}\nZONE I={d["i"]}, J={d["j"]}, K={d["k"]}, F=POINT'
    _save(spark, head, [_lines(table, ["x", "y", "z", *variables], "%.8e", ["k", "j", "i"], 1)], path)


def write_profile(spark: SparkSession, path: str, profile: DataFrame, z: str = "z", value: str = "value") -> None:
    """Two columns by rising z, without a header."""
    _save(spark, "", [_lines(profile, [z, value], "%.12g", [z], 1)], path)


def write_summary(spark: SparkSession, path: str, row: DataFrame) -> None:
    """A one-row result as a line of text for each value."""
    names = row.columns
    text = row.select(F.posexplode(F.array(*[F.concat(F.lit(f"{n} = "), F.coalesce(F.col(n).cast("string"), F.lit("none"))) for n in names])).alias("_k", "value"))
    _save(spark, "", [text.select(F.lit(1).alias("section"), F.array(F.col("_k").cast("double")).alias("keys"), "value")], path)


def staged(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table at ``path``, or in the shared folder: for a small result of much work that several steps read."""
    path = path or f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_result(df: DataFrame, folder: str, name: str, tag: str = "") -> None:
    """A step's table under its name and, if given, the tag of its run; see sources.read_result."""
    df.write.mode("overwrite").parquet(result_path(folder, name, tag))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an output is there already, to be skipped."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
