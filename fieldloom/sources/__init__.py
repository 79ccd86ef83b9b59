"""Readers of mesh partitions and structured snapshots as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import NODE_COLUMNS, result_path
from . import files, tecplot
from .plot3d import Plot3DSource
from .tecplot import NAME, TecplotSource


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TecplotSource)
    spark.dataSource.register(Plot3DSource)


def index_partitions(spark: SparkSession, path: str, folder: str | None = None, pattern: str = "tecplot_blk*_iter*.dat", part: int = tecplot.PART) -> str:
    """Counts the lines of mesh files, parts of a file in different tasks, and keeps for each file how many stand before each part in ``folder`` (or in lines beside the files), which it returns. A task writes what it found of its files as one file.

    With it as ``index``, read_nodes and read_elements read a file in parts, and elements without the nodes before them. Files that have an index of their size keep it.
    """
    folder = folder or f"{path.rstrip('/')}/lines"
    s, p = files.store(folder)
    s.create_dir(p, recursive=True)
    have = {name: x["size"] for name, x in tecplot.read_index(folder).items()}
    todo = [(f, size) for f, size in files.listed(path, pattern) if have.get(tecplot.name_of(f)) != size]
    if not todo:
        return folder
    found = spark.createDataFrame(pa.table({"path": [f for f, _ in todo], "size": pa.array([n for _, n in todo], pa.int64())}))
    rows = found.withColumn("k", F.explode(F.expr(f"sequence(0, int((greatest(1, size) - 1) div {part}))")))
    near = F.expr(f"k div {max(1, tecplot.PART // part)}")  # parts of a file that stay together
    rows = rows.repartition(min(len(todo) * 4, 4 * spark.sparkContext.defaultParallelism), "path", near)

    def count(batches):
        for pdf in batches:
            yield pdf.assign(n=[tecplot.count_lines(f, *tecplot.window(size, k, part)) for f, size, k in zip(pdf["path"], pdf["size"], pdf["k"], strict=True)])

    def write(batches):
        entries = (tecplot.index_entry(f, size, [x["n"] for x in counts], part) for pdf in batches for f, size, counts in zip(pdf["path"], pdf["size"], pdf["counts"], strict=True))
        if (first := next(entries, None)) is not None:
            yield pd.DataFrame({"n": [tecplot.write_index(folder, chain([first], entries))]})

    counted = rows.mapInPandas(count, "path string, size long, k int, n long")
    counts = counted.groupBy("path", "size").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("counts"))
    counts.mapInPandas(write, "n long").count()
    return folder


def _reader(spark: SparkSession, name: str):
    """A reader whose small files are dealt among as many tasks as keep all cores busy."""
    register(spark)
    return spark.read.format(name).option("tasks", max(files.TASKS, 3 * spark.sparkContext.defaultParallelism))


def read_nodes(spark: SparkSession, path: str, variables: Sequence[str] = tuple(NODE_COLUMNS), iters: Sequence[int] | None = None, pattern: str = "tecplot_blk*_iter*.dat", dtype: str = "float32", index: str | None = None) -> DataFrame:
    """iter, blk, node_idx, X, Y, Z and the variables asked for. Only those columns are parsed, only those iterations opened; a file is a partition, or several with an ``index``; small files share one.

    dtype says in which precision values are taken from the text; they are doubles afterwards.
    """
    r = _reader(spark, "tecplot_fe").option("section", "nodes")
    r = r.option("index", index) if index else r
    r = r.option("columns", ",".join(variables)).option("pattern", pattern).option("dtype", dtype)
    return (r.option("iters", ",".join(map(str, iters))) if iters is not None else r).load(path)


def read_elements(spark: SparkSession, path: str, iters: Sequence[int] | None = None, pattern: str = "tecplot_blk*_iter*.dat", index: str | None = None) -> DataFrame:
    """iter, blk, elem_idx, n0 to n3 (block-local, from 1). Without an ``index`` a file's nodes are passed line by line."""
    r = _reader(spark, "tecplot_fe").option("section", "elems").option("pattern", pattern)
    r = r.option("index", index) if index else r
    return (r.option("iters", ",".join(map(str, iters))) if iters is not None else r).load(path)


def list_partitions(spark: SparkSession, path: str, pattern: str = "tecplot_blk*_iter*.dat") -> DataFrame:
    """iter, blocks: array of (blk, path) by block. Other names are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    name = NAME.pattern
    found = files.where(F.col("path").rlike(name)).select(F.regexp_extract("path", name, 2).cast("long").alias("iter"), F.regexp_extract("path", name, 1).cast("int").alias("blk"), "path")
    return found.groupBy("iter").agg(F.sort_array(F.collect_list(F.struct("blk", "path"))).alias("blocks"))


def fingerprints(spark: SparkSession, path: str, pattern: str = "tecplot_blk*_iter*.dat") -> DataFrame:
    """iter, fingerprint, bytes: a digest of the paths, lengths and times of change of an iteration's files, and their lengths' sum."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime").where(F.col("path").rlike(NAME.pattern))
    one = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    files_of = found.groupBy(F.regexp_extract("path", NAME.pattern, 2).cast("long").alias("iter")).agg(F.sort_array(F.collect_list(one)).alias("files"), F.sum("length").alias("bytes"))
    return files_of.select("iter", F.sha2(F.array_join("files", "\n"), 256).alias("fingerprint"), "bytes")


def read_result(spark: SparkSession, folder: str, name: str, tag: str = "") -> DataFrame:
    """The table that a step wrote under a name and tag."""
    return spark.read.parquet(result_path(folder, name, tag))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """i, j, k, x, y, z of a structured grid."""
    register(spark)
    return spark.read.format("plot3d").option("section", "grid").load(path)


def read_snapshots(spark: SparkSession, path: str, pattern: str = "grid*.f", ordinals: Sequence[int] | None = None, times: Sequence[int] | None = None, places: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """grid_num, time_num, i, j, k and as many of u, v, w, p, e, u_mean, ... as the first file holds; a file is a partition, or several if it is large; small files share one.

    ``times`` picks files by their time number, and ``ordinals`` by their place (from 0) in the order of grid and time number. ``places`` bounds i, j and k, both ends included (None: none): as a record's
    values have fixed places, of a slice or a line no more is read than the rows along i that hold it.
    """
    r = _reader(spark, "plot3d").option("section", "snapshots").option("pattern", pattern)
    r = r.option("places", json.dumps(places)) if places else r
    r = r.option("times", ",".join(map(str, times))) if times is not None else r
    return (r.option("ordinals", ",".join(map(str, ordinals))) if ordinals is not None else r).load(path)


#: Values of an accumulator that make up a row.
CHUNK = 1 << 20


def accumulate(spark: SparkSession, paths: Sequence[str], init: Callable[[Any], dict[str, np.ndarray]], process: Callable[[dict, str, Any], None], extra: Any = None, tasks: int | None = None) -> DataFrame:
    """name, chunk, shape, values: the sums of a caller's accumulators over files.

    A task calls ``init(extra)`` once for a dict of arrays and ``process(arrays, path, extra)`` for each of
    its files, which adds to them in place. Arrays of one name are added up over
    tasks, in chunks of CHUNK values, so no task holds more than its own accumulators; see ``array_of``. No files: no rows.
    """
    n = tasks or spark.sparkContext.defaultParallelism
    files = spark.createDataFrame([(k % n, p) for k, p in enumerate(paths)], "part int, path string").repartitionById(n, "part")

    def run(batches):
        arrays = None
        for pdf in batches:
            for path in pdf["path"]:
                arrays = init(extra) if arrays is None else arrays
                process(arrays, path, extra)
        for name, a in (arrays or {}).items():
            flat = np.asarray(a, float).ravel()
            for k in range(0, max(1, len(flat)), CHUNK):
                yield pd.DataFrame({"name": [name], "chunk": [k // CHUNK], "shape": [list(np.shape(a))], "values": [flat[k : k + CHUNK]]})

    def add(pdf):
        return pd.DataFrame({"name": pdf["name"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "shape": pdf["shape"].iloc[:1], "values": [sum(pdf["values"])]})

    schema = "name string, chunk int, shape array<long>, values array<double>"
    return files.mapInPandas(run, schema).groupBy("name", "chunk").applyInPandas(add, schema)


def array_of(sums: DataFrame, name: str) -> np.ndarray:
    """One of the accumulated arrays, on the driver."""
    rows = sums.where(F.col("name") == name).orderBy("chunk").collect()
    return np.concatenate([r["values"] for r in rows]).reshape(rows[0]["shape"])
