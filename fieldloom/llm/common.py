"""Shared helpers: staging in the cluster's shared folder, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = "4m"


class Cache(dict):
    """Results of a function by word, for as long as a task runs. Long words are worked out each time, and a full table is emptied, so it holds some tens of megabytes at most."""

    def __init__(self, function: Callable, most: int = 150_000, longest: int = 32):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, word: str):
        value = self.function(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def give_back() -> None:
    """Hands what a finished task's worker has freed to the system, as workers wait for further tasks beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as rows may hold long texts; a smaller bound stays."""
    name, jvm = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(str(spark.conf.get(name))) > jvm.byteStringAsBytes(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


class Stage:
    """Tables written once under the shared folder and read back.

    A staged table cuts lineage: a lost executor costs only the tasks of the
    running stage, and a table used twice is computed once. ``drop`` removes a
    table that no later step and no result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c):
    """Lower-cases A-Z only. Texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def each(df: DataFrame, count: str, copy: str, chunk: int = 65_536) -> DataFrame:
    """A row for each of the ``count`` (1 at least) copies of a row, numbered from 0 in ``copy``. Many copies are spread over tasks."""
    spread = df.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {chunk})")))
    spread = spread.repartition(*[F.col(c) for c in df.columns], F.col("_chunk"))
    return spread.withColumn(copy, F.explode(F.expr(f"sequence(_chunk * {chunk}, least((_chunk + 1) * {chunk}, {count}) - 1)"))).drop("_chunk")


def row_key(digest, doc_id):
    """Binary: a text's digest and the id after it, which a null id lacks."""
    return F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def rows_of(docs: DataFrame, digest, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and columns of any names) whose row_key ``keys`` (_key) has; of rows that repeat an id and a text, one: that of the least hash.

    Texts move once: rows are joined and picked in one exchange.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    kept = docs.select(row_key(digest, F.col("doc_id")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("_hash"))
    kept = kept.hint("merge").join(keys.select("_key"), "_key", "left_semi")
    return kept.groupBy("_key").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long, a != b) as (id, comp), comp the smallest id.

    Alternates large-star and small-star (Kiveris et al., 2014), each round a
    grouped aggregate and staged, until the edges stop changing. A node's
    neighbours are never gathered: each round only takes their minimum and
    joins it back, and the rounds grow with the logarithm of the component's
    size.
    """
    cur = stage.put(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = cur.union(cur.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        large = stage.put(large, "large")
        # small star: u and its smaller neighbours move to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").selectExpr("v AS u", "m AS v").union(low2.selectExpr("u", "m AS v"))
        new = stage.put(small.where("u <> v").distinct(), "edges")
        key = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        stage.drop(cur, large)
        cur = new
        if key == before:
            out = stage.put(cur.selectExpr("u AS id", "v AS comp").union(cur.selectExpr("v AS id", "v AS comp")).distinct(), "classes")
            stage.drop(cur)
            return out
        before = key
