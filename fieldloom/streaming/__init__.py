"""Incremental work: only what isn't done yet, in batches that resume and in streams."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments
from ..session import shared_dir
from .spans import Spans


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted keys that aren't done."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def pending_prints(prints: DataFrame, made: DataFrame) -> DataFrame:
    """Of inputs (iter, fingerprint), those that nothing was made of yet, or not of them as they are now."""
    return prints.join(made, ["iter", "fingerprint"], "left_anti")


class Checkpoint:
    """Results of iterations under ``path``, a folder for each or, of run_together, for those made in one job, and what they were made with.

    ``meta`` must match what the folder holds, but for the names in ``warn_only``; a mismatch raises
    ValueError unless ``wipe``, which starts afresh: it removes the folder's iterations, what they were made of, and meta.json, and nothing else. A folder that holds other
    files but no meta.json isn't a checkpoint and raises too.
    """

    def __init__(self, spark: SparkSession, path: str, meta: dict, warn_only: Sequence[str] = ("coord_tol",), wipe: bool = False):
        self.spark, self.path, self.meta = spark, path, meta
        text = self._fs_read(f"{path}/meta.json")
        if text is not None and not wipe:
            import warnings

            old = json.loads(text)
            bad = {k for k in {*old, *meta} if old.get(k) != meta.get(k)}
            if hard := bad - set(warn_only):
                raise ValueError(f"the checkpoint was made with other settings: {sorted(hard)}")
            if bad:
                warnings.warn(f"the checkpoint was made with another {sorted(bad)}", stacklevel=2)
        else:
            there = self._names()
            if text is None and there and not wipe:
                raise ValueError(f"{path} isn't empty and isn't a checkpoint")
            for name in there:
                if name in ("meta.json", "inputs") or name.startswith(("iter=", "go=", "new-")):
                    self._path("").getFileSystem(self._conf()).delete(self._path(name), True)
            self._fs_write(f"{path}/meta.json", json.dumps(meta))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        fs, root = self._path("").getFileSystem(self._conf()), self._path("")
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _fs_read(self, name: str) -> str | None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if not p.getFileSystem(self._conf()).exists(p):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(name).collect())

    def _fs_write(self, name: str, text: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        out = p.getFileSystem(self._conf()).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def done(self) -> list[int]:
        """Iterations that are whole: Spark names a folder's success last, and what was made together is told after that."""
        return sorted({*self._alone(), *(r["iter"] for r in self._latest().where("go IS NOT NULL").select("iter").collect())})  # a number for each iteration

    def _alone(self) -> list[int]:
        fs = self._path("").getFileSystem(self._conf())
        return [int(n[5:]) for n in self._names() if n.startswith("iter=") and fs.exists(self._path(f"{n}/_SUCCESS"))]

    def current(self, prints: DataFrame) -> list[int]:
        """Iterations that are whole and were made of the inputs that ``prints`` (iter, fingerprint) tells; see sources.fingerprints."""
        latest = self._latest()
        alone = self.spark.createDataFrame([(it,) for it in self._alone()], "iter long")
        made = latest.where("go IS NOT NULL").select("iter").union(alone).distinct()
        stale = pending_prints(prints.select("iter", "fingerprint"), latest.select("iter", "fingerprint"))
        return sorted(r["iter"] for r in made.join(stale, "iter", "left_anti").collect())  # a number for each iteration

    def _latest(self) -> DataFrame:
        """iter, fingerprint, go: what each iteration was made of, the last time, and in which job if in one with others."""
        if "inputs" not in self._names():
            return self.spark.createDataFrame([], "iter long, fingerprint string, go string")
        rows = self.spark.read.schema("iter long, fingerprint string, nth long, go string").parquet(f"{self.path}/inputs")
        return rows.groupBy("iter").agg(F.max_by(F.struct("fingerprint", "go"), "nth").alias("_m")).select("iter", "_m.*")

    def _todo(self, iters: Sequence[int], prints: DataFrame | None) -> tuple[list[int], dict]:
        have = set(self.done() if prints is None else self.current(prints))
        now = {} if prints is None else {r["iter"]: r for r in prints.collect()}  # a row for each iteration
        return [it for it in iters if it not in have], now

    def _made(self, iters: Sequence[int], now: dict, go: str | None = None) -> None:
        rows = [(it, now[it]["fingerprint"] if it in now else None, time.time_ns(), go) for it in iters]
        self.spark.createDataFrame(rows, "iter long, fingerprint string, nth long, go string").coalesce(1).write.mode("append").parquet(f"{self.path}/inputs")

    def run(self, iters: Sequence[int], work: Callable[[int], DataFrame], on_error: str = "raise", prints: DataFrame | None = None) -> dict[int, str]:
        """Makes the iterations that aren't done. A failure raises, or with on_error="collect" is returned under its iteration.

        With ``prints`` (iter, fingerprint of the inputs) those are made again too whose inputs have changed since, or aren't told. A fingerprint is kept after
        its iteration is whole, so a run that is cut off makes it again.
        """
        failed = {}
        todo, now = self._todo(iters, prints)
        for it in todo:
            try:
                work(it).write.mode("overwrite").parquet(f"{self.path}/iter={it}")
                if prints is not None:
                    self._made([it], now)
            except Exception as e:
                if on_error == "raise":
                    raise
                failed[it] = str(e)
        return failed

    def run_together(self, iters: Sequence[int], work: Callable[[list[int]], DataFrame], together: int = 16, prints: DataFrame | None = None) -> None:
        """As run, but many iterations in one job, whose rows (with iter) ``work`` gives: ``together`` of them or, where ``prints`` tells the bytes of their inputs, as many more as hold TOGETHER bytes.

        A job's rows are one table, whatever the number of its iterations, which count once the job has ended and each was found to have rows.
        """
        todo, now = self._todo(iters, prints)
        for some in _batches(todo, [now[it].asDict().get("bytes") if it in now else None for it in todo], together):
            go = f"g{uuid.uuid4().hex}"
            work(some).sortWithinPartitions("iter").write.parquet(f"{self.path}/go={go}")
            there = {r["iter"] for r in self._read([f"go={go}"]).select("iter").distinct().collect()}  # a number for each iteration
            if missing := set(some) - there:
                raise ValueError(f"iteration {min(missing)} has no rows")
            self._made(some, now, go)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, iters: Sequence[int], rows: int | None = None) -> DataFrame:
        """Exactly the listed iterations; with ``rows``, looks at the data and raises unless each has as many."""
        wanted = list(dict.fromkeys(iters))
        go = {r["iter"]: r["go"] for r in self._latest().where("go IS NOT NULL").collect()}  # a row for each iteration
        held, alone = [(it, go[it]) for it in wanted if it in go], [it for it in wanted if it not in go]
        out = self._read([f"iter={it}" for it in alone]) if alone or not held else None
        if held:
            mine = self.spark.createDataFrame(held, "iter long, go string")
            together = self._read([f"go={g}" for g in sorted({g for _, g in held})]).join(F.broadcast(mine), ["iter", "go"], "left_semi").drop("go")
            out = together if out is None else together.unionByName(out)
        if rows is not None:
            bad = out.groupBy("iter").count().where(F.col("count") != rows).collect()
            if bad:
                raise ValueError(f"iterations of another size: {[r['iter'] for r in bad]}")
        return out


#: Bytes of inputs that a job of run_together takes.
TOGETHER = 4 << 30


def _batches(items: list[int], sizes: list[int | None], least: int) -> Iterator[list[int]]:
    some, held = [], 0
    for it, size in zip(items, sizes, strict=True):
        size = TOGETHER if size is None else size
        if len(some) >= least and held + size > TOGETHER:
            yield some
            some, held = [], 0
        some.append(it)
        held += size
    if some:
        yield some


def _stream(spark: SparkSession, path: str, adapt: Callable[[DataFrame], DataFrame], own: str, spans: Spans, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], files: int | None) -> None:
    """Takes the files under ``path`` that are new, ``files`` a trigger (all at once if None), and puts each trigger's part in a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rstrip("/").rpartition("/")
    one = file.endswith(".parquet")
    source = spark.readStream.schema(schema).option("pathGlobFilter", file if one else "*.parquet")
    if files:
        source = source.option("maxFilesPerTrigger", files)

    def put(batch: DataFrame, number: int) -> None:
        spans.put(part(batch), number)
        spans.fold(merge)

    q = adapt(source.parquet(folder if one else path)).writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", own).start()
    q.awaitTermination()


def stream_means(spark: SparkSession, path: str, adapt: Callable[[DataFrame], DataFrame], keys: Sequence[str], fields: Sequence[str], checkpoint: str | None = None, table: str | None = None, files: int | None = None, most: int = 16) -> DataFrame:
    """Means by key over files as a stream, of all that is there now: keys, fields, n.

    Each trigger takes the files that are new and writes their sums and counts for
    each key to a folder of its own under ``table``, over an earlier try's; more than ``most`` folders are added up into one. The means
    are the folders' sums. So nothing is gathered on the driver or held as state. With the same
    ``checkpoint`` and ``table`` a later call goes on. Without them, folders under spark.checkpoint.dir are used. Files without rows give none.
    """
    own = checkpoint or f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    spans = Spans(spark, table or f"{own}-sums", most)
    sums = [F.sum(F.col(f).cast("double")).alias(f"{f}_sum") for f in fields] + [F.count(f).alias(f"{f}_n") for f in fields]
    part = lambda df: df.groupBy(*keys).agg(*sums, F.count("*").alias("n"))
    merge = lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for f in fields for c in (f"{f}_sum", f"{f}_n")], F.sum("n").alias("n"))
    _stream(spark, path, adapt, own, spans, part, merge, files)
    parts = spans.read()
    parts = part(adapt(spark.read.parquet(path)).limit(0)) if parts is None else parts
    return parts.groupBy(*keys).agg(*[(F.sum(f"{f}_sum") / F.sum(f"{f}_n")).alias(f) for f in fields], F.sum("n").alias("n"))


def moments_of(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, and for each field a struct (n, mean, m2): count, mean and sum of squared distances from it, nulls left out."""
    value = lambda f: F.col(f).cast("double")
    aggs = [F.struct(F.count(f).alias("n"), F.coalesce(F.avg(value(f)), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value(f)) * F.count(f), F.lit(0.0)).alias("m2")).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*aggs)


def merged_moments(parts: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The moments of a key's parts together, whatever their order and cut: squares are taken of distances between means, so no digits are lost.

    A key has as many parts as there are folders, which folding bounds.
    """

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        gap = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return parts.groupBy(*keys).agg(*[F.aggregate(F.collect_list(f), none, add).alias(f) for f in fields])


def stream_moments(spark: SparkSession, path: str, adapt: Callable[[DataFrame], DataFrame], keys: Sequence[str], fields: Sequence[str], checkpoint: str | None = None, table: str | None = None, files: int | None = None, most: int = 16) -> DataFrame:
    """Counts, means and second moments by key over files as a stream, as stream_means: keys, and for each field a struct (n, mean, m2); see moments_of."""
    own = checkpoint or f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    spans = Spans(spark, table or f"{own}-moments", most)
    part, merge = (lambda df: moments_of(df, keys, fields)), (lambda df: merged_moments(df, keys, fields))
    _stream(spark, path, adapt, own, spans, part, merge, files)
    parts = spans.read()
    return part(adapt(spark.read.parquet(path)).limit(0)) if parts is None else merge(parts)


def stream_tke(spark: SparkSession, path: str, adapt: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """i, j, k, tke_t, tke_tz of streamed snapshots (i, j, k, u, v, w): what moments.tke gives of the same rows."""
    fields = ("u", "v", "w")
    cells = stream_moments(spark, path, adapt, moments.CELL, fields, **how)
    flat = cells.select(*moments.CELL, *[F.col(f"{f}.mean").alias(f) for f in fields], *[(F.col(f"{f}.m2") / F.col(f"{f}.n")).alias(f"_v_{f}") for f in fields])
    return moments.tke_of(flat)
