"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is a row of random hashes, the sides of random planes
it lies on, one after the other. Vectors are sorted by key, so those with long
common prefixes stand together, and each is compared with the neighbours in a window before it. Pairs
whose exact cosine is high enough are united over all passes; then the links inside each class are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, components, give_back, read, small_batches

COSINE, PASSES, WINDOW, HASHES = 0.95, 16, 64, 64
#: Passes that are sorted in one go.
AT_ONCE = 2
#: Vectors compared together in a pass, members of a class in a block, and what an angle may be off by rounding.
CHUNK, BLOCK, ROUNDING = 256, 1024, 1e-6


def unit(column: pa.Array) -> np.ndarray:
    """Arrays of one length as vectors of length one, in double precision; first by the largest component, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, column: str = "vec") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of neighbouring rows whose vectors have one length."""
    n = np.diff(batch.column(column).offsets.to_numpy()) if batch.num_rows else np.zeros(0)
    edges = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def keys(x: np.ndarray, nth: int, seed: int) -> np.ndarray:
    """The sides of the pass's HASHES random planes as one number each, first plane first."""
    planes = np.random.default_rng([seed, nth, x.shape[1]]).standard_normal((x.shape[1], HASHES))
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)


def united(linked: np.ndarray) -> np.ndarray:
    """The least place that each place of a symmetric matrix of links is joined to."""
    label = np.arange(len(linked))
    some = np.flatnonzero(linked.any(1))
    while len(some):
        low = np.minimum(label[some], np.where(linked[some], label, len(label)).min(1))
        new = label.copy()
        new[some] = low
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Carry:
    """Rows in sorted order, of which each is compared with the ``window`` before it; gives pairs that join up what is near."""

    def __init__(self, cosine: float, window: int):
        self.cosine, self.window, self.x, self.node = cosine, window, np.zeros((0, 0)), np.zeros(0, np.int64)

    def add(self, x: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x), CHUNK):
            more, names = x[at : at + CHUNK], node[at : at + CHUNK]
            if self.x.shape[1] == more.shape[1]:
                more, names = np.concatenate([self.x, more]), np.concatenate([self.node, names])
            place = np.arange(len(more))
            linked = (more @ more.T >= self.cosine) & (np.abs(place[:, None] - place) <= self.window)
            np.fill_diagonal(linked, False)
            label = united(linked)
            joined = np.flatnonzero(label != place)
            yield names[joined], names[label[joined]]
            self.x, self.node = more[-self.window :], names[-self.window :]


def segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of neighbouring rows of one pass (nth) and length (d)."""
    key = np.stack([batch.column(c).to_numpy() for c in ("nth", "d")])
    edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sorted_passes(nodes: DataFrame, nths: Sequence[int], cosine: float, window: int, seed: int) -> DataFrame:
    """a, b: links of some passes, sorted in one go. And, with b null, the first and last ``window`` rows of each partition, with their place and the partition's number."""

    def key(batches):
        for batch in batches:
            for part in by_length(batch):
                x, d = unit(part.column("vec")), part.column("vec").value_lengths()[0].as_py()
                for nth in nths:
                    k = keys(x, nth, seed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), nth, np.int32)), pa.array(np.full(len(k), d, np.int32)), pa.array(k), *part.columns], names=["nth", "d", "key", *part.schema.names])

    kind, order = nodes.schema["vec"].dataType.simpleString(), ["nth", "d", "key", "node"]
    keyed = nodes.select("node", "vec").mapInArrow(key, f"nth int, d int, key long, node long, vec {kind}")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("nth", "d", "node", "vec", F.spark_partition_id().alias("part"))

    def compare(batches):
        carry, last, at, tail = None, None, 0, None

        def row(a, b, rest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([a, b, *rest], names=["a", "b", "nth", "d", "part", "at", "vec"])

        def ends(rows: pa.Table) -> pa.RecordBatch:
            of = {c: rows[c].combine_chunks() for c in rows.column_names}
            return row(of["node"], pa.nulls(len(rows), pa.int64()), [of[c] for c in ("nth", "d", "part", "at", "vec")])

        for batch in batches:
            for part in segments(batch) if batch.num_rows else ():
                segment, node = (part.column("nth")[0].as_py(), part.column("d")[0].as_py()), part.column("node").to_numpy()
                if segment != last:
                    carry, last = Carry(cosine, window), segment
                nulls = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), part.schema.field("vec").type]
                for a, b in carry.add(unit(part.column("vec")), node):
                    if len(a):
                        yield row(pa.array(a), pa.array(b), [pa.nulls(len(a), t) for t in nulls])
                rows = pa.Table.from_batches([part.append_column("at", pa.array(np.arange(at, at + len(node))))])
                if at < window:
                    yield ends(rows.slice(0, window - at))
                at += len(node)
                tail = rows if tail is None else pa.concat_tables([tail, rows])
                tail = tail.slice(max(0, len(tail) - window)).combine_chunks()
        if tail is not None:
            first = max(0, window - (at - len(tail)))  # those are out already
            if first < len(tail):
                yield ends(tail.slice(first))
        give_back()

    return ordered.mapInArrow(compare, f"a long, b long, nth int, d int, part int, at long, vec {kind}").withColumn("go", F.lit(min(nths)))


def over_borders(ends: DataFrame, cosine: float, window: int) -> DataFrame:
    """a, b: what joins up rows of different partitions that are near and stand at most ``window`` apart. ``ends``: the first and last rows of all partitions of a go."""
    held = ends.groupBy("go", "part").agg((F.max("at") + 1).alias("n"))  # a row for each partition
    first = held.withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy("go").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("go", "part", "first")
    placed = ends.join(F.broadcast(first), ["go", "part"]).withColumn("place", F.col("first") + F.col("at"))
    wide = 4 * window  # a block gets the rows that stand in it and ``window`` more after it
    blocks = F.array_distinct(F.array(F.expr(f"place div {wide}"), F.greatest(F.expr(f"(place - {window}) div {wide}"), F.lit(0))))
    rows = placed.withColumn("block", F.explode(blocks)).select("go", "block", "place", "part", "nth", "d", F.col("a").alias("node"), "vec")

    def compare(_, t):
        t = t.sort_by("place").combine_chunks()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in segments(t.to_batches()[0]):
            place, part, node = (rows.column(c).to_numpy() for c in ("place", "part", "node"))
            x = unit(rows.column("vec"))
            linked = (x @ x.T >= cosine) & (np.abs(place[:, None] - place) <= window) & (part[:, None] != part)
            label = united(linked)
            joined = np.flatnonzero(label != np.arange(len(label)))
            a.append(node[joined])
            b.append(node[label[joined]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("go", "block").applyInArrow(compare, "a long, b long").distinct()


def classes(stage: Stage, nodes: DataFrame, cosine: float, passes: int, window: int, seed: int) -> DataFrame:
    """node, comp of what passes join, comp the least node; nodes that nothing is joined to are left out. A few passes go at a time, so that what a sort holds on disk stays in proportion to the vectors."""
    found = [stage.put(sorted_passes(nodes, range(k, min(passes, k + AT_ONCE)), cosine, window, seed), f"pass{k}") for k in range(0, passes, AT_ONCE)]
    both = found[0]
    for f in found[1:]:
        both = both.union(f)
    border = over_borders(both.where("b IS NULL").drop("b"), cosine, window)
    links = stage.put(both.where("b IS NOT NULL").select("a", "b").union(border).distinct(), "links")
    stage.drop(*found)
    return components(stage, links).select(F.col("id").alias("node"), "comp")


def count_links(stage: Stage, members: DataFrame, cosine: float) -> DataFrame:
    """node, links: how many vectors of the other members (node, comp, n, vec) of its class are near each, n of each.

    Angles obey the triangle inequality: two members within half the allowed angle of the class's mean
    direction are near each other, and count without a look. The others are compared with
    all members of their class, block by block in matrix products; only counts leave a block.
    """
    half = math.acos(cosine) / 2 - ROUNDING

    def sums(batches):
        for batch in batches:
            for part in by_length(batch):
                comp, at = np.unique(part.column("comp").to_numpy(), return_inverse=True)
                total = np.zeros((len(comp), part.column("vec").value_lengths()[0].as_py()))
                np.add.at(total, at, unit(part.column("vec")))
                yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(list(total), pa.list_(pa.float64()))], names=["comp", "total"])

    parts = members.select("comp", "vec").mapInArrow(sums, "comp long, total array<double>").select("comp", F.posexplode("total").alias("p", "x"))
    mean = parts.groupBy("comp", "p").agg(F.sum("x").alias("x")).groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))
    mean = stage.put(mean, "means")  # the join below then has plain exchanges on both sides, and a large class can be split

    def angles(batches):
        for batch in batches:
            for part in by_length(batch):
                mean = np.stack(part.column("mean").to_numpy(zero_copy_only=False))
                length = np.linalg.norm(mean, axis=1, keepdims=True)
                angle = np.arccos(np.clip((unit(part.column("vec")) * mean / np.where(length > 0, length, 1)).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("node", "comp", "n", "vec")] + [pa.array((angle > half) | (length[:, 0] == 0))], names=["node", "comp", "n", "vec", "wide"])

    kind = members.schema["vec"].dataType.simpleString()
    placed = stage.put(members.hint("merge").join(mean, "comp").select("node", "comp", "n", "vec", "mean").mapInArrow(angles, f"node long, comp long, n long, vec {kind}, wide boolean"), "placed")
    size = placed.groupBy("comp").agg(F.count("*").alias("members"), F.count_if("wide").alias("wides"), F.sum(F.when(~F.col("wide"), F.col("n"))).alias("inner"))
    size = stage.put(size, "sizes")
    sure = placed.where("NOT wide").hint("merge").join(size, "comp").select("node", (F.col("inner") - F.col("n")).alias("links"))

    mixed = placed.hint("merge").join(size.where("wides > 0"), "comp").withColumn("os", F.expr(f"(wides + {BLOCK - 1}) div {BLOCK}")).withColumn("ms", F.expr(f"(members + {BLOCK - 1}) div {BLOCK}"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("long")
    asks = mixed.where("wide").select("comp", own("os").alias("o"), F.explode(F.expr("sequence(0L, ms - 1)")).alias("m"), F.lit(True).alias("asks"), "node", "n", "wide", "vec")
    rows = mixed.select("comp", F.explode(F.expr("sequence(0L, os - 1)")).alias("o"), own("ms").alias("m"), F.lit(False).alias("asks"), "node", "n", "wide", "vec")

    def count(batches):
        """Groups (comp, o, m) stand together, those that ask first."""
        group, who = None, None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("comp", "o", "m")] + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)], 1) if batch.num_rows else np.zeros((0, 4), np.int64)
            edges = [0, *(np.flatnonzero((np.diff(ids, axis=0) != 0).any(1)) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                part, this = batch.slice(a, b - a), tuple(ids[a, :3])
                node, n, wide, x = part.column("node").to_numpy(), part.column("n").to_numpy(), part.column("wide").to_numpy(zero_copy_only=False), unit(part.column("vec"))
                if ids[a, 3]:
                    more = who if group == this else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, x.shape[1])))
                    group, who = this, (np.append(more[0], node), np.append(more[1], n), np.concatenate([more[2], x]))
                elif group == this:
                    near = (who[2] @ x.T >= cosine) & (who[0][:, None] != node)
                    out = [(who[0], near @ n), (node[~wide], who[1] @ near[:, ~wide])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["node", "links"])
        give_back()

    dealt = asks.union(rows).repartition("comp", "o", "m").sortWithinPartitions("comp", "o", "m", F.desc("asks"))
    counted = dealt.mapInArrow(count, "node long, links long")
    return sure.union(counted).groupBy("node").agg(F.sum("links").alias("links"))


def usable(vec) -> object:
    """Whether a vector isn't null, empty or zero and holds finite components only."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine, in double precision, is at least ``cosine`` (above 0); classes are the connected components of the links that the passes find. n_links
    counts the other rows of the class that a row is linked with; component_id is the smallest id of the class, and kept says that a row has it.
    Vectors that are null, empty, zero or hold null or non-finite components, and those of different lengths, link with nothing: such a row is its own class.
    Equal vectors are one node, however many rows have them, and link with each other, whatever their ids. Rows may repeat an id: each counts.
    A class without any id has a null component_id, and a null id is never kept. Ties in a pass's order go by node. Other columns are ignored. No rows give none.

    Only vectors that passes found joined are compared further, and those inside half the allowed angle of their class's mean need no comparison. A class whose members lie wider apart costs
    the number of its wide members times all its members, in blocks of BLOCK; no pairs are written.
    """
    small_batches(spark)
    stage = Stage(spark, "vectors")
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    # adding 0.0 makes -0.0 equal to it
    fine = rows.where(usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind[6:-1])))
    nodes = stage.put(fine.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    joined = classes(stage, nodes, cosine, passes, window, seed)
    members = stage.put(nodes.hint("merge").join(joined, "node").select("node", "comp", "n", "least", "vec"), "members")
    links = count_links(stage, members, cosine)
    least = stage.put(members.groupBy("comp").agg(F.min("least").alias("component_id")), "least")  # as a table, so that the join below can split a large class
    named = members.select("node", "comp").hint("merge").join(least, "comp").hint("merge").join(links, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    of_node = stage.put(nodes.hint("merge").join(named, "node", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "named")
    out = fine.hint("merge").join(of_node, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: vec_id, n_links, component_id, kept. Nulls, ties and repeated rows: see near_duplicates."""
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))
