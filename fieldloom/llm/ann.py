"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' planes are fitted on a bounded sample; every vector is then routed
to a leaf of each tree. A query walks all trees through one priority queue, nearest
planes first, and its candidates are the vectors in the leaves it takes, which their
exact distances rank. Queries go in blocks of bounded size to where the vectors are, which don't move.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, give_back, read, small_batches

#: Vectors that the planes are fitted on, at most; all vectors are indexed.
MOST_SAMPLE = 200_000


@dataclass
class Forest:
    """Inner nodes of all trees in one table. A child >= 0 is a node, a child < 0 is leaf -1 - child."""

    planes: np.ndarray  # (nodes, dimensions)
    offsets: np.ndarray
    children: np.ndarray  # (nodes, 2)
    roots: list[int]
    weights: np.ndarray  # of each leaf, its share of the sample

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (vectors, trees)."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]
                at[inner] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, share: float, skip: float = 0.0, within: float = np.inf) -> list[int]:
        """Leaves in the order of the shared queue, until they hold ``share`` of the sample, counted once for each tree, without those that hold the first ``skip``.

        A leaf's place in the queue is its distance, as far as the planes in front of it tell. The queue ends at ``within``, if that comes first.
        """
        margins = (self.planes @ q - self.offsets).tolist()
        heap = [(-np.inf, r) for r in self.roots]
        heapq.heapify(heap)
        leaves, held, enough, first = [], 0.0, share * len(self.roots), skip * len(self.roots)
        while heap and held < enough:
            worst, node = heapq.heappop(heap)
            if worst > within:
                break
            if node < 0:
                if held >= first:
                    leaves.append(-1 - node)
                held += self.weights[-1 - node]
                continue
            m = margins[node]
            left, right = self.children_list[node]
            heapq.heappush(heap, (max(worst, m), left))
            heapq.heappush(heap, (max(worst, -m), right))
        return leaves

    @property
    def children_list(self) -> list:
        if not hasattr(self, "_children"):
            self._children = self.children.tolist()
        return self._children


def build(sample: np.ndarray, n_trees: int, leaf_size: int, seed: int = 0) -> Forest:
    """Each node splits its part of the sample by a random direction between two of its vectors, at the median of the projections."""
    rng = np.random.default_rng(seed)
    planes, offsets, children, roots, weights = [], [], [], [], []

    def leaf(n: int) -> int:
        weights.append(n / max(1, len(sample)))
        return -len(weights)

    for _ in range(n_trees):
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            child = None
            if len(rows) > leaf_size:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
                if not plane.any():
                    plane = rng.standard_normal(sample.shape[1])
                plane = plane / np.linalg.norm(plane)
                p = sample[rows] @ plane
                cut = np.median(p)
                above = p > cut
                if 0 < above.sum() < len(rows):
                    child = len(planes)
                    planes.append(plane)
                    offsets.append(cut)
                    children.append([0, 0])
                    todo += [(rows[~above], child, 0), (rows[above], child, 1)]
            if child is None:
                child = leaf(len(rows))
            if parent < 0:
                roots.append(child)
            else:
                children[parent][side] = child
    d = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(planes, float).reshape(len(planes), d), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2), roots, np.array(weights, float))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec: rows with an id whose vector isn't null, empty or zero and has finite components only."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v, inf = F.col("vec"), F.lit(float("inf"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def common_length(vectors: DataFrame) -> int:
    """The commonest length of the vectors, of equally common ones the greatest; 0 without any."""
    row = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def distinct_vectors(df: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """vec, ids: each vector once with the k + 1 smallest of its ids, as only these can be among the k nearest of any row.

    In two levels, so that a vector with any share of the rows is in no single
    task; each level limits its groups before the exchange too.
    """
    part = df.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    first = part.withColumn("r", F.dense_rank().over(W.partitionBy("vec", "salt").orderBy("vec_id"))).where(f"r <= {k + 1}")
    second = first.withColumn("r", F.dense_rank().over(W.partitionBy("vec").orderBy("vec_id"))).where(f"r <= {k + 1}")
    return second.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


#: Queries, and leaves of them, that are broadcast at a time; vectors of a task that are compared together; pairs that a task holds before it drops the far ones.
BLOCK, LEAVES, TOGETHER, PAIRS = 4096, 8_000_000, 32_768, 500_000


def _matrix(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Arrays of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


class Nearest:
    """The nearest candidates of each query so far: its k least scores and what equals the last, of distinct vectors."""

    def __init__(self, n: int, k: int):
        self.k, self.bound = k, np.full(n, np.inf)
        self.q, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple] = []
        self.n = 0

    def add(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, row, score))
        self.n += len(q)
        if self.n > PAIRS:
            self.prune()

    def prune(self) -> None:
        q, row, score = (np.concatenate([x, *[h[n] for h in self.held]]) for n, x in enumerate((self.q, self.row, self.score)))
        self.held, self.n = [], 0
        order = np.lexsort((row, score, q))
        q, row, score = q[order], row[order], score[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1])  # a pair that shares several leaves has one score
        q, row, score = q[new], row[new], score[new]
        first = np.searchsorted(q, q)
        last = np.minimum(first + self.k - 1, np.searchsorted(q, q, side="right") - 1)
        near = score <= score[last]
        self.q, self.row, self.score = q[near], row[near], score[near]
        queries, begin, count = np.unique(self.q, return_index=True, return_counts=True)
        full = count >= self.k
        self.bound[queries[full]] = self.score[begin[full] + self.k - 1]


def _compare(index: DataFrame, block: pa.Table, k: int, counted=None) -> DataFrame:
    """query_id, vec_id, score of the nearest of each task's part of the index, k and ties for each query of the block. Only pairs that share a leaf are compared."""
    sizes = np.diff(block["leaves"].combine_chunks().offsets.to_numpy())
    leaves = block["leaves"].combine_chunks().flatten().to_numpy()
    order = np.argsort(leaves, kind="stable")
    shared = index.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), _matrix(block["vec"], float), leaves[order], np.repeat(np.arange(len(sizes)), sizes)[order].astype(np.int32)))

    def run(batches):
        query_id, queries, leaf_of, asks = shared.value
        lengths = (queries * queries).sum(1)
        near, members, first_row = Nearest(len(queries), k), [], 0

        def compare(parts: list[pa.RecordBatch]) -> int:
            x, own = (np.concatenate([_matrix(p.column(c), kind) for p in parts]) for c, kind in (("vec", float), ("leaves", np.int64)))
            ids = [i for p in parts for i in p.column("ids").to_pylist()]
            alone, first = np.array([len(m) == 1 for m in ids]), np.array([m[0] for m in ids])
            squares, pairs = (x * x).sum(1), 0
            for t in range(own.shape[1]):
                rows = np.argsort(own[:, t], kind="stable")
                leaf, begin = np.unique(own[rows, t], return_index=True)
                from_, to = np.searchsorted(leaf_of, leaf), np.searchsorted(leaf_of, leaf, side="right")
                ends = np.append(begin[1:], len(rows))
                for n in np.flatnonzero(to > from_).tolist():
                    r, q = rows[begin[n] : ends[n]], asks[from_[n] : to[n]]
                    pairs += len(r) * len(q)
                    # squared lengths and products give squared distances but for rounding; what isn't beyond the bound is measured exactly
                    rough = lengths[q][:, None] + squares[r] - 2 * (queries[q] @ x[r].T)
                    i, j = np.nonzero(rough <= (near.bound[q] ** 2 + 1e-9 * (1 + lengths[q]))[:, None])
                    i, j = q[i], r[j]
                    other = ~(alone[j] & (first[j] == query_id[i]))
                    i, j = i[other], j[other]
                    near.add(i, j + first_row, np.sqrt(((x[j] - queries[i]) ** 2).sum(1)))
                near.prune()
            members.extend(ids)
            return pairs

        held, n, pairs = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= TOGETHER:
                    pairs, first_row = pairs + compare(held), first_row + n
                    held, n = [], 0
        if held:
            pairs += compare(held)
        if counted is not None:
            counted.add(pairs)
        n = np.array([len(members[r]) for r in near.row], int)
        asks_, vec_id, far = np.repeat(query_id[near.q], n), np.array([i for r in near.row for i in members[r]], np.int64), np.repeat(near.score, n)
        other = asks_ != vec_id
        yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (asks_, vec_id, far)], names=["query_id", "vec_id", "score"])
        give_back()

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def search(
    spark: SparkSession, queries: DataFrame, vectors: DataFrame, k: int = 10, n_trees: int = 8, leaf_size: int = 64, share: float = 0.2, first: float = 0.01, reach: float = 3.0, most_sample: int = MOST_SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", counted=None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of ``vectors``, but the rows of its own id, by Euclidean distance.

    A query takes leaves that hold ``first`` of the vectors in each tree on
    average, and then further ones, up to ``share``, as long as one is likely to hold something nearer than the k it has: a neighbour at distance r in d dimensions stands
    some r / sqrt(d) beyond a plane, and leaves behind planes that are ``reach`` times as far are left (r itself, if that is less, as none can be nearer).
    So where vectors have real neighbourhoods, few are compared; ``counted``, an accumulator, gets the number of pairs. Ties go to
    the smaller id. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, as neither do null ids; nor do those of another length than most of ``vectors`` have, which are at no distance from these.
    Of rows that repeat an id, each distinct vector counts and the nearest gives the score. Other columns are ignored.

    Copies of a vector are indexed once. Each vector is written once with its leaves
    and stays where it is; of the queries, BLOCK at a time (fewer if they take over LEAVES leaves) are broadcast with theirs, and
    each task gives their k nearest of its part.
    """
    small_batches(spark)
    stage = Stage(spark, "ann")
    fine = usable(vectors, id_col, vec_col)
    length = common_length(fine)
    points = stage.put(distinct_vectors(fine.where(F.size("vec") == length), k), "points")
    kind = points.schema["vec"].dataType.simpleString()
    rows = points.orderBy(F.xxhash64("ids"), "ids").limit(most_sample).select("vec").toArrow()["vec"]
    sample = _matrix(rows, float) if len(rows) else np.zeros((0, 0))
    forest = build(sample, n_trees if length else 0, leaf_size)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.route(_matrix(batch.column("vec"), float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int32()))], names=["vec", "ids", "leaves"])

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                skip, within = (batch.column(c).to_pylist() for c in ("skip", "within"))
                leaves = [shared.value.search(v, first if s == 0 else share, s, w) for v, s, w in zip(_matrix(batch.column("vec"), float), skip, within, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "vec", "leaves"])

    index = points.select("vec", "ids").mapInArrow(route, f"vec {kind}, ids array<long>, leaves array<int>")
    index = stage.put(index.sortWithinPartitions(F.element_at("leaves", 1)), "index")
    stage.drop(points)
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == length).select(F.col("vec_id").alias("query_id"), F.col("vec").cast(kind).alias("vec")).distinct()
    asked = stage.put(asked, "asked")
    n_asked, none = asked.count(), spark.createDataFrame([], "query_id long, vec_id long, score double")

    def go(more: DataFrame, part: float) -> DataFrame:
        """What the queries find in the leaves that they take (query_id, vec, skip, within)."""
        taken = stage.put(more.mapInArrow(ask, f"query_id long, vec {kind}, leaves array<int>"), "taken")
        together = max(64, min(BLOCK, int(LEAVES / max(1, part * len(forest.weights)))))
        blocks, found = -(-n_asked // together), none
        for n in range(blocks):
            block = taken.where((F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)) == n) & (F.size("leaves") > 0)).toArrow()
            if block.num_rows:
                found = found.union(stage.put(_compare(index, block, k, counted), "near"))
        return found

    one = go(asked.withColumns({"skip": F.lit(0.0), "within": F.lit(float("inf"))}), first)
    best = one.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    kth = best.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("score"))).where(F.col("r") == k).select("query_id", F.col("score").alias("within"))
    further = asked.join(kth, "query_id", "left").select("query_id", "vec", F.lit(first).alias("skip"), F.coalesce(F.col("within") * min(1.0, reach / max(1, length) ** 0.5), F.lit(float("inf"))).alias("within"))
    near = one.union(go(further, share)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector's neighbours among all: query_id, rank, vec_id, score. Nulls, ties and repeated rows: see search."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(spark, vectors.where("vec_id % 100 = 0"), vectors)
