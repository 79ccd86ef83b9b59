"""Near-duplicate detection by DartMinHash signatures and banded joins.

Each element of a weighted set owns a fixed, hashed shower of darts over the
plane weight x rank. A set keeps the darts under its elements' weights, and of
those that fall on a coordinate the one with the least rank: two sets agree on a
coordinate with the probability of their weighted Jaccard similarity (Christiani,
2020). Documents that agree on all rows of a band are candidates; a candidate's
similarity is then computed exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import Cache, Stage, components, each, give_back, read, row_key, rows_of

WORDS, SIMILARITY = 5, 0.8
#: With 48 bands of 7 rows, a pair at similarity 0.8 is missed with probability 1e-5; a pair at 0.3 shares a band with probability 0.01.
BANDS, ROWS = 48, 7
#: Longer lists of texts with a rare run are compared in blocks of so many.
LIST, BLOCK = 64, 1024
#: Counts of runs that say which are rare.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Sets whose darts are thrown together.
TOGETHER = 64

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_PLACES = mix(np.arange(1, WORDS + 64, dtype=U)) | U(1)


class Shingler:
    """Hashes of a text's runs of five words (a shorter text is one run), each once, with their number."""

    def __init__(self) -> None:
        self.known = Cache(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.fromiter(map(self.known.__getitem__, words), U, len(words))
        n = min(WORDS, len(h))
        runs = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            runs += h[k : len(h) - n + 1 + k] * _PLACES[k]
        return np.unique(mix(runs + U(n)), return_counts=True)


@lru_cache(maxsize=256)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(n * math.log(mean) - mean - np.array([math.lgamma(x + 1.0) for x in n.tolist()])))


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each set a 32-bit mark for each of k coordinates: that of the earliest dart. A set: distinct hashes and their weights (> 0), one at least.

    The plane is cut in cells that double in weight and rank; each cell of an
    element holds a Poisson number of darts, hashed from element and cell. Cells
    are thrown by rising rank until k ln k + 2k darts of a set are expected, and further
    while one of its coordinates has none. Sets are thrown together, but each as if alone.
    """
    n = len(sets)
    of, elements, weights = np.repeat(np.arange(n), [len(e) for e, _ in sets]), np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(float)
    wanted = (k * math.log(k) + 2 * k) / np.bincount(of, weights, n)
    rank, mark, least = np.full(n * k, np.inf), np.zeros(n * k, np.uint32), weights.min()
    low, high, step = 0.0, 0.125, 1
    while True:
        open_ = (low < wanted) | np.isinf(rank.reshape(n, k)).any(1)
        if not open_.any():
            return mark.reshape(n, k)
        if not open_.all():
            some = open_[of]
            of, elements, weights = of[some], elements[some], weights[some]
            wanted = np.where(open_, wanted, 0.0)
        wlow, whigh, wstep = 0.0, 1.0, 1
        e, w, o = elements, weights, of
        while len(e):
            cell = mix(e + U((int(_GOLD) * (step * 64 + wstep)) % 2**64))
            darts = np.searchsorted(_poisson((high - low) * (whigh - wlow)), (cell >> U(11)).astype(float) / 2.0**53)
            at = np.repeat(np.arange(len(e)), darts)
            if len(at):
                nth = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(darts) - darts, darts)
                dart = mix(cell[at] + _GOLD * nth.astype(U))
                place = mix(dart)
                r = low + (high - low) * (place >> U(11)).astype(float) / 2.0**53
                c = o[at] * k + ((dart >> U(32)) % U(k)).astype(np.int64)
                early = r < rank[c]
                if whigh > 1 or least < 1:
                    early &= wlow + (whigh - wlow) * (mix(place + _GOLD) >> U(11)).astype(float) / 2.0**53 < w[at]
                r, c, place = r[early], c[early], place[early]
                np.minimum.at(rank, c, r)
                first = r == rank[c]
                mark[c[first]] = mix(place[first]).astype(np.uint32)
            wlow, whigh, wstep = whigh, whigh * 2, wstep + 1
            over = w > wlow
            e, w, o = e[over], w[over], o[over]
        low, high, step = high, high * 2, step + 1


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """signatures_of one set."""
    return signatures_of([(elements, weights)], k)[0]


def band_hashes(mark: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = mark[: bands * rows].reshape(bands, rows).astype(U)
    out = mix(np.arange(bands, dtype=U) + U(1))
    for k in range(rows):
        out = mix(out + m[:, k] * _PLACES[k])
    return out.view(np.int64)


def text_digest(text):
    """16 bytes of a text; null and empty ones are equal."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, digest (binary, of the text), bands (array of long; null without words) and marks (binary: a byte for each coordinate) of each row of (doc_id, text)."""
    k = bands * rows

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [(e, c if weighted else np.ones(len(e))) for e, c in map(shingle, part.column("text").to_pylist())]
                hashes, marks = [None] * len(sets), [None] * len(sets)
                full = [i for i, (e, _) in enumerate(sets) if len(e)]
                for at in range(0, len(full), TOGETHER):
                    some = full[at : at + TOGETHER]
                    for i, m in zip(some, signatures_of([sets[i] for i in some], k), strict=True):
                        hashes[i], marks[i] = band_hashes(m, bands, rows), m.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(hashes, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "digest", "bands", "marks"])
        shingle.known.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>, marks binary")


def shingle_sets(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """id, runs (binary, see pack) of each row of (id, text)."""

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            for part in slices(batch, "text"):
                both = [shingle(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([pack(e, c if weighted else None) for e, c in both], pa.binary())], names=["id", "runs"])
        shingle.known.clear()
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, runs binary")


def pack(elements: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """How many occur again, the place and further count of each of these (32 bits each), and all sorted hashes."""
    again = np.flatnonzero(counts > 1) if counts is not None else np.zeros(0, np.int64)
    more = np.stack([again, counts[again] - 1]).astype("<u4").tobytes() if len(again) else b""
    return len(again).to_bytes(8, "little") + more + elements.tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, those that occur again, and how often."""
    n = int.from_bytes(packed[:8], "little")
    at, more = np.frombuffer(packed, "<u4", 2 * n, 8).reshape(2, n)
    elements = np.frombuffer(packed, U, offset=8 + 8 * n)
    return elements, elements[at], more


def jaccard(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets: the sum of the lesser counts over that of the greater."""
    (x, ax, cx), (y, ay, cy) = unpack(a), unpack(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    if len(ax) and len(ay):
        _, i, j = np.intersect1d(ax, ay, assume_unique=True, return_indices=True)
        both += int(np.minimum(cx[i], cy[j]).sum())
    return both / max(1, len(x) + len(y) + int(cx.sum()) + int(cy.sum()) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b), those whose exact similarity is at least ``similarity``, with it. Plain exchanges on both sides of each join let hot ids be split."""
    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(n).to_pylist() for n in ("a", "b", "runs_a", "runs_b"))
            s = [jaccard(p, q) for p, q in zip(x, y, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([x >= similarity for x in s], pa.bool_()))

    return both.select("a", "b", "runs_a", "runs_b").mapInArrow(run, "a long, b long, similarity double")


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets (id, runs) have a run that falls in each of SLOTS slots."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.concatenate([_slot(unpack(packed)[0]) for packed in batch.column("runs").to_pylist()]), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    rows = sets.select("runs").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - SLOT_BITS)).astype(np.int64)


def prefix(packed: bytes, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest runs of a set, so many that any set as similar as ``similarity`` has one of them among its own; a run that occurs again counts as another each time."""
    elements, again, more = unpack(packed)
    every = [elements] + [mix(again[more >= k] + U(int(_GOLD) * k % 2**64)) for k in range(1, int(more.max(initial=0)) + 1)]
    slots = np.concatenate([_slot(elements)] + [_slot(again[more >= k]) for k in range(1, len(every))])
    every = np.concatenate(every)
    n = len(every) - math.ceil(similarity * len(every) - 1e-9) + 1
    return every[np.lexsort((every, counts[slots]))[:n]].view(np.int64)


def rare_runs(sets: DataFrame, similarity: float) -> DataFrame:
    """token, id, comp for the prefix of each of the sets (id, comp, runs). Counts are shared as SLOTS numbers, whatever the number of runs; they only sort."""
    shared = sets.sparkSession.sparkContext.broadcast(token_counts(sets))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = [prefix(packed, shared.value, similarity) for packed in batch.column("runs").to_pylist()]
                n = [len(x) for x in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *[pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("id", "comp")]], names=["token", "id", "comp"])

    return sets.select("id", "comp", "runs").mapInArrow(run, "token long, id long, comp long")


def compare_blocks(lists: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links (a, b) that join up what is similar but of another class in each group (token, x, y) of rows (token, x, y, id, comp, block, marks, runs).

    Pairs whose marks agree on ``least`` of the coordinates are compared
    exactly, unless links found here have joined them already, so a group of n gives n links at most.
    """

    def run(_, pdf):
        m = np.frombuffer(b"".join(pdf["marks"]), np.uint8).reshape(len(pdf), -1)
        ids, block, runs = pdf["id"].to_numpy(), pdf["block"].to_numpy(), pdf["runs"].to_list()
        within = pdf["x"].iloc[0] == pdf["y"].iloc[0]
        _, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)  # at first a class, in the end what links join
        out = []
        for i in range(len(ids)):
            other = np.flatnonzero((comp != comp[i]) & ((ids > ids[i]) if within else (block > block[i])))
            agree = ((m[other] == m[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
            near = np.flatnonzero(agree >= least)
            for j in other[near[np.argsort(-agree[near], kind="stable")]].tolist():
                if comp[i] != comp[j] and jaccard(runs[i], runs[j]) >= similarity:
                    comp[comp == comp[j]] = comp[i]
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return lists.groupBy("token", "x", "y").applyInPandas(run, "a long, b long")


def _pairs_of_lists(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different classes in lists of LIST members at most (token, id, comp)."""
    packed = lists.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "comp"))).alias("m")).select(F.array_distinct("m").alias("m")).distinct()
    first = packed.select("m", F.posexplode("m").alias("p", "x"))
    pairs = first.select("x", F.explode(F.expr("filter(slice(m, p + 2, size(m)), y -> y.comp <> x.comp)")).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, kept.

    Texts are linked if their sets of five-word runs (words between white
    space, as they are) have a Jaccard similarity of at least ``similarity``,
    ``weighted`` by how often each run occurs (a run that occurs once in either counts as in plain sets); classes are the connected
    components of texts. class_id is the smallest id of the class (null if its rows have none), and one row that has it is kept in each class:
    of rows that repeat an id and a text, or of the class's texts under that id, one alone. Null and empty texts are
    equal to each other and near no other; a text of fewer than five words is one run. Different texts under one id are different nodes:
    each goes by its own class. Texts whose rows all have null ids link like any other.

    Copies go as one text, known by its digest. In a band's bucket every text is compared with
    the bucket's hub, its first text; what is near it
    needs no further pair among itself. Where texts of a bucket are still in different classes, pairs of different classes
    are compared exactly if they share a rare run, as similar texts must: of a
    text's runs, sorted by how many texts have them, the first fifth
    and one. Texts that only share a common passage thus never meet. Long lists of a rare run
    are compared in blocks, by their signatures and then exactly, until they are joined: no class loses a link
    of a bucket, yet a large group of copies gives a link for each.
    """
    out = each(_classes(spark, docs, similarity, bands, rows, weighted), "n", "copy")
    return out.select("doc_id", "class_id", (F.col("head") & (F.col("copy") == 0)).alias("kept"))


def _one_text(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id, text of each text that is asked for (_key, id): rows of one key stand together, and the first in a task is given."""
    texts = docs.select(row_key(text_digest(F.col("text")), F.col("doc_id")).alias("_key"), "text").hint("merge").join(asked, "_key").select("id", "text")

    def first(batches):
        last = None
        for batch in batches:
            ids = batch.column("id").to_numpy()
            new = np.diff(ids, prepend=ids[:1] if last is None else last) != 0
            if len(ids) and last is None:
                new[0] = True
            last = ids[-1] if len(ids) else last
            yield batch.filter(pa.array(new))

    return texts.mapInArrow(first, texts.schema)


def _classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """A row for each id and text: doc_id, digest, class_id, head (whether it is the class's one id and text that stays), n (rows of both)."""
    stage = Stage(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stage.put(signatures(texts, bands, rows, weighted), "signatures")
    # a node for each text, numbered where the table is written; its smallest id is what it is named by
    heads = sig.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    heads = stage.put(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    copies = stage.put(sig.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "copies")
    stage.drop(sig)
    members = heads.select("id", F.explode("bands").alias("key"))
    # buckets that more than one text is in, how many, and their hub
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    star = stage.put(members.hint("merge").join(shared, "key"), "star")
    asked = heads.select("id", row_key(F.col("digest"), F.col("least")).alias("_key")).hint("merge").join(star.select("id").distinct(), "id")
    sets = stage.put(shingle_sets(_one_text(texts, asked), weighted), "sets")
    spokes = star.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    parts = components(stage, verified(spokes, sets, similarity).select("a", "b"))
    # buckets of three or more whose texts are in different classes
    classed = star.where("n > 2").select("key", "id").hint("merge").join(parts, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = classed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = classed.hint("merge").join(open_, "key", "left_semi").select("id", "comp").distinct()
    left = stage.put(left.hint("merge").join(sets, "id"), "open")
    rare = stage.put(rare_runs(left, similarity), "rare")
    some = rare.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token", "n")
    lists = rare.hint("merge").join(some, "token")
    short = verified(_pairs_of_lists(lists.where(F.col("n") <= LIST)), left, similarity).select("a", "b")
    long = lists.where(F.col("n") > LIST).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    long = long.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "comp", "block")
    long = long.hint("merge").join(left.select("id", "runs").hint("merge").join(heads.select("id", "marks"), "id"), "id")
    # five standard deviations under the similarity
    least = similarity - 5 * float(np.sqrt(similarity * (1 - similarity) / (bands * rows)))
    more = stage.put(short.union(compare_blocks(long, least, similarity)), "more")
    # links between classes join them
    of = lambda c: left.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    joined = components(stage, more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    stage.drop(star, sets, left, rare, more)
    parts = parts.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("whole")), "comp", "full").select(F.coalesce("id", "comp").alias("id"), F.coalesce("whole", "comp").alias("comp"))
    # a class goes by its text of the smallest id, those without ids last
    whole = heads.select("id", "digest", "least").hint("merge").join(parts, "id", "left").select("id", "digest", "least", F.coalesce("comp", "id").alias("comp"))
    head = whole.groupBy("comp").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("head")).select("comp", F.col("head.least").alias("class_id"), F.col("head.id").alias("head_id"))
    # exchanges with nothing else on them, so that a hot class or text can be split
    named = whole.hint("merge").join(head, "comp").select("digest", "class_id", (F.col("id") == F.col("head_id")).alias("first"))
    head_row = F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return copies.hint("merge").join(named, "digest").select("doc_id", "digest", "class_id", head_row.alias("head"), "n")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and columns of any names) that near_duplicates keeps, with their columns: one for each class. No rows give none."""
    keys = _classes(spark, docs, **how).where("head").select(row_key(F.col("digest"), F.col("doc_id")).alias("_key"))
    return rows_of(docs, text_digest(F.col("text")), keys)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, kept. Nulls, ties and repeated rows: see near_duplicates."""
    return near_duplicates(spark, read(spark, sf_dir, "documents"))
