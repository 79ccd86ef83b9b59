"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or nothing on each document.
Expectation-maximisation over the counts of vote patterns of all documents
estimates each labeller's accuracy, which gives a pattern's posterior. A linear
scorer over hashed word shapes, fitted to the posteriors of a bounded sample, then
scores every document.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import Cache, Stage, give_back, read, small_batches
from .linear import fit_logistic, sigmoid, slot

#: Documents that the scorer is fitted on, at most.
MOST_SAMPLE = 20_000
BITS = 14
#: Frequent function words of the corpus's languages.
STOP_WORDS = frozenset(
    "the of and to in is it that for was on are as with be by this at from a an or not you de la le les et des en un une du que est pour dans qui par sur pas au avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine el los las y del se por con para su al lo como más no una es o".split()
)
SYMBOLS = frozenset("#$%&*@^~=<>{}[]\\")
#: Words added to a text's length when shapes are counted as shares: of a few words, little can be said.
SMOOTH = 20
#: Characters of a word, and classes of characters in a row, that one feature says.
PIECE, RUNS = 64, 12
GOOD, JUNK, NOTHING = 0, 1, 2
LABELLERS = ("symbols", "bars", "lone_signs", "capitals", "shouting", "repeats", "distinct_words", "distinct_pairs", "function_words", "word_length", "lines")
#: Characters of the longest word that can be a function word, with signs around it.
STOP_LENGTH = 8
common_shape = regex.compile(r"(\p{Lu}*+)\p{Ll}++([.,;:!?]?)").fullmatch
shape_of = regex.compile(r"(\p{Lu}+)|(\p{Ll}+)|(\p{L}+)|(\p{N}+)|(.)", regex.S)


def is_stop(word: str) -> bool:
    return word.strip(".,;:!?").lower() in STOP_WORDS


def _band(x: float, good: float, junk: float) -> int:
    return GOOD if x <= good else JUNK if x >= junk else NOTHING


def votes(text: str | None) -> list[int]:
    """A vote of each labeller. A text without words gets none."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [NOTHING] * len(LABELLERS)
    count = Counter(text)
    upper = sum(k for c, k in count.items() if c.isupper())
    alpha = sum(k for c, k in count.items() if c.isalpha())
    lines = [x for x in text.split("\n") if x.strip()]
    stop = sum(map(is_stop, [w for w in words if len(w) <= STOP_LENGTH])) / n
    return [
        _band(sum(count[c] for c in SYMBOLS) / chars, 0.01, 0.05),
        _band(words.count("|") / n, 0.02, 0.15),
        _band(sum(not w.isalnum() for w in words if len(w) == 1) / n, 0.05, 0.15),
        _band(upper / max(1, alpha), 0.15, 0.4),
        _band((sum(w.endswith("!!") for w in words) if "!!" in text else 0) / n, 0.02, 0.1),
        _band(sum(map(eq, words, words[1:])) / n, 0.1, 0.3) if n >= 5 else NOTHING,
        _band(1 - len(set(words)) / n, 0.6, 0.7) if n >= 20 else NOTHING,
        _band(1 - len(set(pairwise(words))) / n, 0.3, 0.5) if n >= 20 else NOTHING,
        _band(-stop, -0.06, -0.02) if n >= 20 else NOTHING,
        _band(abs(len(text) / n - 6.5), 3.5, 9.0),
        _band(1 - len(set(lines)) / len(lines), 0.3, 0.8) if len(lines) >= 4 else NOTHING,
    ]


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with pattern (int: votes as digits to base 3)."""
    fields = [f for f in docs.schema.fields if f.name not in (text_col, "pattern")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                codes = [sum(v * 3**k for k, v in enumerate(votes(t))) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], pa.array(codes, pa.int32())], names=[*[f.name for f in fields], "pattern"])
        give_back()

    return docs.drop("pattern").mapInArrow(run, T.StructType([*fields, T.StructField("pattern", T.IntegerType())]))


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of junk for each pattern, and each labeller's chance of voting junk given the class (labeller, class), by EM.

    A labeller that votes nothing says nothing. A prior (with 30 % of the
    documents' weight) expects a labeller to object to 25 % of junk and 0.5 % of good texts.
    """
    expected = np.array([0.005, 0.25])
    if not counts:
        return {}, np.tile(expected, (len(LABELLERS), 1))
    codes = sorted(counts)
    v = np.array([[c // 3**k % 3 for k in range(len(LABELLERS))] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    weight = 0.3 * n.sum() + 1
    junk, good = (v == JUNK).astype(float), (v == GOOD).astype(float)
    post = np.where(junk.any(1), 0.9, 0.05)  # each labeller sees one kind of junk, so an objection is believed first
    for _ in range(rounds):
        prior = (post @ n + 1) / (n.sum() + 2)
        q = np.stack([(1 - post) * n, post * n], 1)
        chance = (junk.T @ q + weight * expected) / ((junk + good).T @ q + weight)
        logs = junk @ np.log(chance) + good @ np.log(1 - chance) + np.log([1 - prior, prior])
        new = sigmoid(logs[:, 1] - logs[:, 0])
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(codes, post.tolist(), strict=True)), chance


class Shapes:
    """Hashed shapes of a text's words, their neighbours' and repeats, as shares of its words."""

    EMPTY, REPEAT = slot("empty", BITS), slot("repeat", BITS)

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.slots = Cache(lambda w: self.of_shape[self.shape(w)])
        self.of_shape = Cache(self.shape_slots)
        if weights is not None:
            self.weights = weights
            self.shape_weight = Cache(lambda s: math.fsum(weights[self.shape_slots(s)].tolist()))
            self.weight = Cache(lambda w: self.shape_weight[self.shape(w)])

    @staticmethod
    def shape(w: str) -> str:
        """A word's size, whether it is a function word, and its classes of characters, each run as one."""
        if m := common_shape(w):
            shape = f"{'A' if m[1] else ''}a{m[2]}"
        else:
            shape = "".join("A" if m[1] else "a" if m[2] else "x" if m[3] else "0" if m[4] else m[5] for m in shape_of.finditer(w))
        return f"{min(len(w), 20) // 4}{'f' if len(w) <= STOP_LENGTH and is_stop(w) else ' '}{shape}"

    @staticmethod
    def shape_slots(s: str) -> list[int]:
        """A slot for each RUNS classes of characters, and one for the end."""
        size, stop, shape = s[0], s[1], s[2:]
        end = "f" if stop == "f" else shape[-2:]
        return [slot(f"s:{shape[i : i + RUNS]}:{size}", BITS) for i in range(0, len(shape), RUNS)] + [slot(f"e:{end}", BITS)]

    @staticmethod
    def words(text: str | None) -> list[str]:
        words = (text or "").split()
        if words and max(map(len, words)) > PIECE:
            # a long word counts as so many words, all of which are seen
            words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
        return words

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        """The text's slots and their values."""
        words = self.words(text)
        if not words:
            return [self.EMPTY], [1.0]
        count = Counter(chain.from_iterable(map(self.slots.__getitem__, words)))
        count[self.REPEAT] += sum(map(eq, words, words[1:]))
        n = len(words) + SMOOTH
        return list(count), [k / n for k in count.values()]

    def logit(self, text: str | None) -> float:
        """The sum of the values by the weights, for which a word's weight is known."""
        words = self.words(text)
        if not words:
            return float(self.weights[self.EMPTY])
        repeats = float(self.weights[self.REPEAT]) * sum(map(eq, words, words[1:]))
        return (math.fsum(map(self.weight.__getitem__, words)) + repeats) / (len(words) + SMOOTH)


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with quality (0 to 1, higher: better). Whole texts; a column named quality is replaced."""
    docs = docs.drop("quality")
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        w, b = shared.value
        shapes = Shapes(w)
        for batch in batches:
            for part in slices(batch, text_col):
                z = [shapes.logit(text) + b for text in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(-np.array(z, float)))], names=[*part.schema.names, "quality"])
        shapes.weight.clear()
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality", T.DoubleType())]))


def train(spark: SparkSession, docs: DataFrame, most: int = MOST_SAMPLE) -> tuple[np.ndarray, float]:
    """EM over the vote patterns of all documents, then the scorer on at most ``most`` of them: those whose texts hash lowest."""
    stage = Stage(spark, "votes")
    cast = stage.put(vote_patterns(docs.select("text", F.xxhash64("text").alias("h"))), "patterns")
    counts = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}  # 3^11 patterns at most
    posterior, _ = estimate(counts)
    n = sum(counts.values())
    prior = (sum(posterior[c] * k for c, k in counts.items()) + 1) / (n + 10)
    # hashes are spread evenly, so about ``most`` are under this; equal texts count once
    low = min(2**63 - 1, -(2**63) + int(min(1.0, most / max(1, n)) * 2**64))
    some = cast.where(F.col("h") <= low).groupBy("h").agg(F.min("pattern").alias("p"))
    last = some.orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        stage.drop(cast)
        return np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    votes_of = {r["h"]: r["p"] for r in some.where(F.col("h") <= last).collect()}
    stage.drop(cast)
    sample = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("h") <= last).dropDuplicates(["h"])
    fields = "h long, cols binary, vals binary"

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            for part in slices(batch, "text"):
                both = [shapes(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), pa.array([np.array(x, np.int32).tobytes() for x, _ in both], pa.binary()), pa.array([np.array(x, np.float64).tobytes() for _, x in both], pa.binary())], names=["h", "cols", "vals"]
                )

    rows = sorted(sample.mapInArrow(run, fields).collect())
    index = np.repeat(np.arange(len(rows)), [len(r.cols) // 4 for r in rows])
    cols, vals = np.frombuffer(b"".join(r.cols for r in rows), np.int32), np.frombuffer(b"".join(r.vals for r in rows), np.float64)
    y = np.array([posterior[votes_of[r.h]] for r in rows])
    # the bias stays at the corpus's share, so that a text of a few words, with small shares, is judged by it
    return fit_logistic(index, cols, vals, y, 1 << BITS, l2=1e-5, steps=400, rate=0.2, bias=float(np.log(prior / (1 - prior))))


def classify(spark: SparkSession, docs: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` with quality and keep (quality >= threshold).

    Null and empty texts are scored as such by the model, of which the labellers say
    nothing. Other columns are kept, repeated rows too. No documents: no rows.
    """
    out = score(spark, docs, train(spark, docs, **how))
    return out.withColumn("keep", F.col("quality") >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, quality, keep. Nulls, ties and repeated rows: see classify."""
    return classify(spark, read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.round("quality", 9).alias("quality"), "keep")
