"""Counterfactually regularised toxicity classifier.

A logistic model over hashed words and word beginnings. In the labelled texts each
identity term is swapped for others of its group, and the model is penalised
for the change of its score, so that a neutral mention of a group counts for nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import Cache, read, small_batches
from .linear import fit_logistic, sigmoid, slot

#: Labelled rows that the model is fitted on, at most.
MOST_LABELLED = 20_000
BITS = 20
#: Groups of identity terms that are swapped for each other, in the corpus's languages.
IDENTITY_GROUPS = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "african", "latino", "european", "arab", "american"],
    ["gay", "straight", "lesbian", "bisexual", "homosexual", "heterosexual", "transgender", "queer"],
    ["old", "young", "elderly", "teenage"], ["disabled", "blind", "deaf", "autistic"],
    ["immigrant", "immigrants", "refugee", "refugees", "citizen", "citizens"],
    ["femmes", "hommes", "filles", "garçons"], ["femme", "homme", "fille", "garçon"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"], ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"],
    ["noirs", "blancs", "asiatiques", "africains", "européens", "arabes", "américains"], ["homosexuel", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"],
    ["immigré", "immigrés", "réfugié", "réfugiés", "citoyen", "citoyens"], ["handicapés", "aveugles", "sourds", "autistes"],
    ["frauen", "männer", "mädchen", "jungen"], ["frau", "mann"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch", "evangelisch"], ["muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken", "protestanten"],
    ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "amerikaner"], ["schwule", "lesben", "heterosexuelle", "bisexuelle", "homosexuelle"],
    ["einwanderer", "flüchtling", "flüchtlinge", "bürger"], ["behinderte", "blinde", "gehörlose", "autisten"],
    ["mujeres", "hombres", "niñas", "niños"], ["mujer", "hombre", "niña", "niño"],
    ["musulmán", "cristiano", "judío", "budista", "ateo", "católico"], ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"],
    ["negros", "blancos", "asiáticos", "africanos", "europeos", "árabes", "americanos"], ["gays", "lesbianas", "heterosexuales", "bisexuales", "homosexuales", "transgénero"],
    ["inmigrante", "inmigrantes", "refugiado", "refugiados", "ciudadano", "ciudadanos"], ["discapacitados", "ciegos", "sordos"],
]
GROUP_OF = {term: (g, k) for g, group in enumerate(IDENTITY_GROUPS) for k, term in enumerate(group)}
find_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its first four and five letters."""
    return [slot(f"w:{word}", BITS)] + [slot(f"{n}:{word[:n]}", BITS) for n in (4, 5) if len(word) >= n]


class Featurizer:
    def __init__(self) -> None:
        self.known = Cache(word_features)

    def __call__(self, text: str | None) -> tuple[set[int], set[str]]:
        """The text's features, and its identity terms."""
        words = set(find_words((text or "").lower()))
        out: set[int] = set()
        for w in words:
            out.update(self.known[w])
        return out, words & GROUP_OF.keys()


def labelled_features(labelled: DataFrame) -> DataFrame:
    """label, features (binary: sorted 32-bit integers), terms of each row of (text, label)."""

    def run(batches):
        f = Featurizer()
        for batch in batches:
            for part in slices(batch, "text"):
                both = [f(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([np.array(sorted(x), np.uint32).tobytes() for x, _ in both], pa.binary()), pa.array([sorted(x) for _, x in both], pa.list_(pa.string()))], names=["label", "features", "terms"])

    schema = "label int, features binary, terms array<string>"
    return labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, schema)


def fit(rows: Iterable, counterfactual: float = 1.0, least_rows: int = 4, least_z: float = 3.0) -> tuple[dict[int, float], float]:
    """Weights by feature, and bias, from rows (label, features, terms).

    Only features that at least ``least_rows`` rows have and whose share among
    the toxic differs by ``least_z`` standard errors enter the model, and the
    features of the identity terms that occur, so that the penalty holds them.
    """
    rows = list(rows)
    y = np.array([r[0] for r in rows], float)
    n1, n = y.sum(), len(y)
    if n == 0 or n1 in (0, n):  # one class, or none: nothing to learn but the share
        p = (n1 + 0.5) / (n + 1)
        return {}, float(np.log(p / (1 - p)))
    # row by row, as the features of all rows at once would fill the driver
    all_, one = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for label, features, _ in rows:
        f = np.frombuffer(features, np.uint32)
        all_[f] += 1
        one[f] += label
    share = n1 / n
    z = np.abs(one - all_ * share) / np.sqrt(np.maximum(all_ * share * (1 - share), 1e-9))
    used = (all_ >= least_rows) & (z >= least_z)
    pairs: Counter = Counter()
    for r in rows:
        for t in r[2]:
            group, k = GROUP_OF[t]
            pairs.update((t, other) for other in IDENTITY_GROUPS[group] if other not in r[2])
    for t in {t for p in pairs for t in p}:
        used[word_features(t)] = True
    ids = np.flatnonzero(used)
    place = np.full(1 << BITS, -1)
    place[ids] = np.arange(len(ids))
    parts = [place[f[used[f]]] for f in (np.frombuffer(r[1], np.uint32) for r in rows)]
    index, cols = np.repeat(np.arange(n), [len(x) for x in parts]), np.concatenate(parts)
    swaps = np.zeros((len(pairs), len(ids)))
    for i, ((a, b), count) in enumerate(sorted(pairs.items())):
        swaps[i, place[word_features(a)]] += 1
        swaps[i, place[word_features(b)]] -= 1
        swaps[i] *= np.sqrt(count / n)

    def penalty(w):
        return 2 * counterfactual * (swaps.T @ (swaps @ w))

    w, b = fit_logistic(index, cols, np.ones(len(cols)), y, len(ids), l2=1e-3, penalty=penalty if len(pairs) else None)
    return dict(zip(ids.tolist(), w.tolist(), strict=True)), b


def score(spark: SparkSession, docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts get the bias's score.

    Whole texts of any length; rows stay as they are; columns named score or
    predicted are replaced. The model is broadcast: at most 2^20 weights.
    """
    docs = docs.drop("score", "predicted")
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        known = Cache(lambda w: [x for x in word_features(w) if x in weights])
        for batch in batches:
            for part in slices(batch, text_col):
                z = []
                for text in part.column(text_col).to_pylist():
                    hit: set[int] = set()
                    for w in set(find_words((text or "").lower())):
                        hit.update(known[w])
                    z.append(bias + sum(weights[x] for x in sorted(hit)))
                p = sigmoid(np.array(z, float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, **how) -> tuple[dict[int, float], float]:
    """Fits on at most ``most`` labelled rows that aren't held out: those whose id hashes lowest. Rows without a label or id take no part."""
    some = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # of rows that repeat an id, one text: so ``most`` rows come to the driver at most
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label"))
    rows = labelled_features(labelled).collect()
    return fit(sorted((r.label, r.features, r.terms) for r in rows), **how)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted. Nulls, ties and repeated rows: see score and train."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = score(spark, docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
