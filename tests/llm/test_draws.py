"""Fill-in-middle, importance resampling and near-duplicate vectors against plain versions, with odd rows."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fieldloom.llm import infill, resample, vector_dedup

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables aren't here")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(doc_id, text):
    """n, form, prefix_chars, middle_chars, output of a text."""
    ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = ([0, *ends][k] for k in (a, b))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return len(ends), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 80:
        return len(ends), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(ends), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, " ", "\t\n  \r", "word", "  two words  ", "a<S>b", "Größe x \U0001f600 y", "<S" * 5 + " <P P> <", "x\x00y z", "<M", "line\x0bfeed\x0cform", "a \U00010348 b" * 50]


def test_infill_of_odd_rows(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD * 12)] + [(None, "null ids too have texts", 0), (None, "null ids too have texts", 0), (7, "again", 1), (7, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"output": F.lit("old"), "ids": F.lit(1)})
    out = infill.transform(spark, docs)
    assert out.columns == ["doc_id", "text", "ids", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", infill.restored("output", "form")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, ((i, t, *filled(i, t or "")) for i, t, _ in rows)))
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert infill.transform(spark, docs.limit(0)).count() == 0


def test_units_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab \n\té\U0001f600"), 20_000))
    whole = [m.end() for m in re.finditer(infill.UNITS, text)]
    units = infill.Units()
    for most in (1, 3, 1000, 10**6):
        monkeypatch.setattr(infill, "MOST_CHARS", most)
        assert units.ends(text).tolist() == whole
    for text in (" " * 2_000_000, "x" * 2_000_000, "x " * 300_000 + " " * 500_000):  # long runs
        assert units.ends(text).tolist() == [m.end() for m in re.finditer(infill.UNITS, text)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def drawn(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) of texts, by the formula."""
    feats = lambda t: (w := words(t or "")) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    buckets = lambda t: [zlib.crc32(f.encode()) % 10000 for f in feats(t)]
    s, t = (collections.Counter(b for text in texts for b in buckets(text)) for texts in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in s}
    rows = []
    for i, text in docs:
        g = [gain[b] for b in buckets(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text or "")) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    k = 25 * len(able) // 100
    return sorted(map(repr, [(*r[:4], n + 1 if n < k else None) for n, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]))


def plain(df):
    return sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())))


def test_resample_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["Apple", "bird2", "größe", "\U00010348", "x-y", "stone", "river", "i", "ÄH"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "... --"), (203, "word"), (None, "a b c " * 9), (204, "long text " * 20_000)]
    docs += [(205, "same row of many words " * 6)] * 40 + [(None, None)] * 3  # repeated rows: equal scores, neighbouring ranks
    target = ["apple bird2 apple", None, "river river", ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, bucket int, rank string").repartition(7)
    got = resample.resample(spark, df, spark.createDataFrame([(t, 2) for t in target], "text string, s int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert plain(got) == drawn(docs, target)
    assert plain(resample.resample(spark, df, spark.createDataFrame([], "text string"))) == drawn(docs, [])
    assert resample.resample(spark, df.limit(0), spark.createDataFrame([], "text string")).count() == 0


def test_ranks_by_partition_offsets(spark):
    stage = resample.Stage(spark, "test")
    rows = spark.range(5000).selectExpr("id", "id % 7 AS k", "id % 3 AS n").repartition(9)
    got = resample.ranked(stage, rows, [F.desc("k"), F.asc("id")], "n").collect()
    want, at = {}, 0
    for i in sorted(range(5000), key=lambda i: (-(i % 7), i)):
        want[i] = at
        at += i % 3
    assert {r.id: r._before for r in got} == want


@there
@pytest.mark.parametrize("name", ["op12_infill", "op13_resample"])
def test_queries(spark, name):
    docs, target = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = __spark_entry__.queries()[name](spark, SF)
    if name == "op13_resample":
        assert plain(got) == drawn(docs, [t for _, t in target])
    else:
        want = [(i, n, form, a, b, sha(out), sha(t or "")) for i, t in docs for n, form, a, b, out in [filled(i, t or "")]]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def linked(rows, cosine=0.95):
    """vec_id, n_links, component_id, kept of rows (vec_id, vector) by all pairs."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = collections.defaultdict(list)
    for d in {len(v) for (_, v), ok in zip(rows, fine, strict=True) if ok}:
        of = [k for k, ((_, v), ok) in enumerate(zip(rows, fine, strict=True)) if ok and len(v) == d]
        x = np.array([rows[k][1] for k in of], float)
        x /= np.abs(x).max(1, keepdims=True)  # no square overflows
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if i != j:
                near[of[i]].append(of[j])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
            for g in group:
                out[g] = (rows[g][0], len(near[g]), least, rows[g][0] is not None and rows[g][0] == least)
    return sorted(map(repr, out))


def near_vectors(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, comp string").repartition(how.pop("parts", 5))
    out = vector_dedup.near_duplicates(spark, df, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(repr, map(tuple, out.collect())))


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size, spread in ((1, 0), (2, 0.02), (300, 0.02), (40, 0.03), (5, 0.04)) * 3:
        center = rng.standard_normal(24)
        rows += [center + spread * np.linalg.norm(center) * rng.standard_normal(24) / 5 for _ in range(size)]
    angle = np.arange(60) * 0.2  # a chain: each is near the next alone, and many lie wide of the mean
    rows += [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(22)]) for a in angle[:16]]
    rows += [rng.standard_normal(24) for _ in range(300)]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)) + 10, rows, strict=True)]
    rows += [(i, rows[0][1]) for i in range(3000, 3040)] + [(rows[1][0], rows[1][1])] * 2 + [(None, rows[2][1]), (rows[2][0], rows[5][1])]  # copies, repeated and null ids
    rows += [(None, [9.0] * 7), (None, [8.0] * 7)]  # another length, no id at all
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [float("inf")] * 24), (5005, [None, 1.0]), (None, None), (5006, [1e300] * 24), (5007, [2e300] * 24), (5008, [-0.0, 1.0]), (5009, [0.0, 1.0])]
    assert near_vectors(spark, rows) == linked(rows)


def test_wide_classes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    rows = [(i, [math.cos(i * 0.05), math.sin(i * 0.05)]) for i in range(120)]  # all round a circle
    assert near_vectors(spark, rows, window=4) == linked(rows)


def test_windows_reach_over_borders(spark):
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    rows = [(i, (center + 0.02 * rng.standard_normal(32)).tolist()) for i in range(40)] + [(100 + i, rng.standard_normal(32).tolist()) for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert near_vectors(spark, rows, passes=1, window=6) == linked(rows)  # a few rows a partition: one pass joins all in a chain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_vectors(spark):
    assert near_vectors(spark, []) == []
    assert near_vectors(spark, [(1, None)]) == [repr((1, 0, 1, True))]


def test_recall_of_pairs_at_the_limit(spark):
    """Pairs of cosine 0.95 to 0.96, the hardest, among 20,000 others."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((500, 64))
    side -= (side * x[:500]).sum(1, keepdims=True) * x[:500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.96, (500, 1))
    rows = np.concatenate([x, c * x[:500] + np.sqrt(1 - c * c) * side])
    out = vector_dedup.near_duplicates(spark, spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>").repartition(4))
    found = out.where("vec_id >= 20000 AND n_links = 1 AND component_id = vec_id - 20000").count()
    assert found >= 0.95 * 500
    assert out.where("vec_id < 20000 AND NOT kept").count() == 0


@there
def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(repr, map(tuple, __spark_entry__.queries()["op11_vector_dedup"](spark, SF).collect()))) == linked(rows)
