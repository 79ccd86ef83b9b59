import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm import quality

from .test_llm import PATH, PATTERN, classes, clean, edited, lower, reference  # noqa: F401

pytest.importorskip("public_tokenizers")


def test_pipeline_against_brute_force(spark, tmp_path, reference):  # noqa: F811
    rng = random.Random(0)
    rows = [(n, clean(rng, rng.choice([40, 90, 160]))) for n in range(120)]
    rows += [(200 + n, " | ".join(clean(rng, 60).split())) for n in range(20)]
    rows += [(300 + n, rows[n][1].upper() if n % 2 else rows[n][1]) for n in range(0, 10, 2)]
    rows += [(400 + n, " ".join(edited(rng, rows[n][1].split(), 1))) for n in range(20, 30)]
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality.classify(spark, docs).where("keep").collect()}
    assert good >= set(range(120)) and not good & set(range(200, 220))
    left = {}
    for i, t in rows:
        if i in good:
            left[lower(t)] = max(left.get(lower(t), (-1, "")), (i, t or ""))
    left = dict(left.values())
    near = classes(left.items())
    left = {i: left[i] for i in set(near.values())}
    counts = collections.Counter(r.doc_id for r in got)
    assert counts.keys() <= left.keys() and all(n <= 3 for n in counts.values())
    words = collections.Counter()
    for i, t in left.items():
        words["abc"[i % 3]] += len(t.split())
    whole = 0
    for r in got:
        ids = np.array(reference.encode_ordinary(left[r.doc_id]), "<u4")
        if r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest():
            whole += 1
            assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()
    assert len(got) == whole  # whole documents are mixed
    total, taken = sum(words.values()), collections.Counter()
    for r in got:
        taken["abc"[r.doc_id % 3]] += len(left[r.doc_id].split())
    for n, s in enumerate("abc"):
        assert abs(taken[s] - min(3 * words[s], total * (n + 1) / 6)) <= 160
