import base64
import collections
import hashlib
import pathlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import ann, bpe, common, exact_dedup, html, licenses, linear, minhash, mixing, quality, sequences, toxicity

tokens = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, quality int, n long, digest string, copy int"

ODD = [
    (1, "Hello World, this is one", "en", "a"), (2, "hello world, THIS is one", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "É ß ÉÉ ſ K", "de", "b"), (6, "é ß éé ſ k", "de", "b"),
    (7, "x " * 30_000, "en", None), (8, "hello world, this is one", None, "a"), (8, "hello world, this is one", None, "a"), (None, "hello world, this is one", "fr", "c"), (None, None, None, None), (None, "alone", None, "c"),
    (9, "tab\tand nbsp 　 wide\r\nlines\n\n\n", "en", "c"), (10, "emoji 👩‍👩‍👧 é \x00 ퟿", "en", "c"),
]


def documents(spark, rows=ODD):
    """With columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), True, 1, 2, "d", 3) for r in rows], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# exact dedup


def test_exact_dedup_report(spark):
    got = exact_dedup.new_index(spark).ingest(documents(spark)).collect()
    groups = collections.defaultdict(list)
    for r in ODD:
        groups[hashlib.sha256(lower(r[1]).encode()).digest()].append(r[0])
    assert collections.Counter((r.doc_id, bytes(r.digest)) for r in got) == collections.Counter((i, d) for d, ids in groups.items() for i in ids)
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
    kept = collections.Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) == {1} and kept.keys() == groups.keys()


def test_digest_index_grows_and_repeats(spark):
    index = exact_dedup.new_index(spark)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "A"), (4, "c"), (5, "C")], "doc_id long, text string")
    index.ingest(one)
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(two).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(two).collect()} == got
    assert spark.table(index.table).count() == 3
    assert index.ingest(one.limit(0)).count() == 0


def test_deduplicate_keeps_columns(spark):
    docs = documents(spark)
    got = exact_dedup.deduplicate(spark, docs)
    assert got.columns == docs.columns
    assert collections.Counter(lower(r.text) for r in got.collect()) == collections.Counter({lower(r[1]): 1 for r in ODD})
    assert exact_dedup.deduplicate(spark, docs.limit(0)).count() == 0


# mixing


def fill(sizes, weights, cap=3.0):
    open_, target, rest = set(sizes), dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if rest * weights[s] / total >= cap * sizes[s]}
        if not full:
            return target | {s: rest * weights[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "z", "b", "é", "B", "empty"]
    rows = [(n if n % 17 else None, None if n % 13 == 0 else " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), "en", rng.choice(names[:5]) if n else "empty") for n in range(150)]
    rows[0] = (0, "", "en", "empty")
    rows += [rows[5], rows[5]]
    plan = mixing.plan_mix(spark, documents(spark, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: s.encode()), None]
    want = fill(sizes, {s: 1 + n % 3 for n, s in enumerate(order)})
    assert len(plan) == len(rows)
    taken = collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert (r.position < 1) == (r.offset < r.quota)
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in plan) == sorted((str(r.doc_id), r.size, r.taken) for r in mixing.plan_mix(spark, documents(spark, rows[::-1])).collect())


def test_materialised_mix(spark):
    rows = [(n, " ".join(f"w{n}_{k}" for k in range(1 + n % 7)), "en", "abc"[n % 3]) for n in range(60)] + [(7, "w7_0", "en", "b")]
    docs = documents(spark, rows)
    out = mixing.materialise(spark, docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    quota = {r.source: r.quota for r in mixing.plan_mix(spark, docs).select("source", "quota").distinct().collect()}
    assert words == quota
    whole = {r[1] for r in rows}
    assert sum(r.text not in whole for r in out.collect()) <= 3
    assert mixing.materialise(spark, docs.limit(0)).count() == 0


def test_curriculum_positions(spark):
    rows = [(n, "w w", "en", "ab"[n % 2]) for n in range(400)]
    rise, fall = (0.0, 1.0, 1.0), (1.0, 1.0, 0.0)
    plan = mixing.plan_mix(spark, documents(spark, rows), weights=[rise, fall]).collect()
    for s, share in (("a", lambda t: t if t < 0.5 else 0.5 + (t - 0.5)), ("b", lambda t: 1 - t)):
        got = sorted(r.position for r in plan if r.source == s and r.offset < r.quota)
        grid = np.linspace(0, 1, 10_001)
        w = {"a": np.interp(grid, [0, 0.5, 1], [0, 0.5, 1]), "b": np.interp(grid, [0, 0.5, 1], [1, 0.5, 0])}[s]
        cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)]) / ((w[1:] + w[:-1]) / 2).sum()
        want = np.interp(np.arange(len(got)) / len(got), cum, grid)
        assert np.abs(np.array(got) - want).max() < 0.01
    with pytest.raises(ValueError):
        mixing.plan_mix(spark, documents(spark, rows), weights=[(1, 1), (0, 0)])


# licences


def test_license_scan(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN if "\n" in t)["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;")), (2, "The MIT\n" + mit), (3, "text\nlicenced under the apache licence version 2.0\nmore"), (4, "It is released under the MIT License, I think."), (5, None), (6, ""),
        (7, "© 2021 X\nAll rights reserved."), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT licence"), (8, "x"), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, text_license string, digest int")
    got = [(r.doc_id, r.text_license, r.notice_licenses) for r in licenses.scan(spark, docs).collect()]
    assert got == [(1, "MIT", []), (2, None, []), (3, None, ["Apache-2.0"]), (4, None, []), (5, None, []), (6, None, []), (7, None, []), (8, None, ["CC-BY-NC-4.0", "MIT"]), (8, None, []), (None, "MIT", ["MIT"])]
    assert licenses.scan(spark, docs.limit(0)).count() == 0
    assert licenses.scan(spark, docs, known=[("X", "Copyright-free text.\nsecond line")]).where("text_license IS NOT NULL").count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_ranks(spark, reference):
    rng = random.Random(0)
    alphabet = "aab  \n\t'sté中👩́ -=0١!" + "x" * 3
    texts = [None, "", "<|endoftext|>", "a" * 5000, " " * 999 + "b", "-=" * 3000, "'''s't", "\x00\x01", " 　x"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]
    docs = spark.createDataFrame([(n, t, "kept", b"old") for n, t in enumerate([*texts, texts[-1]])], "doc_id long, text string, extra string, ids binary")
    out = bpe.encode(spark, docs, PATH, PATTERN, with_offsets=True)
    for r in bpe.decode(spark, out, PATH, PATTERN).collect():
        want = reference.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and bytes(r.decoded) == (r.text or "").encode() and r.extra == "kept"
        pieces = [(r.text or "")[a:b] for a, b in zip(r.starts, r.ends, strict=True)]
        assert all(p.encode().find(reference.decode_single_token_bytes(i)) >= 0 for p, i in zip(pieces, want, strict=True))
        assert not want or (r.starts[0] == 0 and r.ends[-1] == len(r.text))
    assert bpe.encode(spark, docs.limit(0), PATH, PATTERN).count() == 0


def test_bpe_pieces_at_every_code_point(reference):
    c = bpe.codec(open(PATH, "rb").read(), PATTERN)
    texts = [f"a{ch}b 1{ch}2 {ch} {ch}{ch}x\n{ch}" for ch in map(chr, range(0, 0x30000, 7)) if not "\ud800" <= ch <= "\udfff"]
    assert all(np.frombuffer(i, "<u4").tolist() == reference.encode_ordinary(t) for t, i in zip(texts, c.encode(texts), strict=True))


# token sequences


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 64, 1000):
        assert sorted(sequences.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert (sequences.permute(np.arange(1000), 1000, 5) != sequences.permute(np.arange(1000), 1000, 6)).any()


def test_sequences_round_trip(spark, tmp_path, reference):
    rows = [(n, "word " * (n * 7 % 90), "en", "a") for n in range(40)] + [(None, "null id", "en", "a"), (5, None, "en", "a"), (6, "word", "en", "a"), (6, "word", "en", "a"), (50, "long " * 3000, "en", "a")]
    docs, root = documents(spark, rows), f"file://{tmp_path}/shards"
    got = sequences.write(spark, docs, PATH, PATTERN, root, length=16, shards=5).collect()
    want = collections.Counter()
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want.update((r[0], k // 16, tuple(ids[k : k + 16])) for k in range(0, len(ids), 16))
    stored = list(sequences.sequences(root))
    assert sorted(r.slot for r in got) == list(range(len(stored))) and len(stored) == sum(want.values())
    assert collections.Counter((r.doc_id, r.seq, tuple(stored[r.slot].tolist())) for r in got) == want
    for start in (0, 1, 17, len(stored) - 1, len(stored)):
        assert [x.tolist() for x in sequences.sequences(root, start)] == [x.tolist() for x in stored[start:]]
    back = {r.slot: np.frombuffer(r.tokens, "<u4").tolist() for r in sequences.read_back(spark, root).collect()}
    assert back == {n: x.tolist() for n, x in enumerate(stored)}
    empty = f"file://{tmp_path}/none"
    assert sequences.write(spark, docs.limit(0), PATH, PATTERN, empty, shards=2).count() == 0 and list(sequences.sequences(empty)) == []


def test_slots_follow_from_ids_and_texts_alone(spark, tmp_path):
    rows = [(n, f"word {n} " * (n * 7 % 50), "en", "a") for n in range(60)] + [(None, f"null {n} " * 30, "en", "a") for n in range(9)] + [(5, "again " * 40, "en", "a"), (2**62, "far", "en", "a"), (-7, "low", "en", "a")]
    slots = []
    for k, docs in enumerate((documents(spark, rows).repartition(1), documents(spark, rows[::-1]).repartition(7))):
        root = f"file://{tmp_path}/{k}"
        if k:
            sequences.write(spark, docs, PATH, PATTERN, root, length=8, shards=9)  # leaves shards behind
        sequences.write(spark, docs, PATH, PATTERN, root, length=8, shards=3)
        slots.append([x.tolist() for x in sequences.sequences(root)])
        assert len(list((tmp_path / str(k)).glob("shard-*"))) <= 3
    assert slots[0] == slots[1]


def test_ids_beyond_two_bytes_raise(spark, tmp_path):
    big = tmp_path / "big"
    for last in (sequences.PAD, 70_000):
        big.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b if b else last}\n" for b in range(256)))
        with pytest.raises(ValueError):
            sequences.write(spark, documents(spark), str(big), PATTERN, f"file://{tmp_path}/x", shards=2)


# near-duplicates


def runs(t):
    """A text's runs of five words, those that occur again numbered."""
    w, seen = (t or "").split(), collections.Counter()
    out = set()
    for k in range(max(1, len(w) - 4) if w else 0):
        run = tuple(w[k : k + 5])
        out.add((run, seen[run]))
        seen[run] += 1
    return frozenset(out)


def classes(rows, least=0.8):
    """Smallest id of each text's component, by all pairs."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    sets, root = {t: runs(t) for t in texts}, {i: i for ids in texts.values() for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for t, ids in texts.items():
        for i in ids:
            join(ids[0], i)
    keys = list(texts)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                join(texts[a][0], texts[b][0])
    return {i: find(i) for i in root}


def by_text(rows, least=0.8):
    """For each text the smallest id of its component (None without any) and a number of the component, by all pairs of texts."""
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    keys, comp = list(ids), list(range(len(ids)))
    sets = [runs(t) for t in keys]
    for n in range(len(keys)):
        for m in range(n):
            if sets[n] and sets[m] and len(sets[n] & sets[m]) / len(sets[n] | sets[m]) >= least:
                comp = [comp[m] if c == comp[n] else c for c in comp]
    low = {c: min((i for k, t in enumerate(keys) if comp[k] == c for i in ids[t] if i is not None), default=None) for c in comp}
    return {t: (low[comp[k]], comp[k]) for k, t in enumerate(keys)}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 60, 150, 400]))]
        rows += [(len(rows) + n, " ".join(edited(rng, base, rng.randrange(4)) if n else base)) for n in range(rng.choice([1, 2, 6]))]
        chain = base
        for _ in range(3):
            chain = edited(rng, chain, max(1, len(base) // 60))
            rows.append((len(rows), " ".join(chain)))
    shared = [f"s{n}" for n in range(60)]
    rows += [(len(rows) + n, " ".join([*shared, *(f"u{n}_{k}" for k in range(60))])) for n in range(40)]
    base = [f"h{n}" for n in range(150)]
    rows += [(len(rows) + n, " ".join(edited(rng, base, n % 7))) for n in range(80)]
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, "one two"), (len(rows) + 4, "one two")]
    want = classes(rows)
    docs = documents(spark, [(*r, "en", "a") for r in rows])
    got = minhash.near_duplicates(spark, docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert collections.Counter(r.class_id for r in got if r.kept) == collections.Counter(set(want.values()))
    left = minhash.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark)
    got = minhash.near_duplicates(spark, docs).collect()
    assert collections.Counter(str(r.doc_id) for r in got) == collections.Counter(str(r[0]) for r in ODD)
    assert {r.class_id for r in got if r.doc_id == 8} == {8} and sum(r.kept for r in got if r.doc_id == 8) == 1
    want = by_text([(r[0], r[1]) for r in ODD])
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter((r[0], want[r[1] or ""][0]) for r in ODD)
    assert minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"h{n}" for n in range(120)]
    rows = [(n, " ".join(edited(rng, base, n % 9))) for n in range(60)]
    far = edited(rng, base, 5)
    rows += [(100 + n, " ".join(edited(rng, far, 1))) for n in range(6)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a, b = np.array([1, 2, 3, 0.5, 7.0]), np.array([2, 1, 3, 1.5, 5.0])
    est = np.mean([(minhash.signature(e, a, 336) == minhash.signature(e, b, 336)).mean() for e in rng.integers(0, 2**63, (60, 5)).astype(np.uint64)])
    assert est == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.02)


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(n, n + 1) for n in range(1000, 1040)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = common.components(common.Stage(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.comp for r in got.collect()} == {x: find(x) for x in root}


# nearest neighbours


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype("f4")
    x[500:900] = x[500]
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, 2.0], 1), (2100, [None] * 16, 1), (2200, [float("inf")] * 16, 1), (None, x[0].tolist(), 1), (700, x[700].tolist(), 1), (2300, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.search(spark, df.where("vec_id % 100 = 0"), df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, rows_ in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [int(n) for n in np.lexsort((np.arange(len(d)), d)) if n != q][:10]
        rows_.sort()
        assert [r for r, *_ in rows_] == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in rows_)
        hits += len(set(order) & {v for _, v, _ in rows_})
        if q in range(500, 900):
            assert [v for _, v, _ in rows_] == order
    assert hits >= 0.9 * 150
    few = df.where("vec_id < 5")
    assert ann.search(spark, few.where("vec_id = 0"), few).count() == 4
    assert ann.search(spark, df.limit(0), df.limit(0)).count() == 0 and ann.search(spark, df.where("vec_id = 2001"), df).count() == 0


@pytest.mark.parametrize("n", [300, 2_000, 20_000, 50_000])
def test_neighbours_found_by_the_forest_alone(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = f"{tmp_path}/v.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), path)
    vectors = spark.read.parquet(path)
    got = collections.defaultdict(list)
    for r in ann.search(spark, vectors.where(f"vec_id % {max(1, n // 100)} = 0"), vectors).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits, y = 0, x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [s for _, s in found] == sorted(s for _, s in found) and all(s == pytest.approx(d[i], rel=1e-12) for i, s in found) and len(found) == 10
        hits += len({i for i, _ in found} & set(np.argsort(d, kind="stable")[:10].tolist()))
    print("recall", n, hits / (10 * len(got)))
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("n, kind", [(20_000, "clusters"), (50_000, "clusters"), (20_000, "flat")])
def test_few_pairs_are_compared_where_vectors_have_neighbourhoods(spark, tmp_path, n, kind):
    """Clusters, and vectors near a space of five dimensions."""
    rng = np.random.default_rng(n)
    if kind == "clusters":
        centers = rng.standard_normal((n // 50, 64))
        x = (centers[rng.integers(0, len(centers), n)] + 0.1 * rng.standard_normal((n, 64))).astype("float32")
    else:
        x = (rng.standard_normal((n, 5)) @ rng.standard_normal((5, 64)) + 0.01 * rng.standard_normal((n, 64))).astype("float32")
    path = f"{tmp_path}/v.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), path)
    vectors, counted = spark.read.parquet(path), spark.sparkContext.accumulator(0)
    got = collections.defaultdict(set)
    for r in ann.search(spark, vectors.where("vec_id % 100 = 0"), vectors, counted=counted).collect():
        got[r.query_id].add(r.vec_id)
    y, hits = x.astype(float), 0
    for q in range(0, n, 100):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    share = counted.value / (n * len(range(0, n, 100)))
    print("recall", hits / (10 * len(got)), "compared", share)
    assert hits >= 0.9 * 10 * len(got) and share < 0.3


def test_neighbours_of_queries_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(n, rng.standard_normal(8 if n in (0, 100, 200) else 16).tolist()) for n in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(spark, df.where("vec_id % 100 = 0"), df).collect()
    assert {r.query_id for r in got} == {300, 400} and len(got) == 20


def test_rarest_runs_meet(spark):
    """Texts with a long common passage and weights: all links, by all pairs, and none between texts that share the passage alone."""
    rng = random.Random(8)
    passage = [f"p{n}" for n in range(60)]
    rows = [(n, " ".join([*passage, *[f"w{rng.randrange(10**6)}" for _ in range(40 + n % 30)]])) for n in range(150)]
    rows += [(1000 + n, " ".join(edited(rng, rows[n][1].split(), 1))) for n in range(0, 150, 5)]
    rows += [(2000 + n, "again and again the same line " * (10 + n)) for n in range(12)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)


@pytest.mark.parametrize("weighted", [True, False])
def test_prefixes_of_similar_sets_meet(weighted):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, minhash.SLOTS)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        e = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        c = rng.integers(1, 4, len(e))
        keep, c2 = rng.random(len(e)) > 0.08, np.maximum(1, c - (rng.random(len(e)) < 0.1))
        a, b = (minhash.pack(x, y if weighted else None) for x, y in ((e, c), (e[keep], c2[keep])))
        if minhash.jaccard(a, b) >= 0.8:
            assert set(minhash.prefix(a, counts, 0.8).tolist()) & set(minhash.prefix(b, counts, 0.8).tolist())


# toxicity


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(0)
    plain, bad = [f"word{n}" for n in range(300)], ["awful", "nasty", "vilestuff"]
    rows, labels = [], []
    for n in range(600):
        words, toxic = rng.choices(plain, k=40), n % 4 == 0
        if toxic:
            words += rng.choices(bad, k=2) + ["muslim"] * (n % 8 == 0)
        rng.shuffle(words)
        rows.append((n, " ".join(words), "en", "a"))
        labels.append((n, int(toxic)))
    docs = documents(spark, [*rows, (700, None, "en", "a"), (701, "", "en", "a"), (1, "twice", "en", "a"), (None, "x", None, None)])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (9999, None), (None, 1)], "doc_id long, label int"))
    got = toxicity.score(spark, docs.withColumn("score", F.lit(1)), model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.text != "twice"]) > 0.97
    neutral = documents(spark, [(1, "word1 word2 a muslim man", "en", "a"), (2, "word1 word2 a christian man", "en", "a")])
    a, b = (r.score for r in toxicity.score(spark, neutral, model).orderBy("doc_id").collect())
    for one, other in (("femmes", "hommes"), ("muslime", "christen"), ("judíos", "católicos"), ("immigrants", "citizens")):
        assert toxicity.GROUP_OF[one][0] == toxicity.GROUP_OF[other][0]
    free = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), counterfactual=0.0)
    c, d = (r.score for r in toxicity.score(spark, neutral, free).orderBy("doc_id").collect())
    assert abs(a - b) < abs(c - d) / 2 and a < 0.5
    assert toxicity.fit([])[0] == {} and toxicity.fit([(1, b"", [])])[1] > 0
    assert toxicity.score(spark, docs.limit(0), model).count() == 0


# quality


def clean(rng, n):
    stop = sorted(quality.STOP_WORDS)
    return " ".join(rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)).capitalize() + "."


def test_quality(spark):
    rng = random.Random(0)
    rows = [(n, clean(rng, rng.choice([3, 30, 200])), "en", "a") for n in range(500)]
    junk = [lambda w: " ".join(f"{x}$$$" for x in w), lambda w: " | ".join(w), lambda w: "!! ".join(w).upper() + "!!", lambda w: " ".join([w[0]] * 60 + [w[1]] * 60)]
    rows += [(1000 + n, junk[n % 4](clean(rng, 80).split()), "en", "a") for n in range(80)]
    docs = documents(spark, [*rows, (2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "a " * 50_000, "en", "a"), (None, "The end of it.", "en", "a")])
    got = {r.doc_id: r.keep for r in quality.classify(spark, docs.drop("keep", "quality")).collect()}
    assert all(got[n] for n in range(500)) and np.mean([got[1000 + n] for n in range(80)]) < 0.15 and not got[2002]
    assert quality.classify(spark, docs.limit(0)).count() == 0
    assert quality.estimate({})[0] == {} and set(quality.votes(None)) == {quality.NOTHING}


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 > 0).astype(float)
    w, b = linear.fit_logistic(np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400), x.ravel(), y, 3)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97


# main text


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a}</style><script>if (a<b) x("</p>")</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use <b>cookies</b></div><!-- <p>no</p> -->
<div class="content with sidebar"><article class="post"><header><h1>Title&nbsp;of
it</h1></header><p>First &lt;b&gt; &amp;amp; <i>it</i>alic<br>line<p>Second<ul><li>one<li>two</ul><aside>Related</aside><div class="share-buttons">Share</div><form>Email</form><div class="ad">Buy</div>
<blockquote>quote</blockquote></article></div><section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; x</footer></body>"""
TEXT = "Title of it\nFirst <b> &amp; italic line\nSecond\none\ntwo\nquote"


def test_main_text(spark):
    rows = [(1, "http://Host.example/a", PAGE), (2, "http://host.example:80/b", PAGE), (2, "http://host.example:80/b", PAGE), (3, None, None), (4, "odd", ""), (None, "http://h/x", "<p>plain<p>text"), (5, "http://h/y", "<article><p>" + "w " * 40_000), (6, "http://h/z", "a < b & c")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, salt int")
    got = collections.Counter((r.page_id, r.url, r.text) for r in html.main_text(spark, df).collect())
    want = [TEXT, TEXT, TEXT, "", "", "plain\ntext", ("w " * 40_000).strip(), "a < b & c"]
    assert got == collections.Counter((*r[:2], t) for r, t in zip(rows, want, strict=True))
    assert html.main_text(spark, df.limit(0)).count() == 0


def test_template_of_pages_without_marks():
    rng = random.Random(0)

    def page():
        w = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
        body = [w(60), w(30)]
        source = f"<html><body><div><a>Home</a> <a>About us</a></div><div class='x'><h2>{body[0]}</h2><p>{body[1]}</div><div class=side>Read more {w(3)}</div><div>All rights of Foo</div></body></html>"
        return source, "\n".join(body)

    pages = [page() for _ in range(20)]
    assert html.extract([p for p, _ in pages]) == [t for _, t in pages]
    assert {"a", "d"} <= set(html.template([["a", "b", "c", "c", "d"], ["a", "x", "c", "c", "d"], ["a", "y", "c", "c", "d"]]))


def test_copies_of_a_page_stay_whole():
    source = "<body><div><p>one two three</p></div></body>"
    assert html.extract([source] * 10) == ["one two three"] * 10


def prose(rng, n):
    return " ".join(f"v{rng.randrange(900)}" for _ in range(n))


def test_template_inside_marked_articles():
    rng = random.Random(1)
    texts = [f"{prose(rng, 5)}\n{prose(rng, 40)}" for _ in range(12)]
    pages = ["<article><h1>{}</h1><div class=tools><a>Send it on</a></div><p>{}</p><div>Follow us for more news</div></article>".format(*t.split("\n")) for t in texts]
    assert html.extract(pages) == texts
    # copies under different menus, and near copies, stay whole
    same = [f"<nav>{prose(rng, 3)}</nav><article><h1>One</h1><p>{texts[0]}</p></article>" for _ in range(12)]
    assert html.extract(same) == ["One\n" + " ".join(texts[0].split())] * 12
    near = [f"<article><p>{texts[0]}</p><p>{texts[1]}</p><p>odd{k}</p></article>" for k in range(12)]
    assert html.extract(near) == ["\n".join([*(" ".join(t.split()) for t in texts[:2]), f"odd{k}"]) for k in range(12)]


def test_all_slots_of_pages_without_marks():
    rng = random.Random(2)
    pages, texts = [], []
    for _ in range(12):
        often = " ".join(w for w in ("and", "That", "is", "it") for _ in range(rng.randrange(1, 6)))
        intro, body, one, two = prose(rng, 40), f"{prose(rng, 60)} {often}", prose(rng, 1), prose(rng, 1)
        pages.append(f"<body><div>Home page</div><div class=intro><p>{intro}</p></div><div class=body><p>{body}</p><p><a>{one}</a> and <a>{two}</a></p><p>That is it.</p></div></body>")
        texts.append(f"{intro}\n{body}\n{one} and {two}\nThat is it.")
    assert html.extract(pages) == texts
    assert html.template([["a", "x", "b"], ["a", "b"], ["a", "x", "b"], ["a", "b", "c"]]) == ["a", "b"]
    assert set(html.template([["a", "t", "t", "b"], ["a", "t", "b", "t"], ["a", "t", "t", "b"], ["a", "t", "t", "b", "t"]])) == {"a", "b"}


@pytest.mark.parametrize("n", [65, 130, 200])
def test_no_page_of_a_host_is_left_without_template(spark, n):
    rng = random.Random(n)
    rows = [(k, f"http://h/{k}", f"<body><div>Home page</div><div><p>{prose(rng, 9)}</p></div></body>") for k in range(n)]
    got = html.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == n and not any("Home" in r.text for r in got)
    assert [len(w) for w in html.windows(list(range(65)))] == [32, 33] and [len(w) for w in html.windows(list(range(64)))] == [64]


def test_names_on_pages_that_mark_no_article():
    prose_ = "<p>We find that it is so in all of the cases that we have seen.</p>"
    for page, want in (
        (f'<div id="discussion"><h2>Discussion</h2>{prose_}</div>', "Discussion\nWe find that it is so in all of the cases that we have seen."),
        (f'<section class="related-work"><h2>Related work</h2>{prose_}</section>', "Related work\nWe find that it is so in all of the cases that we have seen."),
        (f'<div class="side-by-side">{prose_}</div>', "We find that it is so in all of the cases that we have seen."),
        (f'<div class="related"><a href="/a">One story</a> <a href="/b">Another</a></div>{prose_}', "We find that it is so in all of the cases that we have seen."),
        (f'<div class="cookie-notice">We use cookies on this site to serve you.</div><div class="comments"><p>I think so too.</p></div>{prose_}', "We find that it is so in all of the cases that we have seen."),
        ("<article><p>Let <math><mi>x</mi></math> be <object data='f.svg'>a figure</object> here.</p></article>", "Let x be a figure here."),
    ):
        assert html.extract([page]) == [want]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_templates_of_small_hosts(n):
    rng = random.Random(n)
    menu = "<div class=zz><a href=/>Home</a> <a href=/n>News of the day</a></div><div class=yy>All of it was made by us in the year</div>"
    texts = [prose(rng, 80) for _ in range(n)]
    pages = [f"<html><body>{menu}<div class=xx><p>{t}</p></div></body></html>" for t in texts]
    assert html.extract(pages) == texts
    near = [texts[0], *(f"{texts[0]} and {k} more" for k in range(n - 1))]  # near copies stay whole
    if n < 4:
        assert all(t in out for t, out in zip(near, html.extract([f"<html><body><div class=xx><p>{t}</p><p>{texts[1]}</p></div></body></html>" for t in near]), strict=True))


def test_names_inside_an_article():
    page = """<article><header class="entry-header"><h1><a href="/">Title</a></h1></header><section id="discussion"><h2>Discussion</h2><p>We find it so.</p></section><div class="related-work"><p>Others did too.</p></div>
<h2 id="sharing">Sharing</h2><section id="social-impact"><p>Large.</p></section><div id="sharing-economy"><p>It grew.</p></div>
<div class="social"><a>One</a> <a>Two</a></div><div class="related"><h3>Related</h3><ul><li><a>Some other page</a></ul></div><div class="ad-box"><p>Buy now</p></div><div id="comments"><h3>Two comments</h3><p>Nice!</p></div></article>"""
    assert html.extract([page]) == ["Title\nDiscussion\nWe find it so.\nOthers did too.\nSharing\nLarge.\nIt grew."]


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_go_by_text(spark, seed):
    """Different texts under one id, a near copy of either, repeated rows, and texts without ids."""
    rng = random.Random(seed)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = lambda t: " ".join(edited(rng, t.split(), 1))
    rows = [(1, a), (2, near(a)), (2, b), (3, near(b)), (None, e), (None, e), (None, near(e)), (None, None), (7, c), (7, d), (7, d), (8, c), (9, near(d)), (4, c + " x"), (4, c + " y"), (None, near(a))]
    want, docs = by_text(rows), spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(spark, docs).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter((i, want[t or ""][0]) for i, t in rows)
    assert sum(r.kept for r in got) == len({n for _, n in want.values()}) and all(r.doc_id == r.class_id for r in got if r.kept)
    left = minhash.drop_near_duplicates(spark, docs).collect()
    assert sorted(want[r.text or ""][1] for r in left) == sorted({n for _, n in want.values()})  # one row of each class, no class lost
    assert all(r.doc_id == want[r.text or ""][0] for r in left)
    assert {r.text for r in left if r.doc_id in (1, 2)} == {a, b}


def test_shapes_see_whole_words():
    shapes = quality.Shapes()
    for head, one, other in (("a" * 64, "b" * 200, "#7%" * 200), ("字" * 64, "字" * 300, "$" * 300), ("a1" * 6, "a" * 9, "$" * 9)):
        assert shapes(head + one) != shapes(head + other)
    assert sum(shapes("字" * 6400)[1]) > 1.5


def test_spellings_level_neighbouring_words(spark):
    rows = [(1, "Licence licence LICENCE"), (2, "license license license"), (3, "sub-licence, sub licence"), (4, "sublicense sublicense")]
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[3] == got[4] != got[1]


def test_mix_with_clashing_names_and_a_hot_null_id(spark):
    rows = [(None, f"w{n} " * 7, "s") for n in range(300)] + [(n, "a b c", "t") for n in range(200)] + [(None, None, None)] * 50
    docs = spark.createDataFrame([(*r, 1, 2, 3, [4], 5, 6, 7, 8) for r in rows], "doc_id long, text string, source string, offset int, quota int, _pos int, curve array<int>, source_size int, key int, n int, row int")
    plan = mixing.plan_mix(spark, docs).collect()
    taken = collections.Counter()
    for r in plan:
        taken[r.source] += r.taken
    assert len(plan) == 550 and taken["s"] == min(int(2700 / 3), 6300) and taken["t"] == 1800
    out = mixing.materialise(spark, docs)
    assert out.columns == docs.columns and out.where("row = 8 AND offset = 1").count() == out.count() > 0


def test_entire_licenses_with_title_and_holder(spark):
    bodies = dict((n, t) for n, t in licenses.KNOWN if "\n" in t)
    heads = ["MIT License\n\nCopyright (c) The Foo Authors\n\n", "The MIT License (MIT)\n(c) Jane Doe 2020\n", "Copyright © Jane Doe\n", "© Jane Doe 2020\nAll rights reserved.\n", ""]
    rows = [(k, h + bodies["MIT"]) for k, h in enumerate(heads)] + [(9, "ISC License\nCopyright The Bar\n" + bodies["ISC"]), (10, "MIT License\nCopyright (c) Foo"), (11, "Some words\n" + bodies["MIT"])]
    got = {r.doc_id: r.text_license for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: "MIT" for k in range(len(heads))} | {9: "ISC", 10: None, 11: None}


def test_license_columns_and_lines_behind(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    tail = "\n\nCopyright Jane Doe\n(c) 2020 John Roe\nAll rights reserved."
    long = "\n".join(f"Copyright {n} Jane Doe" for n in range(30_000))  # more lines than a pattern could nest
    texts = [mit, mit + tail, f"MIT License\n© Jane Doe\n{mit}{tail}", f"{long}\n{mit}\n{long}", f"{mit}\nand more", "Copyright Jane Doe", long, tail, None, mit.upper()]
    df = spark.createDataFrame([(t, n, "l", "d", "b", "y", "x", "r") for n, t in enumerate(texts)], "text string, n int, _lines string, _digest string, _b string, _body string, _license string, _row string")
    out = licenses.scan(spark, df)
    assert out.columns == [*df.columns, "canonical_sha256", "text_license", "notice_licenses"]
    got = {r.n: r for r in out.collect()}
    assert [got[n].text_license for n in range(len(texts))] == ["MIT", "MIT", "MIT", "MIT", None, None, None, None, None, "MIT"]
    assert all((r._lines, r._digest, r._b, r._body, r._license, r._row, r.text) == ("l", "d", "b", "y", "x", "r", texts[r.n]) for r in got.values())


def test_license_sql_knows_whole_texts(spark):
    """The SQL and the scan agree on whole licences, with what may stand in front of and behind them."""
    import duckdb

    known = dict(licenses.KNOWN[:3])
    files = [p.read_text() for p in pathlib.Path("/usr/share/common-licenses").glob("*") if p.is_file()] if pathlib.Path("/usr/share/common-licenses").exists() else []
    texts = [*known.values(), *(f"The {n} License\n\nCopyright (c) 2020 X\n{t}\nCopyright Y Z\n" for n, t in known.items()), *(f"© X\n{t}\n© Y" for t in known.values()), *files, "c 1999 x\nword\nc 2000", "", None, "Released under the MIT License.\nmore", "a\n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(licenses.SQL).fetchall()
    got = licenses.scan(spark, df).select("doc_id", "canonical_sha256", "text_license", F.array_join("notice_licenses", ",")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert sum(r.text_license is not None for r in got) >= 9


@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_entire_long_licenses(spark, name, file):
    path = pathlib.Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("the system has no licence texts")
    assert licenses.scan(spark, spark.createDataFrame([(path.read_text(),)], "text string")).first().text_license == name


def test_mix_of_whole_documents(spark):
    rows = [(n, " ".join(f"w{n}_{k}" for k in range(2 + n % 9)), "en", "abc"[n % 3]) for n in range(60)]
    docs = documents(spark, rows)
    out = mixing.materialise(spark, docs, whole=True).collect()
    assert {r.text for r in out} <= {r[1] for r in rows}
    words = collections.Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    for r in mixing.plan_mix(spark, docs).select("source", "quota").distinct().collect():
        assert abs(words[r.source] - r.quota) <= 5


def test_copies_are_spread_and_numbered(spark):
    out = common.each(spark.createDataFrame([("a", 1), ("b", 7), ("c", 3)], "x string, n long"), "n", "copy", chunk=3).collect()
    assert sorted((r.x, r.n, r.copy) for r in out) == sorted((x, n, c) for x, n in (("a", 1), ("b", 7), ("c", 3)) for c in range(n))


def test_rows_of_any_columns(spark):
    rows = [(1, "A", {"k": 1}, [1]), (1, "a", {"k": 2}, [2]), (2, "b", None, None), (None, None, {}, []), (None, "", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key map<string,int>, `_row` array<int>")
    for left in (exact_dedup.deduplicate(spark, docs), minhash.drop_near_duplicates(spark, docs)):
        assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in exact_dedup.deduplicate(spark, docs).collect()) == [(0, ""), (1, "a"), (2, "b")]


def test_index_is_opened_again(spark, tmp_path):
    """A later session, whose catalog is empty, goes on with the index, whatever number of buckets it would take."""
    folder = f"file://{tmp_path}"
    index = exact_dedup.DigestIndex(spark, "mine", 3, folder)
    index.ingest(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    other = spark.newSession()
    other.sql(f"DROP TABLE {index.table}")
    again = exact_dedup.DigestIndex(other, "mine", folder=folder)
    assert again.n_buckets == 3
    got = again.ingest(other.createDataFrame([(3, "A"), (4, "c")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {3: (1, False), 4: (4, True)}
    for n in range(20):  # files are bounded: it compacts by itself
        again.ingest(other.createDataFrame([(10 + n, f"text {n} {k}") for k in range(9)], "doc_id long, text string"))
    assert again.rows.files() <= 17 * 3 and other.table(again.table).count() == 183
    again.drop()
    assert not (tmp_path / "mine").exists()


def test_index_compacts_and_drops(spark):
    index = exact_dedup.new_index(spark)
    for n in range(3):
        index.ingest(spark.createDataFrame([(k, f"text {k % (5 + n)}") for k in range(20)], "doc_id long, text string")).collect()
    before = sorted(map(tuple, spark.table(index.table).collect()))
    index.compact()
    assert sorted(map(tuple, spark.table(index.table).collect())) == before and len(before) == 7
    again = index.ingest(spark.createDataFrame([(9, "text 1"), (11, "new")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in again} == {9: False, 11: True}
    index.drop()
    assert not spark.catalog.tableExists(index.table)
