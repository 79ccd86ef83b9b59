"""Token sequences in training order, as fixed-stride binary shards.

Documents are cut in sequences of token ids. A keyed Feistel permutation with
cycle-walking gives each sequence a global slot; slots are range-partitioned
and written as shards in which the sequence of a slot stands at a fixed offset, so that
training reads them in sequence and resumes anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load, slices
from .common import Stage, read, shared_dir

#: Tokens of a sequence, and the id that fills one up (free in the vocabulary, and no text has it).
LENGTH, PAD = 256, 50256
#: A sequence's number has so many bits for its document's id, for its text's hash and for its place in the text; numbers may be equal.
ID_BITS, TEXT_BITS, SEQ_BITS = 33, 12, 16
ID = np.dtype("<u2")
U = np.uint64


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The place of each index below n: a bijection of 0..n-1 onto itself that the key picks.

    A balanced Feistel network permutes the next power of four; a value that isn't below n is permuted again, until it is.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, bits = U((1 << half) - 1), U(half)
    keys = [U(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for k in keys:
            f = (right + k) * U(0x9E3779B97F4A7C15)
            f = (f ^ (f >> U(29))) * U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> U(32))) & mask)
        return (left << bits) | right

    out = once(index.astype(U))
    while (outside := np.flatnonzero(out >= U(n))).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes, pattern: str):
    """One for each worker process: a function from a text to its ids, without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return lambda text: encode(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder, under the name that Arrow has for it."""
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest if rest else uri)


def write(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, root: str, key: int = 1, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Writes the shards of ``docs`` (doc_id, text) under ``root`` and returns a row for each sequence: doc_id, seq (from 0), slot, shard, n_tokens.

    A sequence's number (document's id, counted from the least one, then some bits of its text's hash, and its place in the text) is permuted over the
    whole space of numbers; the permuted numbers are spread evenly, so the bounds of
    ``shards`` ranges are known beforehand, and a range sorted by them is a shard. Slots count the
    sequences in that order, from 0 without gaps: they follow from ids, texts and key alone, not from files, partitions or retries.
    Equal numbers (of one id, if texts' hashes agree or a text is very long, or of null ids, which go by the text's hash) are put in the order of hash, place and id. A shard holds ``length`` ids of two bytes for each sequence, little
    endian, a document's last one filled up with PAD; sequences.json says how many each has, so that a slot's place
    is known. Texts are encoded once, and only sequences move, once.

    A shard is written under another name and renamed when whole, so a task that
    is repeated after an executor is lost leaves the same file; what an earlier call left there and this one doesn't write is removed at the end.

    Ids of tokens that two bytes don't hold, and a vocabulary that uses PAD, raise ValueError. A document with no tokens (null or empty) has no sequence. Repeated rows are documents like any
    other; null ids stay null; other columns are ignored. No documents: no shards.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    file = load(spark, ranks_path)
    check_ids(file.value)
    n_shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width_of_ids = min((high or 0) - (low or 0) + 1, 1 << ID_BITS)
    space = 2 * width_of_ids << TEXT_BITS + SEQ_BITS  # in the second half, documents without an id
    width = -(-space // n_shards)

    def number(doc: int | None, text_hash: int, seq: np.ndarray) -> np.ndarray:
        d = (doc - low) % width_of_ids if doc is not None else width_of_ids + (text_hash >> TEXT_BITS) % width_of_ids
        return ((d << TEXT_BITS | text_hash % (1 << TEXT_BITS)) << SEQ_BITS) + seq % (1 << SEQ_BITS)

    def cut(batches):
        encode = encoder(file.value, pattern)
        for batch in batches:
            for piece in slices(batch, "text"):
                docs_, hashes, seqs, tokens, numbers = [], [], [], [], [np.zeros(0, np.int64)]
                for doc, text, h in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "hash")), strict=True):
                    row = encode(text).astype(ID).tobytes()
                    n = -(-len(row) // (2 * length))
                    docs_ += [doc] * n
                    hashes += [h] * n
                    seqs.append(np.arange(n))
                    tokens += [row[k : k + 2 * length] for k in range(0, len(row), 2 * length)]
                    numbers.append(number(doc, h, seqs[-1]))
                place = permute(np.concatenate(numbers), space, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((place // width).astype(np.int32)), pa.array(place), pa.array(hashes, pa.int64()), pa.array(docs_, pa.int64()), pa.array(np.concatenate(seqs).astype(np.int32)), pa.array(tokens, pa.binary())],
                    names=["shard", "place", "hash", "doc_id", "seq", "tokens"],
                )

    rows = docs.mapInArrow(cut, "shard int, place long, hash long, doc_id long, seq int, tokens binary")
    rows = rows.repartitionById(n_shards, "shard").sortWithinPartitions("place", "hash", "seq", "doc_id")

    def save(batches: Iterator[pa.RecordBatch]):
        out, at, fill = None, 0, np.full(length, PAD, ID).tobytes()
        for batch in batches:
            tokens = batch.column("tokens").to_pylist()
            if out is None and tokens:
                store, folder = _store(root)
                name, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{file_name(batch.column('shard')[0].as_py())}"
                out = store.open_output_stream(name)
            if tokens:
                out.write(b"".join(t + fill[len(t) :] for t in tokens))
            nth = pa.array(np.arange(at, at + len(tokens)))
            at += len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), batch.column("shard"), nth, pa.array([len(t) // 2 for t in tokens], pa.int32())], names=["doc_id", "seq", "shard", "nth", "n_tokens"])
        if out is not None:
            out.close()
            store.move(name, final)

    store, folder = _store(root)
    store.create_dir(folder, recursive=True)
    done = Stage(spark, "sequences").put(rows.mapInArrow(save, "doc_id long, seq int, shard int, nth long, n_tokens int"), "rows")
    counted = {r["shard"]: r["count"] for r in done.groupBy("shard").count().collect()}  # a row for each shard
    counts = [counted.get(k, 0) for k in range(n_shards)]
    written = {file_name(k) for k, n in enumerate(counts) if n}
    for old in store.get_file_info(fs.FileSelector(folder)):
        if old.base_name.startswith(("shard-", ".")) and old.base_name not in written:
            store.delete_file(old.path)
    with store.open_output_stream(f"{folder}/sequences.json") as f:
        f.write(json.dumps({"counts": counts, "length": length, "pad": PAD, "key": key, "dtype": ID.str}).encode())
    before = spark.createDataFrame([(k, int(n)) for k, n in enumerate(np.cumsum([0, *counts])[:-1])], "shard int, base long")
    return done.join(F.broadcast(before), "shard").select("doc_id", "seq", (F.col("base") + F.col("nth")).alias("slot"), "shard", "n_tokens")


def check_ids(ranks_file: bytes) -> None:
    ids = [int(line.split()[1]) for line in ranks_file.splitlines() if line.strip()]
    if max(ids, default=0) > np.iinfo(ID).max or PAD in ids:
        raise ValueError(f"a shard's ids have two bytes, and {PAD} fills sequences up: the vocabulary doesn't fit")


def file_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def describe(root: str) -> dict:
    store, folder = _store(root)
    with store.open_input_stream(f"{folder}/sequences.json") as f:
        return json.loads(f.read())


def sequences(root: str, start: int = 0) -> Iterator[np.ndarray]:
    """The sequences in training order from slot ``start`` on, without padding: what a reader that resumes does."""
    meta = describe(root)
    store, folder = _store(root)
    stride, ends = 2 * meta["length"], np.cumsum(meta["counts"])
    for shard in range(int(np.searchsorted(ends, start, side="right")), len(ends)):
        if n := meta["counts"][shard]:
            with store.open_input_file(f"{folder}/{file_name(shard)}") as f:
                f.seek(max(0, start - (int(ends[shard]) - n)) * stride)
                while raw := f.read(stride):
                    ids = np.frombuffer(raw, ID)
                    yield ids[ids != meta["pad"]]


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """slot, tokens (binary: ids of four bytes, little endian, without padding) of all shards."""
    meta = describe(root)
    ends = np.cumsum(meta["counts"]).tolist()
    todo = [(k, int(e - n)) for k, (n, e) in enumerate(zip(meta["counts"], ends, strict=True)) if n]

    def run(batches):
        store, folder = _store(root)
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{file_name(shard)}") as f:
                    at = base
                    while raw := f.read(2 * meta["length"] * 4096):
                        ids = np.frombuffer(raw, ID).reshape(-1, meta["length"])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), pa.array([x[x != meta["pad"]].astype("<u4").tobytes() for x in ids], pa.binary())], names=["slot", "tokens"])
                        at += len(ids)

    shards = spark.createDataFrame(todo, "shard int, base long").repartition(max(1, len(todo)))
    return shards.mapInArrow(run, "slot long, tokens binary")


def op7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as shards and read again: doc_id, seq, slot, shard, n_tokens, ids_sha256. Nulls, ties and repeated rows: see write."""
    import public_tokenizers as tokenizers_

    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    placed = write(spark, read(spark, sf_dir, "documents"), tokenizers_.path("byte_bpe_multi_50k.tiktoken"), tokenizers_.PATTERN, root)
    digests = read_back(spark, root).select("slot", F.sha2("tokens", 256).alias("ids_sha256"))
    return placed.hint("merge").join(digests, "slot").select("doc_id", "seq", "slot", "shard", "n_tokens", "ids_sha256")
