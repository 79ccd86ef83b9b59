"""Byte-level BPE with the tokenizers library over Arrow batches.

Ranks become a vocabulary and merges in the byte table's alphabet (each byte has
a printable character). A text is cut by the pattern; each distinct piece is
encoded by the library once and kept, while the task runs, in a bounded table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, read, small_batches

#: Pieces kept by a worker and characters of each, rows and characters in one go, and tokens of a text in one go: bounds on memory, not on texts.
MOST_PIECES, MOST_PIECE, ROWS, MOST_CHARS, MOST_TOKENS = 100_000, 32, 256, 1_000_000, 500_000


def byte_alphabet() -> list[str]:
    """The character for each byte: itself where it is printable Latin-1, else the next free one from 256."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Codec:
    """Encodes and decodes as the ranks say; equal to ranked byte-pair merging of each match of the pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        chars = byte_alphabet()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = _merged(token, ranks, rank) if len(token) > 1 else []
            if len(parts) == 2:
                merges.append((spell(parts[0]), spell(parts[1])))
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall
        byte_of = {c: b for b, c in enumerate(chars)}
        # reverses the byte table: all tokens' bytes in a row, and where each begins (length -1: no such token)
        bytes_of = {i: bytes(byte_of[c] for c in word) for word, i in self.model.get_vocab().items()}
        ids = range(max(bytes_of, default=-1) + 1)
        self.length = np.array([len(bytes_of[i]) if i in bytes_of else -1 for i in ids], np.int64)
        self.start = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.bytes = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in ids), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > MOST_CHARS:
            found, parts = self.pattern.finditer(texts[0]), []
            while some := [m[0] for m in islice(found, MOST_TOKENS)]:
                parts += self._join([some])
            return [b"".join(parts)]
        return self._join([self.find(t) if t else [] for t in texts])

    def _join(self, pieces: list[list[str]]) -> list[bytes]:
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, long = self.known, {}
        new = [*{p for ps in pieces for p in ps if p not in known}]
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            found = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, at = np.asarray(found.ids, "<u4").tobytes(), 0
            for p, end in zip(some, (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(some)))).tolist(), strict=True):
                (known if len(p) <= MOST_PIECE else long)[p] = ids[at:end]
                at = end
        get = (lambda p: known.get(p) or long[p]) if long else known.__getitem__
        return [b"".join(map(get, ps)) for ps in pieces]

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        out = self.length[ids] if not len(ids) or ids.max() < len(self.length) else np.full(1, -1)
        if (out < 0).any():
            raise KeyError("an id that the vocabulary lacks")
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids. A character split over tokens is whole again, as bytes are joined before any decoding."""
        all_, out = np.frombuffer(ids, "<u4"), []
        for i in range(0, len(all_), MOST_TOKENS):
            some = all_[i : i + MOST_TOKENS]
            n = self.lengths(some)
            ends = np.cumsum(n)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.start[some] - (ends - n), n)].tobytes())
        return b"".join(out)

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each token has a byte of; parts of one character share its place."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths(np.frombuffer(ids, "<u4")))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return char_of[starts], char_of[ends - 1] + 1


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The token's bytes merged with all ranks lower than its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=1)
def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One for each worker process: the vocabulary (some 30 MB) stays between tasks, known pieces don't."""
    return Codec(ranks_file, pattern)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ROWS rows and about MOST_CHARS bytes of text: a single long text is a part of its own."""
    from_ = 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    total = 0
    for i, n in enumerate(lengths):
        if i > from_ and (i - from_ >= ROWS or total + n > MOST_CHARS):
            yield batch.slice(from_, i - from_)
            from_, total = i, 0
        total += n
    if from_ < len(lengths):
        yield batch.slice(from_)


def load(spark: SparkSession, path: str):
    """The vocabulary's file, read on the driver and broadcast (about a megabyte, whatever the corpus)."""
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """The rows of ``docs`` with ids (binary: little-endian unsigned 32-bit integers) and, if asked for, starts and ends.

    Special tokens are ordinary text. Null and empty texts have no ids. Any
    length of text is encoded whole. Columns of ``docs`` named as the new ones
    are replaced; rows stay as they are, in any number. ``starts`` and ``ends`` count the text's characters.
    """
    added = [T.StructField("ids", T.BinaryType())] + [T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("starts", "ends") if with_offsets]
    docs = docs.drop(*[f.name for f in added])
    file = load(spark, ranks_path)

    def run(batches):
        c = codec(file.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                ids = c.encode(texts)
                out = [pa.array(ids, pa.binary())]
                if with_offsets:
                    both = [c.offsets(t or "", i) for t, i in zip(texts, ids, strict=True)]
                    out += [pa.array([x[k].tolist() for x in both], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[f.name for f in added]])
        c.known.clear()
        give_back()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` (with ids as from encode) with decoded (binary). Null ids decode to nothing; an unknown id raises KeyError."""
    encoded = encoded.drop("decoded")
    file = load(spark, ranks_path)

    def run(batches):
        c = codec(file.value, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                raw = pa.array([c.decode(i or b"") for i in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode_and_decode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with ids and decoded as encode and decode give them, in one worker and one pass."""
    fields = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "decoded")]
    names, file = [f.name for f in fields], load(spark, ranks_path)

    def run(batches):
        c = codec(file.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = c.encode(part.column(text_col).to_pylist())
                both = [pa.array(ids, pa.binary()), pa.array([c.decode(i) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *both], names=[*names, "ids", "decoded"])
        c.known.clear()
        give_back()

    return docs.mapInArrow(run, T.StructType([*fields, *[T.StructField(n, T.BinaryType()) for n in ("ids", "decoded")]]))


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    import public_tokenizers as tokenizers_

    path, pattern = tokenizers_.path("byte_bpe_multi_50k.tiktoken"), tokenizers_.PATTERN
    out = encode_and_decode(spark, docs.select("doc_id", "text"), path, pattern)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls, ties and repeated rows: see encode."""
    return round_trip(spark, read(spark, sf_dir, "documents"))
