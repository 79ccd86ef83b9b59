"""Fill-in-middle: documents cut in prefix, middle and suffix, and put in another order behind sentinels.

The tokenizers library's Split pre-tokenizer, with matches isolated, gives the
code-point offsets of a text's units without any training. The number of offsets
is the text's length in units, and two offsets, picked by rank, are the cuts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import give_back, read, small_batches

#: Units: a word with the white space before it, or white space at the end.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that the library gets at a time: it makes an object of each unit, so this bounds memory, not texts.
MOST_CHARS = 200_000
#: A unit ends where white space follows a word, so a text may be cut there without any change to its units.
_EDGE = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


class Units:
    def __init__(self, pattern: str = UNITS) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str

    def ends(self, text: str) -> np.ndarray:
        """Where each unit ends, in code points; the last is the text's length."""
        out, at = [np.zeros(0, np.int64)], 0
        while at < len(text):
            edge = _EDGE.search(text, at + MOST_CHARS) if len(text) - at > MOST_CHARS else None
            end = edge.end() if edge else len(text)
            out.append(np.array([e for _, (_, e) in self.split(text[at:end])], np.int64) + at)
            at = end
        return np.concatenate(out)


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """The first four groups of eight hex digits of the digest of seed and id; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def cut(ends: np.ndarray, h1: int, h2: int) -> tuple[int, int]:
    """Code points before the middle and before the suffix: the offsets of the two ranks that the numbers pick among 0..n."""
    n = len(ends)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    return (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)


def transform(spark: SparkSession, docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with n (units), form, prefix_chars, middle_chars and output.

    ``rate`` of 100 texts are cut, of these ``spm`` of 100 with the suffix first; which ones, and where, follows from seed and id alone.
    Empty and null texts, and texts that hold a sentinel, stay plain: output is the text (empty for null), and there are no lengths. Null ids
    draw as an id without digits. Rows of one id draw the same numbers; equal rows give equal results. Texts of any length are cut whole.
    Columns of ``docs`` named as the new ones are replaced; rows stay, in any number.
    """
    small_batches(spark)
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    docs = docs.drop(*[f.name for f in added])

    def one(units: Units, doc_id: int | None, text: str) -> tuple:
        ends, (h1, h2, h3, h4) = units.ends(text), draws(seed, doc_id)
        if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return len(ends), "plain", None, None, text
        a, b = cut(ends, h1, h2)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches):
        units = Units()
        for batch in batches:
            for part in slices(batch, text_col):
                ids, texts = part.column(id_col).to_pylist(), part.column(text_col).to_pylist()
                rows = [one(units, i, t or "") for i, t in zip(ids, texts, strict=True)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *[f.name for f in added]])
        give_back()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that output and form were made of. A cut text holds no sentinel of its own, so each stands once in its output."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    middle = F.substring_index(out, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256. Nulls, ties and repeated rows: see transform."""
    out = transform(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
