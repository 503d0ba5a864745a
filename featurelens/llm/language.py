"""Language identification by script ranges and Viterbi spans (operator 6).

A word is a run of letters. Its score in each language is the sum of smoothed
log frequencies of its character trigrams (with word ends), learned from
labelled texts. The scripts of a word's letters narrow the languages it may
have: those that were seen in that script (all, where none was). A Viterbi
path over the words of a text, with a penalty for each change of language,
labels spans; the language with most letters is the text's, and the share of
its letters is the score.

Learning takes a sample of about ``train_docs`` labelled texts, chosen by a
digest of the id (the bound of the sample). The model has at most
2^16 + scripts entries a language, counted by Spark; its size does not grow
with the table.

Defined results: a text that is null or has no letter is ``und`` with score 0
and no spans. Ties between languages go to the alphabetically first. Rows with
null text or label don't train. If nothing trains, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm import chain
from featurelens.llm.columns import code_points, letter_table, lower_table, mix, ranges_index, runs, slices
from featurelens.llm.staging import prepare

UNKNOWN = "und"
FEATURES = 1 << 16

# First and last code point of the blocks of each script.
SCRIPTS: list[tuple[str, list[tuple[int, int]]]] = [
    ("latin", [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x0370, 0x03FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x0530, 0x058F)]),
    ("hebrew", [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x0900, 0x097F), (0xA8E0, 0xA8FF)]),
    ("bengali", [(0x0980, 0x09FF)]),
    ("gurmukhi", [(0x0A00, 0x0A7F)]),
    ("gujarati", [(0x0A80, 0x0AFF)]),
    ("tamil", [(0x0B80, 0x0BFF)]),
    ("telugu", [(0x0C00, 0x0C7F)]),
    ("kannada", [(0x0C80, 0x0CFF)]),
    ("malayalam", [(0x0D00, 0x0D7F)]),
    ("thai", [(0x0E00, 0x0E7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("han", [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
OTHER = len(SCRIPTS)


def script_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for i, (_, blocks) in enumerate(SCRIPTS):
        for a, b in blocks:
            table[a:b + 1] = i
    return table


class Words:
    """Words of a slice of texts, the trigram feature of every letter and its script."""

    _scripts: np.ndarray | None = None

    def __init__(self, column: pa.Array):
        points, offsets = code_points(column)
        self.base = offsets[:-1]
        self.starts, self.ends, self.row = runs(letter_table()[points], offsets)
        self.lens = self.ends - self.starts
        self.at = np.concatenate([[0], np.cumsum(self.lens)])
        where = ranges_index(self.starts, self.lens)
        letters = lower_table()[points[where]].astype(np.uint64)
        before = np.concatenate([[0], letters[:-1]]).astype(np.uint64)[:len(letters)]
        after = np.concatenate([letters[1:], [0]]).astype(np.uint64)[:len(letters)]
        if len(letters):
            before[self.at[:-1]] = 0
            after[self.at[1:] - 1] = 0
        with np.errstate(over="ignore"):
            code = mix(before * np.uint64(0x9E3779B97F4A7C15) + letters * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9))
        self.features = (code & np.uint64(FEATURES - 1)).astype(np.int32)
        if Words._scripts is None:
            Words._scripts = script_table()
        self.scripts = Words._scripts[points[where]]
        self.rows = len(column)
        self.offsets = np.searchsorted(self.row, np.arange(self.rows + 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x language, log frequencies
    allowed: np.ndarray  # script x language


def sample(labelled: DataFrame, id_col: str, size: int, seed: str) -> DataFrame:
    """About ``size`` rows, chosen by a digest of the id (all, where there are fewer)."""
    total = labelled.count()
    share = min(1.0, size / total) if total else 1.0
    steps = 1 << 52  # fine enough for any table
    return labelled.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(steps)) < int(share * steps))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 20_000,
          smoothing: float = 0.1, script_share: float = 0.001) -> Model:
    """Trigram frequencies and scripts of each language, counted over the sample's whole texts."""
    prepare(labelled.sparkSession)
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    picked = sample(usable.select(id_col, text_col, lang_col), id_col, train_docs, "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col))
                names, codes = np.unique(np.array(part.column(lang_col).to_pylist(), dtype=object).astype(str), return_inverse=True)
                lang = np.repeat(codes[words.row], words.lens)
                for values, width, first in ((words.features.astype(np.int64), FEATURES, 0), (words.scripts.astype(np.int64), OTHER + 1, FEATURES)):
                    counts = np.bincount(lang * width + values, minlength=1)
                    found = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array(names[found // width].astype(str).tolist(), pa.string()),
                        "feature": pa.array((found % width + first).astype(np.int32)), "n": pa.array(counts[found].astype(np.int64))})

    counts = (picked.select(text_col, lang_col).mapInArrow(count, "lang string, feature int, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    languages = sorted(counts["lang"].unique())
    table = np.zeros((FEATURES + OTHER + 1, max(1, len(languages))))
    table[counts["feature"].to_numpy(np.int64), pd.Categorical(counts["lang"], languages).codes] = counts["n"].to_numpy()
    grams, scripts = table[:FEATURES], table[FEATURES:]
    weights = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * FEATURES))
    allowed = scripts >= np.maximum(1, script_share * scripts.sum(axis=0))
    return Model(languages, np.asfortranarray(weights), allowed)


def spans(words: Words, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Language of every word, and letters of each language in every row."""
    k = len(model.languages)
    scores = np.zeros((len(words.lens), k))
    for j in range(k if len(words.lens) else 0):  # one language at a time keeps the arrays of letters small
        scores[:, j] = np.add.reduceat(model.weights[:, j][words.features], words.at[:-1])
    # scripts of a word as bits; few combinations occur
    bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), words.scripts.astype(np.int64)), words.at[:-1]) if len(words.lens) else np.zeros(0, np.int64)
    for b in np.unique(bits):
        mask = model.allowed[[i for i in range(OTHER + 1) if b >> i & 1]].any(axis=0)
        if mask.any() and not mask.all():
            scores[np.ix_(bits == b, ~mask)] -= 1e6
    path = chain.viterbi(scores, words.offsets, penalty)
    letters = np.bincount(words.row * k + path, weights=words.lens, minlength=words.rows * k).reshape(words.rows, k)
    return path, letters


def identify(df: DataFrame, model: Model, text_col: str = "text", penalty: float = 12.0, with_spans: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` (start, end in characters, lang) to every row."""
    prepare(df.sparkSession)
    new = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    if with_spans:
        new["lang_spans"] = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                                      T.StructField("lang", T.StringType())]))
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])
    names = schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most (2^16 + scripts) entries a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, text_col):
                have = dict(zip(part.schema.names, part.columns))
                if not model.languages:
                    pred, score, listed = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), [[]] * part.num_rows
                else:
                    words = Words(part.column(text_col))
                    path, letters = spans(words, model, penalty)
                    total = letters.sum(axis=1)
                    best = np.where(total > 0, letters.argmax(axis=1), len(model.languages))
                    pred = labels[best].tolist()
                    score = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
                    listed = _listed(words, path, labels) if with_spans else None
                have |= {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
                if with_spans:
                    have["lang_spans"] = pa.array(listed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                yield pa.RecordBatch.from_arrays([have[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def _listed(words: Words, path: np.ndarray, labels: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(words.rows)]
    if len(path) == 0:
        return out
    new = np.r_[True, (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(path)] - 1
    for a, b in zip(first, last):
        base = words.base[words.row[a]]
        out[words.row[a]].append({"start": int(words.starts[a] - base), "end": int(words.ends[b] - base), "lang": labels[path[a]]})
    return out


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
