"""Toxic spans by a linear-chain conditional random field (operator 8).

Tokens are runs of letters, lower-cased; each is *offending* or *other*.
Labels come on documents, so tokens are labelled first: a greedy cover picks
words and word beginnings that occur in many toxic documents not covered yet
and hardly in clean ones, until the rest adds too little; tokens of toxic
documents with a picked feature are offending, all others are not. The field
(hashed features of the word, its beginnings and its end, and transitions) is
then fitted to those labels by its exact gradient, expected less observed
counts, from forward-backward passes.

A text's score is the chance that at least one token offends, from the
marginals (those under ``floor`` count as nothing), and the offending
offsets are the runs of tokens with a marginal of one half or more.

Fitting takes at most about ``train_docs`` documents of each label, chosen by a
digest of the id (the bound of the sample), in one task; scoring is row by row.

Defined results: null and empty texts and texts without letters score 0 and
have no spans. Rows with null text or label don't train; if no document of
either label trains, all scores are 0. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm import chain
from featurelens.llm.columns import code_points, letter_table, lower_table, mix, run_hashes, runs, slices
from featurelens.llm.language import sample
from featurelens.llm.staging import prepare

BITS = 18
BEGINNINGS = (3, 4, 5, 6, 7, 8)


@dataclass
class Field:
    weights: np.ndarray  # hashed feature -> weight of "offending" against "other"
    bias: float
    transition: np.ndarray  # 2 x 2 factors


class Tokens:
    """Tokens of a slice of texts with their feature hashes (word, beginnings, end)."""

    def __init__(self, column: pa.Array):
        points, offsets = code_points(column)
        self.base = offsets[:-1]
        self.starts, self.ends, self.row = runs(letter_table()[points], offsets)
        low = lower_table()[points]
        n = self.ends - self.starts
        found = [run_hashes(low, self.starts, self.ends)]
        for k in BEGINNINGS:
            found.append(np.where(n >= k, run_hashes(low, self.starts, np.minimum(self.ends, self.starts + k)) ^ np.uint64(k), found[0]))
        found.append(run_hashes(low, np.maximum(self.starts, self.ends - 3), self.ends) ^ np.uint64(1 << 20))
        self.features = np.stack([mix(h) for h in found], axis=1)
        self.rows = len(column)
        self.offsets = np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashed(self) -> np.ndarray:
        return (self.features >> np.uint64(64 - BITS)).astype(np.int64)


def offending_features(tokens: Tokens, toxic: np.ndarray, least_share: float, clean_weight: float, depth: int = 2) -> np.ndarray:
    """Greedy cover of the toxic rows, ``depth`` times each, by features that clean rows hardly have."""
    rows, found = [], []
    for j in range(1 + len(BEGINNINGS)):  # ends of words are too common to mark anything
        rows.append(tokens.row)
        found.append(tokens.features[:, j])
    values, codes = np.unique(np.concatenate(found), return_inverse=True)
    pairs = np.unique(codes.astype(np.int64) * tokens.rows + np.concatenate(rows))
    feature, row = pairs // tokens.rows, pairs % tokens.rows
    clean = np.bincount(feature[~toxic[row]], minlength=len(values))
    feature, row = feature[toxic[row]], row[toxic[row]]
    least = max(3, int(np.ceil(least_share * toxic.sum())))
    wide = np.bincount(feature, minlength=len(values)) >= least + clean_weight * clean
    keep = wide[feature]
    feature, row = feature[keep], row[keep]
    picked: list[int] = []
    seen = np.zeros(tokens.rows, np.int64)
    while len(feature):
        gain = np.bincount(feature, minlength=len(values)) - clean_weight * clean
        best = int(gain.argmax())
        if gain[best] < least:
            break
        picked.append(best)
        seen[row[feature == best]] += 1
        keep = (seen[row] < depth) & (feature != best)
        feature, row = feature[keep], row[keep]
    return values[picked]


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 25, rate: float = 0.5, l2: float = 1e-3,
        least_share: float = 0.01, clean_weight: float = 5.0) -> Field:
    """Fit the field to the documents by adaptive gradient steps on the mean log-likelihood."""
    tokens = Tokens(texts)
    marks = offending_features(tokens, toxic, least_share, clean_weight)
    label = np.isin(tokens.features[:, :1 + len(BEGINNINGS)], marks).any(axis=1) & toxic[tokens.row]
    weights, bias, trans = np.zeros(1 << BITS), -2.0, np.zeros((2, 2))
    sums = np.full((1 << BITS) + 5, 1e-8)
    if not len(label) or not label.any():
        return Field(weights, -50.0, np.ones((2, 2)))
    hashed = tokens.hashed()
    first = np.zeros(len(label), bool)
    first[tokens.offsets[:-1][np.diff(tokens.offsets) > 0]] = True
    previous = np.r_[0, label[:-1].astype(int)]
    previous[first] = 0
    seen = np.bincount(previous * 2 + label, minlength=4).reshape(2, 2)
    observed = np.bincount(hashed[label].ravel(), minlength=1 << BITS)
    scale = 1.0 / max(1, int(label.sum()))
    for _ in range(rounds):
        score = weights[hashed].sum(axis=1) + bias
        factors = np.stack([np.ones(len(score)), np.exp(np.clip(score, -50, 50))], axis=1)
        p, edges = chain.marginals(factors, np.exp(trans), tokens.offsets)
        some = p[:, 1] > 1e-6
        expected = np.bincount(hashed[some].ravel(), weights=np.repeat(p[some, 1], hashed.shape[1]), minlength=1 << BITS)
        grad = np.concatenate([(observed - expected) * scale - l2 * weights, [(label.sum() - p[:, 1].sum()) * scale], ((seen - edges) * scale).ravel()])
        sums += grad * grad
        step = rate * grad / np.sqrt(sums)
        weights, bias, trans = weights + step[:1 << BITS], bias + step[1 << BITS], trans + step[-4:].reshape(2, 2)
    return Field(weights, float(bias), np.exp(trans))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 800, **fitting) -> Field:
    """Fit on about ``train_docs`` rows of each label (1 and 0)."""
    prepare(labelled.sparkSession)
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, text_col, F.col(label_col).cast("int").alias("_y"))
    picked = None
    for y in (0, 1):
        part = sample(usable.where(F.col("_y") == y), id_col, train_docs, "toxicity")
        picked = part if picked is None else picked.unionByName(part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        field = fit(pa.array(pdf[text_col].tolist(), pa.string()), pdf["_y"].to_numpy() == 1, **fitting)
        at = np.flatnonzero(field.weights)
        return pd.DataFrame({"slot": np.r_[at, [-1], range(-5, -1)].astype(np.int64), "value": np.r_[field.weights[at], field.bias, field.transition.ravel()]})

    rows = picked.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "slot long, value double").toArrow().to_pandas()  # 2^18 weights at most
    slots, values = rows["slot"].to_numpy(), rows["value"].to_numpy()
    weights = np.zeros(1 << BITS)
    weights[slots[slots >= 0]] = values[slots >= 0]
    if not (slots < 0).any():
        return Field(weights, -50.0, np.ones((2, 2)))
    rest = dict(zip(slots[slots < 0].tolist(), values[slots < 0].tolist()))
    return Field(weights, rest[-1], np.array([rest[i] for i in range(-5, -1)]).reshape(2, 2))


def tag(tokens: Tokens, field: Field) -> np.ndarray:
    """Chance of every token to offend."""
    score = np.clip(field.weights[tokens.hashed()].sum(axis=1) + field.bias, -50, 50)
    p, _ = chain.marginals(np.stack([np.ones(len(score)), np.exp(score)], axis=1), field.transition, tokens.offsets, edges=False)
    return p[:, 1]


def score(df: DataFrame, field: Field, text_col: str = "text", floor: float = 0.1, with_spans: bool = False) -> DataFrame:
    """Add ``score`` and, if asked for, ``toxic_spans`` (start, end in characters) to every row."""
    prepare(df.sparkSession)
    new = {"score": T.DoubleType()}
    if with_spans:
        new["toxic_spans"] = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])
    names = schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(field)  # 2^18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                tokens = Tokens(part.column(text_col))
                p = tag(tokens, field)
                clean = np.where(p >= floor, np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0)
                have = dict(zip(part.schema.names, part.columns))
                have["score"] = pa.array(1.0 - np.exp(np.bincount(tokens.row, weights=clean, minlength=tokens.rows)))
                if with_spans:
                    have["toxic_spans"] = pa.array(_spans(tokens, p >= 0.5), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([have[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def _spans(tokens: Tokens, offends: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(tokens.rows)]
    at = np.flatnonzero(offends)
    if len(at) == 0:
        return out
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(tokens.row[at]) != 0)]
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    for a, b in zip(first, last):
        base = tokens.base[tokens.row[a]]
        out[tokens.row[a]].append({"start": int(tokens.starts[a] - base), "end": int(tokens.ends[b] - base)})
    return out
