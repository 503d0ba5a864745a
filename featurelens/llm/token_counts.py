"""Token counts by a trie with shared unigram forward scores (operator 4).

A pre-token is a run of other characters than space, tab and line ends, with a
word-start mark before it. Its tokens are the pieces of a fixed vocabulary
with the greatest sum of unigram log probabilities (Viterbi forward scores).
Distinct pre-tokens go into a trie; the score and token count of a node depend
on the characters above it only, so each shared prefix is scored once, and the
node that ends a pre-token holds its counts. Documents sum the counts of their
pre-tokens.

The vocabulary is a public sentencepiece model; nothing is trained. Pieces of
that model are ordered by rank, so a piece of rank r (from 1) gets the Zipf log
probability -log(r + ``shift``), up to a constant that is the same for all.
Characters without a piece fall back to their UTF-8 bytes, one token a byte,
each as likely as the piece beyond the last. Ties go to fewer tokens.

The trie lives in a worker, is shared by its tasks and starts anew at
``TRIE_NODES`` nodes (a bound of memory, without any effect on counts). Pre-tokens
of more than ``LONG_WORD`` characters, such as texts of scripts without spaces,
share no prefixes worth keeping: the same scores are computed in a rolling window.

Defined results: null, empty and blank texts have no pre-tokens and count 0.
Repeated rows and words count each time. Other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featurelens.llm.columns import run_hashes, runs, slices, utf8
from featurelens.llm.staging import prepare

TRIE_NODES = 1_000_000
LONG_WORD = 1_000
MARK = "▁"  # fixed value: the vocabulary's sign for the start of a word


def pieces_of(model: bytes, shift: float = 2.7) -> tuple[dict[str, float], float]:
    """Log probability of every piece by its rank, and that of a fallback byte."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [i for i in range(processor.get_piece_size())
             if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
    plain.sort(key=lambda i: (-processor.get_score(i), i))
    return {processor.id_to_piece(i): -math.log(r + shift) for r, i in enumerate(plain, 1)}, -math.log(len(plain) + 1 + shift)


class Trie:
    """Pre-tokens with their best score and token count."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score = [0.0]
        self.tokens = [0]
        self.terminal: dict[int, tuple[int, float]] = {}  # hash of a pre-token -> its tokens and score

    def insert(self, word: str) -> int:
        """Add a pre-token; nodes that are there already are only walked."""
        path = [0]
        for end, char in enumerate(word, 1):
            step = (path[-1], char)
            node = self.children.get(step)
            if node is None:
                node = len(self.score)
                self.children[step] = node
                self._add(word, end, path)
            path.append(node)
        return path[-1]

    def rolling(self, word: str) -> tuple[int, float]:
        """Tokens and score of a long pre-token; only as many scores are kept as the longest piece reaches back."""
        score, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            first = end - len(score)  # the prefix that the oldest kept score is of
            own = len(word[end - 1].encode())
            best, count = score[-1] + own * self.byte_score, tokens[-1] + own
            for start in range(end - 1, first - 1, -1):
                p = self.pieces.get(word[start:end])
                if p is not None:
                    s, n = score[start - first] + p, tokens[start - first] + 1
                    if s > best + 1e-9 or (s > best - 1e-9 and n < count):
                        best, count = s, n
            score.append(best)
            tokens.append(count)
            if len(score) > self.longest:
                del score[0], tokens[0]
        return tokens[-1], score[-1]

    def _add(self, word: str, end: int, path: list[int]) -> None:
        own = len(word[end - 1].encode())
        best, count = self.score[path[end - 1]] + own * self.byte_score, self.tokens[path[end - 1]] + own
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            p = self.pieces.get(word[start:end])
            if p is not None:
                s, n = self.score[path[start]] + p, self.tokens[path[start]] + 1
                if s > best + 1e-9 or (s > best - 1e-9 and n < count):
                    best, count = s, n
        self.score.append(best)
        self.tokens.append(count)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and summed score of every text."""
        data, offsets = utf8(column)
        starts, ends, row = runs((data != 0x20) & ((data < 0x09) | (data > 0x0D)), offsets)
        keys, sample, codes = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        tokens, scores = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float64)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), starts[sample].tolist(), ends[sample].tolist())):
            found = self.terminal.get(key)
            if found is None:
                if len(self.score) > TRIE_NODES:
                    self.clear()
                word = MARK + bytes(data[a:b]).decode("utf-8")
                if len(word) > LONG_WORD:
                    found = self.rolling(word)
                else:
                    node = self.insert(word)
                    found = (self.tokens[node], self.score[node])
                self.terminal[key] = found
            tokens[i], scores[i] = found
        rows = len(column)
        per_row = [np.bincount(row, minlength=rows)] + [
            np.bincount(row, weights=x[codes], minlength=rows) if len(codes) else np.zeros(rows) for x in (tokens, scores)]
        return per_row[0].astype(np.int64), per_row[1].astype(np.int64), per_row[2]


_TRIES: dict[bytes, Trie] = {}


def _trie(model: bytes) -> Trie:
    """The worker's trie for a vocabulary."""
    if model not in _TRIES:
        _TRIES.clear()
        _TRIES[model] = Trie(*pieces_of(model))
    return _TRIES[model]


def count(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_pretokens``, ``n_tokens`` and ``token_score`` to every row."""
    prepare(df.sparkSession)
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file
    new = {"n_pretokens": T.LongType(), "n_tokens": T.LongType(), "token_score": T.DoubleType()}
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                found = dict(zip(new, map(pa.array, trie.count(part.column(text_col)))))
                have = dict(zip(part.schema.names, part.columns)) | found
                yield pa.RecordBatch.from_arrays([have[c] for c in names], names=names)

    return df.mapInArrow(run, schema)
