"""Byte-level BPE encoding and decoding (operator 3).

Encoding runs the ``tokenizers`` library over Arrow batches. A rank file
(base64 token and rank a line) gives the vocabulary; its merges are recovered
from the ranks, and tokens are written in the library's alphabet of one
printable character a byte. The pre-tokeniser pattern is applied to a whole
slice of texts at once on arrays of character classes; each distinct piece
goes through the library once per worker and is then copied by index.
Decoding reverses the alphabet: bytes of all tokens of a row are joined first
and only then read as UTF-8, so characters split over tokens come back whole.

Defined results: null and empty texts have no tokens and decode to no bytes;
ids outside the vocabulary raise ``ValueError``; null ids arrays decode to
null; every other column is kept as it is, and output columns replace input
columns of the same name. Rows are independent: ties, repeated rows and empty
tables need no rule. Pieces are told apart by a 64-bit hash within one worker's
cache (at most ``CACHE_PIECES`` entries: a chance of about 1e-8 of any clash).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm.columns import letter_table, ranges_index, run_hashes, slices, utf8
from featurelens.llm.staging import prepare

CACHE_PIECES = 400_000

# The white space of Unicode's White_Space property and the contractions of the pattern.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two tokens whose merge makes ``token``: what the lower ranks leave of its bytes."""
    own, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


def library_json(ranks: dict[bytes, int]) -> str:
    """The rank vocabulary as a serialised ``tokenizers`` BPE model without a pattern of its own."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    alphabet = byte_alphabet()

    def spell(token: bytes) -> str:
        return "".join(alphabet[b] for b in token)

    by_rank = sorted(ranks, key=ranks.get)
    pairs = [p for p in (_parts(t, ranks) for t in by_rank if len(t) > 1) if len(p) == 2]
    model = models.BPE(vocab={spell(t): ranks[t] for t in by_rank}, merges=[(spell(a), spell(b)) for a, b in pairs],
                       ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point for the pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    numeric = np.fromiter(map(str.isnumeric, map(chr, range(0x110000))), bool, 0x110000)
    import unicodedata

    for i in np.flatnonzero(numeric):  # numeric ideographs are letters
        if unicodedata.category(chr(i))[0] == "N":
            table[i] = NUMBER
    table[letter_table()] = LETTER
    for a, b in WHITE_SPACE:
        table[a:b + 1] = SPACE
    return table


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions (in code points) at which the pattern's matches begin, for all texts at once.

    The matches tile a text. A run of one class is a match, with a plain space
    before it; of white space before other text the last character stands
    alone or joins what follows; an apostrophe that is not joined to a space
    takes the letters of a contraction.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    new = first[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    plain = points == 0x20
    start = new.copy()
    # the last white space before other text of the same row begins a match
    before = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:-1]) if n > 1 else np.zeros(0, np.int64)
    start[before] = True
    joined = before[plain[before]]
    start[joined + 1] = False
    # contractions: an apostrophe run of length one, not joined to a space, before letters
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    one = np.isin(points[quote + 1], [ord(c) for c in CONTRACTIONS_1])
    two = np.zeros(len(quote), bool)
    room = quote + 2 < n
    second = np.where(room, quote + 2, 0)
    room &= ~first[second] & (kind[second] == LETTER)
    for a, b in CONTRACTIONS_2:
        two |= room & (points[quote + 1] == ord(a)) & (points[second] == ord(b))
    taken = np.where(one, 2, np.where(two, 3, 0))
    start[quote[taken > 0] + 1] = False
    end = (quote + taken)[taken > 0]
    end = end[end < n]
    end = end[(kind[end] == LETTER) & ~first[end]]
    start[end] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes slices of texts; keeps the tokens of recent pieces."""

    def __init__(self, library: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(library)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)  # a piece is a "word"
        n = len(self.known)
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.int32)])
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(keys))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and token ids."""
        data, byte_offsets = utf8(column)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        offsets = np.searchsorted(lead, byte_offsets)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, offsets)
        lead = np.r_[lead, len(data)]
        a, b = lead[starts], lead[np.r_[starts[1:], len(points)][:len(starts)]]
        keys, sample, codes = np.unique(run_hashes(data, a, b), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > CACHE_PIECES:
            self._clear()
        listed = keys.tolist()
        fresh = [i for i, k in enumerate(listed) if k not in self.known]
        if fresh:
            raw = data.tobytes()
            self._learn([listed[i] for i in fresh],
                        [raw[s:e].decode("utf-8") for s, e in zip(a[sample[fresh]].tolist(), b[sample[fresh]].tolist())])
        place = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))[codes]
        counts = self.at[place + 1] - self.at[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ends[np.searchsorted(starts, offsets)], self.ids[ranges_index(self.at[place], counts)]


@lru_cache(maxsize=1)
def _encoder(library: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(library)


class Decoder:
    """Bytes of token ids, from the vocabulary in the library's alphabet."""

    def __init__(self, library: str):
        from tokenizers import Tokenizer

        reverse = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = Tokenizer.from_str(library).get_vocab()
        size = max(vocab.values()) + 1
        tokens = [b""] * size
        self.valid = np.zeros(size, bool)
        for spelled, i in vocab.items():
            tokens[i] = bytes(reverse[c] for c in spelled)
            self.valid[i] = True
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets in bytes and the bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens) or not self.valid[ids].all()):
            raise ValueError("token id outside the vocabulary")
        lens = self.lens[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ends[offsets], self.flat[ranges_index(self.at[ids], lens)]


    def spans(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every token in characters of its text: bytes mapped to the characters they belong to."""
        rows, data = self.decode(offsets, ids)
        lead = (data & 0xC0) != 0x80
        character = np.cumsum(lead) - 1
        ends = np.cumsum(self.lens[ids])
        base = np.repeat(np.concatenate([[0], np.cumsum(lead)])[rows[:-1]], np.diff(offsets))
        return character[ends - self.lens[ids]] - base, character[ends - 1] + 1 - base


def _large_binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1,
                                            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _with(batch: pa.RecordBatch, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns)) | new
    return pa.RecordBatch.from_arrays([have[n] for n in names], names=names)


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in new]
    return T.StructType(fields + [T.StructField(n, t) for n, t in new.items()])


def _distinct_names(df: DataFrame) -> None:
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"column names repeat: {df.columns}")


_IDS = T.ArrayType(T.IntegerType(), False)


def _library(df: DataFrame, ranks_path: str):
    prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(library_json(read_ranks(ranks_path)))  # the vocabulary file's size


def encode(df: DataFrame, ranks_path: str, column: str = "text", with_offsets: bool = False) -> DataFrame:
    """Add ``ids`` (and ``token_start``, ``token_end`` in characters of the text) to every row.

    A token that holds part of a character spans that whole character.
    """
    _distinct_names(df)
    shared = _library(df, ranks_path)
    new = {"ids": _IDS} | ({"token_start": _IDS, "token_end": _IDS} if with_offsets else {})
    schema = _schema(df, **new)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        decoder = Decoder(shared.value) if with_offsets else None
        for batch in batches:
            for part in slices(batch, column):
                rows, ids = encoder.encode(part.column(column))
                out = {"ids": _lists(rows, pa.array(ids))}
                if with_offsets:
                    a, b = decoder.spans(rows, ids)
                    out |= {"token_start": _lists(rows, pa.array(a.astype(np.int32))), "token_end": _lists(rows, pa.array(b.astype(np.int32)))}
                yield _with(part, names, **out)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, column: str = "ids") -> DataFrame:
    """Add ``decoded`` (the bytes of the ids) and ``decoded_text`` (read as UTF-8, bad bytes replaced)."""
    _distinct_names(df)
    shared = _library(df, ranks_path)
    schema = _schema(df, decoded=T.BinaryType(), decoded_text=T.StringType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(column)
            raw = decoder.decode(*_flat(lists))
            decoded = _large_binary(*raw).to_pylist()
            gone = lists.is_null().to_pylist()
            decoded = [None if g else d for g, d in zip(gone, decoded)]
            yield _with(batch, names, decoded=pa.array(decoded, pa.binary()),
                        decoded_text=pa.array([None if d is None else d.decode("utf-8", "replace") for d in decoded], pa.string()))

    return df.mapInArrow(run, schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and values of a list column; a null list counts as empty."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts.astype(np.int64))]), values


def round_trip(df: DataFrame, ranks_path: str, column: str = "text") -> DataFrame:
    """``ids`` and ``decoded`` of every row in one pass: the encoder's ids go through the decoder."""
    _distinct_names(df)
    shared = _library(df, ranks_path)
    schema = _schema(df, ids=_IDS, decoded=T.BinaryType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for part in slices(batch, column):
                rows, ids = encoder.encode(part.column(column))
                yield _with(part, names, ids=_lists(rows, pa.array(ids)), decoded=_large_binary(*decoder.decode(rows, ids)))

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ``round_trip``'s columns."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
