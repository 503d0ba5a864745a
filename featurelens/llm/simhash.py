"""Components of documents with near SimHash fingerprints (operator 13).

A fingerprint has 64 bits: the majority of each bit over the XXH64 values (seed
42) of the text's shingles, repeats included. Documents link when fingerprints
differ in at most ``within`` bits.

1. *Embedding.* The fingerprint is cut into segments of ``SEGMENT_BITS`` bits; its
   point has the number of set bits of every segment. The Manhattan distance of
   two points is at most the number of bits that differ.
2. *Grid.* The axes are cut into ``2 * within`` blocks. Points within ``within``
   differ in at most so many blocks, so ``within`` of the blocks agree in all their
   coordinates: each choice of so many blocks gives a grid of its own, and a point
   lies in one cell of each. The range join is an equal join of cells, whose
   number depends on ``within`` alone (70 at 4), and no link can be lost.
3. *Cells.* Cells are sorted and streamed through tasks. Within a cell pairs are
   held against the Manhattan bound and then against the fingerprints; what comes
   out are edges of connected sets, not pairs.
4. *Crowded cells.* A cell of more than ``cell_rows`` points isn't compared. Its
   fingerprints give a row for every value within ``within / 2`` bits of them:
   those that share one are at most ``within`` bits apart, all of them, and any two
   that are so near share one. So a star on each value has the same components as
   all pairs have, with rows in proportion to the fingerprints.

Equal fingerprints are one point from the start, whatever their number.

Defined results: null and empty texts and those without words have fingerprint 0
and link like any other; texts of fewer words than a shingle hash their whole
sequence of words. Null ids lose to any other; a component of null ids only has
a null id. Repeated rows have a result each. An empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.columns import mix, slices
from featurelens.llm.staging import cut, prepare, text_or_empty
from featurelens.operators.density import connected_components
from featurelens.operators.sizes import broadcast_if_small

BITS = 64
SEGMENT_BITS = 2
SEED = 42
PIECE_BYTES = 1 << 20  # of a long text that are split into words at a time
CELL_ROWS = 4_096
FEW_IN_CELL = 32
FEW_VALUES = 4_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, some at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].lower().split()  # of bytes: A-Z and ASCII white space only
        at = end


def _shingles(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words (of all of them, if fewer)."""
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    spots = zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()) if len(words) >= n else [(0, len(line))]
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spots], np.uint64)


def fingerprint(text: bytes, n: int) -> int:
    """64-bit majority of a text's shingle hashes; 0 without words."""
    votes, total, carry = np.zeros(BITS, np.int64), 0, []

    def add(words: list[bytes]) -> int:
        hashes = _shingles(words, n)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            np.add(votes, np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64), out=votes)
        return len(hashes)

    for words in _words(text):
        carry += words
        if len(carry) >= n:
            total += add(carry)
            carry = carry[len(carry) - n + 1:]
    if not total and carry:
        total = add(carry)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """(_id, fp) of every row; ``fp`` is the fingerprint as a signed number."""
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in part.column("_t")]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["_id", "fp"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, fp long")


def points(fps: np.ndarray) -> np.ndarray:
    """Set bits of every segment, a row a fingerprint."""
    shifts = np.arange(0, BITS, SEGMENT_BITS, dtype=np.uint64)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1))


def cells(fps: np.ndarray, within: int) -> np.ndarray:
    """Names of the grid cells of every fingerprint, a column a grid."""
    blocks = np.array_split(points(fps).astype(np.uint64), 2 * within, axis=1)
    coordinates = [mix((b * (np.uint64(SEGMENT_BITS + 1) ** np.arange(b.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64) + np.uint64(1 + (i << 32)))
                   for i, b in enumerate(blocks)]
    with np.errstate(over="ignore"):
        return np.stack([mix(sum((coordinates[i] for i in chosen), np.zeros(len(fps), np.uint64)))
                         for chosen in combinations(range(2 * within), within)], axis=1)


def near(a: np.ndarray, b: np.ndarray, within: int) -> np.ndarray:
    """Whether fingerprints link: by the Manhattan distance of their points, then exactly."""
    found = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
        bound = np.abs(points(x).astype(np.int8) - points(y).astype(np.int8)).sum(axis=1) <= within
        found[at:at + (1 << 16)][bound] = np.bitwise_count(x[bound] ^ y[bound]) <= within
    return found


def edges_of(keys: np.ndarray, fps: np.ndarray, within: int) -> np.ndarray:
    """Edges (smaller, larger) that connect the links within sorted cells."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(keys)])
    size = np.repeat(sizes, sizes)
    out = []
    few = np.flatnonzero((size > 1) & (size <= FEW_IN_CELL))
    step = 1
    while len(few):
        few = few[few + step < len(keys)]
        few = few[keys[few + step] == keys[few]]
        linked = few[near(fps[few], fps[few + step], within)]
        out.append(np.stack([fps[linked], fps[linked + step]], axis=1))
        step += 1
    for a in starts[sizes > FEW_IN_CELL].tolist():
        out.append(_forest(fps[a:a + int(size[a])], within))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
    return np.unique(np.sort(found, axis=1), axis=0)


def _forest(fps: np.ndarray, within: int) -> np.ndarray:
    """One edge for each link that connects sets of a cell not yet connected."""
    parent = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        rest = i + 1 + np.flatnonzero(parent[i + 1:] != parent[i])
        for j in rest[near(np.full(len(rest), fps[i]), fps[rest], within)].tolist():
            if parent[j] != parent[i]:
                parent[parent == parent[j]] = parent[i]
                out.append((fps[i], fps[j]))
    return np.array(out, np.uint64).reshape(-1, 2)


def _masks(radius: int) -> list[int]:
    """All values of at most ``radius`` set bits, as signed numbers."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def crowded_edges(fps: DataFrame, within: int) -> DataFrame:
    """Edges (a, b) that connect all links among ``fps``, by stars on the values within half the distance."""
    masks = F.split(F.lit(",".join(map(str, _masks(within // 2)))), ",").cast("array<bigint>")  # folded to one constant
    rows = fps.select(F.col("fp").alias("a"), F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    heads = rows.groupBy("value").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(heads, "value").where("a <> b").select("a", "b").distinct()


def links(distinct: DataFrame, within: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) with the components of all links among distinct fingerprints (column ``fp``)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fps = batch.column("fp").slice(at, 1 << 14).to_numpy()
                keys = cells(fps.view(np.uint64), within)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]))], names=["cell", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            found = edges_of(keys, fps.view(np.uint64), within).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        def alone(fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("cell").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if crowded is not None:  # the rest of a cell that went over the limit before
                more = keys == crowded
                yield alone(fps[more])
                keys, fps = keys[~more], fps[~more]
            if not len(keys):
                continue
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.r_[starts, len(keys)])
            over = np.repeat(sizes > cell_rows, sizes)
            yield alone(fps[over])
            crowded = int(keys[-1]) if over[-1] else None
            ended = np.arange(len(keys)) < starts[-1]  # the last cell may go on
            yield edges(keys[ended & ~over], fps[ended & ~over])
            keys, fps = keys[~ended & ~over], fps[~ended & ~over]
        yield edges(keys, fps)

    placed = distinct.select("fp").mapInArrow(place, "cell long, fp long")
    found = cut(placed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(compare, "a long, b long"))
    edges = found.where("b IS NOT NULL").distinct()
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return edges if crowded.isEmpty() else edges.unionByName(crowded_edges(crowded, within))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, within: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links)."""
    if within not in (2, 4, 6) or n < 1:
        raise ValueError(f"within must be 2, 4 or 6 and n positive: {within}, {n}")
    prepare(df.sparkSession)
    rows = cut(fingerprints(df, id_col, text_col, n))
    distinct = cut(rows.groupBy("fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    linked = connected_components(links(distinct, within, cell_rows), "a", "b").select(F.col("_id").alias("fp"), "comp")
    nodes = cut(distinct.join(linked, "fp", "left").where("_n > 1 OR comp IS NOT NULL").select("fp", F.coalesce("comp", "fp").alias("comp"), "_least"))
    least = broadcast_if_small(nodes.groupBy("comp").agg(F.min("_least").alias("component_id")), limit=FEW_VALUES)
    shared = nodes.join(least, "comp").select("fp", "component_id", F.lit(True).alias("_shared"))
    shared = broadcast_if_small(shared, limit=FEW_VALUES)  # numbers; beyond the limit a shuffled join, whose hot keys the adaptive skew join splits
    found = rows.join(shared, "fp", "left")
    return found.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.when(F.col("_shared"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
