"""Benchmark passages in documents by the q-gram lemma (operator 7).

Texts and items are lower-cased and runs of white space become one space. An
item of m characters may differ from a place in a text by k edits:
``edit_share`` of its length, and no more than leaves the lemma a bound of one
shared q-gram. Such a place shares at least m + 1 - q - k * q of the item's
q-grams, all on diagonals (place in text less place in item) of a strip 2k + 1
wide. Shared q-grams are counted in overlapping bands of diagonals, twice that
width and one width apart, so that some band holds the whole strip; bands that
meet the bound are kept, and the item is aligned to the text within the band
(free start and end in the text). A place within the budget is a match.

Items are read in blocks of about ``block_chars`` characters, each sent to the
tasks (that is the bound of what is broadcast), whatever the size of the
benchmark; documents are scanned once a block and never shuffled. Hits of very
frequent q-grams are laid out ``MATCH_HITS`` at a time and added up by band.

Defined results: null and empty texts and items match nothing; items shorter
than q match where they occur unchanged. Places of one item that overlap are
one match, with the fewest edits (then the leftmost). Item ids are integers or
null. Items that repeat match one by one; repeated documents repeat their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.bpe import WHITE_SPACE
from featurelens.llm.columns import code_points, lower_table, mix, ranges_index, slices
from featurelens.llm.staging import prepare

MATCH_HITS = 1_000_000
ALIGN_BANDS = 2_048
FILTER_BITS = 22
_SEED = np.uint64(0xD1342543DE82EF95)


def _space() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for a, b in WHITE_SPACE:
        table[a:b + 1] = True
    return table


_SPACE: np.ndarray | None = None


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points after normalisation, row offsets, and the place of each in its original text."""
    global _SPACE
    if _SPACE is None:
        _SPACE = _space()
    points, offsets = code_points(column)
    blank = _SPACE[points]
    keep = ~blank
    if len(points):  # of a run of white space the last one stays
        keep[:-1] |= blank[:-1] & ~blank[1:]
        keep[offsets[1:][offsets[1:] > 0] - 1] = True
    kept = np.flatnonzero(keep)
    out = np.where(blank[kept], np.uint32(0x20), lower_table()[points[kept]])
    at = np.searchsorted(kept, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    return out, at, kept - offsets[row]


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q code points from every position (by doubling)."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width = _SEED, 1
        have = mix(points.astype(np.uint64) + np.uint64(1))
        done, length = None, 0
        left = q
        while left:
            if left & 1:
                done = have if done is None else _join(done, length, have, width)
                length += width
            left >>= 1
            if left:
                have = have[:-width] * power + have[width:]
                power, width = power * power, width * 2
        return mix(done[:n])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_SEED), n, 1 << 64))


def _join(first: np.ndarray, length: int, second: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``length`` symbols followed by ``width`` more."""
    n = min(len(first), len(second) - length)
    return first[:n] * _power(width) + second[length:length + n]


class Items:
    """A block of benchmark items and the index of their q-grams."""

    def __init__(self, ids: list, texts: list[str | None], q: int, edit_share: float):
        points, at, _ = normalised(pa.array(texts, pa.string()))
        some = [i for i in range(len(ids)) if at[i + 1] > at[i]]
        texts_of = [_strip(points[at[i]:at[i + 1]]) for i in some]
        some = [(i, t) for i, t in zip(some, texts_of) if len(t)]
        self.ids = [ids[i] for i, _ in some]
        self.points = [t for _, t in some]
        self.q = q
        self.m = np.array([len(t) for t in self.points], np.int64)
        self.k = np.maximum(0, np.minimum(np.floor(edit_share * self.m), (self.m - q) // q)).astype(np.int64)
        self.least = np.maximum(1, self.m + 1 - q - self.k * q)
        self.by_length = {}
        for length in sorted({min(q, int(m)) for m in self.m}):
            which = [i for i, m in enumerate(self.m) if min(q, int(m)) == length]
            hashes = [gram_hashes(self.points[i], length) for i in which]
            owner = np.repeat(which, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            values, first = np.unique(h[order], return_index=True)
            table = np.zeros(1 << FILTER_BITS, bool)
            table[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_length[length] = (values, np.r_[first, len(h)], owner[order], place[order], table)


def _strip(points: np.ndarray) -> np.ndarray:
    a, b = 0, len(points)
    while a < b and points[a] == 0x20:
        a += 1
    while b > a and points[b - 1] == 0x20:
        b -= 1
    return points[a:b]


def find(points: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """Matches (row, item, start, end, edits) of a slice in normalised positions."""
    out = []
    for length, (values, first, owner, place, table) in items.by_length.items():
        h = gram_hashes(points, length)
        if not len(h):
            continue
        spot = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        code = np.searchsorted(values, h[spot])
        code[code == len(values)] = 0
        hit = values[code] == h[spot]
        spot, code = spot[hit], code[hit]
        row = np.searchsorted(at, spot, side="right") - 1
        inside = spot + length <= at[row + 1]
        spot, code, row = spot[inside], code[inside], row[inside]
        counts = first[code + 1] - first[code]
        # rows in groups of a bounded number of hits; a row beyond that counts run after run of its places
        total = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.searchsorted(row, np.arange(len(at)))
        a = 0
        while a < len(at) - 1:
            b = a + 1
            while b < len(at) - 1 and total[cuts[b + 1]] - total[cuts[a]] <= MATCH_HITS:
                b += 1
            if total[cuts[b]] > total[cuts[a]]:
                out += _bands(points, at, items, *(x[cuts[a]:cuts[b]] for x in (spot, row, code, counts)), first, owner, place)
            a = b
    return out


def _bands(points, at, items, spot, row, code, counts, first, owner, place) -> list[tuple[int, int, int, int, int]]:
    """Count hits in bands of diagonals and align those that meet the bound; hits are laid out for a run of places at a time."""
    width = 2 * items.k + 1
    low = -int(items.m.max()) - 1
    span = int(np.diff(at).max()) - 2 * low
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.cumsum(counts)
    turns = -(-int(total[-1]) // MATCH_HITS)
    cuts = np.r_[np.searchsorted(total, np.arange(1, turns) * MATCH_HITS) + 1, len(total)]
    for a, b in zip(np.r_[0, cuts[:-1]], cuts):
        c, times = code[a:b], counts[a:b]
        index = ranges_index(first[c], times)
        item = owner[index]
        band = np.floor_divide(np.repeat(spot[a:b] - at[row[a:b]], times) - place[index], width[item])
        found, more = np.unique((item * (len(at) - 1) + np.repeat(row[a:b], times)) * span + (band - low), return_counts=True)
        if len(keys):
            found, which = np.unique(np.concatenate([keys, found]), return_inverse=True)
            more = np.bincount(which, weights=np.concatenate([n, more])).astype(np.int64)
        keys, n = found, more
    # a band of two widths begins at every width: its halves are neighbouring entries
    after = np.searchsorted(keys, keys + 1)
    after[after == len(keys)] = 0
    both = n + np.where(keys[after] == keys + 1, n[after], 0)
    least = items.least[keys // span // (len(at) - 1)]
    picked = np.concatenate([keys[both >= least], keys[n >= least] - 1])
    picked = np.unique(picked)
    where = picked // span
    out = []
    for i in np.unique(where // (len(at) - 1)).tolist():
        mine = where // (len(at) - 1) == i
        rows = where[mine] % (len(at) - 1)
        start = at[rows] + (picked[mine] % span + low) * width[i]
        out += _align(points, at[rows], at[rows + 1], rows, items.points[i], int(items.k[i]), start, i)
    return out


def _align(points, a, b, rows, item, k, first, number) -> list[tuple[int, int, int, int, int]]:
    """Align the item to each row's text [a, b) along the diagonals of the band that begins at ``first``."""
    found = np.concatenate([_places(points, a[s], b[s], rows[s], item, k, first[s]) for s in (slice(i, i + ALIGN_BANDS) for i in range(0, len(first), ALIGN_BANDS))])
    kept: list[tuple[int, int, int, int]] = []
    for place in np.unique(found, axis=0):  # in order of row, start, end and edits
        r, s, e, x = place.tolist()
        if kept and kept[-1][0] == r and s < kept[-1][2]:  # overlapping places are one: the better stays
            if x < kept[-1][3]:
                kept[-1] = (r, s, e, x)
        else:
            kept.append((r, s, e, x))
    return [(r, number, s, e, x) for r, s, e, x in kept]


def _places(points, a, b, rows, item, k, first) -> np.ndarray:
    """(row, start, end, edits) of the places in some bands."""
    m, width = len(item), 2 * k + 1
    diagonals = np.arange(-k, 2 * width + k)
    start = first[:, None] + diagonals  # where in the text the item begins on each diagonal
    # an unchanged occurrence needs no alignment
    found, open_ = [np.zeros((0, 4), np.int64)], np.ones(len(first), bool)
    for i in range(len(first)):
        at = start[i][(start[i] >= a[i]) & (start[i] + m <= b[i])]
        at = at[points[at] == item[0]]
        same = at[(points[at[:, None] + np.arange(m)] == item).all(axis=1)]
        if len(same):
            open_[i] = False
            found.append(np.stack([np.full(len(same), rows[i]), same, same + m, np.zeros(len(same), np.int64)], axis=1))
    first, start, rows, a, b = first[open_], start[open_], rows[open_], a[open_], b[open_]
    if len(first):
        found.append(np.array(_edited(points, a, b, rows, item, k, start, len(diagonals)), np.int64).reshape(-1, 4))
    return np.unique(np.concatenate(found), axis=0)


def _edited(points, a, b, rows, item, k, start, width) -> list[tuple[int, int, int, int]]:
    """Places within ``k`` edits, by dynamic programming along the diagonals of every band."""
    m = len(item)
    cost = np.zeros(start.shape, np.int32)
    begin = start.copy()
    shift = np.arange(width, dtype=np.int32)
    for r in range(m):
        pos = start + r
        inside = (pos >= a[:, None]) & (pos < b[:, None])
        char = np.where(inside, points[np.clip(pos, 0, len(points) - 1)], np.uint32(0xFFFFFFFF))
        step = cost + (char != item[r])
        drop = np.full_like(cost, 1 << 20)  # the item's character is missing from the text
        drop[:, :-1] = cost[:, 1:] + 1
        better = drop < step
        origin = np.where(better, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1), begin)
        level = np.where(better, drop, step) - shift  # characters added in the text: a step right costs one
        lowest = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == lowest, shift, 0), axis=1)
        cost, begin = lowest + shift, np.take_along_axis(origin, source.astype(np.int64), axis=1)
    best = cost.argmin(axis=1)
    each = np.arange(len(start))
    edits = cost[each, best]
    starts = np.maximum(begin[each, best], a)
    ends = np.minimum(start[each, best] + m, b)
    return [(int(rows[i]), int(starts[i]), int(ends[i]), int(edits[i])) for i in np.flatnonzero((edits <= k) & (ends > starts))]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[tuple[list, list]]:
    """Items and texts, about ``block_chars`` characters at a time."""
    given = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_t")).where("_t IS NOT NULL")
    chars = given.agg(F.sum(F.length("_t").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for block in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == block).orderBy("_item", "_t").collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def _checked(df: DataFrame, q: int, edit_share: float) -> None:
    if q < 2 or not 0 <= edit_share < 1:
        raise ValueError(f"q must be 2 or more and edit_share from 0 to below 1: {q}, {edit_share}")
    prepare(df.sparkSession)


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text: str = "text", q: int = 8, edit_share: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """Rows (id, item, start, end, edits): where a document holds an item; places in characters of the text."""
    _checked(df, q, edit_share)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, item long, start long, end long, edits int"
    source = df.select(id_col, F.col(text_col).alias("_t"))
    out = None
    for ids, texts in _blocks(benchmark, item_col, item_text, block_chars):
        shared = df.sparkSession.sparkContext.broadcast((ids, texts))  # one block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, q, edit_share)
            for batch in batches:
                for part in slices(batch, "_t"):
                    points, at, place = normalised(part.column("_t"))
                    found = find(points, at, items)
                    yield pa.RecordBatch.from_arrays([
                        part.column(id_col).take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([items.ids[f[1]] for f in found], pa.int64()),
                        pa.array([int(place[f[2]]) for f in found], pa.int64()),
                        pa.array([int(place[f[3] - 1]) + 1 for f in found], pa.int64()),
                        pa.array([f[4] for f in found], pa.int32())], names=[id_col, "item", "start", "end", "edits"])

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("item", item_col)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          q: int = 8, edit_share: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``df`` that hold no item of the benchmark, as they are."""
    _checked(df, q, edit_share)
    for ids, texts in _blocks(benchmark, item_col, item_text, block_chars):
        shared = df.sparkSession.sparkContext.broadcast((ids, texts))  # one block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, q, edit_share)
            for batch in batches:
                for part in slices(batch, text_col):
                    points, at, _ = normalised(part.column(text_col))
                    keep = np.ones(part.num_rows, bool)
                    keep[[f[0] for f in find(points, at, items)]] = False
                    yield part.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
