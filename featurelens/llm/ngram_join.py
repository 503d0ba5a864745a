"""Components of documents with similar word n-gram sets (operator 10).

A document's set holds the 64-bit hashes of its distinct word n-grams. Two
documents link when Jaccard similarity is at least ``percent`` / 100; the
result is each document's component under links.

Two exact filters make candidate clusters, by ``percent``:

1a. *Bands and parts* (from ``PARTS_FROM`` percent, where parts hold many elements).
   Sets go into size bands; those that can link into the next band visit it too.
   Linked sets of a band differ in at most H elements, so of H + 1 + z parts of the
   hash space at least z + 1 are equal. A set gives a key (band, part, hash of the
   part) for each part that is not small (fewer than up to ``LEAST_IN_PART``
   elements, by band). Elements that very many sets share (found by counts of 2^18
   hash buckets over all documents) are left out of these parts. A set with more
   than z small parts also gives keys of parts with all elements, and for small ones
   too if more than z are small again. So linked sets always share a key. Keys are
   combined per slice before they are shuffled.
1b. *Prefixes* (below). Elements are put in order of rarity: classes of the logarithm of
   the number of documents that hold them, then the hash. Of two sets that can link, the
   first size - ceil(percent * size) + 1 elements (prefixes) share one. Blocks of documents
   send their elements (40 bits of the hash, so a count may be too large, alike for all)
   to parts by hash; the parts count them and reply with those that two documents hold at
   least. Only these can be shared, so a prefix of elements found once sends nothing more.
   At an element shared by prefixes, two sets are held against the length
   filter and the positional filter (what is left of both must suffice). A passage
   that many documents share comes late in this order, so only sets that hold
   little else have it in their prefixes. Each task sends the connected sets of its
   passing pairs, as one edge a set (at elements of more than 1,024 sets all of them
   count as connected, which only makes a cluster larger).
2. *Clusters.* Edges join sets into candidate clusters; links exist only inside.
3. *Tiles.* A cluster of few rows and n-grams is a tile. With parts, larger ones are cut
   into tiles by size band and slot, and each pair of tiles whose sizes can link is
   compared once. With prefixes, each tile is compared within itself and with a few
   leaders of the cluster, so texts aren't copied for pairs of tiles; this
   connects near copies of one text. Then the sets of pairs that pass the filters and
   aren't connected are compared, in rounds. In a tile every set has a hashed bitmap:
   overlap <= (a + b - bits that differ) / 2. Pairs that pass this bound and
   are not yet connected are verified by intersecting the sorted hash arrays.
   A tile gives the edges of a spanning forest, never all pairs.

Texts are scanned for counts, for names, for keys and for the tiles; of texts
only those of one document per distinct clustered set are moved to tiles. Sets
are named by a 64-bit hash of their elements (expected clashes among N
distinct sets: N^2 / 2^65), verified in the tile against the recomputed set.

Defined results: null, empty and blank texts have no set and stand alone (their
component is their own id). Texts with fewer than n words have their whole
sequence as the only element. Null ids never name a component unless all
its ids are null. Repeated rows and equal texts share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.columns import lower_ascii, mix, ranges_index, run_hashes, runs, slices, utf8
from featurelens.llm.staging import cut, free_shuffles, fresh, prepare, text_or_empty, written
from featurelens.operators.density import connected_components
from featurelens.operators.sizes import broadcast_if_small

PARTS_FROM = 90
LEAST_IN_PART = 3
HEAVY_BITS = 18
PACK_GRAMS = 8_000_000
RARITY_BITS = 20
KEY_BITS = 40
BLOCK_GRAMS = 1_000_000
BLOCK_DOCS = 60_000
REPLIES = 256
PACK_ENTRIES = 2_000_000
LEADERS = 8
PAIRS_IN_TILE = 256
PAIRS_A_ROUND = 100_000
FIRST_PAIRS = 10_000
FEW_LINKS = 500_000
MANY_SETS = 1_024
FLUSH_PAIRS = 4_000_000
BITMAP_WORDS = 64
TILE_ROWS = 512
FEW_VALUES = 4_000_000
TILE_GRAMS = 1_000_000
_K = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every row, and the row offsets."""
    data, offsets = utf8(column)
    low = lower_ascii(data)
    starts, ends, row = runs((low != 0x20) & ((low < 0x09) | (low > 0x0D)), offsets)
    words = run_hashes(low, starts, ends)
    per_row = np.bincount(row, minlength=len(column)) if len(row) else np.zeros(len(column), np.int64)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            grams += words[j:j + len(grams)] * _K[j % 5] + np.uint64(j // 5)
        whole = mix(grams)
        inside = row[:len(grams)] == row[n - 1:n - 1 + len(grams)]
        values, owner = [whole[inside]], [row[:len(grams)][inside]]
        first = np.cumsum(per_row) - per_row
        for k in range(1, n):  # shorter sequences are one element
            short = np.flatnonzero(per_row == k)
            seq = np.zeros(len(short), np.uint64)
            for j in range(k):
                seq += words[first[short] + j] * _K[j % 5] + np.uint64(j // 5)
            values.append(mix(seq ^ np.uint64(k << 56)))
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(column) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(column) + 1))


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of every set (0 for an empty one)."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(values ^ _K[0]), at[full])
        out[full] = mix(sums + np.diff(at)[full].astype(np.uint64))
    return out


class Bands:
    """Size bands and, for each, how many parts its sets are cut into."""

    def __init__(self, percent: int, top: int):
        self.percent = percent
        edges = [1]
        # wide bands have fewer visitors, narrow ones larger parts; linkable sizes are at most one band apart
        ratio = 1.5 if percent >= 90 else max(1.25, 100 / percent)
        while edges[-1] <= top * 2:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
        self.edges = np.array(edges, np.int64)
        plan = [self._plan(int(a), int(b) - 1) for a, b in zip(edges[:-1], edges[1:])]
        self.parts, self.spare, self.least = (np.array(x, np.int64) for x in zip(*plan))

    def _plan(self, low: int, high: int) -> tuple[int, int, int]:
        """Parts, how many small parts a set may have before it must give keys for them, and what is small.

        As large a least size as lets but one set in about 10,000 have more.
        """
        differ = 2 * high * (100 - self.percent) // (100 + self.percent)
        for least in range(LEAST_IN_PART, 0, -1):
            for spare in range(differ + 2 if differ else 0):
                parts = differ + 1 + spare
                mean = low * self.percent / 100 / parts
                small = parts * sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(least))
                if small + 4 * math.sqrt(small) <= spare + 0.05:
                    return parts, spare, least
        return differ + 1, 0, 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def keys(self, values: np.ndarray, at: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sets and the set each belongs to; ``heavy`` marks buckets of very common elements.

        Where linked sets cannot differ (H = 0) they have one name and need no key.
        """
        sizes = np.diff(at)
        rows = np.flatnonzero(sizes)
        own = self.of(sizes[rows])
        visit = sizes[rows] * 100 // self.percent >= self.edges[own + 1]
        rows, band = np.concatenate([rows, rows[visit]]), np.concatenate([own, own[visit] + 1])
        several = self.parts[band] > 1
        rows, band = rows[several], band[several]
        light = ~heavy[(values >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)]
        light_at = np.concatenate([[0], np.cumsum(light)])[at]
        keys, owner, many = self._parts(values[light], light_at, rows, band, 0)
        again, its, _ = self._parts(values, at, rows[many], band[many], 1)
        return np.concatenate([keys, again]), np.concatenate([owner, its])

    def _parts(self, values, at, rows, band, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their sets, and which entries have too many small parts (of kind 1 these give keys for them)."""
        if not len(rows):
            return np.zeros(0, np.uint64), rows, np.zeros(0, bool)
        parts, lens = self.parts[band], np.diff(at)[rows]
        base = np.cumsum(parts) - parts
        element = mix(values[ranges_index(at[rows], lens)] ^ np.repeat(mix(band.astype(np.uint64) + _K[1]), lens))
        slot = np.repeat(base, lens) + ((element >> np.uint64(33)).astype(np.int64) % np.repeat(parts, lens))
        total = int(parts.sum())
        count = np.bincount(slot, minlength=total)
        sums = np.zeros(total, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, slot, mix(element ^ _K[2]))
            entry = np.repeat(np.arange(len(rows)), parts)
            number = np.arange(total) - np.repeat(base, parts)
            small = count < np.repeat(self.least[band], parts)
            many = np.bincount(entry[small], minlength=len(rows)) > self.spare[band]
            emit = ~small | many[entry] if kind else ~small
            name = mix((band.astype(np.uint64) << np.uint64(32))[entry] + number.astype(np.uint64) + _K[3 - kind])
            keys = mix(sums + name * _K[4])
        return keys[emit], rows[entry[emit]], many


def prefixes(values: np.ndarray, at: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the elements in each set's prefix, the set each belongs to and its place in order of rarity.

    ``classes`` has the rarity of hash buckets.
    """
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return rarest(owner, classes[(values >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], values >> np.uint64(8), np.diff(at), percent)


def rarest(owner: np.ndarray, classes: np.ndarray, keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``prefixes``, of elements with a set (``owner``), a class and a key of up to 56 bits each.

    Elements of a set that are not given come before all given ones.
    """
    names = (classes.astype(np.uint64) << np.uint64(56)) | keys
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    given = np.bincount(owner, minlength=len(sizes))
    first = np.cumsum(given) - given
    place = np.arange(len(owner)) - first[owner] + (sizes - given)[owner]
    inside = place < (sizes - (sizes * percent + 99) // 100 + 1)[owner]
    return mix(names[inside]), owner[inside], place[inside]


def pressed(values: np.ndarray) -> bytes:
    """Bytes of an array, by place in a value, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def unpressed(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).reshape(n)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) for every other node of a graph's edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[:len(a)], place[len(a):]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[left], parent[right])
        after = parent.copy()
        for side in (parent[left], parent[right], left, right):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == parent).all():
            break
        parent = after
    other = parent != np.arange(len(nodes))
    return np.stack([nodes[other], nodes[parent[other]]], axis=1)


def candidates(keys: np.ndarray, sids: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """Edges (set, smallest set of its component) of the pairs that pass the filters at a shared element."""
    order, group = _shared(keys, sids)
    keys, sids = keys[order], sids[order]
    crowd = group > MANY_SETS
    head = sids[np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))] if len(keys) else sids
    found, held = [stars(sids[crowd], head[crowd])], 0
    for pairs in _passing(keys, sids, sizes[order], places[order], np.flatnonzero((group > 1) & ~crowd), percent):
        found.append(pairs)
        held += len(pairs)
        if held > FLUSH_PAIRS:
            pairs = np.concatenate(found)
            found, held = [stars(pairs[:, 0], pairs[:, 1])], 0
    pairs = np.concatenate(found)
    return stars(pairs[:, 0], pairs[:, 1])


def apart(keys: np.ndarray, sids: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """The pairs of sets with different roots that pass the filters at a shared element, in runs without repeats."""
    order, _ = _shared(keys, sids)
    if not len(order):
        return
    # the sets of a key's most common root come last: pairs start from the others only
    order = order[np.lexsort((roots[order], keys[order]))]
    key, root = keys[order], roots[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (root[1:] != root[:-1])]
    starts, run = np.flatnonzero(first), np.cumsum(first) - 1
    ranked = np.lexsort((np.diff(np.r_[starts, len(key)]), key[starts]))
    largest = np.zeros(len(starts), bool)
    largest[ranked[np.r_[key[starts][ranked][1:] != key[starts][ranked][:-1], True]]] = True
    last = np.lexsort((largest[run], key))
    others = np.flatnonzero(~largest[run][last])
    order = order[last]
    keys, sids, roots = keys[order], sids[order], roots[order]
    found, held = [np.zeros((0, 2), np.int64)], 0
    for pairs in _passing(keys, sids, sizes[order], places[order], others, percent, roots):
        found.append(np.sort(pairs, axis=1))
        held += len(pairs)
        if held > FLUSH_PAIRS:
            found, held = [np.unique(np.concatenate(found), axis=0)], 0
            if len(found[0]) > FLUSH_PAIRS // 2:
                yield found.pop()
    if found:
        yield np.unique(np.concatenate(found), axis=0)


def _shared(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and set, each pair of them once (the first given), and how many sets the key of each has."""
    order = np.lexsort((sids, keys))
    order = order[np.r_[True, (keys[order[1:]] != keys[order[:-1]]) | (sids[order[1:]] != sids[order[:-1]])]] if len(order) else order
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(keys)])
    return order, np.repeat(counts, counts)


def _passing(keys, sids, sizes, places, at: np.ndarray, percent: int, roots: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of sets at a key that pass the length and the positional filter; ``at``: places to start from."""
    sizes, step = sizes.astype(np.int64), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        for some in np.array_split(at, len(at) // FLUSH_PAIRS + 1):
            a, b = sizes[some], sizes[some + step]
            left = np.minimum(a - places[some], b - places[some + step])  # this element and those after it
            passing = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (left * (100 + percent) >= percent * (a + b))
            if roots is not None:
                passing &= roots[some] != roots[some + step]
            some = some[passing]
            yield np.stack([sids[some], sids[some + step]], axis=1)
        step += 1


def compare(texts: pa.Array, sids: np.ndarray, tiles: np.ndarray, sides: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (set, smallest set it is connected to, tile) within each tile's links.

    ``sides`` tells the two halves of a pair of tiles; pairs within a half are
    another tile's work. Side -1 compares all pairs.
    """
    values, at = [], [np.zeros(1, np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
        v, a = gram_sets(part.column("t"), n)
        values.append(v)
        at.append(a[1:] + at[-1][-1])
    values, at = np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(at)
    same = set_ids(values, at).view(np.int64) == sids
    sizes = np.diff(at)
    out: list[tuple[int, int, int]] = []
    order = np.lexsort((sids, sizes, tiles))
    order = order[same[order]]
    cuts = np.flatnonzero(np.diff(tiles[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        _, once = np.unique(sids[group] * 4 + sides[group], return_index=True)
        group = group[np.sort(once)]
        out += _tile(group, values, at, sizes, sids, sides, percent, int(tiles[group[0]]))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _tile(group, values, at, sizes, sids, sides, percent, tile) -> list[tuple[int, int, int]]:
    m = len(group)
    bits = np.zeros((m, BITMAP_WORDS), np.uint64)
    for i, g in enumerate(group.tolist()):
        spot = values[at[g]:at[g + 1]] >> np.uint64(64 - 6 - BITMAP_WORDS.bit_length() + 1)
        np.bitwise_or.at(bits[i], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    size, side = sizes[group], sides[group]
    parent = np.arange(m)
    for i in range(m - 1):
        last = np.searchsorted(size, size[i] * 100 // percent, side="right")
        if last <= i + 1:
            continue
        rest = np.arange(i + 1, last)
        rest = rest[(parent[rest] != parent[i]) & ((side[rest] != side[i]) | (side[i] < 0))]
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        both = size[rest] + size[i]
        rest = rest[((both - differ) // 2) * (100 + percent) >= percent * both]
        mine = values[at[group[i]]:at[group[i] + 1]]
        for j in rest.tolist():
            if parent[j] == parent[i]:
                continue
            theirs = values[at[group[j]]:at[group[j] + 1]]
            place = np.searchsorted(theirs, mine)
            place[place == len(theirs)] = 0
            overlap = int((theirs[place] == mine).sum())
            if overlap * 100 >= percent * (len(mine) + len(theirs) - overlap):
                parent[parent == parent[j]] = parent[i]
    names = sids[group]
    heads = np.unique(parent)
    least = {int(h): int(names[parent == h].min()) for h in heads[np.bincount(parent, minlength=m)[heads] > 1]}
    return [(int(x), least[int(p)], tile) for x, p in zip(names, parent) if int(p) in least and int(x) != least[int(p)]]


def _named(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Slim rows: id, text hash, set size and set name."""
    source = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_text"), text_or_empty(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                values, at = gram_sets(part.column("_t"), n)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_text"), pa.array(np.diff(at)),
                                                  pa.array(set_ids(values, at).view(np.int64))], names=["_id", "_text", "n", "sid"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, _text long, n long, sid long")


def _heavy_buckets(texts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Hash buckets with far more elements than most, and the number of elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << HEAVY_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "_t"):
                values, _ = gram_sets(part.column("_t"), n)
                counts += np.bincount((values >> np.uint64(64 - HEAVY_BITS)).astype(np.int64), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2^18 at most
    counts = np.zeros(1 << HEAVY_BITS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    middle = np.median(counts)
    spread = 1.4826 * np.median(np.abs(counts - middle))
    return counts > middle + 8 * spread + 20, int(counts.sum())


def _part_clusters(df: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """(sid, cluster) of all sets that share a key with another set."""
    spark = df.sparkSession
    texts = df.select(text_or_empty(text_col).alias("_t"))
    heavy, grams = _heavy_buckets(texts, n)
    shared = spark.sparkContext.broadcast(heavy)  # 2^18 flags
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams // PACK_GRAMS)
    bits = max(4, (4 * partitions - 1).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, turn = None, 0
        for batch in batches:
            for part in slices(batch, "_t"):
                values, at = gram_sets(part.column("_t"), n)
                top = int(np.diff(at).max(initial=1))
                if bands is None or bands.edges[-1] <= top * 2:
                    bands = Bands(percent, max(top, 1 << 16))
                keys, owner = bands.keys(values, at, shared.value)
                keys, sids, edges = _combined(keys, set_ids(values, at).view(np.int64)[owner])
                ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1, (1 << bits) + 1).astype(np.uint64))
                rows = [(i, False, keys[a:b].tobytes(), sids[a:b].tobytes()) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if b > a]
                if len(edges):
                    turn += 1
                    rows.append((turn * 7919 % (1 << bits), True, edges[:, 0].tobytes(), edges[:, 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                                                 names=["part", "edge", "keys", "sids"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, edges = [], [], []
        for batch in batches:
            for edge, k, v in zip(batch.column("edge").to_pylist(), batch.column("keys").to_pylist(), batch.column("sids").to_pylist()):
                if edge:
                    edges.append(np.stack([np.frombuffer(k, np.int64), np.frombuffer(v, np.int64)], axis=1))
                else:
                    keys.append(np.frombuffer(k, np.uint64))
                    sids.append(np.frombuffer(v, np.int64))
        if keys:
            edges.append(_combined(np.concatenate(keys), np.concatenate(sids))[2])
        found = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    packs = texts.mapInArrow(pack, "part int, edge boolean, keys binary, sids binary")
    edges = packs.repartition(partitions, "part").mapInArrow(match, "a long, b long").distinct()
    return cut(connected_components(edges, "a", "b").select(F.col("_id").alias("sid"), F.col("comp").alias("cluster")))


def _combined(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys with their smallest set, and edges from the other sets of a key to that one."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    head = sids[first][np.cumsum(first) - 1] if len(keys) else sids
    other = head != sids
    return keys[first], sids[first], np.unique(np.stack([sids[other], head[other]], axis=1), axis=0)


ENTRIES = "part int, keys binary, sids binary, sizes binary, places binary"
KINDS = {"keys": np.uint64, "sids": np.int64, "sizes": np.int32, "places": np.int32}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def _entries(df: DataFrame, text_col: str, n: int, percent: int, parts: int) -> DataFrame:
    """Packs of the elements in prefixes that two documents hold at least, with set, size and place."""
    texts = df.select(text_or_empty(text_col).alias("_t"))
    bits = max(4, (parts - 1).bit_length())
    asked = "part int, block long, n int, keys binary, docs binary"
    replied = "block long, n int, keys binary, docs binary, classes binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            values, sizes = np.concatenate([v for v, _, _ in held]), np.concatenate([x for _, x, _ in held])
            docs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            order = np.argsort(values)
            values, docs = values[order], docs[order]
            part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            ends = np.searchsorted(part, np.arange(1, parts + 1).astype(np.uint64))
            keys, name = values >> np.uint64(64 - KEY_BITS), (task << 32) + turn
            rows = [(i, name, b - a, pressed(gaps(keys[a:b])), pressed(docs[a:b])) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())) if b > a]
            rows.append((name % parts, name, -len(sizes), np.concatenate([x for _, _, x in held]).tobytes(), sizes.astype(np.int32).tobytes()))
            held.clear()
            return _batch(asked, rows)

        for batch in batches:
            for part in slices(batch, "_t"):
                values, at = gram_sets(part.column("_t"), n)
                sids = set_ids(values, at)
                names, once = np.unique(sids, return_index=True)
                kept = np.sort(once[names != 0])  # equal sets give one prefix a slice
                for a in range(0, len(kept), BLOCK_DOCS):
                    some = kept[a:a + BLOCK_DOCS]
                    if held and (sum(len(v) for v, _, _ in held) > BLOCK_GRAMS or sum(len(x) for _, x, _ in held) + len(some) > BLOCK_DOCS):
                        yield block()
                        turn += 1
                    held.append((values[ranges_index(at[some], np.diff(at)[some])], np.diff(at)[some], sids[some].view(np.int64)))
        if held:
            yield block()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], []
        for batch in batches:
            for part, block, m, keys, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if m < 0:
                    known.append((block, m, keys, docs, None))
                else:
                    rows.append((block, m, np.cumsum(unpressed(keys, m, np.uint64), dtype=np.uint64), docs))
        if known:
            yield _batch(replied, known)
        if not rows:
            return
        keys = np.concatenate([k for _, _, k, _ in rows])
        order = np.argsort(keys)
        starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])
        counts = np.diff(np.r_[starts, len(keys)])
        classes = np.zeros(len(keys), np.uint8)
        classes[order] = np.repeat(np.floor(6 * np.log2(counts)).clip(0, 255).astype(np.uint8), counts)  # 0: held once
        at, out = 0, []
        for block, m, own, docs in rows:
            rank = classes[at:at + m]
            at += m
            some = rank > 0
            if some.any():
                out.append((block, int(some.sum()), pressed(gaps(own[some])), pressed(unpressed(docs, m, np.uint16)[some]), pressed(rank[some])))
            if len(out) == REPLIES:
                yield _batch(replied, out)
                out = []
        if out:
            yield _batch(replied, out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                blocks.setdefault(block, []).append(row)
        found = []
        for block in list(blocks):
            rows = blocks.pop(block)
            sids, sizes = next((np.frombuffer(k, np.int64), np.frombuffer(d, np.int32).astype(np.int64)) for m, k, d, _ in rows if m < 0)
            rows = [r for r in rows if r[0] > 0]
            if rows:
                docs = np.concatenate([unpressed(d, m, np.uint16) for m, _, d, _ in rows])
                classes = np.concatenate([unpressed(c, m, np.uint8) for m, _, _, c in rows])
                keys = np.concatenate([np.cumsum(unpressed(k, m, np.uint64), dtype=np.uint64) for m, k, _, _ in rows])
                keys, owner, places = rarest(docs.astype(np.int64), classes, keys, sizes, percent)
                found.append((keys, sids[owner], sizes[owner].astype(np.int32), places.astype(np.int32)))
        if found:
            columns = [np.concatenate(x) for x in zip(*found)]
            order = np.argsort(columns[0], kind="stable")
            columns = [x[order] for x in columns]
            ends = np.searchsorted(columns[0] >> np.uint64(64 - bits), np.arange(1, (1 << bits) + 1).astype(np.uint64))
            yield _batch(ENTRIES, [(i, *(c[a:b].tobytes() for c in columns)) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if b > a])

    replies = texts.mapInArrow(ask, asked).repartition(parts, "part").mapInArrow(reply, replied)
    return replies.repartition(parts, "block").mapInArrow(pack, ENTRIES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    got: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in KINDS.items()}
    for batch in batches:
        for name, rows in got.items():
            rows += [np.frombuffer(x, KINDS[name]) for x in batch.column(name).to_pylist()]
    return [np.concatenate(got.pop(name)) for name in KINDS]


def _prefix_clusters(entries: DataFrame, percent: int, parts: int) -> DataFrame:
    """(sid, cluster) of all sets that pass the filters with another set at an element of their prefixes."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = candidates(*_unpacked(batches), percent)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    edges = entries.repartition(parts, "part").mapInArrow(match, "a long, b long").distinct()
    return cut(connected_components(edges, "a", "b").select(F.col("_id").alias("sid"), F.col("comp").alias("cluster")))


def _places(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, sid, size, place) of the entries of sets in larger clusters."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *columns = _unpacked(iter([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), *columns)], names=["key", "sid", "size", "place"])

    wide = broadcast_if_small(clusters.where("NOT whole").select("sid"), limit=FEW_VALUES)
    return cut(entries.mapInArrow(unpack, "key long, sid long, size int, place int").join(wide, "sid"))


def _pairs_apart(places: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b), once each: sets of ``roots`` (sid, root) with different roots that pass the filters at an element of their prefixes."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        for found in apart(*(table.column(c).to_numpy()[order] for c in ("key", "sid", "size", "place", "root")), percent):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    rows = places.join(broadcast_if_small(roots, limit=FEW_VALUES), "sid").select("key", "sid", "size", "place", "root")
    return cut(rows.repartition("key").mapInArrow(match, "a long, b long").distinct())


def _classes(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, tile_rows: int, tile_grams: int) -> DataFrame:
    """Slim rows with the root set of their component and its smallest id (both null for rows without a set)."""
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100: {percent}")
    prepare(df.sparkSession)
    sets = cut(_named(df, id_col, text_col, n))
    if percent >= PARTS_FROM:
        places, clusters = None, _sized(sets, _part_clusters(df, text_col, n, percent), percent, tile_rows, tile_grams)
    else:
        grams = sets.agg(F.sum("n")).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), grams // PACK_ENTRIES)
        with written(_entries(df, text_col, n, percent, parts), "ngram-entries") as entries:
            free_shuffles(df.sparkSession)
            clusters = _sized(sets, _prefix_clusters(entries, percent, parts), percent, tile_rows, tile_grams)
            places = _places(entries, clusters)
            free_shuffles(df.sparkSession)
    roots = _linked(df, sets, clusters, places, id_col, text_col, n, percent, tile_rows, tile_grams)
    full = sets.where("n > 0")
    least = full.groupBy("sid").agg(F.min("_id").alias("_least")).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = cut(least)
    named = least.join(least.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("sid", "root", "component_id")
    alone = sets.where("n = 0").withColumns({"root": F.lit(None).cast("long"), "component_id": F.lit(None).cast(sets.schema["_id"].dataType)})
    return full.join(named, "sid").select("_id", "_text", "n", "root", "component_id").unionByName(
        alone.select("_id", "_text", "n", "root", "component_id"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90,
               tile_rows: int = TILE_ROWS, tile_grams: int = TILE_GRAMS) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id`` (smallest id reachable by links)."""
    found = _classes(df, id_col, text_col, n, percent, tile_rows, tile_grams)
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sized(sets: DataFrame, members: DataFrame, percent: int, tile_rows: int, tile_grams: int) -> DataFrame:
    """Each set once: sid, cluster, n, size band, one document and whether its cluster is small enough to be a tile (``whole``)."""
    one = sets.where("n > 0").join(members, "sid").groupBy("sid", "cluster", "n").agg(F.min(F.struct("_text", "_id")).alias("_doc"))
    one = cut(one.withColumn("band", F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / percent)) if percent < 100 else F.col("n")).cast("long")))
    sizes = one.groupBy("cluster").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_grams"))
    return one.join(sizes.select("cluster", ((F.col("_rows") <= tile_rows) & (F.col("_grams") <= tile_grams)).alias("whole")), "cluster")


def _linked(df, sets, clusters, places, id_col, text_col, n, percent, tile_rows, tile_grams) -> DataFrame:
    """(sid, root) of all sets that link with another one; ``places``: of prefixes, as ``_places`` gives them, else None."""
    small = clusters.where("whole").select("sid", "_doc", F.xxhash64("cluster").alias("tile"), F.lit(-1).alias("side"), F.lit(True).alias("whole"))
    wide = clusters.where("NOT whole").drop("whole")
    if places is None:
        paired = _tile_pairs(wide, tile_rows, tile_grams)
    else:
        wide = cut(wide)
        paired = _led(wide, tile_rows, tile_grams)
    edges = _compared(df, small.unionByName(paired), id_col, text_col, n, percent)
    # a whole cluster's edges lead to its root; those of tiles of larger ones are joined up here
    found = edges.where("whole").select(F.col("a").alias("sid"), F.col("b").alias("root"))
    links = edges.where("NOT whole").select("a", "b")
    if places is not None and not wide.isEmpty():
        links = _rest_linked(df, sets, wide, places, links, id_col, text_col, n, percent)
    if not links.isEmpty():
        found = found.unionByName(_roots(links))
    return found


def _roots(links: DataFrame) -> DataFrame:
    """(sid, root) of links' sets; those that aren't given are their own root. Few links are joined up in one task."""
    if links.count() > FEW_LINKS:
        return connected_components(links, "a", "b").select(F.col("_id").alias("sid"), F.col("comp").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *((b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches)]
        found = stars(*(np.concatenate(x) for x in zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["sid", "root"])

    return cut(links.coalesce(1).mapInArrow(run, "sid long, root long"))


def _slots(wide: DataFrame, tile_rows: int, tile_grams: int) -> tuple[DataFrame, DataFrame]:
    """How many tiles every (cluster, band) has, and the sets of larger clusters with the slot each goes to."""
    slots = wide.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("_in_band"), F.greatest(F.ceil(2 * F.count(F.lit(1)) / tile_rows), F.ceil(2 * F.sum("n") / tile_grams)).cast("long").alias("_slots"))
    return slots, wide.join(slots, ["cluster", "band"]).withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "sid"), F.col("_slots")))


def _led(wide: DataFrame, tile_rows: int, tile_grams: int) -> DataFrame:
    """Tiles of larger clusters, once each set: those of its (cluster, band, slot), which a few leaders of this and the next bands visit."""
    slots, placed = _slots(wide, tile_rows, tile_grams)
    tile = F.xxhash64("cluster", "band", "slot").alias("tile")
    others = slots.select("cluster", F.col("band").alias("_at"), F.col("_slots").alias("_there"))
    leads = F.pmod(F.xxhash64(F.lit("leads"), "sid"), F.ceil(F.col("_in_band") / LEADERS).cast("long")) == 0
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("_at")
    leaders = placed.where(leads).select("sid", "_doc", "cluster", near).join(others, ["cluster", "_at"]).select(
        "sid", "_doc", "cluster", F.col("_at").alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_there") - 1)).alias("slot"))
    rows = placed.select("sid", "_doc", tile).unionByName(leaders.select("sid", "_doc", tile)).distinct()
    return rows.select("sid", "_doc", "tile", F.lit(-1).alias("side"), F.lit(False).alias("whole"))


def _rest_linked(df, sets, wide, places, links, id_col, text_col, n, percent) -> DataFrame:
    """Links of larger clusters: those given and those of the pairs that pass the filters and aren't connected yet.

    Pairs are verified in rounds, from few to as many as there are sets; after each,
    pairs of sets that are connected by now are left out.
    """

    def joined(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return wide.select("sid", F.col("sid").alias("root"))
        return cut(wide.select("sid").join(_roots(links), "sid", "left").withColumn("root", F.coalesce("root", "sid")))

    roots = joined(links)
    pairs = _pairs_apart(places, roots, percent)
    total, most, named = pairs.count(), max(PAIRS_A_ROUND, sets.count()), wide.select("sid", "_doc")
    turn = F.pmod(F.xxhash64(F.lit("round"), "a", "b"), F.lit(total))
    done, size = 0, min(most, max(FIRST_PAIRS, LEADERS * named.count()))
    while done < total:
        if done:
            roots = joined(links)
        some = pairs.where((turn >= done) & (turn < done + size))
        done, size = done + size, min(2 * size, most)
        for side in ("a", "b"):
            some = some.join(roots.select(F.col("sid").alias(side), F.col("root").alias(f"_{side}")), side)
        some = cut(some.where("_a != _b").select("a", "b"))
        degree = some.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_IN_TILE).cast("long").alias("_tiles"))
        dealt = some.join(degree, "a").withColumn("tile", F.xxhash64("a", F.pmod(F.xxhash64(F.lit("deal"), "b"), F.col("_tiles"))))
        sides = dealt.select(F.col("a").alias("sid"), "tile", F.lit(0).alias("side")).distinct().unionByName(
            dealt.select(F.col("b").alias("sid"), "tile", F.lit(1).alias("side")))
        work = sides.join(named, "sid").select("sid", "_doc", "tile", "side", F.lit(False).alias("whole"))
        links = links.unionByName(_compared(df, work, id_col, text_col, n, percent).select("a", "b"))
        del work, sides, dealt, degree, some
        free_shuffles(df.sparkSession)
    return links


def _tile_pairs(wide: DataFrame, tile_rows: int, tile_grams: int) -> DataFrame:
    """Tiles of larger clusters: (band, slot); each pair of tiles in the same or neighbouring bands once."""
    slots, placed = _slots(wide, tile_rows, tile_grams)
    above = slots.select("cluster", (F.col("band") - 1).alias("band"), F.col("_slots").alias("_above"))
    below = slots.select("cluster", (F.col("band") + 1).alias("band"), F.col("_slots").alias("_below"))
    placed = placed.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")

    def pair(b1, s1, b2, s2, side):
        return F.struct(F.xxhash64("cluster", b1, s1, b2, s2).alias("tile"), side.cast("int").alias("side"))

    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1), lambda j: pair(
        F.col("band"), F.least("slot", j), F.col("band"), F.greatest("slot", j),
        F.when(j == F.col("slot"), F.lit(-1)).when(F.col("slot") < j, F.lit(0)).otherwise(F.lit(1))))
    up = F.when(F.col("_above").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_above") - 1), lambda j: pair(
        F.col("band"), F.col("slot"), F.col("band") + 1, j, F.lit(0))))
    down = F.when(F.col("_below").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_below") - 1), lambda j: pair(
        F.col("band") - 1, j, F.col("band"), F.col("slot"), F.lit(1))))
    none = F.array().cast("array<struct<tile:bigint,side:int>>")
    return placed.select("sid", "_doc", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))).alias("_p")).select(
        "sid", "_doc", "_p.tile", "_p.side", F.lit(False).alias("whole"))


def _compared(df: DataFrame, work: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Edges (a, b, whole) of the links within the tiles of ``work`` (sid, _doc, tile, side, whole)."""
    work = cut(work)
    rows = work.count()
    docs = df.select(F.col(id_col).alias("_k"), F.xxhash64(text_or_empty(text_col)).alias("_h"), text_or_empty(text_col).alias("_t"))
    wanted = work.select("sid", F.col("_doc._text").alias("_text"), F.col("_doc._id").alias("_id")).distinct()
    wanted = broadcast_if_small(wanted, limit=FEW_VALUES)  # names, never texts; beyond the limit both sides are shuffled
    texts = docs.join(wanted, (F.col("_h") == F.col("_text")) & F.col("_k").eqNullSafe(F.col("_id"))).select("sid", "_t")
    groups = max(1, rows // 400)
    work = work.select("sid", "tile", "side", "whole").join(texts.dropDuplicates(["sid"]), "sid").withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        text = table.column("_t").chunk(0) if table.num_rows else pa.array([], pa.string())
        tiles = table.column("tile").to_numpy()
        a, b, tile = compare(text, *(table.column(c).to_numpy() for c in ("sid", "tile", "side")), n, percent)
        whole = np.isin(tile, tiles[table.column("whole").to_numpy()])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "whole": pa.array(whole)})

    return cut(work.groupBy("bucket").applyInArrow(run, "a long, b long, whole boolean"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, as they are: of each component the document with the smallest id.

    Rows that agree in id and text are one document; null ids come after all others.
    """
    found = cut(_classes(df, id_col, text_col, n, percent, TILE_ROWS, TILE_GRAMS).where("root IS NOT NULL").select("_id", "_text", "root"))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_text")).alias("_stay"))
    same = F.col("_id").eqNullSafe(F.col("_stay._id")) & (F.col("_text") == F.col("_stay._text"))
    name, there = fresh(df, "_gone_id", "_gone_text")
    gone = found.join(stays, "root").where(~same).select(F.col("_id").alias(name), F.col("_text").alias(there)).distinct()
    gone = broadcast_if_small(gone, limit=FEW_VALUES)
    match = (F.xxhash64(text_or_empty(text_col)) == F.col(there)) & F.col(id_col).eqNullSafe(F.col(name))
    return df.join(gone, match, "left_anti")
