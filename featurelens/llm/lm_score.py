"""Cross-entropy difference of matched bigram models (operator 1).

Two bigram models of the same form over the same words: one of the target
documents, one of the background (all others). Every word of the table is a
symbol of its own, however rare, and a boundary symbol stands before and after
each text. Probabilities are absolute discounting, interpolated with add-one
unigram frequencies. Each document gets the mean loss a token in both models;
the difference (target less background) is its score: the lower, the more like
the target.

Both models are distributed tables: the counts of every word and of every pair
of neighbours, packed in parts by hash, whose number grows with the text. Tasks
sum their own counts before the shuffle. To score, texts are put in blocks of
``BLOCK_TOKENS``; a block asks each part for its distinct pairs and words, once
however often it holds them, and sums the losses of its texts from the replies.
So a common pair is asked for once a block, nothing of the tables reaches the
driver but three totals, and no task holds more than its part or block.

Defined results: a document with a null id is background. Words, and pairs of them, are told apart by hashes of 64 bits. Words are runs of other characters than space, tab and line
ends, A-Z lower-cased. Null, empty and blank texts have no tokens and losses
and score 0. Without any target document the target model is uniform over the
words. A word that no training text has counts 0. Repeated rows count each time.
``vocab_size`` folds all but so many most frequent words into one unknown word;
words of equal count rank by hash then. It is off unless given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.columns import lower_ascii, mix, run_hashes, runs, slices, utf8
from featurelens.llm.staging import cut, free_shuffles, fresh, prepare, text_or_empty, written
from featurelens.operators.sizes import broadcast_if_small
from featurelens.session import remove_path, shared_dir

FLUSH_ENTRIES = 1_000_000
BLOCK_TOKENS = 1_000_000
PART_BYTES = 4 << 20  # text for each part of the tables
FEW_VALUES = 4_000_000

UNKNOWN, BOUNDARY = np.uint64(1), np.uint64(2)  # symbols beside the words' hashes
PAIRS, WORDS, COUNTS, TOTALS = range(4)  # kinds of packs: names of pairs with two counts, words with counts and kinds of both models; pairs as counted
KEYS, VALUES = (1, 1, 2), (2, 4, 2)
BLOCK = ("names", "flags", "lengths", "words", "ids", "runs", "spots", "homes", "own")
PACK = "kind int, part int, block long, keys binary, values binary"


@dataclass
class Models:
    tables: DataFrame  # packs of pairs and words
    parts: int
    symbols: int  # words, unknown and boundary
    tokens: tuple[int, int]  # of background and target
    vocabulary: np.ndarray | None  # sorted hashes, if vocab_size was given
    discount: float
    paths: tuple[str, ...]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    data, offsets = utf8(column)
    low = lower_ascii(data)
    starts, ends, row = runs((low != 0x20) & ((low < 0x09) | (low > 0x0D)), offsets)
    return run_hashes(low, starts, ends), row


def symbols_of(column: pa.Array, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with words, each between two boundaries, and the symbols a row has (0 without words)."""
    hashes, row = words_of(column)
    if vocabulary is not None:
        place = np.searchsorted(vocabulary, hashes)
        place[place == len(vocabulary)] = 0
        hashes = np.where(vocabulary[place] == hashes, hashes, UNKNOWN) if len(vocabulary) else np.full(len(hashes), UNKNOWN)
    counts = np.bincount(row, minlength=len(column))
    full = counts[counts > 0]
    line = np.full(len(hashes) + 2 * len(full), BOUNDARY, np.uint64)
    line[np.arange(len(hashes)) + np.repeat(2 * np.arange(len(full)) + 1, full)] = hashes
    return line, np.where(counts > 0, counts + 2, 0)


def _seconds(lengths: np.ndarray) -> np.ndarray:
    """Places of all symbols that have one before them in their text."""
    first = np.zeros(int(lengths.sum()), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return np.flatnonzero(~first)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every distinct row of ``keys``, in their order, and the group of each row."""
    order = np.lexsort(keys.T)
    first = np.ones(len(keys), bool)
    first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(first) - 1
    return order[first], group


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, group = _grouped(keys)
    sums = np.stack([np.bincount(group, weights=v, minlength=len(first)) for v in values.T], axis=1).astype(np.int64)
    return keys[first], sums


def _named(pairs: np.ndarray) -> np.ndarray:
    """Pairs of symbols by names of 64 bits, as words have."""
    with np.errstate(over="ignore"):
        return mix(mix(pairs[:, :1]) + pairs[:, 1:])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys if keys.shape[1] == 1 else _named(keys))[:, 0] % np.uint64(parts)).astype(np.int64)


def _bytes(values: np.ndarray) -> bytes:
    return values.T.tobytes()  # a column after the other: they compress better


def _matrix(data: bytes, columns: int, dtype: type) -> np.ndarray:
    return np.frombuffer(data, dtype).reshape(columns, -1).T


def _packs(kind: int, block: int, keys: np.ndarray, values: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """A row for each part that some keys belong to; keys stay in their order."""
    part = _part(keys, parts)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    cuts = list(zip(starts, [*starts[1:], len(order)]))
    return _rows([(kind, int(p), block, _bytes(keys[order[a:b]]), None if values is None else _bytes(values[order[a:b]]))
                  for p, (a, b) in zip(found, cuts)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "part": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "values": pa.binary()}
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _unpacked(kind: int, keys: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(keys, KEYS[kind], np.uint64), _matrix(values, VALUES[kind], np.int64)


def _reduced(packs: DataFrame, parts: int) -> DataFrame:
    """One pack a kind and part with the sums of all; counted pairs become named ones and packs of their first symbols."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict = {}
        for batch in batches:
            for kind, part, keys, values in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "keys", "values"))):
                got.setdefault((kind, part), []).append(_unpacked(kind, keys, values))
        for kind, part in list(got):
            keys, sums = _summed(*(np.concatenate(x) for x in zip(*got.pop((kind, part)))))
            if kind == COUNTS:
                # a symbol comes before another one as often as after one: its count is that of its pairs as the first
                yield _packs(WORDS, 0, *_summed(keys[:, :1], np.concatenate([sums, sums > 0], axis=1)), parts)
                kind, keys = PAIRS, _named(keys)
            yield _rows([(kind, part, 0, _bytes(keys), _bytes(sums))])

    return packs.repartition(parts, "kind", "part").mapInArrow(add, PACK)


def vocabulary(df: DataFrame, text_col: str, vocab_size: int) -> np.ndarray:
    """Sorted hashes of the ``vocab_size`` most frequent words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                values, n = np.unique(words_of(part.column("_t"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = df.select(F.col(text_col).alias("_t")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(vocab_size).select("word").collect()  # the parameter's size
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def train(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_size: int | None = None,
          discount: float = 0.75) -> Models:
    """Count both models; ``targets`` holds the ids (``id_col``) of the target documents.

    The ids are sent to the tasks if a count shows that they are few, else both
    sides are shuffled. The tables stay in the shared folder for ``score`` until ``release``.
    """
    spark = df.sparkSession
    prepare(spark)
    kept = None if vocab_size is None else vocabulary(df, text_col, vocab_size)
    size = df.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "_t"):
                flag = part.column("_y").to_numpy(zero_copy_only=False)
                line, lengths = symbols_of(part.column("_t"), kept)
                second = _seconds(lengths)
                if not len(second):
                    continue
                good = np.repeat(flag, lengths)[second]
                k, v = _summed(np.stack([line[second - 1], line[second]], axis=1), np.stack([~good, good], axis=1))
                keys.append(k)
                values.append(v)
                held += len(k)
                if held > FLUSH_ENTRIES:
                    yield _packs(COUNTS, 0, *_summed(np.concatenate(keys), np.concatenate(values)), parts)
                    keys, values, held = [], [], 0
        if keys:
            yield _packs(COUNTS, 0, *_summed(np.concatenate(keys), np.concatenate(values)), parts)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values in zip(batch.column("keys").to_pylist(), batch.column("values").to_pylist()):
                k, v = _unpacked(WORDS, keys, values)
                yield pa.RecordBatch.from_arrays([pa.array([int((k[:, 0] > BOUNDARY).sum())]), pa.array([int(v[:, 0].sum())]), pa.array([int(v[:, 1].sum())])],
                                                 names=["words", "background", "target"])

    chosen = broadcast_if_small(targets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lit(True).alias("_good")).distinct())
    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(chosen, "_id", "left").select(
        "_t", F.coalesce("_good", F.lit(False)).alias("_y"))
    path = shared_dir(spark, "lm-tables")
    _reduced(given.mapInArrow(count, PACK), parts).write.parquet(path)
    found = spark.read.schema(PACK).parquet(path)
    _reduced(found.where(F.col("kind") == WORDS), parts).write.parquet(path + "-words")
    free_shuffles(spark)
    words = spark.read.schema(PACK).parquet(path + "-words")
    sums = words.mapInArrow(totals, "words long, background long, target long").agg(F.sum("words"), F.sum("background"), F.sum("target")).first()
    known = (sums[0] or 0) if kept is None else len(kept)
    return Models(found.where(F.col("kind") == PAIRS).unionByName(words), parts, known + 2, (sums[1] or 0, sums[2] or 0), kept, discount, (path, path + "-words"))


def release(models: Models) -> None:
    """Remove the tables; what ``score`` returned before stays valid."""
    for path in models.paths:
        remove_path(models.tables.sparkSession, path)


def _blocks(texts: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """Rows of about BLOCK_TOKENS symbols: names and lengths of texts, distinct symbols, and all symbols as their places."""
    limit = BLOCK_TOKENS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths, lines, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate(lines), return_inverse=True)
            columns = [np.concatenate(names), np.concatenate(lengths), words, ids.astype("<i4").view(np.uint8).reshape(-1, 4).T]  # ids a byte after the other
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["names", "lengths", "words", "ids"])

        for batch in batches:
            for part in slices(batch, "_t"):
                line, n = symbols_of(part.column("_t"), vocabulary)
                name = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b")], axis=1)
                names.append(name[n > 0])
                lengths.append(n[n > 0].astype(np.int64))
                lines.append(line)
                held += len(line)
                if held > limit:
                    yield out()
                    names, lengths, lines, held = [], [], [], 0
        if held:
            yield out()

    found = texts.mapInArrow(gather, "names binary, lengths binary, words binary, ids binary")
    return found.withColumn("block", F.monotonically_increasing_id())


def _distinct_pairs(words: np.ndarray, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (first, second) of a block's distinct pairs, and of every pair which one it is."""
    ids, second = np.ascontiguousarray(_matrix(data, 4, np.uint8)).view("<i4")[:, 0], _seconds(lengths)
    codes, which = np.unique(ids[second - 1].astype(np.int64) * len(words) + ids[second], return_inverse=True)
    return codes // len(words), codes % len(words), which


def _replied(part: np.ndarray, packs: list[tuple[int, bytes]], unpack: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Values of a block's keys, in their order, from the replies of all parts; ``part`` is that of each key."""
    values = np.concatenate([unpack(v) for _, v in sorted(packs)])
    out = np.empty_like(values)
    out[np.argsort(part, kind="stable")] = values
    return out


def _losses(single, pairs, a, b, which, lengths, tokens, symbols, discount) -> list[np.ndarray]:
    """Mean loss a token of every text in the background and in the target model."""
    row, n, out = np.repeat(np.arange(len(lengths)), lengths - 1), lengths - 1, []
    for side in (0, 1):
        count, kinds_of = single[:, side], single[:, 2 + side]
        unigram = (count + 1.0) / (tokens[side] + symbols)
        rest = np.where(count > 0, discount * kinds_of / np.maximum(count, 1), 1.0)
        seen = np.maximum(pairs[:, side] - discount, 0) / np.maximum(count[a], 1)
        loss = -np.log(rest[a] * unigram[b] + seen)
        out.append(np.bincount(row, weights=loss[which], minlength=len(n)) / n)
    return out


def _joined(df: DataFrame, found: DataFrame, name: list) -> DataFrame:
    """The losses of named texts (_a, _b, _n, _target, _background) beside the rows of ``df``."""
    own = {c: f for c, f in zip(found.columns, fresh(df, *found.columns))}
    found = broadcast_if_small(found.withColumnsRenamed(own), limit=FEW_VALUES)  # names and losses, no texts; beyond the limit both sides are shuffled
    at = {c: F.col(f) for c, f in own.items()}
    new = {"n_tokens": F.coalesce(at["_n"], F.lit(0)), "target_loss": F.coalesce(at["_target"], F.lit(0.0)),
           "background_loss": F.coalesce(at["_background"], F.lit(0.0)), "score": F.coalesce(at["_target"] - at["_background"], F.lit(0.0))}
    joined = df.join(found, (name[0] == at["_a"]) & (name[1] == at["_b"]), "left")
    return joined.select(*[c for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def _looked_up(asked: DataFrame, models: Models) -> DataFrame:
    """The values of all asked keys, in their order; 0 where a table lacks the key."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, wanted = {}, {}
        for batch in batches:
            for kind, part, block, keys, values in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "block", "keys", "values"))):
                if values is None:
                    wanted.setdefault((kind, part), []).append((block, _matrix(keys, KEYS[kind], np.uint64)))
                else:
                    tables[kind, part] = _unpacked(kind, keys, values)
        for (kind, part), asks in wanted.items():
            have, values = tables.pop((kind, part), (np.zeros((0, KEYS[kind]), np.uint64), np.zeros((0, VALUES[kind]), np.int64)))
            first, group = _grouped(np.concatenate([have, *(k for _, k in asks)]))
            by_group = np.zeros((len(first), VALUES[kind]), np.int64)
            by_group[group[:len(have)]] = values
            at = len(have)
            for block, keys in asks:
                yield _rows([(kind, part, block, None, _bytes(by_group[group[at:at + len(keys)]]))])
                at += len(keys)

    return asked.unionByName(models.tables).repartition(models.parts, "kind", "part").mapInArrow(answer, PACK)


def score(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` to every row.

    A text is named by 128 bits of hash; equal texts have equal scores.
    """
    prepare(df.sparkSession)
    text = text_or_empty(text_col)
    name = [F.xxhash64(text), F.xxhash64(F.lit(7), text)]
    parts, symbols, tokens, discount = models.parts, models.symbols, models.tokens, models.discount

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, words, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "words", "ids"))):
                words = np.frombuffer(words, np.uint64)
                a, b, _ = _distinct_pairs(words, ids, np.frombuffer(lengths, np.int64))
                yield _packs(PAIRS, block, _named(np.stack([words[a], words[b]], axis=1)), None, parts)
                yield _packs(WORDS, block, words[:, None], None, parts)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        own = table.slice(int(np.flatnonzero(kinds < 0)[0]), 1).to_pylist()[0]
        packs = {k: [(r["part"], r["values"]) for r in table.filter(pa.array(kinds == k)).to_pylist()] for k in (PAIRS, WORDS)}
        words, lengths = np.frombuffer(own["words"], np.uint64), np.frombuffer(own["lengths"], np.int64)
        a, b, which = _distinct_pairs(words, own["ids"], lengths)
        pairs = _replied(_part(_named(np.stack([words[a], words[b]], axis=1)), parts), packs[PAIRS], lambda v: _matrix(v, VALUES[PAIRS], np.int64))
        single = _replied(_part(words[:, None], parts), packs[WORDS], lambda v: _matrix(v, VALUES[WORDS], np.int64))
        names = np.frombuffer(own["names"], np.int64).reshape(-1, 2)
        found = _losses(single, pairs, a, b, which, lengths, tokens, symbols, discount)
        out = {"_a": pa.array(names[:, 0]), "_b": pa.array(names[:, 1]), "_n": pa.array(lengths - 1), "_target": pa.array(found[1]), "_background": pa.array(found[0])}
        return pa.table(out)

    with written(_blocks(df.select(text.alias("_t"), name[0].alias("_a"), name[1].alias("_b")), models.vocabulary), "lm-blocks") as blocks:
        replies = _looked_up(blocks.mapInArrow(ask, PACK), models).select("kind", "part", "block", "values")
        whole = blocks.withColumn("kind", F.lit(-1)).unionByName(replies, allowMissingColumns=True)
        found = whole.groupBy("block").applyInArrow(finish, "_a long, _b long, _n long, _target double, _background double")
        found = cut(found.dropDuplicates(["_a", "_b"]))
    return _joined(df, found, name)


# ---- both models of a table and the scores of that table, in one go


def _packed(data: bytes) -> bytes:
    """Compressed, with the length in front: what is shuffled and written is mostly small counts."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, a column after the other, compressed."""
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) >> (8 * n) == 0)
    return _packed(bytes([size]) + values.T.astype(f"<u{size}").tobytes())


def _from_small(data: bytes, columns: int) -> np.ndarray:
    data = _unpacked_bytes(data)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).reshape(columns, -1).T.astype(np.int64)


def _block_pairs(words: np.ndarray, ids: bytes, lengths: np.ndarray, flags: np.ndarray) -> tuple:
    """Of a block's distinct pairs: first and second places, which one each pair is, names, and counts in background and target texts."""
    a, b, which = _distinct_pairs(words, ids, lengths)
    good = np.repeat(flags, lengths - 1)
    counts = np.stack([np.bincount(which[~good], minlength=len(a)), np.bincount(which[good], minlength=len(a))], axis=1)
    return a, b, which, _named(np.stack([words[a], words[b]], axis=1)), counts


def _counted_blocks(texts: DataFrame, parts: int) -> DataFrame:
    """Rows of about BLOCK_TOKENS symbols.

    They hold names, kinds and lengths of texts, the distinct symbols and all symbols as
    their places (ids); of the distinct pairs how many each symbol begins (runs) and
    their parts (spots); and of all symbols the parts (homes) and the counts (own).
    """
    limit = BLOCK_TOKENS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flags, lengths, lines, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate(lines), return_inverse=True)
            size, kinds = np.concatenate(lengths), np.concatenate(flags)
            ids = np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()  # a byte after the other
            first, _, _, keys, counts = _block_pairs(words, ids, size, kinds)
            own = np.stack([np.bincount(first, weights=c, minlength=len(words)) for c in counts.T], axis=1).astype(np.int64)
            runs = np.bincount(first, minlength=len(words))
            columns = [np.concatenate(names).tobytes(), kinds.tobytes(), size.tobytes(), words.tobytes(), _packed(ids),
                       _small(runs[:, None]), _small(_part(keys, parts)[:, None]), _small(_part(words[:, None], parts)[:, None]), _small(own)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=list(BLOCK))

        for batch in batches:
            for part in slices(batch, "_t"):
                line, n = symbols_of(part.column("_t"), None)
                name = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b")], axis=1)
                names.append(name[n > 0])
                flags.append(part.column("_y").to_numpy(zero_copy_only=False)[n > 0])
                lengths.append(n[n > 0].astype(np.int64))
                lines.append(line)
                held += len(line)
                if held > limit:
                    yield out()
                    names, flags, lengths, lines, held = [], [], [], [], 0
        if held:
            yield out()

    found = texts.mapInArrow(gather, ", ".join(f"{c} binary" for c in BLOCK))
    return found.withColumn("block", F.monotonically_increasing_id())


def _grouped_packs(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, np.ndarray, bytes]]]:
    """The packs of a task by part, in the order of blocks."""
    got: dict[int, list] = {}
    for batch in batches:
        for part, block, keys, values in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "keys", "values"))):
            got.setdefault(part, []).append((block, np.frombuffer(keys, np.uint64), values))
    return {part: sorted(packs, key=lambda p: p[0]) for part, packs in got.items()}


def cross_entropy(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75) -> DataFrame:
    """``train`` on a table and ``score`` of the same table: equal columns and values, but each pair goes to its part once.

    1. Blocks send their distinct pairs with both counts to parts by hash; a part adds
       them up and replies with the sums. It also tells one block, for each model, that
       the pair is its to count among the continuations of the first word.
    2. Blocks send their words with their own counts and those continuations; parts add
       up and reply.
    3. A block has all that its texts' losses need.

    Rows between stages are at most as many as the distinct pairs of the blocks.
    """
    spark = df.sparkSession
    prepare(spark)
    text = text_or_empty(text_col)
    name = [F.xxhash64(text), F.xxhash64(F.lit(7), text)]
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1
    chosen = broadcast_if_small(targets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lit(True).alias("_good")).distinct())
    given = df.select(F.col(id_col).alias("_id"), text.alias("_t"), name[0].alias("_a"), name[1].alias("_b")).join(chosen, "_id", "left").select(
        "_t", "_a", "_b", F.coalesce("_good", F.lit(False)).alias("_y"))

    def packs(block: int, keys: np.ndarray, values: np.ndarray, kind: int) -> pa.RecordBatch:
        part = _part(keys[:, None], parts)
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        return _rows([(kind, int(p), block, keys[order[a:b]].tobytes(), _small(values[order[a:b]])) for p, a, b in zip(found, starts, [*starts[1:], len(order)])])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                words, lengths, flags = (np.frombuffer(block[c], t) for c, t in (("words", np.uint64), ("lengths", np.int64), ("flags", bool)))
                _, _, _, keys, counts = _block_pairs(words, _unpacked_bytes(block["ids"]), lengths, flags)
                yield packs(block["block"], keys[:, 0], counts, PAIRS)

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _grouped_packs(batches).items():
            keys, counts = np.concatenate([k for _, k, _ in got]), np.concatenate([_from_small(v, 2) for _, _, v in got])
            order = np.argsort(keys, kind="stable")  # equal keys stay in the order of blocks
            new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            out = np.zeros((len(keys), 3), np.int64)
            for side in (0, 1):
                own = counts[order, side]
                out[order, side] = np.add.reduceat(own, starts)[group]
                has = np.cumsum(own > 0)
                before = (has - (own > 0))[starts][group]
                out[order, 2] += ((own > 0) & (has - before == 1)).astype(np.int64) << side  # the first block that has it
            at = 0
            for block, k, _ in got:
                yield _rows([(PAIRS, part, block, None, _small(out[at:at + len(k)]))])
                at += len(k)

    def tell_words(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] < 0)
        words = np.frombuffer(own["words"], np.uint64)
        sums = _replied(_from_small(own["spots"], 1)[:, 0], [(r["part"], r["values"]) for r in rows if r["kind"] == PAIRS], lambda v: _from_small(v, 3))
        first = np.repeat(np.arange(len(words)), _from_small(own["runs"], 1)[:, 0])
        kinds = [np.bincount(first, weights=sums[:, 2] >> side & 1, minlength=len(words)).astype(np.int64) for side in (0, 1)]
        return pa.Table.from_batches([packs(own["block"], words, np.concatenate([_from_small(own["own"], 2), np.stack(kinds, axis=1)], axis=1), WORDS),
                                      _rows([(PAIRS, 0, own["block"], None, _small(sums[:, :2]))])])

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _grouped_packs(batches).items():
            keys, counts = np.concatenate([k for _, k, _ in got]), np.concatenate([_from_small(v, 4) for _, _, v in got])
            found, group = np.unique(keys, return_inverse=True)
            sums = np.stack([np.bincount(group, weights=c, minlength=len(found)) for c in counts.T], axis=1).astype(np.int64)
            at = 0
            for block, k, _ in got:
                yield _rows([(WORDS, part, block, None, _small(sums[group[at:at + len(k)]]))])
                at += len(k)
            yield _rows([(TOTALS, part, -1, None, np.array([int((found > BOUNDARY).sum()), *sums[:, :2].sum(axis=0)], np.int64).tobytes())])

    with written(_counted_blocks(given, parts), "lm-blocks") as blocks:
        with written(blocks.select("block", "words", "ids", "lengths", "flags").mapInArrow(ask, PACK).repartition(parts, "part").mapInArrow(add_pairs, PACK), "lm-pairs") as replies:
            free_shuffles(spark)
            told = blocks.select("block", "words", "runs", "spots", "own").withColumn("kind", F.lit(-1)).unionByName(replies.drop("keys"), allowMissingColumns=True).groupBy("block").applyInArrow(tell_words, PACK)
            path = shared_dir(spark, "lm-told")
            told.write.partitionBy("kind").parquet(path)
        del told
        free_shuffles(spark)
        some = not blocks.isEmpty()  # else no part was written
        told = {kind: spark.read.schema(PACK).parquet(f"{path}/kind={kind}") if some else spark.createDataFrame([], PACK) for kind in (PAIRS, WORDS)}
        with written(told[WORDS].repartition(parts, "part").mapInArrow(add_words, PACK), "lm-words") as words:
            remove_path(spark, f"{path}/kind={WORDS}")
            sums = [np.frombuffer(r["values"], np.int64) for r in words.where(F.col("kind") == TOTALS).select("values").collect()]  # three numbers a part
            known, *tokens = np.sum(sums, axis=0).tolist() if sums else (0, 0, 0)
            symbols = known + 2
            free_shuffles(spark)

            def finish(key: tuple, table: pa.Table) -> pa.Table:
                rows = table.to_pylist()
                own = next(r for r in rows if r["kind"] < 0)
                homes, lengths = _from_small(own["homes"], 1)[:, 0], np.frombuffer(own["lengths"], np.int64)
                a, b, which = _distinct_pairs(homes, _unpacked_bytes(own["ids"]), lengths)
                pairs = _from_small(next(r["values"] for r in rows if r["kind"] == PAIRS), 2)
                single = _replied(homes, [(r["part"], r["values"]) for r in rows if r["kind"] == WORDS], lambda v: _from_small(v, 4))
                found = _losses(single, pairs, a, b, which, lengths, tokens, symbols, discount)
                names = np.frombuffer(own["names"], np.int64).reshape(-1, 2)
                return pa.table({"_a": pa.array(names[:, 0]), "_b": pa.array(names[:, 1]), "_n": pa.array(lengths - 1),
                                 "_target": pa.array(found[1]), "_background": pa.array(found[0])})

            answers = told[PAIRS].withColumn("kind", F.lit(PAIRS)).unionByName(words.where(F.col("kind") == WORDS)).drop("keys")
            whole = blocks.select("block", "names", "lengths", "homes", "ids").withColumn("kind", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
            found = whole.groupBy("block").applyInArrow(finish, "_a long, _b long, _n long, _target double, _background double")
            found = cut(found.dropDuplicates(["_a", "_b"]))
        remove_path(spark, path)
    return _joined(df, found, name)

