"""Near-duplicate lines by an exact set-similarity join (operator 5).

A line's tokens are the hashes of its distinct runs of ``n`` words (of the
whole line, if shorter). Lines with equal token sets are one entry, named by
128 bits of hash and placed at its first occurrence. Tokens are ordered by
rarity: counts of 2^16 hash buckets over all lines give a global order, rare
buckets first, then the hash. Two sets can reach the similarity only if their
prefixes (the first size - ceil(t * size) + 1 tokens) share a token, their
sizes are within t of each other (length filter) and, at their first shared
token, what is left suffices for the overlap (positional filter). Pairs that
pass are verified on their full sets. A line goes if an earlier one
has Jaccard similarity t or more. Lines are in order of document id, then the
text's hash and the number of the copy (for ids that are null or repeat), then
line number.

DataFrame functions only. Tokens are computed once and stored until the sets
are. What is shuffled is prefix tokens, and texts of lines
in candidate pairs; the broadcast is the 2^16 bucket ranks. Rows of a frequent
prefix token are split by the adaptive skew join; equal lines count as one
there however often they occur.

Defined results: lines end at line feeds; blank lines and null or empty texts
have no tokens and stay. Case and the kind of white space don't matter.
Null ids come first in the order of documents. A row is told by its id, a hash
of its text and, among rows that agree in both, a number from 0 (``copy``): of
such copies the lines of number 0 count as the earlier ones.
"""

from __future__ import annotations

import functools
import operator
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.llm.staging import cut, fresh, prepare, text_or_empty, written
from featurelens.operators.sizes import broadcast_if_small

BUCKET_BITS = 16
FEW_VALUES = 4_000_000


def _buckets(token: Column) -> Column:
    return token.bitwiseAND((1 << BUCKET_BITS) - 1)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def _copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, n): how many rows agree in id and text."""
    return df.groupBy(F.col(id_col).alias("doc"), _text_hash(text_col).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


def _numbers(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, line_no, line) of every line that isn't blank."""
    split = df.select(F.col(id_col).alias("doc"), _text_hash(text_col).alias("text_hash"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike("[^ \\t\\r\\f\\x0B]"))


def with_tokens(lines: DataFrame, n: int) -> DataFrame:
    """Add ``tokens``: hashes of the runs of ``n`` words, repeated ones too."""
    blank = " \t\r\f\x0b"
    clean = lines.withColumn("_l", F.btrim(F.lower("line"), F.lit(blank)))
    # most lines have single spaces only, for which splitting needs no pattern
    odd = functools.reduce(operator.or_, [F.col("_l").contains(x) for x in ("  ", "\t", "\r", "\f", "\x0b")])
    words = clean.withColumn("_w", F.when(odd, F.split("_l", "[ \\t\\r\\f\\x0B]+")).otherwise(F.split("_l", " ")))
    # a word is hashed once; a run is the hash of its words' numbers
    hashed = words.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    runs = F.when(F.size("_h") < n, F.array(F.xxhash64("_h", F.size("_h")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_h") - n), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(n)])))
    return hashed.withColumn("tokens", runs).drop("_l", "_w", "_h")


def bucket_ranks(lines: DataFrame) -> list[int]:
    """Rank of every bucket by the count of its tokens over all lines (ties by number)."""
    # explode() would add a filter on the array, which repeats its whole expression for every element
    counts = lines.select(F.explode_outer("tokens").alias("t")).groupBy(_buckets(F.col("t")).cast("int").alias("b")).count().collect()  # 2^16 at most
    found = {r["b"]: r["count"] for r in counts}
    order = sorted(range(1 << BUCKET_BITS), key=lambda b: (found.get(b, 0), b))
    ranks = [0] * (1 << BUCKET_BITS)
    for rank, b in enumerate(order):
        ranks[b] = rank
    return ranks


def by_rarity(ranks: list[int]) -> Column:
    """Distinct ``tokens`` as sorted numbers: bucket rank above the hash's other bits."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")  # folded to one constant

    def key(t: Column) -> Column:
        rank = F.element_at(table, (_buckets(t) + 1).cast("int"))
        return F.shiftleft(rank, 47).bitwiseOR(F.shiftrightunsigned(t, BUCKET_BITS + 1))

    return F.sort_array(F.array_distinct(F.transform("tokens", key)))


def _least(size: Column, percent: int) -> Column:
    """Ceiling of size * percent / 100, in whole numbers."""
    return F.floor((size * percent + 99) / 100).cast("int")


def entries(tokens: DataFrame, percent: int) -> DataFrame:
    """One row per line: doc, text_hash, line_no, set name (sid, sid2), size and prefix tokens in order of rarity."""
    ranks = bucket_ranks(tokens)
    ordered = tokens.select("doc", "text_hash", "line_no", by_rarity(ranks).alias("tokens"))
    size = F.size("tokens")
    return ordered.select("doc", "text_hash", "line_no", F.xxhash64("tokens").alias("sid"), F.xxhash64(F.lit(7), "tokens").alias("sid2"), size.alias("size"),
                          F.slice("tokens", F.lit(1), size - _least(size, percent) + 1).alias("prefix"))


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per line that isn't blank: doc, text_hash, copy, line_no, ``first`` (the earliest similar or equal line, always of copy 0) and ``removed``."""
    if not 1 <= percent <= 100 or n < 1:
        raise ValueError(f"percent must be from 1 to 100 and n positive: {percent}, {n}")
    prepare(df.sparkSession)
    with ExitStack() as stored:
        # read for the counts and again for the sets; hashes don't compress
        hashed = with_tokens(lines_of(df, id_col, text_col), n).select("doc", "text_hash", "line_no", "tokens")
        with written(hashed, "line-tokens", **{"compression": "uncompressed", "parquet.enable.dictionary": "false"}) as tokens:
            table = stored.enter_context(written(entries(tokens, percent), "line-sets"))
        lines = cut(table.select("doc", "text_hash", "line_no", "sid", "sid2"))
        sets = table.groupBy("sid", "sid2").agg(F.min(F.struct("doc", "text_hash", "line_no")).alias("at"), F.first("size").alias("size"),
                                                F.first("prefix").alias("prefix"))
        sets = cut(sets)
    firsts = sets.select("sid", "sid2", "at")
    pairs = cut(_candidates(sets, percent))
    similar = _verified(df, firsts, pairs, id_col, text_col, n, percent)
    earlier = similar.groupBy("sid", "sid2").agg(F.min("earlier").alias("earlier"))
    decided = firsts.join(earlier, ["sid", "sid2"], "left").select("sid", "sid2", F.coalesce(F.least("earlier", "at"), "at").alias("first"))
    # rows that agree in id and text have the same lines, which are kept once here and numbered again
    repeated = broadcast_if_small(_copies(df, id_col, text_col).where("n > 1").select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"), "n"), limit=FEW_VALUES)
    counted = lines.join(repeated, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").drop("_d", "_h")
    once = counted.where("n IS NOT NULL").dropDuplicates(["doc", "text_hash", "line_no"]).withColumn("copy", _numbers("n"))
    rows = counted.where("n IS NULL").withColumn("copy", F.lit(0).cast("long")).unionByName(once)
    found = rows.join(decided, ["sid", "sid2"])
    place = F.struct("doc", "text_hash", "line_no")
    same = place.eqNullSafe(F.col("first")) & (F.col("copy") == 0)
    return found.select("doc", "text_hash", "copy", "line_no", "first", (~same).alias("removed"))


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of set names that pass the prefix, length and positional filters.

    A row is a token, a name and size and position in one number. Names of 64
    bits do here: sets that share one are told apart when pairs are verified.
    """
    tokens = sets.select("sid", F.shiftleft(F.col("size").cast("long"), 32).alias("_s"), F.posexplode("prefix").alias("_p", "token"))
    tokens = tokens.select("token", "sid", (F.col("_s") + F.col("_p")).alias("at"))
    a = tokens.select("token", F.col("sid").alias("a_sid"), F.col("at").alias("_a"))
    b = tokens.select("token", F.col("sid").alias("b_sid"), F.col("at").alias("_b"))
    a_size, b_size = F.shiftright("_a", 32), F.shiftright("_b", 32)
    a_pos, b_pos = F.col("_a").bitwiseAND((1 << 32) - 1), F.col("_b").bitwiseAND((1 << 32) - 1)
    left = F.least(a_size - a_pos, b_size - b_pos)  # this token and those after it
    enough = left * (100 + percent) >= percent * (a_size + b_size)
    lengths = F.least(a_size, b_size) * 100 >= F.greatest(a_size, b_size) * percent
    joined = a.join(b, "token").where((F.col("a_sid") < F.col("b_sid")) & lengths & enough)
    return joined.select("a_sid", "b_sid").distinct()


def _verified(df, firsts, pairs, id_col, text_col, n, percent) -> DataFrame:
    """(sid, sid2, earlier) for sets with a similar one whose first line comes earlier."""
    wanted = pairs.select(F.col("a_sid").alias("sid")).unionByName(pairs.select(F.col("b_sid").alias("sid"))).distinct()
    places = firsts.join(wanted, "sid").select("sid", "sid2", "at", F.col("at.doc").alias("_d"), F.col("at.text_hash").alias("_h"),
                                                 F.col("at.line_no").alias("_l"))
    places = broadcast_if_small(places, limit=FEW_VALUES)  # names and places, no texts; beyond the limit both sides are shuffled
    texts = lines_of(df, id_col, text_col)
    there = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("line_no") == F.col("_l"))
    kept = texts.join(places, there).select("sid", "sid2", "at", "line")
    full = with_tokens(kept, n).select("sid", "sid2", "at", F.array_distinct("tokens").alias("tokens")).dropDuplicates(["sid", "sid2"])
    side = lambda p: full.select(*[F.col(c).alias(f"{p}_{c}") for c in ("sid", "sid2", "at", "tokens")])
    both = pairs.join(side("a"), "a_sid").join(side("b"), "b_sid")
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens"))
    total = F.size("a_tokens") + F.size("b_tokens")
    similar = both.withColumn("_o", overlap).where(F.col("_o") * (100 + percent) >= percent * total)
    return similar.select(F.when(F.col("a_at") < F.col("b_at"), F.col("b_sid")).otherwise(F.col("a_sid")).alias("sid"),
                          F.when(F.col("a_at") < F.col("b_at"), F.col("b_sid2")).otherwise(F.col("a_sid2")).alias("sid2"),
                          F.least("a_at", "b_at").alias("earlier"))


def per_document(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, lines that aren't blank and how many of them go."""
    counts = found.groupBy(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"), F.col("copy").alias("_c")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"))
    rows = _copies(df, id_col, text_col).withColumn("copy", _numbers("n"))
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("copy") == F.col("_c"))
    return rows.join(counts, same, "left").select(
        F.col("doc").alias(id_col), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))


def without_removed(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the removed lines taken out of its texts (null stays null)."""
    # all copies after number 0 lose the same lines, so number 1 stands for them
    row, name, doc, hashed, is_first, lines = fresh(df, "_row", "_hash", "_doc_of", "_hash_of", "_is_first", "_gone")
    gone = found.where("removed AND copy <= 1").groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(hashed), (F.col("copy") == 0).alias("_f")).agg(
        F.collect_set("line_no").alias(lines))
    rows = cut(df.withColumns({row: F.monotonically_increasing_id(), name: _text_hash(text_col)}))
    firsts = rows.groupBy(F.col(id_col).alias(doc), F.col(name).alias(hashed)).agg(F.min(row).alias(is_first)).select(is_first)
    marked = rows.join(firsts, F.col(row) == F.col(is_first), "left").withColumn(is_first, F.col(is_first).isNotNull())
    (first,) = fresh(marked, "_f")
    gone = gone.withColumnRenamed("_f", first)
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(name) == F.col(hashed)) & (F.col(is_first) == F.col(first))
    joined = marked.join(gone, same, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*df.columns)
