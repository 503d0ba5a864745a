"""Merkle manifest of a table by nested-interval labels (operator 12).

A row's leaf is the digest of its fields. Within a group (``lang``) the leaves
are in order of id; every ``fan_out`` consecutive nodes have a parent, up to the
group's subroot; the subroots, in order of the group, likewise lead to the root.
A node is labelled with the interval of leaf ranks it covers.

1. *Ranks* come from one global sort of slim rows: each partition of the sorted
   rows counts its rows of each group, the counts are summed up, and a row's rank
   is its partition's first rank plus its place. A group of any size is spread.
2. *Levels* are built bottom-up, one aggregation each, on (group, interval start
   div span); a parent keeps its at most ``fan_out`` children with their intervals.
3. *Proofs* go top-down: a node meets its parent by a join on the level's bucket
   and containment of its interval in the parent's. The siblings are the parent's
   children whose intervals are disjoint from the node's; its path is theirs in
   front of the parent's path. Rows of a level are an eighth of those below, so
   the work is in proportion to the leaves.

A proof is folded by hashing upwards from a leaf through its path; the leaf may
be a claimed one, made of other field values, which then misses the root.

Defined results: a null field is ``-``, any other its UTF-8 length, a colon and
its value. The null group comes first; null ids come first in a group; rows that
agree in group and id are ordered by leaf, and by claimed leaf then. Repeated rows are leaves of
their own. A group of one row has its leaf as subroot; one group has its subroot
as root. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm.exact_dedup import UPPER
from featurelens.llm.staging import cut, prepare
from featurelens.operators.sizes import broadcast_if_small

FAN_OUT = 8
_ROW_BITS = 33  # of monotonically_increasing_id; the partition's number is above
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """A value as it goes into a leaf's digest."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return _digest(F.concat(*[field(v) for v in values]))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` with the intervals of leaves (``lo``, ``hi``) and the size ``n`` of their group; the largest size."""
    rows = cut(rows)  # the sort's sampling reads its input too
    placed = cut(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    along = Window.partitionBy(group).orderBy("_part")
    starts = counts.withColumns({"_first": F.sum("_n").over(along) - F.col("_n") - F.col("_from"), "n": F.sum("_n").over(Window.partitionBy(group))})
    # a row for each partition and one more for each further group in it
    starts = broadcast_if_small(starts.select(group, "_part", "_first", "n"))
    largest = starts.agg(F.max("n")).first()[0] or 0
    rank = F.col("_first") + F.col("_at")
    return placed.join(starts, [group, "_part"]).withColumns({"lo": rank, "hi": rank}).drop("_at", "_part", "_first"), largest


def levels_of(leaves: DataFrame, largest: int, fan_out: int) -> list[DataFrame]:
    """Tables of nodes (g, lo, hi, n, digest) from the leaves up, the upper ones with their children (``kids``).

    ``n`` is the number of the group's nodes on that level: 1 at its top.
    """
    levels, span = [leaves], 1
    while largest > 1:
        span *= fan_out
        largest = -(-largest // fan_out)
        runs = levels[-1].where("n > 1").groupBy("g", F.expr(f"lo div {span}L").alias("_bucket"), "n").agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))  # fan_out at most
        joined = F.array_join(F.transform("kids", lambda kid: _hex(kid["digest"])), "")
        levels.append(cut(runs.select(
            "g", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            F.expr(f"(n + {fan_out - 1}L) div {fan_out}L").alias("n"), _digest(joined).alias("digest"), "kids")))
    return levels


def attached(levels: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """Leaves with ``path`` (left and right siblings a level, from the leaf up) and the columns of ``tops``.

    ``tops`` gives every group (g) the ``path`` that its top node starts with.
    """
    extra = [c for c in tops.columns if c != "g"]
    above = None
    for level in reversed(range(len(levels))):
        nodes, span = levels[level], fan_out ** (level + 1)
        found = nodes.where("n = 1").join(tops, "g")
        if above is not None:
            up = above.select("g", F.expr(f"lo div {span}L").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                              F.col("kids").alias("_kids"), *extra)
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            met = nodes.where("n > 1").withColumn("_bucket", F.expr(f"lo div {span}L")).join(up, ["g", "_bucket"]).where(inside)

            def side(disjoint) -> Column:
                return F.unhex(F.array_join(F.transform(F.filter("_kids", disjoint), lambda kid: F.hex(kid["digest"])), ""))

            step = F.struct(side(lambda kid: kid["hi"] < F.col("lo")).alias("left"), side(lambda kid: kid["lo"] > F.col("hi")).alias("right"))
            met = met.withColumn("path", F.concat(F.array(step), "path"))
            found = found.unionByName(met.select(*found.columns))
        above = found
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf (hex) leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(_hex(step["left"]), at, _hex(step["right"])), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text: level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), "")


_NO_PATH = "cast(array() as array<struct<left:binary,right:binary>>)"


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
             claims: Mapping[str, Column] | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per row of ``df``: id, ``leaf``, ``claimed`` leaf, ``subroot``, ``root`` (all hex) and ``path``.

    ``claims`` replaces fields by other values in the claimed leaf.
    """
    if fan_out < 2:
        raise ValueError(f"fan_out must be 2 or more: {fan_out}")
    prepare(df.sparkSession)
    claims = dict(claims or {})
    group = F.col(group_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("_id"), F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("g"),  # null first
        leaf([F.col(c) for c in fields]).alias("digest"), leaf([claims.get(c, F.col(c)) for c in fields]).alias("claimed"))
    leaves, largest = ranked(rows, "g", ["_id", "digest", "claimed"])
    levels = levels_of(leaves, largest, fan_out)
    subroots = None
    for nodes in levels:
        tops = nodes.where("n = 1").select("g", "digest")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    subroots = subroots.select(F.lit(0).alias("all"), "g", "digest")
    upper, groups = ranked(subroots, "all", ["g"])
    upper_levels = levels_of(upper.select(F.col("all").alias("g"), "lo", "hi", "n", "digest", F.col("g").alias("_group")), groups, fan_out)
    found = upper_levels[-1].where("n = 1").select("digest").first()  # the root
    root = found[0].hex() if found else ""
    start = df.sparkSession.range(1).select(F.lit(0).alias("g"), F.expr(_NO_PATH).alias("path"))
    tops = attached(upper_levels, start, fan_out).select(F.col("_group").alias("g"), F.col("digest").alias("subroot"), "path")
    paths = attached(levels, broadcast_if_small(tops), fan_out)
    return paths.select(F.col("_id").alias(id_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("claimed")).alias("claimed"),
                        _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"), "path")


def lowered(column: str) -> Column:
    return F.translate(F.col(column), UPPER, UPPER.lower())


def verified(df: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Proofs of all rows, where ``where`` holds with a claimed leaf of the text with A-Z lower-cased."""
    tampered = F.when(F.coalesce(where, F.lit(False)), lowered(text_col)).otherwise(F.col(text_col))
    found = manifest(df, id_col, claims={text_col: tampered}, **options)
    found = found.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return found.select(id_col, "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
