"""Whitening, Merkle manifest and SimHash components against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm import decontaminate, exact_dedup, line_dedup, lm_score, merkle, ngram_join, sharding, simhash, token_counts, whitening

# ---- operator 11 ----


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _plain_whitening(vectors, k):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(axis=1), c @ q / np.sqrt(values), values / (c * c).sum() * n


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 24)) * np.linspace(3, 0.5, 24)).astype(np.float32)
    rows = [(i, [float(v) for v in row], None) for i, row in enumerate(vectors)]
    bad = [(9_000, None, 1), (9_001, [1.0, None] + [0.0] * 22, 1), (9_002, [float("nan")] * 24, 1), (9_003, [float("inf")] + [0.0] * 23, 1),
           (9_004, [1.0, 2.0], 1), (9_005, [], 1)]
    df = _vectors(spark, rows + bad).withColumns({"component": F.lit(1), "x": F.lit(2), "_id": F.lit(3), "length": F.lit(4)}).repartition(5)
    for k, basis in ((5, 12), (32, None)):
        found = whitening.whiten(df, k=k, max_basis=basis).toPandas().sort_values(["vec_id", "component"])
        deviation, z, explained = _plain_whitening(vectors, min(k, 24))
        assert len(found) == 700 * min(k, 24) and set(found["vec_id"]) == set(range(700))
        got = found["whitened"].to_numpy().reshape(700, -1)
        signs = np.sign((got * z).sum(axis=0))
        np.testing.assert_allclose(got * signs, z, atol=1e-9)
        np.testing.assert_array_equal(found["deviation"].to_numpy().reshape(700, -1)[:, 0], deviation)
        np.testing.assert_allclose(found["explained"].to_numpy().reshape(700, -1)[0], explained, rtol=1e-10)
        assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-10 and (found["n"] == 700).all()


def test_whitening_of_degenerate_tables(spark):
    empty = _vectors(spark, [])
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0], 0)] * 4)).collect() == []  # no spread
    flat = [(i % 7, [float(i), 2.0 * i, 0.0], 0) for i in range(40)] + [(None, [5.0, 10.0, 0.0], None)]  # one direction, repeated and null ids
    found = whitening.whiten(_vectors(spark, flat)).collect()
    assert len(found) == 41 and {r["component"] for r in found} == {1} and sum(r["vec_id"] is None for r in found) == 1
    assert abs(found[0]["explained"] - 1) < 1e-9


def test_jacobi_davidson_restarts_and_locks():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.sort(rng.random(300) ** 3)[::-1] * 50
    values[3] = values[2]  # a double eigenvalue
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found = whitening.jacobi_davidson(lambda b: a @ b, 300, 8, max_basis=24)
    np.testing.assert_allclose(found.values, values[:8], rtol=1e-12)
    assert found.residuals.max() < 1e-12 * values[0] and found.rounds < 60
    np.testing.assert_allclose(found.vectors.T @ found.vectors, np.eye(8), atol=1e-13)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    np.testing.assert_allclose(a @ whitening.minres(lambda v: a @ v, b, 60), b, atol=1e-8)


# ---- operator 12 ----

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _climb(level):
    """All levels above some nodes."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _siblings(levels, i):
    steps = []
    for level in levels[:-1]:
        run = i // 8 * 8
        steps.append((level[run:i], level[i + 1:run + 8]))
        i //= 8
    return steps


def _plain_manifest(rows):
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaves.setdefault(lang, []).append((doc_id, _h(*map(_field, (doc_id, source, lang, n_chars, text))), _h(*map(_field, (doc_id, source, lang, n_chars, _lower(text))))))
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: _climb([x[1] for x in sorted(leaves[g])]) for g in groups}
    high = _climb([low[g][-1][0] for g in groups])
    out = []
    for at, g in enumerate(groups):
        for i, (doc_id, leaf, lowered) in enumerate(sorted(leaves[g])):
            steps = _siblings(low[g], i) + _siblings(high, at)
            start = lowered if zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
            for left, right in steps:
                start = _h(*left, start, *right)
            out.append((doc_id, leaf, low[g][-1][0], high[-1][0], _h(*[x for s in steps for x in (*s[0], *s[1])]), start, start == high[-1][0]))
    return sorted(out)


def _tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_manifest_equals_plain_trees(spark):
    sizes = {None: 3, "": 1, "de": 1, "en": 531, "fr": 64, "é": 9, "zz": 8, "a": 2, "b": 1, "c": 17}  # ten groups: two levels above the subroots
    rows, number = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            number += 7
            rows.append((number, [f"Some TEXT {number}", "lower", None, "", "ÄÖ A"][number % 5], lang, ["web", None][number % 2], [5, None][number % 3 == 0]))
    df = spark.createDataFrame(rows, COLUMNS).repartition(6).withColumns({c: F.lit(1) for c in ("g", "lo", "hi", "n", "digest", "_id", "path", "leaf", "all", "_part")})
    found = sorted(tuple(r) for r in merkle.verified(df, _tampered()).collect())
    assert found == _plain_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("rows", [[(5, "A", None, None, None)], [(5, "A", "x", "s", 1), (6, None, "x", "s", 1)], [(i, "B", str(i), None, 2) for i in range(9)]])
def test_manifest_of_few_rows(spark, rows):
    found = merkle.verified(spark.createDataFrame(rows, COLUMNS), _tampered()).collect()
    assert sorted(map(tuple, found)) == _plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert merkle.verified(spark.createDataFrame([], COLUMNS), _tampered()).collect() == []
    repeated = [(None, "x", "en", "s", 1)] * 9 + [(3, "x", "en", "s", 1)] * 3 + [(3, "Y" * 1_000_000, "en", "s", 1)]
    df = spark.createDataFrame(repeated, COLUMNS)
    found = merkle.verified(df, F.lit(None).cast("boolean")).collect()
    assert len(found) == 13 and all(r["verified"] for r in found) and len({r["root"] for r in found}) == 1
    again = merkle.verified(df.repartition(3), F.lit(False)).collect()
    assert {r["root"] for r in again} == {r["root"] for r in found}


# ---- operator 13 ----


def _plain_fingerprint(text, n=4):
    words = _lower(text or "").encode()
    for blank in (9, 10, 11, 12, 13):
        words = words.replace(bytes([blank]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(ids, prints, within=4):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= within:
                parent[top(i)] = top(j)
    roots = [top(i) for i in range(len(ids))]
    known = lambda r: [x for x, y in zip(ids, roots) if y == r and x is not None]
    return [min(known(r), default=None) for r in roots]


def _near_texts(seed, documents, words=60):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(documents):
        base = [f"w{rng.integers(900)}" for _ in range(words)]
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(words)] = f"w{rng.integers(900)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("cell_rows", [4_096, 3])
def test_simhash_components_equal_all_pairs(spark, cell_rows):
    texts = _near_texts(2, 60) + [None, "", " \t\n", "One", "one", "two words", "Two\twords ", "a b c d", "é É", "x" * 300_000]
    ids = [1_000 - i for i in range(len(texts))]
    ids[3], ids[-1], ids[7] = None, None, 5
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4).withColumns(
        {c: F.lit(1) for c in ("fp", "_id", "cell", "comp", "component_id", "_shared")})
    found = simhash.components(df, cell_rows=cell_rows).collect()
    prints = [_plain_fingerprint(t) for t in texts]
    wanted = list(zip(ids, [f"{p:016x}" for p in prints], _plain_components(ids, prints)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert len({r["component_id"] for r in found}) < len(set(prints))  # some link


def test_crowded_cells_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    prints = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(80)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.crowded_edges(spark.createDataFrame(signed, "fp long"), 4).collect()
    parent = {s[0]: s[0] for s in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[top(e["a"])] = top(e["b"])
    plain = _plain_components(list(range(len(prints))), prints)
    groups = {}
    for s, c in zip(signed, plain):
        groups.setdefault(c, set()).add(top(s[0]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_manhattan_distance_bounds_hamming_and_cells_keep_links():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 3_000).astype(np.uint64)
    flips = np.array([sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in a], np.uint64)
    b = a ^ flips
    apart = np.abs(simhash.points(a).astype(int) - simhash.points(b).astype(int)).sum(axis=1)
    assert (apart <= np.bitwise_count(flips)).all() and simhash.near(a, b, 4).all()
    assert (simhash.cells(a, 4) == simhash.cells(b, 4)).any(axis=1).all()
    assert simhash.cells(a, 4).shape[1] == 70


def test_simhash_of_long_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    assert simhash.components(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"Word{i % 5_003}" for i in range(400_000))  # several pieces
    assert simhash.fingerprint(text.encode(), 4) == _plain_fingerprint(text)
    assert simhash.fingerprint((" " * 3_000_000 + "a b").encode(), 4) == _plain_fingerprint("a b")


# ---- odd inputs of earlier operators


def test_decontamination_of_one_repeated_character():
    """A long text of one character against an item of the same: hits are counted in bounded runs."""
    import tracemalloc

    import pyarrow as pa

    items = decontaminate.Items([7], ["a" * 500], 8, 0.08)
    points, at, _ = decontaminate.normalised(pa.array(["a" * 60_000, "b", "a" * 499 + "b" * 40]))
    tracemalloc.start()
    found = decontaminate.find(points, at, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6, peak
    assert {f[0] for f in found} == {0, 2} and all(f[4] <= 40 for f in found)
    ends = [(f[2], f[3]) for f in found if f[0] == 0]
    assert ends == [(i, i + 500) for i in range(0, 59_501, 500)]


def test_long_words_score_as_in_the_trie():
    pieces = {"a": -1.0, "ab": -1.5, "▁a": -1.2, "b": -2.0, "abab": -2.1, "▁": -3.0}
    trie = token_counts.Trie(pieces, -5.0)
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 5, 17, 300):
        word = "▁" + "".join(rng.choice(list("abc")) for _ in range(size))
        node = trie.insert(word)
        assert trie.rolling(word) == (trie.tokens[node], pytest.approx(trie.score[node]))


def test_long_words_keep_no_nodes():
    import pyarrow as pa

    trie = token_counts.Trie({"x": -1.0, "xx": -1.1}, -4.0)
    pretokens, tokens, _ = trie.count(pa.array(["x" * 300_000, "x x", None]))
    assert pretokens.tolist() == [1, 2, 0] and tokens[0] == 150_000 + 3 and len(trie.score) < 10


CLASHING = ("_raw", "_gone_id", "_gone_raw", "_gone_text", "_i", "_n", "_d", "_row", "_hash", "_f", "_gone", "_doc_of", "_first", "_a", "_b", "_ID", "_kept", "_rows")


def test_clashing_names_come_back_as_they_were(spark):
    rows = [(1, "a b c d e f\nx y z"), (2, "A b c d e f\nx y z"), (2, "A b c d e f\nx y z"), (None, None), (4, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHING})

    def same(found, ids):
        got = found.collect()
        assert found.columns == df.columns and sorted(str(r["doc_id"]) for r in got) == sorted(map(str, ids))
        for r in got:
            assert all(r[c] == f"{c}-{'' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)

    same(exact_dedup.distinct_documents(df, keep="max"), [2, None, 4])
    same(exact_dedup.distinct_documents(df, keep="min"), [1, None, 4])
    same(ngram_join.one_of_each(df, n=5, percent=80), [1, None, 4])
    same(line_dedup.without_removed(df, line_dedup.matches(df)), [1, 2, 2, None, 4])
    models = lm_score.train(df, df.where("doc_id = 1"))
    scored = lm_score.score(df, models)
    assert sorted(scored.columns) == sorted([*df.columns, "n_tokens", "target_loss", "background_loss", "score"])
    assert {r["_a"] for r in scored.collect()} == {"_a-1", "_a-2", "_a-4", "_a-"}
    lm_score.release(models)


def test_sources_are_dealt_by_bucket_whatever_the_join(spark):
    rows = [(i, "hot" if i % 10 else "cold", "t" * (i % 7)) for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sharding.stratified_shards(df, 4, bucket_rows=50)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [_source" in plan and "_b#" in plan.split("RepartitionByExpression [_source")[1].split("]")[0]
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r["position"] for r in got) == list(range(1_500))
    for shard in range(4):
        assert sum(r["shard"] == shard and r["source"] == "cold" for r in got) in (37, 38)


def test_cross_entropy_equals_training_and_scoring(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(rng.zipf(1.5)) % 60}" for _ in range(rng.integers(0, 40))) for _ in range(60)] + [None, "", " \n", "One ONE one", "w1", "w1"]
    rows = [(i % 61 if i % 13 else None, t, str(i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _a string").repartition(3)
    monkeypatch.setattr(lm_score, "PART_BYTES", 700)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 90)
    for targets in (df.where("doc_id % 3 = 0"), df.where("doc_id = 0 OR doc_id IS NULL"), df.where("false")):
        models = lm_score.train(df, targets)
        wanted, got = lm_score.score(df, models), lm_score.cross_entropy(df, targets)
        assert got.columns == wanted.columns
        key = lambda r: r["_a"]
        for x, y in zip(sorted(wanted.collect(), key=key), sorted(got.collect(), key=key), strict=True):
            assert tuple(x)[:4] == tuple(y)[:4] and tuple(x)[4:] == pytest.approx(tuple(y)[4:], rel=1e-12, abs=1e-12)
        lm_score.release(models)
    assert lm_score.cross_entropy(df.where("false"), df).collect() == []
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["score"]) for r in lm_score.cross_entropy(blank, blank).collect()] == [(0, 0.0)] * 2
