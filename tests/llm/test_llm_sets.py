"""Set operators against brute force: dedup, joins, sharding, decontamination; and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from featurelens.llm import decontaminate, exact_dedup, line_dedup, ngram_join, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(2 + i % 5)) for i in range(60)]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, size string, sid int").repartition(parts)


def near_copies(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(" ".join(t))
    return texts


def test_exact_dedup(spark):
    texts = ["Aé", "aé", "AÉ", None, "", "b", "b", "B", "long " * 5000] + ["same"] * 60
    rows = list(enumerate(texts)) + [(None, "b"), (None, "alone"), (5, "b")]
    for keep, fan_in in (("max", 2), ("min", 8)):
        got = exact_dedup.classes(table(spark, rows, 9), keep=keep, fan_in=fan_in).collect()
        assert len(got) == len(rows)
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
        for r in got:
            ids = groups[r["text_sha256"]]
            known = [i for i in ids if i is not None]
            assert r["group_size"] == len(ids) and r["keep_id"] == ((max if keep == "max" else min)(known) if known else None)
        assert all(sum(r["kept"] for r in got if r["text_sha256"] == d) == 1 for d in groups)
        kept = exact_dedup.distinct_documents(table(spark, rows, 9), keep=keep).collect()
        assert len(kept) == len(groups) and all(r["size"] == "x" for r in kept)
    assert exact_dedup.classes(table(spark, [])).count() == 0


def grams(text, n):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    sets, parent = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return collections.Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n, percent, tile_rows", [(3, 90, 512), (5, 80, 4), (2, 60, 3)])
def test_ngram_components(spark, n, percent, tile_rows):
    texts = near_copies(percent, 12, 14, 80, 6) + ["", None, " \n", "one", "ONE", "one two", "x" * 9000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "two three")]
    got = ngram_join.components(table(spark, rows), n=n, percent=percent, tile_rows=tile_rows).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, n, percent)
    if n == 5:
        kept = ngram_join.one_of_each(table(spark, rows[:-3]), n=n, percent=percent).collect()
        want = {c if s else d for d, s, c in brute_components(rows[:-3], n, percent)}
        assert sorted(r["doc_id"] for r in kept) == sorted(want) and kept[0]["size"] == "x"
    if n == 2:
        assert ngram_join.components(table(spark, [])).count() == 0


def test_linked_sets_share_a_key():
    import numpy as np

    rng = random.Random(4)
    heavies = [np.zeros(1 << 18, bool), np.arange(1 << 18) % 2 == 0, np.ones(1 << 18, bool)]
    for percent in (80, 90):
        bands = ngram_join.Bands(percent, 1 << 12)
        for size in [*range(1, 60), 150, 400, 1500]:
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
            drop = rng.randrange(size * (100 - percent) // 100 + 1)
            b = np.unique(np.r_[a[drop:], np.array([rng.getrandbits(64) for _ in range(size * (100 - percent) // 100 - drop)], np.uint64)])
            both = len(np.intersect1d(a, b))
            if np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            keys, owner = bands.keys(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), rng.choice(heavies))
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize("percent", [50, 60, 75, 79, 80, 90])
def test_subsets_of_the_least_size_share_a_key(percent):
    import numpy as np

    rng = random.Random(percent)
    bands = ngram_join.Bands(percent, 1 << 10)
    light = np.zeros(1 << 18, bool)
    for size in [*range(2, 130), 300, 700]:
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        b = np.sort(np.array(rng.sample(a.tolist(), -(-size * percent // 100)), np.uint64))
        if len(b) < len(a):
            keys, owner = bands.keys(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), light)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (size, len(b))


def _passing(a, b, percent, classes):
    """Whether the prefixes of two sets lead to an edge between them."""
    import numpy as np

    keys, owner, places = ngram_join.prefixes(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), classes, percent)
    sizes = np.array([len(a), len(b)])
    return len(ngram_join.candidates(keys, owner + 1, sizes[owner], places, percent)) == 1


def test_prefixes_of_linked_sets_pass():
    import numpy as np

    rng = random.Random(4)
    noise = np.random.default_rng(4)
    classes = [np.zeros(1 << 20, np.uint8), noise.integers(0, 2, 1 << 20).astype(np.uint8), noise.integers(0, 256, 1 << 20).astype(np.uint8)]
    for percent in (80, 90):
        for size in [*range(1, 60), 150, 400, 1500]:
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
            drop = rng.randrange(size * (100 - percent) // 100 + 1)
            b = np.unique(np.r_[a[drop:], np.array([rng.getrandbits(64) for _ in range(size * (100 - percent) // 100 - drop)], np.uint64)])
            both = len(np.intersect1d(a, b))
            if np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            assert _passing(a, b, percent, rng.choice(classes))


@pytest.mark.parametrize("percent", [50, 60, 75, 79, 80, 90])
def test_prefixes_of_the_smallest_subsets_pass(percent):
    import numpy as np

    rng = random.Random(percent)
    classes = np.random.default_rng(percent).integers(0, 30, 1 << 20).astype(np.uint8)
    for size in [*range(2, 130), 300, 700]:
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        b = np.sort(np.array(rng.sample(a.tolist(), -(-size * percent // 100)), np.uint64))
        if len(b) < len(a):
            assert _passing(a, b, percent, classes), (size, len(b))


def test_common_passages_are_no_candidates():
    """Sets that share a frequent passage and little else aren't paired, whatever their number."""
    import numpy as np

    rng = np.random.default_rng(8)
    passage = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 1 << 63, 40).astype(np.uint64)]) for _ in range(1_500)]
    classes = np.zeros(1 << 20, np.uint8)
    classes[(passage >> np.uint64(44)).astype(np.int64)] = 60
    at = np.cumsum([0, *map(len, sets)])
    keys, owner, places = ngram_join.prefixes(np.concatenate(sets), at, classes, 80)
    assert len(ngram_join.candidates(keys, owner, np.diff(at)[owner], places, 80)) == 0


def _near_and_less_near(rng, copies, edits):
    """Texts made from one: most with few words changed, some with so many that they link with some copies only."""
    base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(120)]
    texts = []
    for i in range(copies):
        t = list(base)
        for _ in range(rng.randrange(0, edits[i % len(edits)])):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(" ".join(t))
    return texts


def _moved(monkeypatch):
    """Receives how many texts each table of tiles asks for."""
    counts, cut = [], ngram_join.cut

    def counted(df):
        df = cut(df)
        if "tile" in df.columns:
            counts.append(df.count())
        return df

    monkeypatch.setattr(ngram_join, "cut", counted)
    return counts


def test_texts_of_a_large_cluster_are_moved_a_few_times(spark, monkeypatch):
    """Each pair of tiles had a copy of every text in them, so copies grew with the square of a cluster."""
    rows = list(enumerate(_near_and_less_near(random.Random(2), 240, [2])))
    counts = _moved(monkeypatch)
    got = ngram_join.components(table(spark, rows), n=5, percent=80, tile_rows=16).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 80)
    assert sum(counts) <= 5 * len(rows), counts


def test_sets_that_no_leader_links_are_compared_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(t for g in range(3) for t in _near_and_less_near(rng, 40, [3, 8, 14])))
    monkeypatch.setattr(ngram_join, "LEADERS", 0.001)
    monkeypatch.setattr(ngram_join, "PAIRS_IN_TILE", 5)
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROUND", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    counts = _moved(monkeypatch)
    got = ngram_join.components(table(spark, rows), n=5, percent=80, tile_rows=3).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 80)
    assert len(counts) > 2


def test_only_elements_of_several_documents_in_prefixes_are_sent(spark):
    """A passage of 60 words in all, 40 words of its own in each: the own elements fill the prefixes."""
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(30)]
    rows = [(d, f"{passage} {t}") for d, t in enumerate(own)]
    assert ngram_join._entries(table(spark, rows), "text", 5, 80, 4).count() == 0
    near = [*rows, (99, f"{passage} {own[3]} end")]
    found = ngram_join._entries(table(spark, near), "text", 5, 80, 4)
    assert ngram_join._prefix_clusters(found, 80, 4).count() == 2


def test_pairs_apart_are_all_that_pass_with_different_roots():
    import numpy as np

    rng = np.random.default_rng(3)
    for many in (1, 6, 60):
        keys, sids = rng.integers(0, 12, 400), rng.integers(0, 90, 400)
        sizes, places, roots = rng.integers(20, 30, 90)[sids], np.zeros(400, np.int64), rng.integers(0, many, 90)[sids]
        root, size = dict(zip(sids.tolist(), roots.tolist())), dict(zip(sids.tolist(), sizes.tolist()))
        want = set()
        for k in range(12):
            own = sorted(set(sids[keys == k].tolist()))
            want |= {(a, b) for a in own for b in own if a < b and root[a] != root[b] and 10 * min(size[a], size[b]) >= 8 * max(size[a], size[b])}
        got = [tuple(sorted(p)) for found in ngram_join.apart(keys, sids, sizes, places, roots, 80) for p in found.tolist()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", range(1, 7))
def test_sets_of_tiny_slices(n):
    import pyarrow as pa

    for words in range(7):
        texts = ["a b c d e f"[:max(0, 2 * words - 1)]]
        for texts in (texts, [None, *texts, ""]):
            values, at = ngram_join.gram_sets(pa.array(texts, pa.string()), n)
            assert at.tolist()[-1] == len(values) == (0 if words == 0 else max(1, words - n + 1))


def test_one_of_each_on_a_slice_of_three_words(spark):
    rows = [(1, "a b c")]
    assert [r["doc_id"] for r in ngram_join.one_of_each(table(spark, rows), n=5, percent=80).collect()] == [1]


def test_line_dedup(spark):
    lines = near_copies(9, 10, 6, 30, 4) + ["short line", "Short  LINE", "a b c d e", "   "]
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 7)))) for i in range(40)] + [(40, None), (41, ""), (None, lines[0])]
    seen, removed = [], collections.Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for k, line in enumerate((t or "").split("\n")):
            s = grams(line.lower(), 5)
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    removed[(d, k)] += 1
                seen.append(s)
    found = line_dedup.matches(table(spark, rows)).collect()
    assert {(r["doc"], r["line_no"]) for r in found if r["removed"]} == set(removed) and len(found) == len(seen)
    df = table(spark, rows)
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.without_removed(df, line_dedup.matches(df)).collect()}
    for d, t in rows:
        assert cleaned[d] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in removed))
    assert line_dedup.matches(table(spark, [])).count() == 0


def test_line_dedup_of_null_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    lines = near_copies(11, 8, 6, 30, 4) + ["  ", "short line"]
    rng = random.Random(12)
    ids = [None] * 14 + [3] * 6 + list(range(5, 12))
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5)))) for i in ids]
    rows += [rows[0]] * 3 + [rows[15]] * 2 + [(20, rows[0][1]), (None, None), (None, ""), (3, None)]
    hashes = {r["text"]: r["h"] for r in table(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    copies, seen, removed = collections.Counter(), [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        key = (d, hashes[t], copies[d, hashes[t]])
        copies[key[:2]] += 1
        removed[key] = []
        for k, line in enumerate((t or "").split("\n")):
            s = grams(line.lower(), 5)
            if s:
                removed[key].append((k, any(100 * len(s & o) >= 80 * len(s | o) for o in seen)))
                seen.append(s)
    want = {(*key, k, gone) for key, marks in removed.items() for k, gone in marks}
    texts = {h: t for t, h in hashes.items() if t is not None}
    for parts in (2, 9):
        df = table(spark, rows, parts)
        found = line_dedup.matches(df)
        got = [(r["doc"], r["text_hash"], r["copy"], r["line_no"], r["removed"]) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        per = collections.Counter((r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.per_document(df, found).collect())
        assert per == collections.Counter((d, len(marks), sum(g for _, g in marks)) for (d, _, _), marks in removed.items())
        cleaned = collections.Counter((r["doc_id"], r["text"] or "") for r in line_dedup.without_removed(df, found).collect())
        assert cleaned == collections.Counter((d, "\n".join(x for k, x in enumerate(texts[h].split("\n")) if (k, True) not in marks))
                                              for (d, h, _), marks in removed.items())


def test_sharding_law_and_mixture(spark):
    rng = random.Random(3)
    sources = ["hot"] * 400 + [f"s{i % 7}" for i in range(300)] + [None] * 50
    rows = [(i if i % 90 else None, "é" * rng.randrange(5) if i % 11 else None, s) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = sharding.stratified_shards(df, 8, bucket_rows=40).collect()
    assert len(got) == len(rows) and sorted(r["position"] for r in got) == list(range(len(rows)))
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
        mixture = collections.Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(mixture[x] - sources.count(x) / 8) <= 2 for x in set(sources))
    key = lambda i, t, *rest: (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(key(*r) for r in rows)
    again = sharding.stratified_shards(df.repartition(2), 8, bucket_rows=1000).collect()
    assert {(r["doc_id"], r["position"]) for r in again if r["doc_id"]} == {(r["doc_id"], r["position"]) for r in got if r["doc_id"]}
    assert sharding.stratified_shards(df.limit(0), 8).count() == 0


def edit_distance(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 22))) for _ in range(12)] + ["ab", "", None]
    texts = [None, "", "x" * 5000]
    for _ in range(60):
        hurt = list(rng.choice(items[:12]))
        for _ in range(rng.randrange(0, 1 + len(hurt) // 8)):
            p = rng.randrange(len(hurt))
            hurt[p] = rng.choice(["", "z", hurt[p] + "y"])
        texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))) + "  " + "".join(hurt).upper() + "\n" + rng.choice(WORDS))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = table(spark, list(enumerate(texts)))
    want = {}
    for d, t in enumerate(texts):
        flat = re.sub(r"\s+", " ", (t or "").lower())
        for i, item in enumerate(items):
            m = len(item or "")
            if m:
                k = max(0, min(int(0.08 * m), (m - 8) // 8))
                e = edit_distance(item, flat)
                if e <= k:
                    want[(d, i)] = e
    for block in (4_000_000, 200):
        got = collections.defaultdict(list)
        for r in decontaminate.matches(df, bench, block_chars=block).collect():
            got[(r["doc_id"], r["item_id"])].append(r["edits"])
            assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
        assert {k: min(v) for k, v in got.items()} == want
    kept = decontaminate.clean(df, bench, block_chars=200).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(range(len(texts))) - {d for d, _ in want}) and kept[0]["size"] == "x"
    assert decontaminate.clean(df, bench.limit(0)).count() == len(texts)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    texts = near_copies(3, 25, 5, 90, 4)
    texts += [texts[0].upper(), texts[7], "123 456", None, ""]
    items = [" ".join(rng.choice(WORDS) for _ in range(14)) for _ in range(3)]
    texts += [f"{texts[2]} extra words here to differ enough {items[1]}", items[2] + " tail"]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    last = {}
    for i, t in kept.items():
        last[t.translate(LOWER)] = i
    kept = {i: t for i, t in kept.items() if i in last.values()}
    stays = {c for _, _, c in brute_components(list(kept.items()), 5, 80)}
    kept = {i: t for i, t in kept.items() if i in stays}
    kept = {i: t for i, t in kept.items() if not any(edit_distance(x, " ".join(t.lower().split())) <= min(int(0.08 * len(x)), (len(x) - 8) // 8) for x in items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept) and all(r["decodes"] for r in got)


def test_sql_twins(spark):
    import duckdb

    from featurelens.llm.catalogue import QUERIES, SQL

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in SQL.items():
        want = con.sql(sql)
        order = sorted(want.columns)
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*order).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.sql(sql).project(", ".join(order)).fetchall())), name


def test_pipeline_keeps_documents_of_several_languages(spark):
    import corpus_pipeline

    words = {"aa": "kato peki tiko", "bb": "mul nurz grub", "cc": "shey wyth flyx", "dd": "oua eio uai"}
    rng = random.Random(7)
    say = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(i, say(lang, 12), lang) for i, lang in enumerate(sorted(words) * 10)]
    rows += [(100 + i, " ".join(say(lang, 8) for lang in sorted(words)), "aa") for i in range(5)] + [(200, "12 34", "aa"), (201, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {i for i, t, _ in rows if re.search(r"[^\W\d_]", t or "")}


def test_line_tokens_are_computed_once(spark, monkeypatch):
    """op5: counts and sets read stored tokens, which were computed for each of the two."""
    read, real = [], line_dedup.bucket_ranks
    monkeypatch.setattr(line_dedup, "bucket_ranks", lambda lines: read.extend(lines.inputFiles()) or real(lines))
    df = spark.createDataFrame([(1, "a  b\tc d e f\n\nx"), (2, " A b c d e f "), (3, None)], "doc_id long, text string")
    found = line_dedup.per_document(df, line_dedup.matches(df)).collect()
    assert read and all("line-tokens" in f for f in read)
    assert sorted(tuple(r) for r in found) == [(1, 2, 0), (2, 1, 1), (3, 0, 0)]
