"""Row-by-row operators against plain Python: BPE, token counts, LM scores, chains, language, toxicity."""

import base64
import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from featurelens.llm import bpe, chain, language, lm_score, token_counts, toxicity
from featurelens.llm.catalogue import pieces_path, ranks_path

AWKWARD = [None, "", " ", "\n\n", "a", "It's we'll they've I'd 'S 's ''s \t's", "héllo 🙂 wörld  \n x", "日本語 テスト", "x" * 30_000, "the the the", "the the the"]


def rows_of(spark, texts, **extra):
    data = [(i, t, "keep", -1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, score string, ids double").repartition(3)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, reference):
    rng = random.Random(1)
    alphabet = "a b'sStTrReEvVlLmMdD  \n\t1 2!?.'é　\xa0\x1cß中文🙂٣Ⅷ½"
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += ["".join(f"a{chr(i)}b 1{chr(i)} !{chr(i)} " for i in range(k, k + 64) if not 0xD800 <= i < 0xE000) for k in range(0, 0x20000, 64)]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(rows_of(spark, texts), ranks_path(), with_offsets=True), ranks_path()).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert list(got[i]["ids"]) == reference.encode_ordinary(t)
        assert bytes(got[i]["decoded"]) == t.encode() and got[i]["decoded_text"] == t and got[i]["score"] == "keep"
        for k, (a, b) in enumerate(zip(got[i]["token_start"], got[i]["token_end"])):
            piece = reference.decode_single_token_bytes(got[i]["ids"][k])
            assert piece in t[a:b].encode() and a < b
    one_pass = {r["doc_id"]: r for r in bpe.round_trip(rows_of(spark, texts[:50]), ranks_path()).collect()}
    assert all(one_pass[i]["ids"] == got[i]["ids"] and one_pass[i]["decoded"] == got[i]["decoded"] for i in one_pass)


def test_bpe_edges(spark):
    assert bpe.encode(rows_of(spark, []), ranks_path()).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [15496, 995])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded_text"] for r in bpe.decode(lists, ranks_path()).collect()}
    assert got == {1: None, 2: "", 3: "Hello world"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), ranks_path()).collect()


def test_token_counts_equal_plain_viterbi(spark):
    pieces, byte_score = token_counts.pieces_of(open(pieces_path(), "rb").read())

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            own = len(word[e - 1].encode())
            options = [(best[e - 1][0] + own * byte_score, -(best[e - 1][1] + own))]
            options += [(best[s][0] + pieces[word[s:e]], -(best[s][1] + 1)) for s in range(e) if word[s:e] in pieces]
            top = max(s for s, _ in options)
            s, n = max((o for o in options if o[0] > top - 1e-9), key=lambda o: o[1])
            best.append((s, -n))
        return best[-1]

    texts = [t for t in AWKWARD if t is None or len(t) < 1000] + ["internationalisation of tokenisation", "zzzqqq ☃☃ ünïcödé"]
    got = {r["doc_id"]: r for r in token_counts.count(rows_of(spark, texts), pieces_path()).collect()}
    for i, t in enumerate(texts):
        words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", t or "") if w]
        want = [plain("▁" + w) for w in words]
        assert got[i]["n_pretokens"] == len(words) and got[i]["n_tokens"] == sum(n for _, n in want)
        assert got[i]["token_score"] == pytest.approx(sum(s for s, _ in want))


def test_trie_scores_shared_prefixes_once():
    trie = token_counts.Trie({"ab": -1.0, "a": -2.0, "b": -2.5, "abc": -1.5}, -9.0)
    trie.insert("abab")
    nodes = len(trie.score)
    trie.insert("abc")
    assert len(trie.score) == nodes + 1 and trie.score[trie.insert("abc")] == -1.5 and trie.tokens[trie.insert("abab")] == 2


def test_lm_losses_equal_plain_counts(spark):
    rng = random.Random(2)
    words = ["a", "B", "cc", "d", "é", "ff"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + [None, " \n"]
    flags = [i % 3 == 0 if i % 5 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, flags)), "doc_id long, text string, good boolean").repartition(4)
    models = lm_score.train(df, df.where("good"), vocab_size=4)
    got = {r["doc_id"]: r for r in lm_score.score(df, models).collect()}
    low = [(t or "").replace("B", "b").split() for t in texts]
    counts = {w: sum(x.count(w) for x in low) for w in {w for x in low for w in x}}
    kept = set(sorted(counts, key=lambda w: -counts[w])[:4])
    lines = [["#"] + [w if w in kept else "?" for w in x] + ["#"] if x else [] for x in low]
    symbols = [*kept, "?", "#"]
    losses = []
    for side in (True, False):
        pairs = [p for line, f in zip(lines, flags) if bool(f) == side for p in itertools.pairwise(line)]
        uni = {s: 1 + sum(b == s for _, b in pairs) for s in symbols}
        total = sum(uni.values())

        def loss(h, w):
            n = sum(a == h for a, _ in pairs)
            c = pairs.count((h, w))
            rest = 0.75 * len({b for a, b in pairs if a == h}) / n if n else 1.0
            return -math.log(rest * uni[w] / total + (max(c - 0.75, 0) / n if n else 0))

        losses.append([np.mean([loss(*p) for p in itertools.pairwise(line)]) if line else 0.0 for line in lines])
    for i in range(len(texts)):
        assert got[i]["target_loss"] == pytest.approx(losses[0][i], rel=1e-5)
        assert got[i]["background_loss"] == pytest.approx(losses[1][i], rel=1e-5)
        assert got[i]["score"] == pytest.approx(losses[0][i] - losses[1][i], abs=1e-5)


@pytest.mark.parametrize("block_tokens, part_bytes", [(300, 500), (2_000_000, 16 << 20)])
def test_lm_keeps_every_word(spark, monkeypatch, block_tokens, part_bytes):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(lm_score, "PART_BYTES", part_bytes)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(3000) if rng.random() < 0.7 else rng.randrange(9)}" for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += ["hot pair " * 40] * 30 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    models = lm_score.train(df, df.where("doc_id % 3 = 0"))
    lines = [["#", *(t or "").split(), "#"] if t else [] for t in texts]
    vocabulary = {w for x in lines for w in x if w != "#"}
    assert len(vocabulary) > 2048
    sides = []
    for target in (True, False):
        pairs = collections.Counter(p for i, x in enumerate(lines) if (i % 3 == 0) == target for p in itertools.pairwise(x))
        n, kinds = collections.Counter(), collections.Counter(a for a, _ in pairs)
        for (a, _), c in pairs.items():
            n[a] += c
        sides.append((pairs, n, kinds, sum(n.values()) + len(vocabulary) + 2))

    def loss(side, a, b):
        pairs, n, kinds, total = side
        rest = 0.75 * kinds[a] / n[a] if n[a] else 1.0
        return -math.log(rest * (n[b] + 1) / total + (max(pairs[a, b] - 0.75, 0) / n[a] if n[a] else 0))

    other = ["w1 never seen w2", "w5 w2999", None]
    more = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(other)] + [(9, other[0], 9)], "doc_id long, text string, score int")
    for frame, given in ((df, dict(enumerate(texts))), (more, dict(enumerate(other)) | {9: other[0]})):
        got = {r["doc_id"]: r for r in lm_score.score(frame, models).collect()}
        assert got.keys() == given.keys()
        for i, t in given.items():
            line = ["#", *t.split(), "#"] if t else []
            want = [np.mean([loss(s, *p) for p in itertools.pairwise(line)]) if line else 0.0 for s in sides]
            assert got[i]["n_tokens"] == max(len(line) - 1, 0)
            assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(tuple(want), rel=1e-9)
            assert got[i]["score"] == pytest.approx(want[0] - want[1], abs=1e-9)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_chains_equal_plain_recursions(block, monkeypatch):
    monkeypatch.setattr(chain, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(15):
        lens = rng.integers(0, 20, size=5)
        at = np.r_[0, np.cumsum(lens)]
        k = int(rng.integers(2, 4))
        scores, penalty = rng.normal(size=(at[-1], k)) * 2, rng.uniform(0, 3)
        path = chain.viterbi(scores, at, penalty)
        factors, trans = np.exp(scores), np.exp(rng.normal(size=(k, k)))
        found, edges = chain.marginals(factors, trans, at)
        want_edges = np.zeros((k, k))
        for a, b in zip(at[:-1], at[1:]):
            if a == b:
                continue
            v = np.zeros(k)
            for r in scores[a:b]:
                v = np.maximum(v, v.max() - penalty) + r
            p = path[a:b]
            assert scores[a:b][np.arange(b - a), p].sum() - penalty * (p[1:] != p[:-1]).sum() == pytest.approx(v.max())
            forward = [np.eye(k)[0]]
            for r in factors[a:b]:
                forward.append((forward[-1] @ trans) * r)
            back = np.ones(k)
            for t in range(b - 1, a - 1, -1):
                f = forward[t - a + 1]
                assert found[t] == pytest.approx(f * back / (f * back).sum())
                pair = forward[t - a][:, None] * trans * (factors[t] * back)[None, :]
                want_edges += pair / pair.sum()
                back = trans @ (factors[t] * back)
        assert edges == pytest.approx(want_edges)


def test_language_spans_scripts_and_edges(spark):
    train = [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("the cat and the dog went with them that day", "en"), ("der hund und die katze sind nicht in dem haus", "de"), ("собака и кошка в доме", "ru")] * 5)]
    train += [(98, None, "en", "s"), (99, "text", None, "s")]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string, source string"))
    assert model.languages == ["de", "en", "ru"]
    texts = ["the dog and the cat that went", "der hund und die katze nicht", "кошка и собака", "the cat and the dog went with them кошка собака в доме и", None, "", "123 !?", "ξένος"]
    got = {r["doc_id"]: r for r in language.identify(rows_of(spark, texts), model, penalty=4.0, with_spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(8)][:3] == ["en", "de", "ru"]
    assert [s["lang"] for s in got[3]["lang_spans"]] == ["en", "ru"] and texts[3][got[3]["lang_spans"][1]["start"]:].startswith("кошка")
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6)) and got[7]["lang_pred"] in model.languages
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(rows_of(spark, texts), empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.fold("doc_id", 4) == 2
    rows = language.identify(docs.where(held), language.train(docs.where(~held))).select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_toxicity_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = language.fold("doc_id", 3) == 1
    joined = docs.join(labels, "doc_id")
    field = toxicity.train(joined.where(~held))
    rows = toxicity.score(joined.where(held), field, with_spans=True).collect()
    toxic = [r["score"] >= 0.7 for r in rows if r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean([r["score"] < 0.7 for r in rows if not r["toxic"]]) > 0.98
    assert all(r["text"][s["start"]:s["end"]].strip() for r in rows for s in r["toxic_spans"])
    odd = toxicity.score(rows_of(spark, AWKWARD), field).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and all(r["score"] == 0 for r in odd if not (r["text"] or "").strip())
    nothing = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert all(r["score"] == 0 for r in toxicity.score(rows_of(spark, AWKWARD), nothing).collect())
