"""The registered queries of this folder and the SQL twin of each that has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.llm import bpe, decontaminate, exact_dedup, language, line_dedup, lm_score, merkle, ngram_join, sharding, simhash, token_counts, toxicity, whitening

SHARDS = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm_score.cross_entropy(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")).drop("text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir), keep="max")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), ranks_path()))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir).select("doc_id", "text"), pieces_path()).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.per_document(docs, line_dedup.matches(docs))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(~held))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds."""
    return decontaminate.matches(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(language.fold("doc_id", 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held)
    field = toxicity.train(docs.where(~held).join(labels, "doc_id"))
    found = toxicity.score(docs, field)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(documents(spark, sf_dir), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(documents(spark, sf_dir).select("doc_id", "text"), n=3, percent=90)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verified(documents(spark, sf_dir), tampered)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir).select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash": op13_simhash,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LOWER_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(*fields: str) -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR END" for f in fields]
    return f"sha256({' || '.join(parts)})"


SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op5_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
             w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[ \\t\\r\\f\\x0B]+'), lambda x: x <> '') AS t FROM l),
             g AS (SELECT doc_id, line_no, list_sort(list_distinct(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
                       ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END)) AS s FROM w WHERE len(t) > 0),
             u AS (SELECT s, min((doc_id, line_no)) AS place, row_number() OVER () AS id FROM g GROUP BY s),
             e AS (SELECT id, place, len(s) AS n, unnest(s) AS x FROM u),
             m AS (SELECT DISTINCT id FROM (
                     SELECT b.id FROM e a JOIN e b ON a.x = b.x AND a.place < b.place
                     GROUP BY a.id, b.id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)))
        SELECT d.doc_id, count(g.line_no) AS n_lines,
               coalesce(sum(CASE WHEN m.id IS NOT NULL OR (g.doc_id, g.line_no) <> u.place THEN 1 ELSE 0 END) FILTER (WHERE g.line_no IS NOT NULL), 0)::BIGINT AS n_removed
        FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN u ON g.s = u.s LEFT JOIN m ON u.id = m.id GROUP BY d.doc_id""",
    "op9_sharding": """
        WITH table256 AS (
                 SELECT list(c ORDER BY i) AS t FROM (
                     SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k:
                         CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
                     FROM (SELECT unnest(range(256)) AS i))),
             b AS (SELECT doc_id, source, string_split(hex(encode(coalesce(text, ''))), '') AS x FROM documents),
             v AS (SELECT doc_id, source, CASE WHEN x = [''] THEN [] ELSE
                          list_transform(x, lambda c: ascii(c) - CASE WHEN ascii(c) > 57 THEN 55 ELSE 48 END) END AS x FROM b),
             w AS (SELECT doc_id, source, list_transform(range(len(x) // 2), lambda j: (16 * x[2 * j + 1] + x[2 * j + 2])::BIGINT) AS x FROM v),
             d AS (SELECT doc_id, source, len(x) + 1 AS size,
                          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, x),
                              lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1]))) AS text_crc32,
                          ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
                   FROM w, table256),
             r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1) + 1)::DOUBLE
                             / (2 * count(*) OVER (PARTITION BY source)) AS f, count(*) OVER () AS n FROM d),
             p AS (SELECT *, row_number() OVER (ORDER BY f, coalesce(source, ''), source IS NULL, h, doc_id, text_crc32, size) - 1 AS position FROM r)
        SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 8 // n)::INTEGER AS shard,
               position - ((position * 8 // n) * n + 7) // 8 AS slot, NULL::INTEGER AS grown_shard FROM p""",
    "op10_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
             g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
                       ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM w),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT g.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM g
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE table256 AS (
                 SELECT list(c ORDER BY i) AS t FROM (
                     SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k:
                         CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
                     FROM (SELECT unnest(range(256)) AS i))),
             d AS (SELECT doc_id, lang, text, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
                          {_leaf("doc_id", "source", "lang", "n_chars", _LOWER_OR_NULL)} AS lowered,
                          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                              lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1]))) % 3 = 0 AS tampered
                   FROM documents, table256),
             lone AS (SELECT coalesce('=' || lang, '') AS g, doc_id, CASE WHEN tampered THEN lowered ELSE leaf END AS claimed, 0 AS level,
                             row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d),
             low AS (SELECT g, level, i, n, h FROM lone UNION ALL
                     SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, level, i // 8, n),
             subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
             high AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots UNION ALL
                      SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 8, n),
             nodes AS (SELECT g, level, i, n, h FROM low WHERE n > 1 UNION ALL
                       SELECT '', 1000 + level, i, n, h FROM high WHERE n > 1),
             steps AS (SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
                              coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
                       FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY a.g, a.level, a.i),
             places AS (SELECT o.doc_id, o.g, s.level, s.l, s.r FROM lone o JOIN steps s ON s.level < 1000 AND s.g = o.g AND s.i = o.i // (8 ** s.level)::BIGINT
                        UNION ALL
                        SELECT o.doc_id, o.g, s.level, s.l, s.r FROM lone o JOIN subroots u ON u.g = o.g
                        JOIN steps s ON s.level >= 1000 AND s.i = u.i // (8 ** (s.level - 1000))::BIGINT),
             lists AS (SELECT doc_id, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs, string_agg(l || r, '' ORDER BY level) AS all_of FROM places GROUP BY doc_id),
             folded AS (SELECT o.doc_id, o.g, o.h AS leaf, coalesce(all_of, '') AS all_of,
                               list_reduce(list_prepend(o.claimed, coalesce(list_transform(range(1, len(ls) + 1), lambda k: ls[k] || '|' || rs[k]), [])),
                                   lambda acc, step: sha256(split_part(step, '|', 1) || acc || split_part(step, '|', 2))) AS folded_root
                        FROM lone o LEFT JOIN lists USING (doc_id))
        SELECT f.doc_id, f.leaf, u.subroot, h.h AS root, sha256(f.all_of) AS proof_sha256, f.folded_root, f.folded_root = h.h AS verified
        FROM folded f JOIN subroots u USING (g), high h WHERE h.n = 1""",
}
