"""The opN queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix, taken_words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring import remove_repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import judge

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.license import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is played as a melody of 64 notes, written as WAV bytes."""
    from quire.llm.chroma import aligned, fingerprints, rendered

    media = rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")
    return aligned(fingerprints(media)).withColumnRenamed("id", "vec_id")


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.chat import rotate

    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.minhash import near_duplicates

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.packing import pack_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import score

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, labels)


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sharding import shard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")))
    out = shard(docs, size=size, group=F.col("text"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_chroma_fingerprints": op5_chroma_fingerprints,
    "op6_perspective_rotation": op6_perspective_rotation,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_histogram_sharding": op10_histogram_sharding,
}

ORACLES = {
    "op2_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        u AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM w WHERE len(words) >= 20),
        k AS (SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id, start) AS seen FROM u),
        g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM k WHERE seen > 1),
        x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
        y AS (SELECT x.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, string_agg(x.word, ' ' ORDER BY x.pos) FILTER (g.pos IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN y ON w.doc_id = y.doc_id""",
    "op3_quality_rules": """
        WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
        k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS k FROM g),
        r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE k > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
        b AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
        m AS (SELECT doc_id, lang, source, n_words, unnest(['symbols', 'dup_lines', 'repeats', 'mean_chars']) AS metric, unnest([100, 400, 400, 150]) AS least,
            unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) AS v FROM b),
        h AS (SELECT lang, source, metric, least, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM m WHERE n_words >= 50),
        a AS (SELECT 2 AS level, lang, source, metric, least, bucket, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 1, lang, NULL, metric, least, bucket, count(*) FROM h GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, metric, least, bucket, count(*) FROM h GROUP BY ALL),
        u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM a),
        q AS (SELECT level, lang, source, metric, least, max(total) AS docs, min(bucket) FILTER (4 * up >= total) AS q1, min(bucket) FILTER (4 * up >= 3 * total) AS q3 FROM u GROUP BY ALL),
        f AS (SELECT level, lang, source, metric, q1 - greatest(3 * (q3 - q1), least) AS lo, q3 + greatest(3 * (q3 - q1), least) AS hi FROM q WHERE docs >= 100 OR level = 0),
        x AS (SELECT m.doc_id, bool_and(v >= coalesce(f2.lo, f1.lo, f0.lo, v) AND v <= coalesce(f2.hi, f1.hi, f0.hi, v)) AS fits FROM m
            LEFT JOIN f f2 ON f2.level = 2 AND f2.lang IS NOT DISTINCT FROM m.lang AND f2.source IS NOT DISTINCT FROM m.source AND f2.metric = m.metric
            LEFT JOIN f f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM m.lang AND f1.metric = m.metric LEFT JOIN f f0 ON f0.level = 0 AND f0.metric = m.metric GROUP BY m.doc_id)
        SELECT b.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fits AS kept FROM b JOIN x ON x.doc_id = b.doc_id""",
    "op6_perspective_rotation": """
        WITH t AS (SELECT conv_id, turn, role, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
        p AS (SELECT DISTINCT conv_id AS c, role AS r FROM t WHERE role IS DISTINCT FROM 'system'),
        r AS (SELECT t.*, coalesce(p.r, 'unknown') AS perspective, p.r IS NULL AS anonymous, role IS NOT DISTINCT FROM p.r AS loss, replace(replace(speaker, '<|', '< |'), '|>', '| >') AS shown FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
        g AS (SELECT *, CASE WHEN loss THEN 'assistant' WHEN role = 'system' THEN shown ELSE 'user name=' || shown END AS tag FROM r),
        s AS (SELECT *, '<|' || tag || '|>
' || content || '<|end|>
' AS rendered FROM g),
        o AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective, anonymous ORDER BY turn NULLS FIRST, role NULLS FIRST, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM s)
        SELECT conv_id, perspective, anonymous, turn, speaker, tag, rendered, char_start, char_start + length(rendered) AS char_end, char_start + length(tag) + 5 AS content_start,
            char_start + length(tag) + 5 + length(content) AS content_end, loss FROM o""",
    "op7_minhash_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
        c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.node = w.doc_id""",
}
