"""The operators applied to the whole test tables, as thin queries."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned_tokens
from .common import table
from .decontaminate import contamination
from .exact import exact_duplicates
from .lines import duplicate_lines
from .manifest import folded_root, manifest, proof_text
from .near import near_duplicates
from .ngram_join import ngram_join
from .pages import main_texts
from .pieces import encode
from .quality import quality_scores, train
from .sharding import shards
from .substrings import repeated_spans
from .tokens import token_count, token_prefixes

TOKEN_LIMIT, KEPT_SCORE = 4096, 0.7


def model_bytes() -> bytes:
    """The public model is read once on the driver and travels with the tasks."""
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefixes(table(spark, sf_dir, "documents"), model_bytes())
    n_tokens = token_count(F.col("prefix_tokens"))
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > TOKEN_LIMIT).alias("over_limit")
    )


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).withColumnRenamed("id", "doc_id")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return classes.withColumnRenamed("id", "doc_id")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"), 8).withColumnRenamed("id", "doc_id")
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.withColumnRenamed("id", "doc_id").withColumn("predicted", (F.col("score") >= KEPT_SCORE).cast("int"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    lengths = F.transform("spans", lambda span: span["end"] - span["first"])
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, length: total + length)
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = duplicate_lines(table(spark, sf_dir, "documents"))
    return lines.withColumnsRenamed({"id": "doc_id", "keep_id": "keep_doc_id"})


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), model_bytes(), decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.col("ids").alias("piece_ids"), "text")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(tampered, F.regexp_replace(docs["text"], "\n", "")).otherwise(docs["text"])
    proved = manifest(docs, claimed={"text": text}).withColumn("folded_root", folded_root())
    return proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    aligned = aligned_tokens(table(spark, sf_dir, "documents"), first, model_bytes(), groups_as=lambda groups: F.sha2(groups, 256))
    return aligned.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_minhash_near_dedup": minhash_near_dedup,
    "op3_exact_dedup": exact_dedup,
    "op4_sharding": sharding,
    "op5_quality_classifier": quality_classifier,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_line_dedup": line_dedup,
    "op8_substring_dedup": substring_dedup,
    "op9_sentencepiece_codec": sentencepiece_codec,
    "op10_html_extraction": html_extraction,
    "op11_merkle_manifest": merkle_manifest,
    "op12_ngram_jaccard_join": ngram_jaccard_join,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

ORACLES = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents),
        place AS (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS pos FROM doc WHERE len(words) > 0),
        shingle AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 1], ' ') AS piece FROM place),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                 FROM shingle x JOIN shingle y ON x.piece = y.piece AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN size s ON a = s.doc_id JOIN size t ON b = t.doc_id
                 WHERE 100 * common >= 80 * (s.n + t.n - common)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM documents
                  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_benchmark_decontamination": r"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        starts AS (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS pos FROM item WHERE len(words) > 0),
        wanted AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[pos:pos + 9], ' ') AS piece FROM starts),
        sizes AS (SELECT DISTINCT n FROM wanted),
        places AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM doc, sizes WHERE len(words) >= n),
        pieces AS (SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS piece FROM places),
        found AS (SELECT doc_id, item_id, n, pos FROM pieces JOIN wanted USING (n, piece)),
        hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY doc_id),
        owner AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN owner USING (doc_id)
    """,
    "op8_substring_dedup": r"""
        WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        place AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM doc WHERE len(words) >= 35),
        piece AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS digest FROM place),
        twice AS (SELECT digest FROM piece GROUP BY digest HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM piece JOIN twice USING (digest)),
        word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM doc WHERE len(words) > 0),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE field AS (
            SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '') AS name,
                   concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
                          coalesce(strlen(source) || ':' || source, '-'),
                          coalesce(strlen(lang) || ':' || lang, '-'),
                          coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front FROM documents),
        crc AS (
            SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 8 * len(name) + 1), lambda i:
                       CASE WHEN i % 8 = 1 THEN ascii(name[(i + 7) // 8])::BIGINT ELSE 0 END)),
                   lambda state, byte: xor(xor(state, byte) >> 1, 3988292384 * (xor(state, byte) & 1))) AS register
            FROM field),
        claim AS (SELECT *, CASE WHEN xor(register, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM crc),
        leaf AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree,
                   sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(front || coalesce(strlen(other) || ':' || other, '-')) AS claimed FROM claim),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
        node AS (
            SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
            UNION ALL
            SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM node WHERE n > 1 GROUP BY tree, level, pos // 3, n),
        subroot AS (
            SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
        upper AS (
            SELECT 0 AS level, pos, digest, n FROM subroot
            UNION ALL
            SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3, n),
        inner_step AS (
            SELECT doc_id, leaf, level AS seq, string_agg(digest, '' ORDER BY node.pos) FILTER (node.pos < own) AS before,
                   string_agg(digest, '' ORDER BY node.pos) FILTER (node.pos > own) AS behind
            FROM (SELECT doc_id, leaf, tree, level, placed.pos // (3 ** level)::BIGINT AS own
                  FROM placed JOIN (SELECT DISTINCT tree, level FROM node WHERE n > 1) USING (tree)) AS way
            JOIN node USING (tree, level) WHERE node.pos // 3 = own // 3 GROUP BY doc_id, leaf, level, own),
        outer_step AS (
            SELECT tree, 1000 + level AS seq, string_agg(digest, '' ORDER BY upper.pos) FILTER (upper.pos < own) AS before,
                   string_agg(digest, '' ORDER BY upper.pos) FILTER (upper.pos > own) AS behind
            FROM (SELECT tree, level, subroot.pos // (3 ** level)::BIGINT AS own
                  FROM subroot CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1)) AS way
            JOIN upper USING (level) WHERE upper.pos // 3 = own // 3 GROUP BY tree, level, own),
        step AS (
            SELECT doc_id, leaf, seq, coalesce(before, '') AS before, coalesce(behind, '') AS behind FROM inner_step
            UNION ALL
            SELECT doc_id, leaf, seq, coalesce(before, ''), coalesce(behind, '') FROM placed JOIN outer_step USING (tree)),
        way AS (
            SELECT doc_id, leaf, string_agg(before || behind, '' ORDER BY seq) AS proof, list(before || '|' || behind ORDER BY seq) AS steps FROM step GROUP BY doc_id, leaf),
        folded AS (
            SELECT placed.doc_id, leaf, tree, coalesce(proof, '') AS proof,
                   list_reduce(list_prepend(claimed, coalesce(steps, [])), lambda state, x: sha256(split_part(x, '|', 1) || state || split_part(x, '|', 2))) AS folded_root
            FROM placed LEFT JOIN way USING (doc_id, leaf))
        SELECT doc_id, leaf, subroot.digest AS subroot, top.digest AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = top.digest AS verified
        FROM folded JOIN subroot USING (tree) CROSS JOIN (SELECT digest FROM upper WHERE n = 1) AS top
    """,
    "op12_ngram_jaccard_join": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents),
        place AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM doc WHERE len(words) > 0),
        shingle AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS piece FROM place),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                 FROM shingle x JOIN shingle y ON x.piece = y.piece AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN size s ON a = s.doc_id JOIN size t ON b = t.doc_id
                 WHERE 100 * common >= 80 * (s.n + t.n - common)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM documents
                  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
    """,
}
