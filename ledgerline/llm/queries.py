"""The queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, binary, chat, counts, exactdup, manifest, neardup, packing, passages, quality, sharding, toxicity, treebpe
from .common import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = binary.write_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return binary.checksums(binary.read_tokens(spark, folder))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    turns = turns.union(extra).select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    told = chat.format_conversations(turns)
    read = told.select(
        "conv_id",
        "n_turns",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(
            F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
        ).alias("turns"),
        F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_runs")), "").alias("masked"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER, limit=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = held_out_fold()
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def held_out_fold():
    """Whether a row is never learnt from: crc32 of its id mod 4 is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(read_table(spark, sf_dir, "documents"), TOKENIZER))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = treebpe.encode_decode(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return told.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    leaf = lambda text: manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    original = leaf(F.col("text"))
    tampered = F.when(even, leaf(F.translate("text", "\n", ""))).otherwise(original)
    told, root = manifest.manifest(docs.select("doc_id", "source", original.alias("leaf"), tampered.alias("tampered")))
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return told.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        manifest.folded(F.col("tampered"), F.col("lefts"), F.col("rights")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = passages.without_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return told.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_near_duplicates,
        op3_exact_duplicates,
        op4_token_blocks,
        op5_chat_format,
        op6_token_counts,
        op7_toxicity,
        op8_sharding,
        op9_packing,
        op10_bpe_round_trip,
        op11_filter_audit,
        op12_merkle_manifest,
        op13_substring_dedup,
    )
}

ORACLES = {
    "op3_exact_duplicates": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op5_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g'))
                + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) + 15 AS n
            FROM c
        ), j AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted_chars
            FROM e GROUP BY conv_id
        )
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM j
    """,
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo
            FROM documents
        ), f AS (
            SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                regexp_matches(t, '[#$%&*|]'), lo < doc_id] AS fails
            FROM d
        ), c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
            FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL
        ), o AS (
            SELECT '' AS ord UNION ALL SELECT ord || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(ord) < 5 AND NOT contains(ord, x)
        ), s AS (
            SELECT ord AS filter_order, step, substr(ord, step, 1) AS letter, instr('ABCDE', substr(ord, step, 1)) AS me,
                list_transform(range(1, step), lambda k: instr('ABCDE', substr(ord, k, 1))) AS earlier
            FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(ord) = 5
        ), j AS (
            SELECT part, filter_order, step, letter, n, good, toxic, fails[me] AS mine, list_bool_or(list_transform(earlier, lambda k: fails[k])) AS before,
                len(list_filter(fails, lambda x: x)) = 1 AS single
            FROM c, s
        ), r AS (
            SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT mine AND NOT coalesce(before, false)), 0) AS kept,
                coalesce(sum(n) FILTER (mine AND NOT coalesce(before, false)), 0) AS removed, coalesce(sum(n) FILTER (mine AND before), 0) AS redundant,
                coalesce(sum(n) FILTER (mine AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (mine AND NOT coalesce(before, false)), 0) AS good_lost,
                coalesce(sum(toxic) FILTER (mine AND NOT coalesce(before, false)), 0) AS toxic_lost
            FROM j GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM r
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
            FROM documents
        ), h AS (
            SELECT doc_id, source, crc & 1 = 1 AS even, text,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
            FROM d
        ), l AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || CASE WHEN even THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS tampered
            FROM h
        ), leaves AS (
            SELECT *, coalesce('+' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l
        ), grown(tree, lvl, pos, n, digest) AS (
            SELECT tree, 0, pos, n, leaf FROM leaves
            UNION ALL
            SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM grown WHERE n > 1 GROUP BY tree, lvl, pos // 3, n
        ), tops AS (
            SELECT tree, lvl, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM grown WHERE n = 1
        ), forest(lvl, pos, n, digest) AS (
            SELECT 0, pos, n, digest FROM tops
            UNION ALL
            SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lvl, pos // 3, n
        ), nodes AS (
            SELECT tree, lvl, pos, digest FROM grown WHERE n > 1 UNION ALL SELECT '#', lvl, pos, digest FROM forest WHERE n > 1
        ), sides AS (
            SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lefts, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rights
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 GROUP BY ALL
        ), steps AS (
            SELECT s.*, CASE WHEN t.tree IS NULL THEN s.tree ELSE '#' END AS next_tree, CASE WHEN t.tree IS NULL THEN s.lvl + 1 ELSE 0 END AS next_lvl, CASE WHEN t.tree IS NULL THEN s.pos // 3 ELSE t.pos END AS next_pos
            FROM sides s LEFT JOIN tops t ON t.tree = s.tree AND t.lvl = s.lvl + 1
        ), path(doc_id, leaf, home, tree, lvl, pos, proof, folded) AS (
            SELECT doc_id, leaf, tree, CASE WHEN l.n > 1 THEN tree ELSE '#' END, 0, CASE WHEN l.n > 1 THEN l.pos ELSE t.pos END, '', tampered FROM leaves l JOIN tops t USING (tree)
            UNION ALL
            SELECT p.doc_id, p.leaf, p.home, next_tree, next_lvl, next_pos, p.proof || lefts || rights, sha256(lefts || p.folded || rights)
            FROM path p JOIN steps s ON s.tree = p.tree AND s.lvl = p.lvl AND s.pos = p.pos
        ), root AS (SELECT digest AS root, lvl FROM forest WHERE n = 1)
        SELECT doc_id, leaf, t.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM path p JOIN tops t ON t.tree = p.home, root WHERE p.tree = '#' AND p.lvl = root.lvl
    """,
    "op13_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) > 12)
        ), r AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY said) AS lo FROM s) WHERE lo < doc_id
        ), g AS (
            SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS k FROM r) GROUP BY ALL
        ), e AS (
            SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k))) END AS kept
            FROM d LEFT JOIN g USING (doc_id)
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e
    """,
}
