"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, masked_text, read_turns
from .decontaminate import decontaminate
from .hard_negatives import hard_negatives
from .html_text import extract_main_text
from .language import fit_language_model, identify_language
from .lm_score import cross_entropy_difference
from .mixing import plan_mix
from .near_duplicates import near_duplicates
from .secrets import scan_secrets
from .substring_dedup import dedup_substrings
from .token_counts import document_tokens
from .top_k import top_k
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id", "text"]).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    chats = format_chats(rows.union(more)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", masked_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = fit_language_model(docs.where("not held_out"))
    return identify_language(docs, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(_table(spark, sf_dir, "documents")).drop("draws")


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(_table(spark, sf_dir, "documents"))


def op11_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def queries() -> dict:
    found = (op1_line_blocks, op2_secret_scan, op3_chosen_path, op4_chat_format, op5_wu_manber, op6_piece_unigrams, op7_cross_entropy, op8_ball_tree, op9_mix_sources, op10_separator_scan, op11_bit_sliced, op12_count_min, op13_bond)
    return {f.__name__: f for f in found}


_ESCAPED = r"regexp_replace(regexp_replace({0}, '<(\\*)(\||/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": f"""
            WITH r AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
            t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS DISTINCT FROM role AS begins FROM s)
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(length({_ESCAPED.format("text")}) + CASE WHEN begins THEN 23 + length({_ESCAPED.format("role")}) ELSE 8 END)::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op5_wu_manber": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
            b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
            bw AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS x FROM (
                SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
            dw AS (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS x FROM (
                SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
            f AS (SELECT doc_id, p, dw.m, item_id FROM dw JOIN bw USING (x) WHERE dw.m = bw.m),
            h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM f) GROUP BY doc_id),
            i AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM f) GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
                sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id""",
        "op8_ball_tree": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
            FROM s QUALIFY rank <= 5""",
        "op12_count_min": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            x AS (SELECT r, doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
            m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k HAVING min(doc_id) < max(doc_id)),
            h AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM x JOIN m USING (k) WHERE doc_id > least),
            e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
            k AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept FROM e ANTI JOIN h USING (r, q) GROUP BY r),
            g AS (SELECT r, count(*) AS n FROM h GROUP BY r)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)""",
        "op13_bond": """
            WITH v AS (
                SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.r, b.vec_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e)),
            p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY place <= 5)
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, place ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    }
