"""The queries of the text operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import chat, decontaminate, language, mixing, near_dedup, packing, secrets, transport_stream
from gridlore.llm.common import load
from gridlore.llm.substring_dedup import substring_dedup
from gridlore.llm.suffix_arrays import suffix_array_dedup


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(load(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(load(spark, sf_dir, "documents"))
    removed = F.aggregate("factors", F.lit(0).cast("long"), lambda n, f: n + f["length"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = language.identify(docs.select("doc_id", "text"), language.learn(language.learnt_from(docs)), "language")
    return out.select("doc_id", F.coalesce(language.bucket(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = transport_stream.demux(transport_stream.mux(load(spark, sf_dir, "documents")))
    units = F.col("units")
    feature = F.concat_ws(
        " ",
        F.format_string("program=%d pid=%d type=%d packets=%d errors=%d units=%d", "program", "pid", "stream_type", "packets", "continuity_errors", F.size(units)),
        F.format_string("pts=%d..%d", units[0]["pts"], F.element_at(units, -1)["pts"]),
        F.format_string("random_access=%d", F.size(F.filter(units, lambda u: u["random_access"]))),
    )
    return read.select(
        "doc_id", "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = turns.unionByName(extra).withColumn("parts", chat.typed_parts(F.col("text")))
    attachments = F.col("attachments")
    out = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"), attachments))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chat.masked_text(F.col("formatted"), F.col("loss"), attachments)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size(attachments).cast("long").alias("n_attachments"), "expanded_tokens",
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_near_dedup, op2_secret_scan, op3_decontaminate, op4_substring_dedup, op5_language_id, op6_transport_stream, op7_mixing, op8_packing, op9_chat_format, op10_suffix_array_dedup)
}

ORACLES = {
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
        c AS (SELECT DISTINCT doc_id, unnest(range(g.i, g.i + 13)) AS pos FROM g JOIN m USING (k) WHERE m.d < g.doc_id),
        a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        r AS (SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.pos) FILTER (WHERE c.pos IS NULL) AS kept, count(c.pos) AS gone
              FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos GROUP BY a.doc_id)
        SELECT w.doc_id, coalesce(r.n, 0)::BIGINT AS n_words, coalesce(r.gone, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM w LEFT JOIN r USING (doc_id)""",
    "op9_chat_format": r"""
        WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
        f AS (SELECT *, regexp_split_to_array(text, '!\[[^\]\n]*\]\([^()\s]+\)') AS plain, regexp_extract_all(text, '!\[[^\]\n]*\]\([^()\s]+\)') AS refs FROM t),
        e AS (SELECT *, length(replace(replace(array_to_string(plain, ''), '\', '\\'), '<', '\l'))
                        + coalesce(list_sum(list_transform(refs, lambda r, i: 5 + length((2 * i - 1)::VARCHAR) + CASE WHEN regexp_matches(r, '(?i)\.(png|jpe?g|gif|webp|bmp)\)$') OR regexp_matches(r, '(?i)\.(wav|mp3|flac|ogg|m4a)\)$') THEN 5 ELSE 8 END)), 0) AS content FROM f),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                     sum(16 + length(role) + content) AS chars, sum(len(refs)) AS refs
              FROM e GROUP BY conv_id, alone)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
               refs::BIGINT AS n_attachments, refs::BIGINT AS expanded_tokens FROM g""",
}
