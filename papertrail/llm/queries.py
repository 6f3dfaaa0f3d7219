"""Registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm.common import read

QUERIES: dict = {}
SQL: dict = {}

# DuckDB forms of the shared pieces
_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS4 = r"regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS5 = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op10_exact_dedup", f"""
WITH d AS (SELECT doc_id, {_AZ.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


@register("op4_decontaminate", f"""
WITH b AS (SELECT item_id, {_WORDS4.format("text")} AS w FROM benchmark),
bt AS (SELECT item_id, w, least(len(w), 13) AS t FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, t, array_to_string(w[p:p + t - 1], ' ') AS win
       FROM (SELECT item_id, w, t, unnest(range(1, len(w) - t + 2)) AS p FROM bt)),
d AS (SELECT doc_id, {_WORDS4.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, t, p, array_to_string(w[p:p + t - 1], ' ') AS win
       FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS p
             FROM d, (SELECT DISTINCT t FROM bw) WHERE len(w) >= t)),
hit AS (SELECT doc_id, dw.t, p, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.win = bw.win),
cov AS (SELECT doc_id, count(*) AS n_hit FROM
        (SELECT DISTINCT doc_id, unnest(range(p, p + t)) AS i FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.decontaminate import decontaminate

    c = F.col("contamination")
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"]).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papertrail.llm.token_counts import token_counts

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papertrail.llm.packing import pack

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register("op5_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_WORDS5.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
lost AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d JOIN lost USING (doc_id))
         ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed,
       sha256(CASE WHEN lost.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.substring_dedup import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


@register("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, payload_digest,
             min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > lo THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > lo THEN lo END AS refers_to
FROM q""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.common import shared_path
    from papertrail.llm.warc import read_archives, write_archives

    path = shared_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    r = read_archives(spark, path)
    own = F.col("payload").isNotNull()
    return r.select("page_id", F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                    F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
                    "record_type", "refers_to")


@register("op2_chat_rotation", """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) - 1 AS seq FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
r AS (SELECT t.conv_id, speaker, seq, seq // 64 AS part, who = speaker AS mine,
             '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant'
                               ELSE 'user name=' || who END || chr(10) AS head, text || '<|im_end|>' AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM r)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY seq) AS text,
       coalesce(string_agg(CASE WHEN mine THEN (pos + length(head)) || '-' || (pos + length(head) + length(body)) END,
                           ',' ORDER BY seq), '') AS spans
FROM o GROUP BY conv_id, speaker, part""")
def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.chat_rotation import rotate

    shown = F.transform("spans", lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string")))
    out = rotate(read(spark, sf_dir, "conversations")).withColumn("spans", F.concat_ws(",", shown))
    return out.withColumn("n_turns", F.col("n_turns").cast("long"))


@register("op6_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS5.format(_AZ.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), words=3, num=9, den=10).select(
        "doc_id", "n_shingles", "component_id")


@register("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.quality import KEEP_TAIL, ratings_of, score, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, ratings_of(read(spark, sf_dir, "labels")))
    q = F.col("quality")
    return score(docs, model, carry=["doc_id"]).select("doc_id", q["expected"].alias("expected_grade"), q["tail"].alias("p_top"),
                                     (q["tail"] >= KEEP_TAIL).alias("kept"))


@register("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm import secrets
    from papertrail.llm.common import stored

    docs = read(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.dictionary_of(docs), path_col="source")
    found = stored(found, "secret-candidates")
    forest = secrets.train(found.withColumn("label", secrets.reviewed(F.col("before"), F.col("finding"))))
    return secrets.score(found, forest).select("doc_id", "start", "finding", "score", (F.col("score") >= 0.5).alias("is_secret"))


@register("op11_fill_in_middle", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1, n - hi) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertrail.llm.fim import fill_in_middle, restored

    out = fill_in_middle(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_pattern_packing")
def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papertrail.llm.pattern_packing import pieces_of, place

    pieces = pieces_of(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papertrail.llm.alignment import aligned_blocks, with_counts

    blocks = aligned_blocks(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return with_counts(blocks.withColumn("groups_sha256", digest).drop("groups"))
