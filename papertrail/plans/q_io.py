"""Registered source/sink, refresh and streaming queries.

File-based queries first write data derived from the driver tables into
a fresh folder under the session's shared checkpoint directory, then read
it back with the library's readers (the write is part of the query)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.functions import bib as B
from papertrail.operators import metrics as M
from papertrail.plans import duck as D
from papertrail.plans.q_bib import _entries, library_text, sql_parsed
from papertrail.plans.q_metrics import CLASSES4, SQL_SCORED, scored
from papertrail.plans.q_search import _store_chunks, sql_chunks
from papertrail.plans.registry import SQL, register
from papertrail.session import scratch_path, table
from papertrail.sources import readers as RD
from papertrail.sources import sinks as SK
from papertrail.streaming import chat as CHAT
from papertrail.streaming import incremental as INC


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ S6, K2, K3, S1, S2, S7


def _jsonl_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    p = _scratch(spark, "jsonl")
    e.write.mode("overwrite").json(p)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return RD.read_jsonl(spark, p, schema).select("event_id", "user_id", "event_type", "value")


register("s_jsonl_roundtrip", sql="SELECT event_id, user_id, event_type, value FROM events")(_jsonl_roundtrip)


def _partition_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("predicted_label"))
    p = _scratch(spark, "by-label")
    SK.write_by_label(d, p, "predicted_label")
    back = spark.read.parquet(p)
    return back.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))


register("k_partition_counts", sql="SELECT lang AS predicted_label, count(*) AS n FROM documents GROUP BY lang")(_partition_counts)


def _text_records(spark, sf):
    """Documents written as records of text files, half of them with CRLF line
    ends, read back (S1)."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("t"))
    p = _scratch(spark, "records")
    d.filter("doc_id % 2 = 0").select("t").write.option("lineSep", "\n\n\n").text(f"{p}/lf")
    crlf = F.replace("t", F.lit("\n"), F.lit("\r\n"))
    d.filter("doc_id % 2 = 1").select(crlf).write.option("lineSep", "\r\n\r\n\r\n\r\n").text(f"{p}/crlf")
    a = RD.read_text_records(spark, f"{p}/lf", split_files=True)
    b = RD.read_text_records(spark, f"{p}/crlf")
    return a.select("text").unionByName(b.select("text"))


register("s_text_records", sql=f"""
WITH r AS (SELECT unnest(regexp_split_to_array(replace('doc ' || CAST(doc_id AS VARCHAR) || chr(10) || text, chr(13) || chr(10), chr(10)), '\n{{3,}}')) AS p
           FROM documents)
SELECT {D.strip('p')} AS text FROM r WHERE length({D.strip('p')}) > 0
""")(_text_records)


def _read_bib(spark, sf):
    """Library-form entries written with the bib sink (K1), parsed back (S2);
    entries without an id are read too, their id is null."""
    e = _entries(spark, sf)
    p = _scratch(spark, "bib")
    SK.write_bib(e.select(library_text(e).alias("bib")), p)
    return RD.read_bib(spark, p, ext=".txt").select(
        "entrytype", F.nullif("id", F.lit("")).alias("id"), F.explode("fields").alias("field", "value"))


register("s_read_bib", sql=sql_parsed("id"))(_read_bib)


def _read_docs(spark, sf):
    """Text files written from documents, read back by the directory reader (S3)."""
    p = _scratch(spark, "docs")
    table(spark, sf, "documents").select(F.regexp_replace("text", r"\s", " ")).write.text(p)
    lines = RD.read_docs(spark, p, ".TXT").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''").select(F.md5("line").alias("line_md5"))


register("s_read_docs", sql="SELECT md5(regexp_replace(text, '\\s', ' ', 'g')) AS line_md5 FROM documents WHERE text <> ''")(_read_docs)


def _read_json(spark, sf):
    """One JSON file per supplier, read as documents (S4) and as texts."""
    p = _scratch(spark, "json-docs")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("maxRecordsPerFile", 1).json(p)
    docs = RD.read_json_docs(spark, p).select(F.lit("docs").alias("reader"), F.col("page_content").alias("text"))
    texts = RD.read_json_map(spark, p).select(F.lit("map").alias("reader"), F.trim(F.regexp_replace("json", "\n", "")).alias("text"))
    return docs.unionByName(texts)


register("s_read_json", sql="""
SELECT 'docs' AS reader, 's_suppkey: ' || CAST(s_suppkey AS VARCHAR) || '; s_name: ' || s_name AS text FROM supplier
UNION ALL SELECT 'map', '{"s_suppkey":' || CAST(s_suppkey AS VARCHAR) || ',"s_name":"' || s_name || '"}' FROM supplier
""")(_read_json)


def _results_csv(spark, sf):
    rep = M.class_report(scored(spark, sf), "y", "pred", CLASSES4)
    p = _scratch(spark, "csv")
    SK.write_results_csv(rep, p)
    back = spark.read.option("header", True).option("inferSchema", True).csv(p)
    r6 = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return back.select(F.col("label").cast("long").alias("label"), *r6, F.col("support").cast("long").alias("support"))


register("k_results_csv", sql=SQL["a_class_report"])(_results_csv)


def _run_summary(spark, sf):
    """The summary (K8) and the metric log (K9), both read back."""
    s = scored(spark, sf)
    lc = M.label_counts(s, "pred", [0, 1, 2])
    summ = SK.run_summary(lc, "label", "count", s.select(F.avg("conf")).scalar(), {"max_length": 512, "stride": 384})
    p, log = _scratch(spark, "summary"), _scratch(spark, "metrics")
    summ.write.mode("overwrite").json(p)
    SK.append_metrics(summ.select("total", "avg_confidence"), log)
    SK.append_metrics(summ.select("total", "avg_confidence"), log)
    per = [F.col(f"per_class.`{k}`").cast("long").alias(f"n{k}") for k in range(3)]
    logged = spark.read.json(log).agg(F.count("timestamp").alias("logged"), F.sum("total").cast("long").alias("log_total"))
    return spark.read.json(p).select("total", F.round("avg_confidence", 6).alias("avg_confidence"), *per,
                                     F.col("params.stride").alias("stride")).join(logged)


register("k_run_summary", sql=f"""
WITH {SQL_SCORED}
SELECT count(*) AS total, round(avg(conf), 6) AS avg_confidence, count(*) FILTER (pred = 0) AS n0, count(*) FILTER (pred = 1) AS n1,
       count(*) FILTER (pred = 2) AS n2, '384' AS stride, CAST(2 AS BIGINT) AS logged, CAST(2 * count(*) AS BIGINT) AS log_total
FROM scored
""")(_run_summary)


def _index_shards_io(spark, sf):
    """save_index / load_index round trip with a second, later shard set for
    some chunks: the later one wins (K7)."""
    ch = _store_chunks(spark, sf).select("cid", "doc_id", "chunk_id", "text")
    again = ch.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    p = _scratch(spark, "index")
    man = SK.save_index(ch, p, "cid", shard_size=100)
    later = again.withColumn("shard_no", F.lit(1_000_000))
    later.write.mode("append").partitionBy("shard_no").parquet(f"{p}/shards")
    back = SK.load_index(spark, p, "cid")
    m = man.select("total_docs", "num_shards", F.size("shards").alias("listed"))
    return back.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("text").alias("text_md5")).join(m)


register("k_save_index", sql=f"""
WITH {sql_chunks()}, n AS (SELECT count(*) AS n FROM chunks)
SELECT doc_id, chunk_id, md5(CASE WHEN doc_id % 5 = 0 THEN 'new ' ELSE '' END || text) AS text_md5, n AS total_docs,
       CAST(ceil(n / 100.0) AS BIGINT) AS num_shards, CAST(ceil(n / 100.0) AS BIGINT) AS listed FROM chunks, n
""")(_index_shards_io)

# ------------------------------------------------------------------ A18, A19, T2

CUTOFF = "2024-01-15 00:00:00"


def _freshness(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("store"), F.col("ts").alias("mtime"))
    # events.ts is a wall-clock timestamp (TIMESTAMP_NTZ): compare and
    # print it as such, independent of the session time zone
    man = spark.createDataFrame([("click", CUTOFF), ("view", "2024-12-31 00:00:00"), ("error", CUTOFF)],
                                "store string, built_at string").withColumn("built_at", F.to_timestamp_ntz("built_at"))
    f = INC.source_freshness(e, man, "store")
    return f.select("store", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"),
                    F.col("stale").cast("long").alias("stale"))


register("a_freshness", sql=f"""
WITH l AS (SELECT event_type AS store, max(ts) AS latest FROM events GROUP BY 1),
m AS (SELECT * FROM (VALUES ('click', TIMESTAMP '{CUTOFF}'), ('view', TIMESTAMP '2024-12-31 00:00:00'), ('error', TIMESTAMP '{CUTOFF}')) t(store, built_at))
SELECT l.store, strftime(l.latest, '%Y-%m-%d %H:%M:%S') AS latest,
       CAST(m.built_at IS NULL OR l.latest > m.built_at AS BIGINT) AS stale
FROM l LEFT JOIN m USING (store)
""")(_freshness)


def _index_status(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("store")).agg(
        F.create_map(F.lit("docs"), F.count(F.lit(1)).cast("string"), F.lit("origin"), F.lit("listing")).alias("meta"))
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)", 1).alias("store"))
    m = p.groupBy("store").agg(F.create_map(F.lit("pages"), F.count(F.lit(1)).cast("string"),
                                            F.lit("origin"), F.lit("manifest")).alias("meta"))
    s = INC.index_status(d, m)
    return s.select("store", "status", F.col("meta")["docs"].alias("docs"), F.col("meta")["pages"].alias("pages"),
                    F.col("meta")["origin"].alias("origin"))


register("a_index_status", sql="""
WITH l AS (SELECT lang AS store, CAST(count(*) AS VARCHAR) AS docs FROM documents GROUP BY 1),
m AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS store, CAST(count(*) AS VARCHAR) AS pages FROM pages GROUP BY 1)
SELECT coalesce(l.store, m.store) AS store,
       CASE WHEN m.store IS NULL THEN 'missing_index' WHEN l.store IS NULL THEN 'orphan' ELSE 'ok' END AS status,
       l.docs, m.pages, CASE WHEN l.store IS NOT NULL THEN 'listing' ELSE 'manifest' END AS origin
FROM l FULL JOIN m USING (store)
""")(_index_status)


def _refresh(spark, sf):
    e = table(spark, sf, "events")
    cur = e.groupBy(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")).agg(F.max("ts").alias("mtime"))
    old = (e.filter(F.col("ts") < F.to_timestamp_ntz(F.lit(CUTOFF)))
           .groupBy(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")).agg(F.max("ts").alias("mtime")))
    gone = e.filter(F.col("user_id") % 7 == 0).select(F.concat(F.lit("gone_"), F.col("user_id").cast("string")).alias("path"),
                                                      F.col("ts").alias("mtime")).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return INC.refresh_delta(cur, old.unionByName(gone))


register("t_refresh_delta", sql=f"""
WITH cur AS (SELECT 'f' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events GROUP BY 1),
old AS (SELECT 'f' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1
        UNION ALL SELECT 'gone_' || CAST(user_id AS VARCHAR), max(ts) FROM events WHERE user_id % 7 = 0 GROUP BY 1)
SELECT coalesce(cur.path, old.path) AS path,
       CASE WHEN old.mtime IS NULL THEN 'new' WHEN cur.mtime IS NULL THEN 'removed' ELSE 'changed' END AS action
FROM cur FULL JOIN old USING (path) WHERE old.mtime IS NULL OR cur.mtime IS NULL OR cur.mtime <> old.mtime
""")(_refresh)

# ------------------------------------------------------------------ T1, T3


def _stream_ingest(spark, sf):
    """Documents land as Parquet files in four drops; the stream ingests
    each file once, splits records and appends them to the sink."""
    from papertrail.functions.records import split_records

    d = table(spark, sf, "documents").select("doc_id", "text")
    src, sink = _scratch(spark, "stream-src"), _scratch(spark, "stream-sink")
    d.withColumn("drop", F.col("doc_id") % 4).write.partitionBy("drop").parquet(src)

    def process(batch):
        return batch.select("doc_id", F.posexplode(split_records("text")).alias("pos", "record")) \

    INC.stream_ingest(spark, src, d.schema, sink, _scratch(spark, "stream-ckpt"), key=["doc_id", "pos"], process=process)
    return spark.read.parquet(sink).select("doc_id", F.col("pos").cast("long").alias("pos"), "record")


register("t_stream_ingest", sql=f"""
WITH r AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{{3,}}'), lambda p: {D.strip('p')}), lambda p: length(p) > 0) AS ps FROM documents))
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, p AS record FROM r
""")(_stream_ingest)


def _chat_state(spark, sf):
    c = table(spark, sf, "conversations")
    src, sink = _scratch(spark, "chat-src"), _scratch(spark, "chat-sink")
    c.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(c.schema).parquet(src)
    out = CHAT.chat_state(stream)
    with CHAT.state_store(spark):
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", _scratch(spark, "chat-ckpt"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(sink)


register("t_chat_state", sql=SQL["w_chat_history"])(_chat_state)

# ------------------------------------------------------------------ S7


def _binary_docs(spark, sf):
    """Pages land in folders of documents, their names ending in .pdf in several
    cases or in another extension; an empty file lies beside them."""
    root = _scratch(spark, "binary")
    p = table(spark, sf, "pages").select((F.col("page_id") % 97).alias("doc"), F.hex(F.coalesce("html", F.lit(""))).alias("body"))
    p = p.repartition("doc")
    for k, ext in enumerate(("pdf", "PDF", "Pdf", "txt")):
        p.filter(F.col("doc") % 4 == k).write.mode("append").partitionBy("doc").option("extension", ext).option("emptyValue", "").csv(root)
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/doc=97/empty.PdF")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).create(empty).close()
    docs = RD.list_binary_docs(spark, root)
    name = F.regexp_extract("path", r"doc=(\d+)/", 1).cast("long")
    return docs.select(name.alias("doc"), F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("extension"), "length",
                       F.when(F.col("is_empty"), F.lit("empty file")).alias("error"))


register("s_binary_docs", sql="""
SELECT page_id % 97 AS doc, CASE page_id % 97 % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PDF' ELSE 'Pdf' END AS extension,
       CAST(sum(2 * octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS length, NULL::VARCHAR AS error
FROM pages WHERE page_id % 97 % 4 < 3 GROUP BY 1, 2
UNION ALL SELECT 97, 'PdF', 0, 'empty file'
""")(_binary_docs)
