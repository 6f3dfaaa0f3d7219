"""Registered corpus queries: projections, unions, key joins, ordinals, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import prompts as PR
from papertrail.functions import text as X
from papertrail.functions.records import split_records
from papertrail.operators import corpus as C
from papertrail.plans import duck as D
from papertrail.plans.q_text import _KW, _SQL_DOI_RECORD, _SQL_EXTRACT_DOI, _doi_record
from papertrail.plans.registry import register
from papertrail.session import table

# ------------------------------------------------------------------ S1


def _blob(doc_id, text, source, lang):
    return F.concat(F.lit("\r\n"), text, F.lit("\r\n\r\n\r\n"), source, F.lit("\n\n\n\n\n\n  \n\n\n"),
                    lang, F.lit(" "), doc_id.cast("string"), F.lit("\n\n"), source, F.lit("\n\n\n\n"))


_SQL_BLOB = ("(chr(13) || chr(10) || text || repeat(chr(13) || chr(10), 3) || source || repeat(chr(10), 6) || '  ' "
             "|| repeat(chr(10), 3) || lang || ' ' || CAST(doc_id AS VARCHAR) || repeat(chr(10), 2) || source || repeat(chr(10), 4))")


def _split_records(spark, sf):
    d = table(spark, sf, "documents")
    recs = d.select("doc_id", F.posexplode(split_records(_blob(F.col("doc_id"), F.col("text"), F.col("source"),
                                                               F.col("lang")))).alias("pos", "record"))
    return recs.select("doc_id", F.col("pos").cast("long").alias("pos"), "record")


register("s_split_records", sql=f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace({_SQL_BLOB}, chr(13) || chr(10), chr(10)), '\\n{{3,}}'),
                                                     lambda x: {D.strip('x')}), lambda x: x <> '') AS recs FROM documents)
SELECT doc_id, CAST(generate_subscripts(recs, 1) - 1 AS BIGINT) AS pos, unnest(recs) AS record FROM t
""")(_split_records)

# ------------------------------------------------------------------ P1-P4


def _content(spark, sf):
    d = table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("  "), F.col("source"), F.lit(" "), F.col("lang")))
    abstract = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    return d.select("doc_id", C.title_abstract(title, abstract).alias("content"))


register("p_content", sql=f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '  ' || source || ' ' || lang END AS title,
                  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS abstract FROM documents)
SELECT doc_id, {D.strip("coalesce(title, '') || chr(10) || coalesce(abstract, '')")} AS content FROM t
""")(_content)


def _drop_empty(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    content = X.strip(F.when(F.col("toxic") == 1, F.lit(" \n ")).otherwise(F.col("text")))
    kept = C.drop_empty(d.select("doc_id", content.alias("content")), "content")
    return kept.select("doc_id", F.length("content").cast("long").alias("n_chars"))


register("p_drop_empty", sql=f"""
WITH t AS (SELECT d.doc_id, {D.strip("CASE WHEN l.toxic = 1 THEN ' ' || chr(10) || ' ' ELSE d.text END")} AS content
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CAST(length(content) AS BIGINT) AS n_chars FROM t WHERE coalesce(length(content), 0) > 0
""")(_drop_empty)


def _label_union(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("src_id"), "text")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("src_id"), "text")
    u = C.label_sources([(docs, 1), (bench, 0)])
    return u.select("src_id", F.col("label").cast("long").alias("label"), F.length("text").cast("long").alias("n_chars"))


register("p_label_union", sql="""
SELECT doc_id AS src_id, CAST(1 AS BIGINT) AS label, CAST(length(text) AS BIGINT) AS n_chars FROM documents
UNION ALL
SELECT item_id AS src_id, CAST(0 AS BIGINT) AS label, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark
""")(_label_union)


def _qa_from_conversations(spark, sf):
    """(conv_id, turn, question, reasoning, answer): each user turn with the
    next assistant turn; reasoning = the first line of the answer."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("answer"))
    qa = u.join(a, ["conv_id", "turn"], "inner")
    return qa.withColumn("reasoning", F.substring_index(F.col("answer"), "\n", 1))


_SQL_QA = """qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, split_part(a.text, chr(10), 1) AS reasoning
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def _sft_prompt(spark, sf):
    qa = _qa_from_conversations(spark, sf)
    t = F.concat(C.render_prompt(PR.SFT_TRAIN_TEMPLATE, question="question", reasoning="reasoning", answer="answer"),
                 F.lit(PR.EOS))
    return qa.select("conv_id", "turn", t.alias("prompt"))


register("p_sft_prompt", sql=f"""
WITH {_SQL_QA}
SELECT conv_id, turn, {D.render(PR.SFT_TRAIN_TEMPLATE, question='question', reasoning='reasoning', answer='answer')} || {D.q(PR.EOS)} AS prompt
FROM qa
""")(_sft_prompt)


def _offset_limit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return C.slice_from(d, ["source", "doc_id"], 100, 400).select("doc_id", "seq")


register("p_offset_limit", sql="""
SELECT doc_id, seq FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS seq FROM documents)
WHERE seq >= 100 AND seq < 400
""")(_offset_limit)


def _route_store(spark, sf):
    b = table(spark, sf, "benchmark")
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.col("text"), F.lit(" What catalyst works?"))).otherwise(F.col("text"))
    qs = b.select("item_id", X.route_query(q).alias("route"))
    # only the general store exists; it is described by the corpus itself
    stores = (table(spark, sf, "documents").groupBy(F.lit("general").alias("store_type"))
              .agg(F.count(F.lit(1)).alias("store_docs")))
    j = C.route_store(qs, stores)
    return j.select("item_id", "route", F.col("store_docs").cast("long").alias("store_docs"), "error")


register("p_route_store", sql=f"""
WITH qs0 AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' What catalyst works?' ELSE text END AS q FROM benchmark),
qs AS (SELECT item_id, CASE WHEN {_KW} THEN 'synthesis' ELSE 'general' END AS route FROM qs0),
st AS (SELECT 'general' AS store_type, count(*) AS store_docs FROM documents)
SELECT item_id, route, CAST(store_docs AS BIGINT) AS store_docs,
       CASE WHEN st.store_type IS NULL THEN 'knowledge base not available: ' || route END AS error
FROM qs LEFT JOIN st ON qs.route = st.store_type
""")(_route_store)

# ------------------------------------------------------------------ U1 / U2


def _union_all(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("txt").alias("kind"), F.col("doc_id").alias("id"),
                                             F.length("text").cast("long").alias("n_chars"))
    p = table(spark, sf, "pages").select(F.lit("md").alias("kind"), F.col("page_id").alias("id"),
                                         F.length("html").cast("long").alias("n_chars"))
    return C.union_all(d, p)


register("u_union_all", sql="""
SELECT 'txt' AS kind, doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT 'md' AS kind, page_id AS id, CAST(length(html) AS BIGINT) AS n_chars FROM pages
""")(_union_all)


def _intersect(spark, sf):
    d = table(spark, sf, "documents").select("lang")
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)", 1).alias("lang"))
    return C.intersect_keys(d, p, "lang")


register("u_intersect", sql="""
SELECT DISTINCT lang FROM documents WHERE lang IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) FROM pages)
""")(_intersect)

# ------------------------------------------------------------------ J1-J4, J8


def _bib_from_labels(spark, sf):
    """Bib entries built from `labels`: every labelled document gets one;
    toxic ones get a second, later entry with the same DOI (the later one
    must win)."""
    lab = table(spark, sf, "labels")
    doi = F.concat(F.lit(" 10."), (F.col("doc_id") + 1000).cast("string"), F.lit("/CHEM."), F.col("doc_id").cast("string"), F.lit(" "))
    first = lab.select((F.col("doc_id") * 2).alias("entry_no"), doi.alias("doi"),
                       F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("title"))
    second = lab.filter(F.col("toxic") == 1).select((F.col("doc_id") * 2 + 1).alias("entry_no"), doi.alias("doi"),
                                                    F.lit("T").alias("title"))
    return first.unionByName(second)


_SQL_BIB = """bib AS (
  SELECT doc_id * 2 AS entry_no, ' 10.' || CAST(doc_id + 1000 AS VARCHAR) || '/CHEM.' || CAST(doc_id AS VARCHAR) || ' ' AS doi,
         'Q' || CAST(quality AS VARCHAR) AS title FROM labels
  UNION ALL
  SELECT doc_id * 2 + 1, ' 10.' || CAST(doc_id + 1000 AS VARCHAR) || '/CHEM.' || CAST(doc_id AS VARCHAR) || ' ', 'T'
  FROM labels WHERE toxic = 1),
bib1 AS (SELECT lower(trim(doi)) AS doi_key, arg_max(title, entry_no) AS title FROM bib WHERE trim(doi) <> '' GROUP BY 1),
recs AS (SELECT doc_id, text, """ + _SQL_EXTRACT_DOI.format(x=_SQL_DOI_RECORD) + """ AS doi FROM documents)"""


def _doi_pairs(spark, sf):
    recs = table(spark, sf, "documents").select("doc_id", _doi_record(F.col("doc_id"), F.col("text")).alias("text"))
    bib = _bib_from_labels(spark, sf)
    j = C.pair_by_doi(recs, bib, rec_id="doc_id", rec_text="text")
    return j.select("doc_id", "doi_key", F.col("entry.title").alias("title"))


register("j_doi_pairs", sql=f"""
WITH {_SQL_BIB}
SELECT r.doc_id, b.doi_key, b.title FROM recs r JOIN bib1 b ON r.doi = b.doi_key
""")(_doi_pairs)


def _doi_missing(spark, sf):
    recs = table(spark, sf, "documents").select("doc_id", _doi_record(F.col("doc_id"), F.col("text")).alias("text"))
    miss = C.unmatched(recs, _bib_from_labels(spark, sf))
    return miss.select("doc_id", "doi", "snippet")


register("j_doi_missing", sql=f"""
WITH {_SQL_BIB}
SELECT doc_id, doi, substr({_SQL_DOI_RECORD}, 1, 80) AS snippet
FROM recs WHERE doi IS NULL OR doi NOT IN (SELECT doi_key FROM bib1)
""")(_doi_missing)


def _match_names(spark, sf):
    txt = table(spark, sf, "documents").select(F.concat(F.lit("paper_"), F.col("doc_id").cast("string")).alias("name"),
                                               F.col("n_chars"))
    js = table(spark, sf, "labels").select(F.concat(F.lit("paper_"), F.col("doc_id").cast("string")).alias("name"),
                                           F.col("quality").cast("long").alias("quality"))
    return C.match_by_name(txt, js, "name")


register("j_match_names", sql="""
SELECT 'paper_' || CAST(d.doc_id AS VARCHAR) AS name, d.n_chars, CAST(l.quality AS BIGINT) AS quality
FROM documents d JOIN labels l ON 'paper_' || CAST(d.doc_id AS VARCHAR) = 'paper_' || CAST(l.doc_id AS VARCHAR)
""")(_match_names)


def _restore_names(spark, sf):
    c = table(spark, sf, "conversations")
    width = c.select(F.max("turn") + 1).scalar()  # ids of two conversations never meet
    idx = F.col("conv_id") * width + F.col("turn")
    results = c.select(X.custom_id(F.col("role"), idx).alias("custom_id"), "conv_id", "turn")
    mapping = c.filter(F.col("role") == "user").select(X.custom_id(F.col("role"), idx).alias("custom_id"),
                                                       F.concat(F.col("role"), F.lit(" #"), F.col("turn").cast("string")).alias("name"))
    return C.restore_names(results, mapping).select("conv_id", "turn", "custom_id", "name")


register("j_restore_names", sql="""
WITH r AS (SELECT conv_id, turn, role, printf('req_%06d', conv_id * (SELECT max(turn) + 1 FROM conversations) + turn) || '_' || role AS custom_id FROM conversations)
SELECT r.conv_id, r.turn, r.custom_id, coalesce(m.name, r.custom_id) AS name
FROM r LEFT JOIN (SELECT custom_id, role || ' #' || CAST(turn AS VARCHAR) AS name FROM r WHERE role = 'user') m USING (custom_id)
""")(_restore_names)


def _response(spark, sf):
    req = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    resp = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("predicted"))
    return C.response_join(req, resp, "doc_id")


register("j_response", sql="""
SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(l.quality AS BIGINT) AS predicted
FROM documents d LEFT JOIN labels l USING (doc_id)
""")(_response)

# ------------------------------------------------------------------ W3, W6, W8, W9


def _rename(spark, sf):
    """Names of one file per source, some of them spelt like made names."""
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 10 == 3, F.lit("_1")).otherwise(F.lit("")), F.lit(".md"))
    d = table(spark, sf, "documents").select("doc_id", "lang", name.alias("file_name"))
    return C.resolve_name_conflicts(d, "lang", "file_name", order=["doc_id"]).select("doc_id", "lang", "target_name")


register("w_rename", sql="""
WITH t AS (SELECT doc_id, lang, source || CASE WHEN doc_id % 10 = 3 THEN '_1' ELSE '' END AS stem FROM documents),
g AS (SELECT lang, list(doc_id ORDER BY doc_id) AS ids, list([stem] ORDER BY doc_id) AS stems FROM t GROUP BY lang),
r AS (SELECT lang, ids, list_reduce(stems, lambda acc, x: list_append(acc, list_filter(
        list_concat([x[1]], list_transform(range(1, len(acc) + 1), lambda k: x[1] || '_' || CAST(k AS VARCHAR))),
        lambda c: NOT list_contains(acc, c))[1])) AS names FROM g)
SELECT unnest(ids) AS doc_id, lang, unnest(list_transform(names, lambda n: n || '.md')) AS target_name FROM r
""")(_rename)


def _sequence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return C.sequence_after_sort(d, ["source", "doc_id"], start=5).select("doc_id", "seq")


register("w_sequence", sql="""
SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) + 4 AS BIGINT) AS seq FROM documents
""")(_sequence)


def _batches(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return C.batch_no(e, "vec_id", 64).select("vec_id", "batch_no")


register("w_batches", sql="""
SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS BIGINT) AS batch_no FROM embeddings
""")(_batches)


def _split811(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return C.split(d, (0.8, 0.1, 0.1), by="doc_id", seed=42)


register("w_split_811", sql=f"""
WITH t AS (SELECT doc_id, ({D.hash32('doc_id')} % 10000) / 10000.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM t
""")(_split811)


def _split_strat(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return C.split(lab, (0.8, 0.2), by="doc_id", seed=7, names=("train", "test"), stratify="quality")


register("w_split_stratified", sql=f"""
WITH t AS (SELECT doc_id, CAST(quality AS BIGINT) AS quality, {D.hash32('doc_id', 7)} AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY quality) AS n FROM t)
SELECT doc_id, quality, CASE WHEN pos < n * 0.8 THEN 'train' ELSE 'test' END AS split FROM r
""")(_split_strat)


def _kfold(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return C.kfold(d, 5, by="doc_id", seed=42).withColumn("fold", F.col("fold").cast("long"))


register("w_kfold", sql=f"""
SELECT doc_id, {D.hash32('doc_id')} % 5 AS fold FROM documents
""")(_kfold)
