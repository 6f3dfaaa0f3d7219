"""Registered JSON / QA / request-response queries.

Model responses are built from every row of `events` (props JSON) and
`conversations` (question/answer text) with the same string operations
on both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import jsonx as J
from papertrail.functions import prompts as PR
from papertrail.operators import corpus as C
from papertrail.operators.qa_scan import extract_qa
from papertrail.plans import duck as D
from papertrail.plans import jobs
from papertrail.plans.registry import register
from papertrail.session import table
from papertrail.sources.sinks import dead_letter, qa_document

# ------------------------------------------------------------------ F3-F7


def _fenced(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 4
    raw = (F.when(m == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
           .when(m == 1, F.concat(F.lit(" ```\n"), F.col("props"), F.lit("```\n")))
           .when(m == 2, F.concat(F.lit("  "), F.col("props")))
           .otherwise(F.concat(F.lit("```json "), F.col("props"))))
    return e.select("event_id", raw.alias("raw"))


_SQL_FENCED = """fenced AS (SELECT event_id, CASE event_id % 4
  WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 1 THEN ' ```' || chr(10) || props || '```' || chr(10)
  WHEN 2 THEN '  ' || props
  ELSE '```json ' || props END AS raw FROM events)"""


def _duck_unfence(x):
    s = D.strip(x)
    return (f"CASE WHEN starts_with({s}, '```json') AND ends_with({s}, '```') "
            f"THEN {D.strip(f'substr({s}, 8, greatest(length({s}) - 10, 0))')} "
            f"WHEN starts_with({s}, '```') AND ends_with({s}, '```') "
            f"THEN {D.strip(f'substr({s}, 4, greatest(length({s}) - 6, 0))')} ELSE {s} END")


register("f_code_fence", sql=f"""
WITH {_SQL_FENCED}
SELECT event_id, {_duck_unfence('raw')} AS unfenced FROM fenced
""")(lambda spark, sf: _fenced(spark, sf).select("event_id", J.strip_code_fence("raw").alias("unfenced")))


def _braceless(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 3
    raw = (F.when(m == 0, F.col("props")).when(m == 1, F.expr("substring(props, 2)"))
           .otherwise(F.expr("substring(props, 1, length(props) - 1)")))
    return e.select("event_id", raw.alias("raw"))


def _duck_braces(x):
    s = D.strip(x)
    s2 = f"(CASE WHEN starts_with({s}, '{{') THEN {s} ELSE '{{' || {s} END)"
    return f"(CASE WHEN ends_with({s2}, '}}') THEN {s2} ELSE {s2} || '}}' END)"


register("f_brace_repair", sql=f"""
WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN substr(props, 2)
                                 ELSE substr(props, 1, length(props) - 1) END AS raw FROM events)
SELECT event_id, {_duck_braces('raw')} AS repaired FROM b
""")(lambda spark, sf: _braceless(spark, sf).select("event_id", J.brace_repair("raw").alias("repaired")))


_NOTE = '", "note": "said \\"hi\\"' + '""  '
_TRIPLE_Q = '"' * 3


def _quoted(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 3
    raw = (F.when(m == 0, F.col("props"))
           .when(m == 1, F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit(_NOTE)))
           .otherwise(F.concat(F.lit('{"v": "'), F.col("value").cast("string"), F.lit('"'))))
    return e.select("event_id", raw.alias("raw"))


register("f_quote_repair", sql=f"""
WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props
             WHEN 1 THEN '{{"type": "' || event_type || {D.q(_NOTE)}
             ELSE '{{"v": "' || CAST(value AS VARCHAR) || '"' END AS raw FROM events),
c AS (SELECT event_id, regexp_replace({D.strip('raw')}, '"+\\s*$', '') AS s FROM b)
SELECT event_id, replace(CASE WHEN ends_with({D.strip('s')}, '}}') THEN s ELSE s || '}}' END, '\\"', '"') AS repaired FROM c
""")(lambda spark, sf: _quoted(spark, sf).select("event_id", J.quote_repair("raw").alias("repaired")))


def _broken_bib(spark, sf):
    d = table(spark, sf, "documents")
    clean = F.regexp_replace("text", '"', "'")
    raw = F.concat(F.lit('{"ENTRYTYPE": "article", "ID": "'), F.col("source"), F.lit('_'), F.col("doc_id").cast("string"),
                   F.lit('", "title": "'), F.substring_index(clean, "\n", 1), F.lit('", "year":"'),
                   (F.col("doc_id") % 30 + 1990).cast("string"),
                   F.when(F.col("doc_id") % 2 == 0, F.lit('", "doi": "10.1/x')).otherwise(F.lit("")),
                   F.lit('", "abstract": "'), clean, F.lit(_TRIPLE_Q))
    return d.select("doc_id", raw.alias("raw"))


_SQL_BROKEN = ("""bb AS (SELECT doc_id, '{"ENTRYTYPE": "article", "ID": "' || source || '_' || CAST(doc_id AS VARCHAR)
   || '", "title": "' || split_part(replace(text, '"', ''''), chr(10), 1) || '", "year":"' || CAST(doc_id % 30 + 1990 AS VARCHAR)
   || CASE WHEN doc_id % 2 = 0 THEN '", "doi": "10.1/x' ELSE '' END
   || '", "abstract": "' || replace(text, '"', '''') || """ + D.q(_TRIPLE_Q) + " AS raw FROM documents)")


def _salvage(spark, sf):
    m = _broken_bib(spark, sf).select("doc_id", J.salvage_fields("raw").alias("m"))
    return m.select("doc_id", F.explode("m").alias("field", "value"))


_SALV = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, regexp_extract(raw, '\"{f}\":\\s*\"([^\"]*)\"', 1) AS value FROM bb "
    f"WHERE regexp_matches(raw, '\"{f}\":\\s*\"[^\"]*\"')" for f in J.SALVAGE_FIELDS)
# the abstract reaches to the last quote of the text
_SALV += """ UNION ALL SELECT doc_id, 'abstract' AS field, regexp_extract(raw, '(?s)"abstract":\\s*"(.*)"[^"]*$', 1) AS value FROM bb"""
register("f_salvage", sql=f"""
WITH {_SQL_BROKEN}
{_SALV}
""")(_salvage)


def _lenient_input(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 6
    raw = (F.when(m == 0, F.col("props"))
           .when(m == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
           .when(m == 2, F.regexp_replace("props", "^\\{|\\}$", ""))
           .when(m == 3, F.concat(F.lit("["), F.col("props"), F.lit("]")))
           .when(m == 4, F.lit("   "))
           .otherwise(F.concat(F.col("props"), F.lit(" trailing"))))
    return e.select("event_id", raw.alias("raw"))


_SQL_LENIENT_IN = """li AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props
  WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN regexp_replace(props, '^\\{|\\}$', '', 'g')
  WHEN 3 THEN '[' || props || ']'
  WHEN 4 THEN '   '
  ELSE props || ' trailing' END AS raw FROM events)"""


def _json_lenient(spark, sf):
    p = _lenient_input(spark, sf).select("event_id", J.parse_json_lenient("raw").alias("v"))
    return p.select("event_id", F.col("v").isNotNull().cast("long").alias("valid"), J.variant_kind("v").alias("kind"),
                    F.try_variant_get("v", "$.k", "string").alias("k"))


def _duck_kind(x):
    return (f"CASE json_type({x}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END")


register("f_json_lenient", sql=f"""
WITH {_SQL_LENIENT_IN},
r AS (SELECT event_id, raw, CASE WHEN length({_duck_unfence('raw')}) > 0 THEN {_duck_braces(_duck_unfence('raw'))} END AS rep FROM li),
v AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(rep) THEN rep END AS j FROM r)
SELECT event_id, CAST(j IS NOT NULL AS BIGINT) AS valid, CASE WHEN j IS NULL THEN NULL ELSE {_duck_kind('j')} END AS kind,
       CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.k') END AS k FROM v
""")(_json_lenient)

# ------------------------------------------------------------------ F8, F9


def _json_str(c):
    """A JSON string literal of a column (quotes included)."""
    t = F.to_json(F.array(c))
    return F.substring(t, F.lit(2), F.length(t) - 2)


def qa_responses(spark, sf):
    """One JSONL model response per QA pair of `conversations`: the pair
    as an object line, a noise line, and a second object whose reasoning
    is falsy (0 / false / null) and whose answer is empty."""
    from papertrail.plans.q_corpus import _qa_from_conversations

    qa = _qa_from_conversations(spark, sf)
    line1 = F.concat(F.lit('{"question": '), _json_str(F.col("question")), F.lit(', "reasoning": '),
                     _json_str(F.col("reasoning")), F.lit(', "answer": '), _json_str(F.col("answer")), F.lit("}"))
    falsy = F.when(F.col("turn") % 3 == 0, F.lit("0")).when(F.col("turn") % 3 == 1, F.lit("false")).otherwise(F.lit("null"))
    line2 = F.concat(F.lit('{"question": '), _json_str(F.substring_index("answer", "\n", 1)), F.lit(', "reasoning": '),
                     falsy, F.lit(', "answer": ""}'))
    resp = F.concat(line1, F.lit("\nHere are more:\n"), line2)
    return qa.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair"), "conv_id", "turn",
                     line1.alias("first"), line2.alias("second"), resp.alias("response"))


_SQL_RESP = """qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, split_part(a.text, chr(10), 1) AS reasoning
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
  WHERE u.role = 'user'),
resp AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS pair, conv_id, turn,
  '{"question": ' || to_json(question) || ', "reasoning": ' || to_json(reasoning) || ', "answer": ' || to_json(answer) || '}'
  || chr(10) || 'Here are more:' || chr(10)
  || '{"question": ' || to_json(split_part(answer, chr(10), 1)) || ', "reasoning": '
  || CASE turn % 3 WHEN 0 THEN '0' WHEN 1 THEN 'false' ELSE 'null' END || ', "answer": ""}' AS response FROM qa),
lines AS (SELECT pair, conv_id, i, ln FROM (SELECT pair, conv_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS ln
          FROM (SELECT pair, conv_id, string_split(response, chr(10)) AS ls FROM resp))),
objs AS (SELECT pair, conv_id, CAST(row_number() OVER (PARTITION BY pair ORDER BY i) - 1 AS INTEGER) AS ord, ln FROM lines
         WHERE json_valid(ln) AND json_type(ln) = 'OBJECT')"""


def _duck_falsy(x, path):
    t = f"json_type({x}, '{path}')"
    v = f"json_extract_string({x}, '{path}')"
    return (f"CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN '' WHEN {t} = 'VARCHAR' THEN {v} "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {v} = 'true' THEN 'True' ELSE '' END "
            f"WHEN {t} IN ('OBJECT', 'ARRAY') THEN CASE WHEN {v} IN ('{{}}', '[]') THEN '' ELSE {v} END "
            f"WHEN CAST({v} AS DOUBLE) = 0 THEN '' ELSE {v} END")


_SQL_NORM = ", ".join(f"{_duck_falsy('ln', '$.' + f)} AS {f}" for f in ("question", "reasoning", "answer"))


def _qa_fast(spark, sf):
    r = qa_responses(spark, sf)
    o = r.select("pair", F.posexplode(J.jsonl_objects("response")).alias("ord", "v"))
    return o.select("pair", F.col("ord").cast("int").alias("ord"), J.normalize_qa("v").alias("qa")).select(
        "pair", "ord", "qa.question", "qa.reasoning", "qa.answer")


register("f_qa_jsonl_fast", sql=f"""
WITH {_SQL_RESP}
SELECT pair, ord, {_SQL_NORM} FROM objs
""")(_qa_fast)


def _normalize_qa(spark, sf):
    """normalize_qa on objects with every falsy kind and a truthy number."""
    c = table(spark, sf, "conversations")
    m = F.col("turn") % 5
    q = F.when(m == 0, F.lit("0")).when(m == 1, F.lit("false")).when(m == 2, F.lit("null")) \
         .when(m == 3, F.lit('""')).otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string")))
    raw = F.concat(F.lit('{"question": '), _json_str(F.col("role")), F.lit(', "reasoning": '), q, F.lit(', "answer": true}'))
    n = c.select("conv_id", "turn", J.normalize_qa(F.parse_json(raw)).alias("qa"))
    return n.select("conv_id", "turn", "qa.question", "qa.reasoning", "qa.answer")


register("f_normalize_qa", sql=f"""
WITH t AS (SELECT conv_id, turn, '{{"question": ' || to_json(role) || ', "reasoning": ' ||
  CASE turn % 5 WHEN 0 THEN '0' WHEN 1 THEN 'false' WHEN 2 THEN 'null' WHEN 3 THEN '""' ELSE '1' || CAST(conv_id AS VARCHAR) END
  || ', "answer": true}}' AS ln FROM conversations)
SELECT conv_id, turn, {_SQL_NORM} FROM t
""")(_normalize_qa)


def shaped_responses(spark, sf):
    """The same objects in every accepted shape: a fenced array, prose around
    objects, lines, pretty-printed objects, nested lists of JSON strings."""
    r = qa_responses(spark, sf)
    m = (F.col("conv_id") + F.col("turn")) % 5
    pretty = F.replace(F.replace("response", F.lit('{"question": '), F.lit('{\n  "question": ')), F.lit('"}\n'), F.lit('"\n}\n'))
    text = (F.when(m == 0, F.concat(F.lit("```json\n["), F.col("first"), F.lit(",\n"), F.col("second"), F.lit("]\n```")))
            .when(m == 1, F.concat(F.lit("Sure!\n"), F.regexp_replace("response", "\n", "\n\n"), F.lit("\nDone.")))
            .when(m == 2, F.col("response")).when(m == 3, pretty)
            .otherwise(F.concat(F.lit("Here: ["), F.to_json(F.array("first", "second")), F.lit("]"))))
    return r.withColumn("text", text)


def _extract_qa(spark, sf):
    return extract_qa(shaped_responses(spark, sf).select("pair", "text"), "pair", "text")


register("f_extract_qa", sql=f"""
WITH {_SQL_RESP}
SELECT pair, ord, {_SQL_NORM} FROM objs
""")(_extract_qa)

# ------------------------------------------------------------------ K4, K5


def _qa_doc(spark, sf):
    """Documents are conversations; the pairs of one form its QA file."""
    r = qa_responses(spark, sf)
    o = r.select("conv_id", "turn", F.posexplode(J.jsonl_objects("response")).alias("ord", "v"))
    qa = o.select("conv_id", F.struct("turn", "ord").alias("o"), J.normalize_qa("v").alias("qa")).select("conv_id", "o", "qa.*")
    return qa_document(qa, "conv_id", "o").select("conv_id", F.col("n_pairs").cast("long").alias("n_pairs"), "json")


_SQL_PAIR = ("'{\"question\":' || to_json(question) || ',\"reasoning\":' || to_json(reasoning) || ',\"answer\":' || to_json(answer) || '}'")
register("k_qa_document", sql=f"""
WITH {_SQL_RESP.replace("SELECT pair, conv_id, i, ln", "SELECT pair, conv_id, turn, i, ln").replace("SELECT pair, conv_id, generate_subscripts", "SELECT pair, conv_id, turn, generate_subscripts").replace("SELECT pair, conv_id, string_split", "SELECT pair, conv_id, turn, string_split").replace("objs AS (SELECT pair, conv_id,", "objs AS (SELECT pair, conv_id, turn,")},
n AS (SELECT conv_id, turn, ord, {_SQL_NORM} FROM objs)
SELECT conv_id, count(*) AS n_pairs, CASE WHEN count(*) = 1 THEN min({_SQL_PAIR})
       ELSE '[' || string_agg({_SQL_PAIR}, ',' ORDER BY turn, ord) || ']' END AS json
FROM n GROUP BY conv_id
""")(_qa_doc)


def _dead_letter(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    raw = F.concat(F.col("props"), F.lit(" "), F.col("event_type"))
    d = dead_letter(e.withColumn("name", F.concat(F.lit("event_"), F.col("event_id").cast("string"))).withColumn("raw", raw),
                    "API_CALL", "name", F.lit("API call failed"), "raw", raw_max_len=8)
    return d.drop("ts")


register("k_dead_letter", sql="""
SELECT 'API_CALL' AS stage, 'event_' || CAST(event_id AS VARCHAR) AS name, 'API call failed' AS message,
       substr(props || ' ' || event_type, 1, 8) AS raw FROM events WHERE event_type = 'error'
""")(_dead_letter)

# ------------------------------------------------------------------ M9, M10, M13, M14


def _corpora(spark, sf):
    txt = table(spark, sf, "documents").select(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("name"),
                                               "text")
    js = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("name"),
        F.to_json(F.struct("quality", "toxic")).alias("json"))
    return txt, js


def _build_requests(spark, sf):
    txt, js = _corpora(spark, sf)
    req, mapping = jobs.build_requests(txt, js, start=10, model="any")
    return req.join(mapping, "custom_id").select("custom_id", "name", F.col("params.messages")[0]["content"].alias("content"),
                                                 F.col("params.max_tokens").cast("long").alias("max_tokens"))


register("m_build_requests", sql=f"""
WITH t AS (SELECT d.source || '_' || CAST(d.doc_id AS VARCHAR) AS name, d.text,
                  '{{"quality":' || CAST(l.quality AS VARCHAR) || ',"toxic":' || CAST(l.toxic AS VARCHAR) || '}}' AS json
           FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS idx FROM t)
SELECT printf('req_%06d', idx) || '_' || substr(regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 53) AS custom_id, name,
       {D.render(PR.QA_USER_TEMPLATE, text='text', json_template_content='json')} AS content, CAST({jobs.DEFAULT_MAX_TOKENS} AS BIGINT) AS max_tokens
FROM s WHERE idx >= 10
""")(_build_requests)


def _results(spark, sf):
    """Batch results: system turns errored; every fourth pair returns
    prose only (parse error); the rest JSONL responses."""
    r = shaped_responses(spark, sf)
    cid = F.concat(F.lit("req_"), F.col("pair"))
    typ = F.when(F.col("turn") % 4 == 2, F.lit("errored")).otherwise(F.lit("succeeded"))
    text = F.when(F.col("turn") % 4 == 3, F.lit("I cannot answer that.")).otherwise(F.col("text"))
    res = r.select(cid.alias("custom_id"), typ.alias("type"), text.alias("text"),
                   F.when(typ == "errored", F.lit("overloaded_error")).alias("error_type"), "conv_id")
    mapping = res.filter(F.col("conv_id") % 2 == 0).select("custom_id", F.concat(F.lit("paper_"), F.col("conv_id").cast("string"),
                                                                                    F.lit("_"), F.col("custom_id")).alias("name"))
    return res.drop("conv_id"), mapping


def _ingest(spark, sf):
    res, mapping = _results(spark, sf)
    qa, dl, _ = jobs.ingest_results(res, mapping)
    a = qa.select("name", F.col("ord").cast("long").alias("ord"), F.lit("qa").alias("kind"), "question", "answer")
    b = dl.select("name", F.lit(None).cast("long").alias("ord"), F.col("stage").alias("kind"),
                  F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"))
    return a.unionByName(b)


register("m_ingest_results", sql=f"""
WITH {_SQL_RESP.replace("objs AS (SELECT pair", "objs0 AS (SELECT pair")},
res AS (SELECT 'req_' || pair AS custom_id, pair, conv_id, turn,
               CASE WHEN turn % 4 = 2 THEN 'errored' ELSE 'succeeded' END AS type,
               CASE WHEN turn % 4 = 3 THEN 'I cannot answer that.' ELSE response END AS text FROM resp),
named AS (SELECT r.*, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'paper_' || CAST(conv_id AS VARCHAR) || '_' || custom_id END, custom_id) AS name FROM res r),
ok_lines AS (SELECT n.name, n.pair, i, ln FROM (SELECT name, pair, generate_subscripts(ls, 1) AS i, unnest(ls) AS ln
             FROM (SELECT name, pair, string_split(text, chr(10)) AS ls FROM named WHERE type = 'succeeded')) n),
objs AS (SELECT name, pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY i) - 1 AS BIGINT) AS ord, ln FROM ok_lines
         WHERE json_valid(ln) AND json_type(ln) = 'OBJECT')
SELECT name, ord, 'qa' AS kind, {_duck_falsy('ln', '$.question')} AS question, {_duck_falsy('ln', '$.answer')} AS answer FROM objs
UNION ALL SELECT name, NULL, 'API_ERROR', NULL, NULL FROM named WHERE type <> 'succeeded'
UNION ALL SELECT name, NULL, 'PARSE_ERROR', NULL, NULL FROM named WHERE type = 'succeeded' AND pair NOT IN (SELECT pair FROM objs)
""")(_ingest)


def _build_sft(spark, sf):
    qa = _qa_fast(spark, sf).withColumn("qa_id", F.concat_ws("_", "pair", F.col("ord").cast("string")))
    return jobs.build_sft(qa, "qa_id").select("qa_id", "split", "text")


register("m_build_sft", sql=f"""
WITH {_SQL_RESP}, n AS (SELECT pair || '_' || CAST(ord AS VARCHAR) AS qa_id, {_SQL_NORM} FROM objs),
t AS (SELECT qa_id, {D.render(PR.SFT_TRAIN_TEMPLATE, question='question', reasoning='reasoning', answer='answer')} || {D.q(PR.EOS)} AS text,
             ({D.hash32('qa_id')} % 10000) / 10000.0 AS u FROM n)
SELECT qa_id, CASE WHEN u < 0.9 THEN 'train' ELSE 'test' END AS split, text FROM t
""")(_build_sft)


def _extract_records(spark, sf):
    li = _lenient_input(spark, sf)
    resp = li.select(F.concat(F.lit("paper_"), F.col("event_id").cast("string")).alias("name"),
                     F.when(F.col("event_id") % 10 == 7, F.lit("API call failed")).otherwise(F.col("raw")).alias("response"))
    recs, log = jobs.extract_records(resp)
    a = recs.select("name", F.lit("saved").alias("status"), J.variant_kind("parsed").alias("kind"),
                    F.try_variant_get("parsed", "$.k", "string").alias("k"))
    b = log.select("name", F.col("stage").alias("status"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("k"))
    return a.unionByName(b)


register("m_extract_records", sql=f"""
WITH {_SQL_LENIENT_IN},
resp AS (SELECT 'paper_' || CAST(event_id AS VARCHAR) AS name, CASE WHEN event_id % 10 = 7 THEN 'API call failed' ELSE raw END AS raw FROM li),
r AS (SELECT name, raw, CASE WHEN length({_duck_unfence('raw')}) > 0 THEN {_duck_braces(_duck_unfence('raw'))} END AS rep FROM resp),
v AS (SELECT name, raw, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(rep) THEN rep END AS j FROM r)
SELECT name, 'saved' AS status, {_duck_kind('j')} AS kind, json_extract_string(j, '$.k') AS k FROM v WHERE j IS NOT NULL
UNION ALL SELECT name, 'API_CALL', NULL, NULL FROM v WHERE raw = 'API call failed'
UNION ALL SELECT name, 'JSON_PARSE', NULL, NULL FROM v WHERE j IS NULL
""")(_extract_records)
