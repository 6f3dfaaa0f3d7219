"""Registered extraction-record queries: typed normalisation (two shapes),
JSON flattening (text and leaves), JSON documents, contract checks.
Records are generated from every `events` row (props + columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import extraction as X
from papertrail.plans.registry import register
from papertrail.session import table


def _num(c):
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def records(spark, sf):
    e = table(spark, sf, "events")
    act = (F.when(F.col("event_id") % 4 == 0, F.lit("Thermal")).when(F.col("event_id") % 4 == 1, F.lit("Tip"))
           .when(F.col("event_id") % 4 == 2, F.lit("Photo")).otherwise(F.lit("Laser")))
    rtype = F.when(F.col("user_id") % 3 == 0, F.lit("Magic coupling")).otherwise(F.lit("Ullmann Coupling"))
    unit = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit(" K"))
    prec = F.concat(F.lit('[{"iupacName": "'), F.col("event_type"), F.lit('", "abbreviation": "P'), F.col("user_id").cast("string"),
                    F.lit('", "deposition": {"method": "Sublimation", "parameters": {"Temperature": "'), _num("value"),
                    F.lit(' K"}}}]'))
    stage = F.concat(F.lit('[{"activation": {"type": "'), act, F.lit('", "conditions": {"annealingTemperature": "'), _num("value"), unit,
                     F.lit('"}}, "mechanism": {"reactionType": "'), rtype, F.lit('"}}]'))
    lit_ = F.concat(F.lit('"literature": {"doi": "10.1/'), F.col("event_id").cast("string"), F.lit('", "year": "2024"}'))
    a = F.concat(F.lit('{"precursors": '), prec, F.lit(', "reactionStages": '), stage,
                 F.lit(', "finalStage": [{"type": "Thermal", "products": {"abbreviation": "N'), F.col("user_id").cast("string"),
                 F.lit('"}}], '), lit_, F.lit("}"))
    kind = F.when(F.col("event_id") % 4 == 1, F.lit('"activation": {"type": "Thermal"}')) \
        .otherwise(F.lit('"type": "Thermal", "activation": {"conditions": {"annealingTime": "1 h"}}'))
    b = F.concat(F.lit('{"precursors": {"precursors": '), prec, F.lit('}, "reactionStages": {"reactionStages": '), stage,
                 F.lit('}, "finalStage": {'), kind, F.lit(', "products": {"products": [{"abbreviation": "N'),
                 F.col("user_id").cast("string"), F.lit('"}, {"abbreviation": "M'), F.col("user_id").cast("string"),
                 F.lit('"}]}}, "adsorption": {"site": "hollow"}, '), lit_, F.lit("}"))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("json"))


_SQL_NUM = "regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')"
_SQL_ACT = "CASE event_id % 4 WHEN 0 THEN 'Thermal' WHEN 1 THEN 'Tip' WHEN 2 THEN 'Photo' ELSE 'Laser' END"
_SQL_RTYPE = "CASE WHEN user_id % 3 = 0 THEN 'Magic coupling' ELSE 'Ullmann Coupling' END"


def _norm(spark, sf):
    n = X.normalize_extraction(records(spark, sf), "json")
    p = X.precursor_rows(n, "event_id")
    lit = n.select("event_id", F.col("record.literature.doi").alias("doi"),
                   F.array_join(F.transform("record.finalStage", lambda f: F.concat(
                       f["type"], F.lit(":"), f["products"]["abbreviation"])), ",").alias("products"))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "iupacName", "abbreviation",
                    F.col("deposition.method").alias("method"), F.col("deposition.parameters.Temperature").alias("temperature")).join(lit, "event_id")


register("f_norm_extraction", sql=f"""
SELECT event_id, CAST(0 AS BIGINT) AS idx, event_type AS iupacName, 'P' || CAST(user_id AS VARCHAR) AS abbreviation,
       'Sublimation' AS method, {_SQL_NUM} || ' K' AS temperature, '10.1/' || CAST(event_id AS VARCHAR) AS doi,
       'Thermal:N' || CAST(user_id AS VARCHAR) || CASE WHEN event_id % 2 = 1 THEN ',Thermal:M' || CAST(user_id AS VARCHAR) ELSE '' END AS products
FROM events
""")(_norm)


DEEP = 12  # levels of the deepest value
_OPEN, _CLOSE = '{"d": ' * DEEP, "}" * DEEP


def _flatten_text(spark, sf):
    e = table(spark, sf, "events")
    j = F.concat(F.lit('{"a": {"b": '), F.col("value").cast("string"), F.lit(', "c": [null, true, {"d": []}]}, "k": '),
                 F.col("user_id").cast("string"), F.lit(', "t": "'), F.col("event_type"), F.lit('", "p": '), F.col("props"),
                 F.lit(', "x": ' + _OPEN), F.col("user_id").cast("string"), F.lit(_CLOSE + "}"))
    return X.flatten_text(e.select("event_id", j.alias("j")), F.col("j"), "text").select("event_id", "text")


_DEEP_TEXT = " ".join("x" + ".d" * k + ":" for k in range(DEEP + 1))
register("f_flatten_text", sql=f"""
SELECT event_id, 'a: a.b: ' || CAST(value AS VARCHAR) || '; a.c: a.c.item_0: None; a.c.item_1: True; a.c.item_2: a.c.item_2.d: '
       || '; k: ' || CAST(user_id AS VARCHAR) || '; t: ' || event_type || '; p: p.k: ' || json_extract_string(props, '$.k')
       || '; {_DEEP_TEXT} ' || CAST(user_id AS VARCHAR) AS text
FROM events
""")(_flatten_text)


def _flatten_leaves(spark, sf):
    e = table(spark, sf, "events")
    j = F.concat(F.lit('{"u": '), F.col("user_id").cast("string"), F.lit(', "p": '), F.col("props"),
                 F.lit(', "l": ["'), F.col("event_type"), F.lit('", false], "x": ' + _OPEN), F.col("user_id").cast("string"),
                 F.lit(_CLOSE + "}"))
    return X.flatten_leaves(e.select("event_id", j.alias("j")), "event_id", "j")


register("f_flatten_leaves", sql=f"""
SELECT event_id, 'u' AS path, CAST(user_id AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'p.k', json_extract_string(props, '$.k') FROM events
UNION ALL SELECT event_id, 'l.item_0', event_type FROM events
UNION ALL SELECT event_id, 'l.item_1', 'False' FROM events
UNION ALL SELECT event_id, 'x{".d" * DEEP}', CAST(user_id AS VARCHAR) FROM events
""")(_flatten_leaves)


def _json_docs(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 5
    t = (F.when(m == 0, F.concat(F.lit("["), F.col("props"), F.lit(", "), F.col("props"), F.lit("]")))
         .when(m == 1, F.concat(F.lit('{"k": '), F.col("user_id").cast("string")))
         .otherwise(F.col("props")))
    d = X.json_docs(e.select("event_id", t.alias("t")), "event_id", "t")
    return d.select("event_id", F.col("item_index").cast("long").alias("item_index"), "page_content",
                    F.col("error").isNotNull().cast("long").alias("is_error"))


register("s_json_docs", sql="""
SELECT event_id, CAST(i AS BIGINT) AS item_index, 'k: ' || json_extract_string(props, '$.k') AS page_content, CAST(0 AS BIGINT) AS is_error
FROM events, range(2) t(i) WHERE event_id % 5 = 0
UNION ALL SELECT event_id, NULL, 'Error processing file: ' || CAST(event_id AS VARCHAR) || '. Error: invalid JSON', 1 FROM events WHERE event_id % 5 = 1
UNION ALL SELECT event_id, NULL, 'k: ' || json_extract_string(props, '$.k'), 0 FROM events WHERE event_id % 5 NOT IN (0, 1)
""")(_json_docs)


def _qa_contract(spark, sf):
    from papertrail.plans.q_corpus import _qa_from_conversations

    qa = _qa_from_conversations(spark, sf)
    qa = qa.withColumn("reasoning", F.when(F.col("turn") % 4 == 1, F.lit(" ")).otherwise(F.col("reasoning")))
    c = X.qa_contract_check(qa, "conv_id", min_chars=300)
    return c.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


_W = "(^|[^\\p{L}\\p{N}_])"
_E = "($|[^\\p{L}\\p{N}_])"
register("f_qa_contract", sql=f"""
WITH qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer,
         CASE WHEN u.turn % 4 = 1 THEN ' ' ELSE split_part(a.text, chr(10), 1) END AS reasoning
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
  WHERE u.role = 'user'),
n AS (SELECT conv_id, count(*) AS n FROM qa GROUP BY conv_id)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN n.n < 5 OR n.n > 10 THEN 'pair_count' END,
  CASE WHEN regexp_matches(lower(question), '{_W}(this paper|this study|this){_E}') THEN 'vague_reference' END,
  CASE WHEN regexp_matches(lower(question), '{_W}(doi|title|authors?){_E}') THEN 'metadata' END,
  CASE WHEN length(trim(coalesce(reasoning, ''))) = 0 THEN 'empty_reasoning' END,
  CASE WHEN length(coalesce(question, '') || coalesce(reasoning, '') || coalesce(answer, '')) < 300 THEN 'too_short' END],
  lambda x: x IS NOT NULL), ',') AS violations
FROM qa JOIN n USING (conv_id)
""")(_qa_contract)


def _extraction_contract(spark, sf):
    n = X.normalize_extraction(records(spark, sf), "json")
    st = X.stage_rows(n, "event_id").select("event_id", "idx", "activation.type", "activation.conditions", "mechanism.reactionType")
    c = X.extraction_contract_check(st)
    return c.select("event_id", F.col("idx").cast("long").alias("idx"), F.array_join("violations", ",").alias("violations"))


register("f_extraction_contract", sql=f"""
WITH s AS (SELECT event_id, {_SQL_ACT} AS type, {_SQL_RTYPE} AS rt,
                  {_SQL_NUM} || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' K' END AS atemp FROM events)
SELECT event_id, CAST(0 AS BIGINT) AS idx, array_to_string(list_filter([
  CASE WHEN type NOT IN ('Thermal', 'Tip', 'Photo') THEN 'activation_type' END,
  CASE WHEN rt NOT IN ('Ullmann Coupling') THEN 'reaction_type' END,
  CASE WHEN type <> 'Thermal' THEN 'thermal_fields' END,
  CASE WHEN NOT regexp_matches(atemp, '[-−+]?\\d+(\\.\\d+)?\\s*(°|℃|[A-Za-zμÅ])') THEN 'missing_unit' END], lambda x: x IS NOT NULL), ',') AS violations
FROM s
""")(_extraction_contract)
