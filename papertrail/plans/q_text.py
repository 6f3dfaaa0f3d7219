"""Registered text-function queries.

The driver tables hold no DOIs or Markdown; where an operator needs them
the strings are built from every row with the same ``concat`` on both
engines (never by sampling or filtering rows).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import text as X
from papertrail.plans import duck as D
from papertrail.plans.registry import register
from papertrail.session import table

# ------------------------------------------------------------------ F0


def _strip(spark, sf):
    d = table(spark, sf, "documents")
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit(" \n\r\n "))
    return d.select("doc_id", X.strip(padded).alias("text_stripped"))


register("f_strip", sql=f"""
SELECT doc_id, {D.strip("' ' || chr(9) || chr(160) || text || ' ' || chr(10) || chr(13) || chr(10) || chr(8195)")} AS text_stripped
FROM documents
""")(_strip)

# ------------------------------------------------------------------ F1 / F2


def _doi_record(doc_id, text):
    """A record with a DOI written in one of three styles (or none)."""
    m = doc_id % 4
    core = F.concat(F.lit("10."), (doc_id + 1000).cast("string"), F.lit("/Chem."), doc_id.cast("string"))
    return (F.when(m == 0, F.concat(text, F.lit("\ndoi: "), core, F.lit(".")))
            .when(m == 1, F.concat(text, F.lit("\nDOI:\n"), core, F.lit(";")))
            .when(m == 2, F.concat(F.lit("Doi "), core, F.lit(".,\n"), text))
            .otherwise(text))


_SQL_DOI_RECORD = """
CASE doc_id % 4
  WHEN 0 THEN text || chr(10) || 'doi: 10.' || CAST(doc_id + 1000 AS VARCHAR) || '/Chem.' || CAST(doc_id AS VARCHAR) || '.'
  WHEN 1 THEN text || chr(10) || 'DOI:' || chr(10) || '10.' || CAST(doc_id + 1000 AS VARCHAR) || '/Chem.' || CAST(doc_id AS VARCHAR) || ';'
  WHEN 2 THEN 'Doi 10.' || CAST(doc_id + 1000 AS VARCHAR) || '/Chem.' || CAST(doc_id AS VARCHAR) || '.,' || chr(10) || text
  ELSE text END"""

_SQL_EXTRACT_DOI = r"lower(regexp_replace(nullif(regexp_extract({x}, '(?i)doi[:\s]*\r?\n*\s*(10\.\d{{4,9}}/\S+)', 1), ''), '[.,;]+$', ''))"


def _extract_doi(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.extract_doi(_doi_record(F.col("doc_id"), F.col("text"))).alias("doi"))


register("f_extract_doi", sql=f"""
SELECT doc_id, {_SQL_EXTRACT_DOI.format(x=_SQL_DOI_RECORD)} AS doi FROM documents
""")(_extract_doi)


def _citekey(spark, sf):
    d = table(spark, sf, "documents")
    doi = X.extract_doi(_doi_record(F.col("doc_id"), F.col("text")))
    return d.select("doc_id", X.citekey(doi, F.col("doc_id")).alias("citekey"))


register("f_citekey", sql=f"""
WITH t AS (SELECT doc_id, {_SQL_EXTRACT_DOI.format(x=_SQL_DOI_RECORD)} AS doi FROM documents)
SELECT doc_id,
  CASE WHEN doi IS NULL OR doi = '' THEN 'article_' || CAST(doc_id + 1 AS VARCHAR)
       ELSE replace(split_part(doi, '/', 1), '.', '_') || '_' || split_part(split_part(doi, '/', 2), '.', 1) END AS citekey
FROM t
""")(_citekey)

# ------------------------------------------------------------------ F17


def _md_doc(doc_id, text):
    i = doc_id.cast("string")
    return F.concat(
        F.lit("## Title "), i, F.lit("\n\n> "), text,
        F.lit("\n\n- item *one* and **two**\n  + nested `code` ~~old~~\n1. step [link](http://x.org/"), i,
        F.lit(")\n\n| a | b |\n|---|:-:|\n| x_1 | y |\n\n![figure "), i,
        F.lit("](img.png) <sup>2</sup> a < b and c > d\n```python\nprint(1)\n```\n\n\n\n***\n   tail   \n"))


_SQL_MD_DOC = """('## Title ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || '> ' || text || chr(10) || chr(10)
 || '- item *one* and **two**' || chr(10) || '  + nested `code` ~~old~~' || chr(10)
 || '1. step [link](http://x.org/' || CAST(doc_id AS VARCHAR) || ')' || chr(10) || chr(10)
 || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| x_1 | y |' || chr(10) || chr(10)
 || '![figure ' || CAST(doc_id AS VARCHAR) || '](img.png) <sup>2</sup> a < b and c > d' || chr(10)
 || '```python' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10) || chr(10) || chr(10) || chr(10)
 || '***' || chr(10) || '   tail   ' || chr(10))"""


def _clean_md(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.clean_markdown(_md_doc(F.col("doc_id"), F.col("text"))).alias("clean"))


register("f_clean_markdown", sql=f"""
SELECT doc_id, {D.clean_markdown(_SQL_MD_DOC)} AS clean FROM documents
""")(_clean_md)


def _clean_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", X.clean_markdown("html").alias("clean"))


register("f_clean_markdown_pages", sql=f"""
SELECT page_id, {D.clean_markdown('html')} AS clean FROM pages
""")(_clean_pages)

# ------------------------------------------------------------------ F18


def _custom_id(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" "), F.col("text"))
    return d.select("doc_id", X.custom_id(name, F.col("doc_id"), start=7).alias("custom_id"))


register("f_custom_id", sql="""
WITH t AS (
  SELECT doc_id, printf('req_%06d', doc_id + 7) AS prefix,
         regexp_replace(source || '/' || lang || ' ' || text, '[^a-zA-Z0-9_-]', '_', 'g') AS clean
  FROM documents)
SELECT doc_id, CASE WHEN 64 - length(prefix) - 1 > 0 AND length(clean) > 0
                    THEN prefix || '_' || substr(clean, 1, 64 - length(prefix) - 1) ELSE prefix END AS custom_id
FROM t
""")(_custom_id)

# ------------------------------------------------------------------ F19


def _route(spark, sf):
    c = table(spark, sf, "conversations")
    # every third turn mentions a keyword the way a chemistry question would
    q = F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" Which Reaction Conditions apply?"))) \
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.route_query(q).alias("route"))


_KW = " OR ".join(f"contains(lower(q), {D.q(k)})" for k in X.SYNTHESIS_KEYWORDS)
register("f_route", sql=f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' Which Reaction Conditions apply?' ELSE text END AS q
           FROM conversations)
SELECT conv_id, turn, CASE WHEN {_KW} THEN 'synthesis' ELSE 'general' END AS route FROM t
""")(_route)

# ------------------------------------------------------------------ F20


def _answer(spark, sf):
    c = table(spark, sf, "conversations")
    t = (F.when(F.col("turn") % 2 == 1,
                F.concat(F.lit("### Question:\n"), F.col("role"), F.lit("\n### Answer:\n  "), F.col("text"),
                         F.lit("</s>\n### Answer: again")))
         .otherwise(F.col("text")))
    return c.select("conv_id", "turn", X.answer_part(t).alias("answer"),
                    X.answer_part(t, eos="</s>").alias("answer_train"))


_SQL_ANS_T = ("CASE WHEN turn % 2 = 1 THEN '### Question:' || chr(10) || role || chr(10) || '### Answer:' || chr(10) "
              "|| '  ' || text || '</s>' || chr(10) || '### Answer: again' ELSE text END")
register("f_answer_part", sql=f"""
WITH t AS (SELECT conv_id, turn, {_SQL_ANS_T} AS x FROM conversations),
u AS (SELECT conv_id, turn, x, instr(x, '### Answer:') AS p, substr(x, instr(x, '### Answer:') + 11) AS after FROM t)
SELECT conv_id, turn,
  CASE WHEN p > 0 THEN {D.strip('after')} ELSE x END AS answer,
  CASE WHEN p > 0 THEN {D.strip("replace(split_part(after, '### Answer:', 1), '</s>', '')")} ELSE x END AS answer_train
FROM u
""")(_answer)

# ------------------------------------------------------------------ F23 / S3 / P7

_SQL_PATH = """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages),
b AS (SELECT page_id, p, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir,
             CASE WHEN strpos(p, '/') > 0 THEN regexp_extract(p, '[^/]*$', 0) ELSE p END AS basename FROM a),
c AS (SELECT *, regexp_extract(basename, '^.+?(\\.[^.]*)$', 1) AS ext FROM b)
"""


def _path_parts(spark, sf):
    p = table(spark, sf, "pages")
    pp = X.path_parts("url")
    return p.select("page_id", pp["dir"].alias("dir"), pp["basename"].alias("basename"),
                    pp["stem"].alias("stem"), pp["ext"].alias("ext"))


register("f_path_parts", sql=_SQL_PATH + """
SELECT page_id, dir, basename, CASE WHEN ext = '' THEN basename ELSE substr(basename, 1, length(basename) - length(ext)) END AS stem, ext
FROM c
""")(_path_parts)


def _docs_stem(spark, sf):
    """read_docs naming rule: name = stem, extension test case-insensitive;
    pages without an extension count as '.html'."""
    p = table(spark, sf, "pages")
    pp = X.path_parts("url")
    ext = F.when(pp["ext"] == "", F.lit(".html")).otherwise(F.lower(pp["ext"]))
    return (p.select("page_id", pp["stem"].alias("name"), ext.alias("ext"))
            .filter(F.col("ext").isin(".html", ".htm")))


register("s_docs_stem", sql=_SQL_PATH + """
SELECT page_id, CASE WHEN ext = '' THEN basename ELSE substr(basename, 1, length(basename) - length(ext)) END AS name,
       CASE WHEN ext = '' THEN '.html' ELSE lower(ext) END AS ext
FROM c WHERE (CASE WHEN ext = '' THEN '.html' ELSE lower(ext) END) IN ('.html', '.htm')
""")(_docs_stem)


def _asset_path(page_id):
    m = page_id % 6
    return F.concat(F.lit("out/"), page_id.cast("string"), F.lit("/fig"),
                    F.when(m == 0, F.lit(".PNG")).when(m == 1, F.lit(".jpeg")).when(m == 2, F.lit(".md"))
                    .when(m == 3, F.lit(".Gif")).when(m == 4, F.lit(".jpg.txt")).otherwise(F.lit(".JPG")))


def _drop_assets(spark, sf):
    from papertrail.operators.corpus import drop_image_assets
    p = table(spark, sf, "pages").select("page_id", _asset_path(F.col("page_id")).alias("path"))
    return drop_image_assets(p, "path")


register("p_drop_assets", sql="""
WITH t AS (SELECT page_id, 'out/' || CAST(page_id AS VARCHAR) || '/fig' ||
  CASE page_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.md' WHEN 3 THEN '.Gif' WHEN 4 THEN '.jpg.txt' ELSE '.JPG' END AS path
  FROM pages)
SELECT page_id, path FROM t
WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) NOT IN ('.jpg', '.jpeg', '.png', '.gif')
""")(_drop_assets)
