"""Registered BibTeX queries (render, entry JSON, field order, parse,
citation records, bib prediction)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import bib as B
from papertrail.functions.records import split_records
from papertrail.functions.text import DOI_PATTERN
from papertrail.plans import duck as D
from papertrail.plans import jobs
from papertrail.plans.registry import register
from papertrail.session import table


def _entries(spark, sf):
    """One bib entry per document: some without type (→ article), some
    without id (→ no entry), a blank field, braces and & in a value."""
    d = table(spark, sf, "documents")
    fields = F.create_map(
        F.lit("title"), F.substring_index("text", "\n", 1), F.lit("author"), F.col("source"),
        F.lit("year"), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("abstract"), F.col("text"),
        F.lit("url"), F.concat(F.lit("http://x.org/?a=1&b={"), F.col("doc_id").cast("string"), F.lit("}")),
        F.lit("note"), F.when(F.col("doc_id") % 2 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" n"), F.col("doc_id").cast("string"))))
    typ = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("article"))
    eid = F.when(F.col("doc_id") % 10 == 9, F.lit(None).cast("string")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return d.select("doc_id", typ.alias("entrytype"), eid.alias("id"), fields.alias("fields"))


_SQL_FIELDS = """e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'article' END AS entrytype,
  CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 'doc' || CAST(doc_id AS VARCHAR) END AS id,
  split_part(text, chr(10), 1) AS title, source AS author, CAST(doc_id % 30 + 1990 AS VARCHAR) AS year, text AS abstract,
  'http://x.org/?a=1&b={' || CAST(doc_id AS VARCHAR) || '}' AS url,
  CASE WHEN doc_id % 2 = 0 THEN '   ' ELSE ' n' || CAST(doc_id AS VARCHAR) END AS note FROM documents)"""


def _esc(x):
    return f"replace(replace(replace({x}, '{{', '{{{{'), '}}', '}}}}'), '&', '\\&')"


def _line(f):
    return f"CASE WHEN length({D.strip(f)}) > 0 THEN '  {f} = {{' || {_esc(f)} || '}},' END"


_LINES = ", ".join(_line(f) for f in ("title", "author", "year", "abstract", "note", "url"))


def _render(spark, sf):
    e = _entries(spark, sf)
    return e.select("doc_id", B.render_bib("entrytype", "id", "fields").alias("bib"))


register("f_render_bib", sql=f"""
WITH {_SQL_FIELDS},
l AS (SELECT doc_id, entrytype, id, list_filter([{_LINES}], lambda x: x IS NOT NULL) AS lines FROM e)
SELECT doc_id, CASE WHEN id IS NULL THEN NULL ELSE
  '@' || coalesce(entrytype, 'article') || '{{' || id || ',' ||
  CASE WHEN len(lines) > 0 THEN chr(10) || regexp_replace(array_to_string(lines, chr(10)), ',$', '') ELSE '' END || chr(10) || '}}' END AS bib
FROM l
""")(_render)


def _pyjson(x):
    y = f"replace({x}, '\\', '\\\\')"
    for a, b in (('"', '\\"'), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"), ("chr(12)", "'\\f'")):
        a_sql = a if a.startswith("chr") else D.q(a)
        b_sql = b if b.startswith("'") else D.q(b)
        y = f"replace({y}, {a_sql}, {b_sql})"
    return f"('\"' || {y} || '\"')"


def _entry_json(spark, sf):
    e = _entries(spark, sf)
    return e.select("doc_id", B.entry_to_json("entrytype", "id", "fields").alias("json"))


_JSON_PARTS = ", ".join(
    f"CASE WHEN length({D.strip(f)}) > 0 THEN '\"{f}\": ' || {_pyjson(D.strip(f))} END" for f in ("title", "author", "year", "abstract"))
register("f_entry_json", sql=f"""
WITH {_SQL_FIELDS}
SELECT doc_id, '{{' || concat_ws(', ', '"ENTRYTYPE": ' || {_pyjson("coalesce(entrytype, 'article')")},
                                 '"ID": ' || {_pyjson("coalesce(id, 'UNKNOWN')")}, {_JSON_PARTS}) || '}}' AS json
FROM e
""")(_entry_json)


def _sort_fields(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    keys = ["zeta", "title", "doi", "alpha", "pages", "ID", "abstract", "Keywords"]
    pairs = []
    for i, k in enumerate(keys):
        pairs.append(F.when((F.col("doc_id") / (2 ** i)).cast("long") % 2 == 1, F.struct(F.lit(k).alias("k"), F.lit("v").alias("v"))))
    arr = F.filter(F.array(*pairs), lambda x: x.isNotNull())
    m = F.map_from_entries(arr)
    return d.select("doc_id", F.array_join(B.sort_fields(m), ",").alias("keys"))


_SORTED = ["title", "pages", "doi", "abstract", "Keywords", "alpha", "zeta"]  # fixed order, then extras by code point
_BIT = {"zeta": 0, "title": 1, "doi": 2, "alpha": 3, "pages": 4, "ID": 5, "abstract": 6, "Keywords": 7}
register("l_sort_fields", sql="""
SELECT doc_id, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN CAST(floor(doc_id / {2 ** _BIT[k]}) AS BIGINT) % 2 = 1 THEN '{k}' END" for k in _SORTED) + """], lambda x: x IS NOT NULL), ',') AS keys
FROM documents
""")(_sort_fields)


def _parsed_value(f):
    return D.strip(f"regexp_replace({f}, '[ \\t\\r]*\\n[ \\t\\r]*', ' ', 'g')")


def sql_parsed(key):
    return f"WITH {_SQL_FIELDS}, k AS (SELECT *, {key} AS key FROM e) " + " UNION ALL ".join(
        f"SELECT coalesce(entrytype, 'article') AS entrytype, key AS id, '{f}' AS field, {_parsed_value(f)} AS value "
        f"FROM k WHERE length({D.strip(f)}) > 0" for f in ("title", "author", "year", "abstract", "note", "url"))


def library_text(e):
    """Library form of every entry; those without an id start with ``@type{,``."""
    bib = B.render_bib("entrytype", F.coalesce("id", F.lit("-")), "fields", escape=False)
    return F.when(F.col("id").isNull(), F.regexp_replace(bib, r"^(@\w+\{)-,", "$1,")).otherwise(bib)


def _bib_parse(spark, sf):
    """Round trip: render one library-form entry per document, join those of
    five ids into one bib text, parse the text back; entries without an id
    get a citekey."""
    e = _entries(spark, sf)
    rendered = e.select("doc_id", library_text(e).alias("bib"))
    files = rendered.groupBy(F.floor(F.col("doc_id") / 5).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("doc_id", "bib"))), lambda x: x["bib"]), "\n\n").alias("bib"))
    parsed = files.select(F.posexplode(B.split_entries("bib")).alias("pos", "t")).select("pos", B.parse_entry("t").alias("p"))
    return parsed.select("p.entrytype", B.entry_key("p", "pos").alias("id"), F.explode("p.fields").alias("field", "value"))


register("s_bib_parse", sql=sql_parsed(
    "coalesce(id, 'article_' || CAST(row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS VARCHAR))"))(_bib_parse)


def citation_records(spark, sf):
    """PubMed-style records built from `documents`: citation line, title,
    authors with affiliations, author information, abstract (the document
    text), identifiers; several records per source blob."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    rec = F.concat(
        F.lit("1. "), F.initcap("lang"), F.lit(" Journal. "), (F.col("doc_id") % 30 + 1990).cast("string"),
        F.lit(" May 16;"), (F.col("doc_id") % 50 + 1).cast("string"), F.lit("("), (F.col("doc_id") % 12 + 1).cast("string"),
        F.lit("):e"), i, F.lit(". doi: 10.1002/"), F.col("source"), F.lit("."), i, F.lit(". Epub 2022\r\nApr 5.\r\n\r\n"),
        F.substring_index("text", " ", 6), F.lit(".\r\n\r\n"),
        F.lit("Doe J(1), Roe AB(2), Poe "), F.upper(F.substring("source", 1, 2)), F.lit("(1).\r\n\r\n"),
        F.lit("Author information:\r\n(1)Dept. of Chemistry.\r\n\r\n"), F.col("text"), F.lit("\r\n\r\n"),
        F.lit("DOI: 10.1002/"), F.col("source"), F.lit("."), i, F.lit("\r\nPMID: "), i)
    return d.select("doc_id", rec.alias("record"))


def _parse_citation(spark, sf):
    r = citation_records(spark, sf)
    p = r.select("doc_id", B.parse_citation("record").alias("p"))
    return p.select("doc_id", F.explode("p.fields").alias("field", "value"))


#: the same records in SQL, with LF line ends
_SQL_RECORDS = """recs AS (SELECT doc_id, replace('1. ' || upper(lang[1]) || lower(lang[2:]) || ' Journal. ' || CAST(doc_id % 30 + 1990 AS VARCHAR) ||
  ' May 16;' || CAST(doc_id % 50 + 1 AS VARCHAR) || '(' || CAST(doc_id % 12 + 1 AS VARCHAR) || '):e' || CAST(doc_id AS VARCHAR) ||
  '. doi: 10.1002/' || source || '.' || CAST(doc_id AS VARCHAR) || '. Epub 2022' || chr(10) || 'Apr 5.' || chr(10) || chr(10) ||
  array_to_string(string_split(text, ' ')[1:6], ' ') || '.' || chr(10) || chr(10) || 'Doe J(1), Roe AB(2), Poe ' || upper(source[1:2]) || '(1).' ||
  chr(10) || chr(10) || 'Author information:' || chr(10) || '(1)Dept. of Chemistry.' || chr(10) || chr(10) || text || chr(10) || chr(10) ||
  'DOI: 10.1002/' || source || '.' || CAST(doc_id AS VARCHAR) || chr(10) || 'PMID: ' || CAST(doc_id AS VARCHAR), chr(13) || chr(10), chr(10)) AS rec
  FROM documents)"""


def _sql_citation(src, key):
    """CTEs ending in ``cited``: ``key`` and a column per field of the records
    ``rec`` of ``src``; absent fields are null."""
    para = D.strip(r"regexp_replace(p, '[ \t\r]*\n[ \t\r]*', ' ', 'g')")
    name = D.strip(r"regexp_replace(x, '\(\d+(,\s*\d+)*\)', '', 'g')")
    last, initials = (f"regexp_extract({name}, '^(.*\\S)\\s+(\\p{{Lu}}+)$', {i})" for i in (1, 2))
    author = (f"CASE WHEN {initials} <> '' THEN {last} || ', ' || array_to_string(list_transform(string_split({initials}, ''), "
              f"lambda c: c || '.'), ' ') ELSE {name} END")
    cite = lambda i: f"nullif(regexp_extract(cite, {D.q(B.CITATION)}, {i}), '')"
    doi = f"nullif(regexp_extract(rec, {D.q(DOI_PATTERN)}, 1), '')"
    return f"""paras AS (SELECT {key}, rec, list_filter(list_transform(regexp_split_to_array(rec, '\\n[ \\t\\r]*\\n'), lambda p: {para}),
                  lambda p: length(p) > 0) AS paras FROM {src}),
parts AS (SELECT *, coalesce(paras[1], '') AS cite, paras[4:] AS rest,
          regexp_split_to_array(regexp_replace(coalesce(paras[3], ''), '\\.$', ''), ',\\s*') AS names FROM paras),
cited AS (SELECT {key}, rec, nullif(regexp_replace(coalesce(paras[2], ''), '\\.$', ''), '') AS title,
   nullif(array_to_string(list_transform(names, lambda x: {author}), ' and '), '') AS author,
   {cite(1)} AS journal, {cite(2)} AS year, {cite(3)} AS volume, {cite(4)} AS number, {cite(5)} AS pages,
   lower(regexp_replace({doi}, '[.,;]+$', '')) AS doi,
   list_filter(rest, lambda p: length(p) = list_max(list_transform(rest, lambda r: length(r))))[1] AS abstract FROM parts)"""


register("f_parse_citation", sql=f"WITH {_SQL_RECORDS}, {_sql_citation('recs', 'doc_id')} " + " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {f} AS value FROM cited WHERE {f} IS NOT NULL" for f in B.FIELD_ORDER))(_parse_citation)


def _predict_bib(spark, sf):
    """Records (split from per-source blobs) → rule-based JSON output
    (the pluggable model's default) → repaired/parsed → citekey → bib;
    unparsable outputs go to the dead letter."""
    recs = citation_records(spark, sf)
    blob = recs.select("doc_id", F.concat("record", F.lit("\r\n\r\n\r\n\r\n")).alias("blob"))
    split = blob.select("doc_id", F.posexplode(split_records("blob")).alias("pos", "text"))
    p = jobs.predicted(split.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("record_id"), "text"))
    return p.select("record_id", F.when(F.col("ok"), "ok").otherwise("PREDICT").alias("status"), F.when(F.col("ok"), F.col("bib")).alias("bib"))


_KEY = """CASE WHEN doi IS NULL THEN 'article_' || record_id ELSE
  replace(split_part(doi, '/', 1), '.', '_') || '_' || split_part(split_part(doi, '/', 2), '.', 1) END"""
register("m_predict_bib", sql=f"""
WITH {_SQL_RECORDS},
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(rec, '\\n{{3,}}'), lambda p: {D.strip('p')}), lambda p: length(p) > 0) AS r FROM recs),
one AS (SELECT doc_id, unnest(r) AS rec, generate_subscripts(r, 1) - 1 AS pos FROM cut),
named AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS record_id, rec FROM one),
{_sql_citation('named', 'record_id')},
l AS (SELECT record_id, doi, list_filter([{', '.join(_line(f) for f in B.FIELD_ORDER)}], lambda x: x IS NOT NULL) AS lines FROM cited)
SELECT record_id, 'ok' AS status, '@article{{' || {_KEY} || ',' || CASE WHEN len(lines) > 0
  THEN chr(10) || regexp_replace(array_to_string(lines, chr(10)), ',$', '') ELSE '' END || chr(10) || '}}' AS bib FROM l
""")(_predict_bib)
