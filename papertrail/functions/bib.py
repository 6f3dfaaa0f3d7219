"""BibTeX columns: parse entries from text, render entries, entry JSON,
and a rule-based citation parser for PubMed-style text records.

An entry is ``(entrytype STRING, id STRING, fields MAP<STRING,STRING>)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail.functions._col import col_of, let
from papertrail.functions.text import citekey, extract_doi, normalize_bib_doi, strip

# The preferred order of bib fields; other fields follow
# alphabetically.  ENTRYTYPE and ID are reserved keys.
FIELD_ORDER = ["title", "author", "journal", "year", "volume", "number", "pages", "doi", "abstract"]
RESERVED = ["ENTRYTYPE", "ID"]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sort_fields(fields) -> Column:
    """Keys of a field map: fixed order first, extras alphabetically."""
    def order(keys):
        fixed = F.filter(_lit_array(FIELD_ORDER), lambda k: F.array_contains(keys, k))
        extras = F.array_sort(F.array_except(keys, _lit_array(FIELD_ORDER + RESERVED)))
        return F.concat(fixed, extras)
    return let(F.map_keys(col_of(fields)), order)


def escape_bib(v) -> Column:
    x = F.replace(col_of(v), F.lit("{"), F.lit("{{"))
    x = F.replace(x, F.lit("}"), F.lit("}}"))
    return F.replace(x, F.lit("&"), F.lit("\\&"))


def render_bib(entrytype, entry_id, fields, escape: bool = True) -> Column:
    """Entry text, or null when the id is missing.

    ``@type{id,`` then ``  field = {value},`` lines (fixed order, then
    extras), the last comma removed, then ``}``.  Blank and null values
    are skipped.  ``escape=True`` (inference form) doubles braces and
    escapes ``&``; ``escape=False`` (library form) strips values instead.
    An entry without fields keeps the comma after the id.
    """
    def build(m, t, i):
        return _render(m, t, i, escape)
    t0 = F.coalesce(F.nullif(col_of(entrytype), F.lit("")), F.lit("article"))
    i0 = F.nullif(col_of(entry_id), F.lit(""))
    return let(col_of(fields), lambda m: let(t0, lambda t: let(i0, lambda i: build(m, t, i))))


def _render(m, t, i, escape):
    def body(keys):
        keep = F.filter(keys, lambda k: F.coalesce(F.length(strip(F.element_at(m, k))), F.lit(0)) > 0)
        val = (lambda k: escape_bib(F.element_at(m, k))) if escape else (lambda k: strip(F.element_at(m, k)))
        lines = F.transform(keep, lambda k: F.concat(F.lit("  "), k, F.lit(" = {"), val(k), F.lit("},")))
        joined = F.regexp_replace(F.array_join(lines, "\n"), ",\\z", "")
        return F.when(F.size(keep) > 0, F.concat(F.lit("\n"), joined)).otherwise(F.lit(""))

    text = F.concat(F.lit("@"), t, F.lit("{"), i, F.lit(","), let(sort_fields(m), body), F.lit("\n}"))
    return F.when(i.isNotNull(), text)


def py_json_string(c) -> Column:
    """JSON string literal as Python's json.dumps(ensure_ascii=False) writes it."""
    x = F.replace(col_of(c), F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def entry_to_json(entrytype, entry_id, fields) -> Column:
    """{"ENTRYTYPE": type or "article", "ID": id or "UNKNOWN", the nine
    standard fields that are non-blank, stripped, in order} (F11)."""
    def build(m):
        parts = [F.concat(F.lit('"ENTRYTYPE": '), py_json_string(F.coalesce(col_of(entrytype), F.lit("article")))),
                 F.concat(F.lit('"ID": '), py_json_string(F.coalesce(col_of(entry_id), F.lit("UNKNOWN"))))]
        for f in FIELD_ORDER:
            parts.append(let(strip(F.element_at(m, F.lit(f))), _json_member(f)))
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return let(col_of(fields), build)


def _json_member(name: str):
    return lambda v: F.when(F.length(v) > 0, F.concat(F.lit(f'"{name}": '), py_json_string(v)))


# ------------------------------------------------------------------ parsing

_ENTRY_SPLIT = r"(?m)(?=^\s*@)"
_NOT_ENTRIES = ["string", "preamble", "comment"]
# the cuts of an entry's body: an escaped character, a brace, a quote, a comma,
# an equals sign, or a run of anything else
_CUTS = r'(?s)\\.|[{}",=]|[^\\{}",=]+|\\'


def split_entries(c) -> Column:
    """ARRAY of entry texts cut at line-start ``@``; ``@string``, ``@preamble``
    and ``@comment`` blocks are not entries."""
    parts = F.split(F.replace(col_of(c), F.lit("\r\n"), F.lit("\n")), _ENTRY_SPLIT)
    kind = lambda p: F.lower(F.regexp_extract(p, r"^@\s*(\w+)", 1))
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p.startswith("@") & ~kind(p).isin(*_NOT_ENTRIES))


def _members(body) -> Column:
    """ARRAY<STRUCT<k, v>>: the ``name = value`` parts of a body, cut at commas
    outside braces and quotes; the text around the ``=`` is still raw."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("valued"), F.lit("").alias("k"),
                     F.lit("").alias("v"), F.array().cast("array<struct<k:string,v:string>>").alias("done"))

    def take(a, cut):
        top = (a["depth"] == 0) & ~a["quoted"]
        depth = a["depth"] + F.when(a["quoted"] & (a["depth"] == 0), 0).when(cut == "{", 1).when((cut == "}") & (a["depth"] > 0), -1).otherwise(0)
        quoted = F.when((cut == '"') & (a["depth"] == 0) & a["valued"], ~a["quoted"]).otherwise(a["quoted"])
        ends, sets = top & ((cut == ",") | (cut == "}")), top & (cut == "=") & ~a["valued"]
        member = F.struct(a["k"].alias("k"), a["v"].alias("v"))
        return F.struct(
            depth.alias("depth"), quoted.alias("quoted"),
            F.when(ends, F.lit(False)).when(sets, F.lit(True)).otherwise(a["valued"]).alias("valued"),
            F.when(ends, F.lit("")).when(sets | a["valued"], a["k"]).otherwise(F.concat(a["k"], cut)).alias("k"),
            F.when(ends | sets, F.lit("")).when(a["valued"], F.concat(a["v"], cut)).otherwise(a["v"]).alias("v"),
            F.when(ends & a["valued"], F.concat(a["done"], F.array(member))).otherwise(a["done"]).alias("done"))

    def last(a):
        member = F.struct(a["k"].alias("k"), a["v"].alias("v"))
        return F.when(a["valued"], F.concat(a["done"], F.array(member))).otherwise(a["done"])
    return F.aggregate(F.regexp_extract_all(body, F.lit(_CUTS), F.lit(0)), state, take, last)


def _value(v) -> Column:
    """A raw value without its outer braces or quotes, line breaks as spaces."""
    x = strip(F.regexp_replace(v, r"[ \t\r]*\n[ \t\r]*", " "))
    return let(x, lambda y: F.when((y.startswith("{") & y.endswith("}")) | (y.startswith('"') & y.endswith('"') & (F.length(y) > 1)),
                                   strip(F.substring(y, F.lit(2), F.length(y) - 2))).otherwise(y))


def parse_entry(c) -> Column:
    """struct(entrytype, id, fields) of one entry text.

    Values may stand in braces (nested to any depth), in quotes, or bare; any
    number of fields may share a line and a value may run over several.
    Field names may hold hyphens, dots and colons; they are lower-cased, and a
    repeated field keeps its last value.
    """
    def parse(e):
        body = F.regexp_replace(e, r"(?s)^@\s*\w+\s*\{[^,]*", "")
        members = F.filter(F.transform(_members(body), lambda x: F.struct(
            F.lower(strip(F.regexp_replace(x["k"], ",", ""))).alias("k"), _value(x["v"]).alias("v"))),
            lambda x: x["k"].rlike(r"^[\p{L}_][\p{L}\p{N}_.:+-]*$"))

        def as_map(pairs):
            last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))),
                                                         lambda y: y["k"] == x["k"]))
            return F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: x["v"]))
        return F.struct(F.regexp_extract(e, r"^@\s*(\w+)\s*\{", 1).alias("entrytype"),
                        F.regexp_extract(e, r"^@\s*\w+\s*\{\s*([^,\s]*)\s*,", 1).alias("id"),
                        let(members, as_map).alias("fields"))
    return let(col_of(c), parse)


def entry_key(entry, idx) -> Column:
    """The id of a parsed entry; where it has none, the citekey of its DOI
    field, or ``article_{idx+1}`` without one."""
    def key(e):
        doi = normalize_bib_doi(F.try_element_at(e["fields"], F.lit("doi")))
        return F.coalesce(F.nullif(e["id"], F.lit("")), citekey(doi, idx))
    return let(col_of(entry), key)


# ------------------------------------------------------------------ citation records

CITATION = r"^\d+\.\s*(.+?)\.\s*(\d{4})\b[^;]*;\s*(\d+)\s*(?:\(([^)]*)\))?\s*:\s*([^.\s]+)"


def _author_bib(name) -> Column:
    """``Steinrück HP`` → ``Steinrück, H. P.``; other forms unchanged."""
    def fmt(n):
        last = F.regexp_extract(n, r"^(.*\S)\s+(\p{Lu}+)$", 1)
        ini = F.regexp_extract(n, r"^(.*\S)\s+(\p{Lu}+)$", 2)
        initials = F.array_join(F.transform(F.split(ini, ""), lambda ch: F.concat(ch, F.lit("."))), " ")
        return F.when(F.length(ini) > 0, F.concat(last, F.lit(", "), initials)).otherwise(n)
    return let(strip(F.regexp_replace(name, r"\(\d+(,\s*\d+)*\)", "")), fmt)


def parse_citation(c) -> Column:
    """struct(entrytype, id, fields) from a PubMed-style text record.

    Paragraph 1: ``N. Journal. Year Mon D;vol(no):pages.``; paragraph 2:
    title; paragraph 3: authors; abstract: the longest later paragraph;
    doi by :func:`extract_doi`.  Wrapped lines are joined with one space.
    """
    def parse(rec):
        paras0 = F.filter(F.transform(F.split(rec, r"\n[ \t\r]*\n"),
                                      lambda p: strip(F.regexp_replace(p, r"[ \t\r]*\n[ \t\r]*", " "))),
                          lambda p: F.length(p) > 0)
        return let(paras0, lambda paras: let(F.coalesce(F.try_element_at(paras, F.lit(1)), F.lit("")),
                                             lambda cite: _citation_fields(rec, paras, cite)))
    return let(F.replace(col_of(c), F.lit("\r\n"), F.lit("\n")), parse)


def _citation_fields(rec, paras, cite):
    title = F.regexp_replace(F.coalesce(F.try_element_at(paras, F.lit(2)), F.lit("")), r"\.$", "")
    authors_p = F.regexp_replace(F.coalesce(F.try_element_at(paras, F.lit(3)), F.lit("")), r"\.$", "")
    authors = F.array_join(F.transform(F.split(authors_p, r",\s*"), _author_bib), " and ")
    rest = F.slice(paras, 4, F.greatest(F.size(paras) - 3, F.lit(1)))
    longest = F.aggregate(rest, F.lit(""), lambda acc, p: F.when(F.length(p) > F.length(acc), p).otherwise(acc))

    def g(i):
        return F.nullif(F.regexp_extract(cite, CITATION, i), F.lit(""))
    fields = F.map_filter(F.create_map(
        F.lit("title"), F.nullif(title, F.lit("")), F.lit("author"), F.nullif(authors, F.lit("")),
        F.lit("journal"), g(1), F.lit("year"), g(2), F.lit("volume"), g(3), F.lit("number"), g(4),
        F.lit("pages"), g(5), F.lit("doi"), extract_doi(rec), F.lit("abstract"), F.nullif(longest, F.lit(""))),
        lambda k, v: v.isNotNull())
    return F.struct(F.lit("article").alias("entrytype"), F.lit(None).cast("string").alias("id"), fields.alias("fields"))
