"""Column functions on text (all JVM-side expressions, no UDFs).

Java regexes run with ``(?U)`` where the corpus rules rely on Unicode
``\\s``/``\\d``/``\\w`` and with ``(?md)`` where ``^``/``$`` must see
only ``\\n`` as a line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail.functions._col import col_of, let, lit_str

# ---------------------------------------------------------------- F0 strip

# The characters Python's str.strip() removes (str.isspace).
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
PY_WS_NO_NL = r"[\t\x0B\f\r\x1C-\x1F\x85\p{Z}]"
_WS = "^" + PY_WS + "+|" + PY_WS + "+\\z"


def strip(c) -> Column:
    """Remove leading/trailing Unicode whitespace, newlines included."""
    return F.regexp_replace(col_of(c), _WS, "")


def rstrip_chars(c, chars: str) -> Column:
    return F.regexp_replace(col_of(c), "[" + _class_escape(chars) + "]+$", "")


def _class_escape(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)


# ---------------------------------------------------------------- tokens

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokenize(c) -> Column:
    """Lower-cased word tokens: runs of letters/digits, empties dropped."""
    return F.filter(F.split(F.lower(col_of(c)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def whitespace_tokens(c) -> Column:
    return F.filter(F.split(col_of(c), r"(?U)\s+"), lambda t: F.length(t) > 0)


# ---------------------------------------------------------------- F1 DOI

DOI_PATTERN = r"(?i)doi[:\s]*\r?\n*\s*(10\.\d{4,9}/\S+)"


def extract_doi(c) -> Column:
    """First DOI after a ``doi`` marker, trailing ``.,;`` removed, lower case."""
    raw = F.regexp_extract(col_of(c), DOI_PATTERN, 1)
    return F.lower(F.regexp_replace(F.nullif(raw, F.lit("")), r"[.,;]+$", ""))


def normalize_bib_doi(c) -> Column:
    """DOI field of a bib entry: stripped and lower-cased, empty → null."""
    d = F.lower(strip(col_of(c)))
    return F.nullif(d, F.lit(""))


# ---------------------------------------------------------------- F2 citekey


def citekey(doi, idx) -> Column:
    """``10.1002/chem.2022`` → ``10_1002_chem``; no DOI → ``article_{idx+1}``.

    Not unique by design (keys collide inside a journal); combine with
    :func:`papertrail.operators.corpus.resolve_name_conflicts` for a
    unique suffix.
    """
    fallback = F.concat(F.lit("article_"), (col_of(idx) + 1).cast("string"))

    def key(d):
        parts = F.split(d, "/")
        prefix = F.replace(F.element_at(parts, 1), F.lit("."), F.lit("_"))
        second = F.coalesce(F.substring_index(F.try_element_at(parts, F.lit(2)), ".", 1), F.lit(""))
        return F.when(d.isNull() | (d == ""), fallback).otherwise(F.concat(prefix, F.lit("_"), second))
    return let(col_of(doi), key)


# ---------------------------------------------------------------- F17 markdown

# The ordered cleaning rules for scientific Markdown
# (pattern, replacement).  Java syntax: $1 for groups, (?md) so that only
# "\n" ends a line, (?U) so that \s and \d are Unicode as in the rules'
# original regex dialect.
MARKDOWN_RULES = [
    (r"<[^>]+>", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?mdU)^#{1,6}\s*", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"_{1,3}([^_]+)_{1,3}", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"```[a-zA-Z]*\n?", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?mdU)^>\s*", ""),
    (r"(?mdU)^[\s]*[-*+]\s+", ""),
    (r"(?mdU)^\s*\d+\.\s+", ""),
    (r"\|", " "),
    (r"(?mdU)^[-:\s]+$", ""),
    (r"(?md)^[-*_]{3,}$", ""),
    (r"\n{3,}", "\n\n"),
]

# math_safe mode keeps "a < b ... c > d" and LaTeX subscripts: tags must
# look like tags and underscores must sit on word boundaries.
_MATH_SAFE = {
    0: (r"</?[A-Za-z][A-Za-z0-9:-]*(\s[^<>]*)?/?>", ""),
    5: (r"(?U)(?<!\w)_{1,3}([^_\s][^_]*?)_{1,3}(?!\w)", "$1"),
}


def clean_markdown(c, mode: str = "reference") -> Column:
    """Markdown/HTML to plain text: the 16 ordered rules, then every line
    stripped, then the whole text stripped."""
    x = col_of(c)
    for i, (pat, rep) in enumerate(MARKDOWN_RULES):
        if mode == "math_safe" and i in _MATH_SAFE:
            pat, rep = _MATH_SAFE[i]
        x = F.regexp_replace(x, pat, rep)
    # strip every line: whitespace other than "\n" around line ends
    x = F.regexp_replace(x, "(?md)^" + PY_WS_NO_NL + "+|" + PY_WS_NO_NL + "+$", "")
    return strip(x)


# ---------------------------------------------------------------- F18 custom id


def custom_id(name, idx, start: int = 0, max_len: int = 64) -> Column:
    """``req_%06d`` + ``_`` + name with characters outside ``[a-zA-Z0-9_-]``
    replaced by ``_``, cut so the whole id has at most ``max_len`` chars."""
    prefix = F.format_string("req_%06d", (col_of(idx) + F.lit(start)).cast("long"))
    room = F.lit(max_len) - F.length(prefix) - F.lit(1)
    # a character becomes one character, so only those that stay are looked at
    head = F.substring(col_of(name), F.lit(1), room)
    return F.when((room > 0) & (F.length(head) > 0),
                  F.concat(prefix, F.lit("_"), F.regexp_replace(head, r"[^a-zA-Z0-9_-]", "_"))).otherwise(prefix)


# ---------------------------------------------------------------- F19 routing

# Fallback keywords that route a question to the synthesis store.
SYNTHESIS_KEYWORDS = [
    "synthesis",
    "retrosynthesis",
    "reaction",
    "catalyst",
    "reaction conditions",
    "synthetic route",
]


def route_query(question, keywords=SYNTHESIS_KEYWORDS, model_answer=None) -> Column:
    """``synthesis`` or ``general``.  A model answer (if given and not null)
    decides by containing "synthesis"; otherwise lower-cased keyword test."""
    by_kw = let(F.lower(col_of(question)), lambda q: F.when(
        reduce(lambda a, b: a | b, [q.contains(F.lit(k)) for k in keywords]), F.lit("synthesis")).otherwise(F.lit("general")))
    if model_answer is None:
        return by_kw
    m = F.lower(strip(col_of(model_answer)))
    return F.when(m.isNull(), by_kw).when(m.contains("synthesis"), F.lit("synthesis")).otherwise(F.lit("general"))


# ---------------------------------------------------------------- F20 answer part

ANSWER_MARKER = "### Answer:"


def answer_part(c, marker: str = ANSWER_MARKER, eos: str | None = None) -> Column:
    """Text after the first marker, stripped; unchanged when absent.

    With ``eos`` (training form): the piece between the first and second
    marker, with the end-of-sequence string removed, stripped.
    """
    def part(x):
        pos = F.instr(x, marker)
        after = F.substring(x, pos + F.lit(len(marker)), F.lit(2 ** 31 - 1))
        if eos is None:
            return F.when(pos > 0, strip(after)).otherwise(x)
        cut = F.substring_index(after, marker, 1)
        return F.when(pos > 0, strip(F.replace(cut, F.lit(eos), F.lit("")))).otherwise(x)
    return let(col_of(c), part)


# ---------------------------------------------------------------- F23 paths


def path_parts(c) -> Column:
    """struct(dir, basename, stem, ext) of a path or URL path.

    ``ext`` keeps its dot (``.md``); a leading-dot name has no extension.
    Query strings and fragments of URLs are dropped first.
    """
    p = F.regexp_replace(col_of(c), r"[?#].*$", "")
    p = F.regexp_replace(p, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    base = F.substring_index(p, "/", -1)
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    ext = F.regexp_extract(base, r"^.+?(\.[^.]*)$", 1)
    stem = F.when(ext == "", base).otherwise(F.substring(base, F.lit(1), F.length(base) - F.length(ext)))
    return F.struct(d.alias("dir"), base.alias("basename"), stem.alias("stem"), ext.alias("ext"))


def truncate(c, n: int) -> Column:
    return F.substring(col_of(c), 1, n)


def lit_or_col(v) -> Column:
    return lit_str(v)
