"""Column functions for half-broken JSON from model responses.

Parsing uses Spark's VARIANT (``try_parse_json``): invalid input gives
null instead of failing the task, and nested values are read with
``variant_get`` without a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail.functions._col import col_of, let
from papertrail.functions.text import strip

FENCE_JSON = "```json"
FENCE = "```"


def strip_code_fence(c) -> Column:
    """Stripped text without a surrounding ```json … ``` or ``` … ``` fence
    (only when it both starts and ends with a fence)."""
    def unfence(s):
        n = F.length(s)
        inner_json = strip(F.substring(s, F.lit(8), F.greatest(n - F.lit(10), F.lit(0))))
        inner = strip(F.substring(s, F.lit(4), F.greatest(n - F.lit(6), F.lit(0))))
        return (F.when(s.startswith(FENCE_JSON) & s.endswith(FENCE), inner_json)
                .when(s.startswith(FENCE) & s.endswith(FENCE), inner)
                .otherwise(s))
    return let(strip(col_of(c)), unfence)


def brace_repair(c) -> Column:
    """Stripped text with a leading ``{`` / trailing ``}`` added if missing."""
    def repair(s):
        s = F.when(s.startswith("{"), s).otherwise(F.concat(F.lit("{"), s))
        return F.when(s.endswith("}"), s).otherwise(F.concat(s, F.lit("}")))
    return let(strip(col_of(c)), repair)


def quote_repair(c) -> Column:
    """Drop a run of quotes at the end, ensure a final ``}``, unescape ``\\"``."""
    def fix(s):
        s = F.when(strip(s).endswith("}"), s).otherwise(F.concat(s, F.lit("}")))
        return F.replace(s, F.lit('\\"'), F.lit('"'))
    return let(F.regexp_replace(strip(col_of(c)), r"\"+\s*$", ""), fix)


# The bib fields salvaged from broken JSON, in order, and the
# pattern of the last one, the abstract.
SALVAGE_FIELDS = ["ENTRYTYPE", "ID", "title", "author", "journal", "year", "volume", "number", "pages", "doi"]
ABSTRACT_PATTERN = r'(?s)"abstract":\s*"(.*?)(?="[^"]*$|$)'


def salvage_fields(c, with_abstract: bool = True) -> Column:
    """MAP<STRING,STRING> of the ``"field": "value"`` pairs found by regex;
    absent fields are left out."""
    return let(col_of(c), lambda x: _salvage(x, with_abstract))


def _salvage(x, with_abstract):
    # a field counts only when its full pattern (closing quote included) matches
    entries = [F.struct(F.lit(f).alias("key"),
                        F.when(x.rlike(f'(?s)"{f}":\\s*"[^"]*"'), F.regexp_extract(x, f'(?s)"{f}":\\s*"([^"]*)"', 1))
                        .alias("value"))
               for f in SALVAGE_FIELDS]
    if with_abstract:
        entries.append(F.struct(F.lit("abstract").alias("key"),
                                F.when(x.rlike(r'(?s)"abstract":\s*"'), F.regexp_extract(x, ABSTRACT_PATTERN, 1))
                                .alias("value")))
    arr = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return F.map_from_entries(arr)


def lenient_repair(c) -> Column:
    """The repaired text tried when a direct parse fails: unfence, then
    add missing braces; null when nothing is left."""
    u = strip_code_fence(c)
    return F.when(F.length(u) > 0, brace_repair(u))


_SCALAR = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"


def strict_parse_json(c) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    Spark's parser stops after the first complete value and ignores what
    follows; a text is accepted only if its last character closes that
    value: for objects, arrays and strings, the text without its last
    character must no longer parse; scalars must match the JSON grammar.
    """
    def check(s, v):
        kind = F.schema_of_variant(v)
        shorter = F.try_parse_json(F.substring(s, F.lit(1), F.length(s) - 1))
        closed = kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "STRING")
        ok = F.when(closed, shorter.isNull()).otherwise(s.rlike(_SCALAR))
        return F.when(v.isNotNull() & ok, v)
    return let(strip(col_of(c)), lambda s: let(F.try_parse_json(s), lambda v: check(s, v)))


def parse_json_lenient(c) -> Column:
    """VARIANT of the text (any JSON type), else of its repaired form,
    else null (F7).  Both attempts are strict (one value, nothing after)."""
    return let(col_of(c), lambda x: F.coalesce(strict_parse_json(x), strict_parse_json(lenient_repair(x))))


def variant_kind(v) -> Column:
    """object / array / string / number / boolean / null of a VARIANT."""
    s = F.schema_of_variant(col_of(v))
    return (F.when(col_of(v).isNull(), F.lit(None))
            .when(s.startswith("OBJECT"), F.lit("object")).when(s.startswith("ARRAY"), F.lit("array"))
            .when(s == "STRING", F.lit("string")).when(s == "BOOLEAN", F.lit("boolean"))
            .when(s == "VOID", F.lit("null")).otherwise(F.lit("number")))


def _falsy_text(v: Column, path: str) -> Column:
    """Text of a field with Python truthiness: null, missing, 0, false,
    '' and empty containers → ''; True → 'True'; other values as text."""
    f = F.try_variant_get(v, path, "variant")
    s = F.schema_of_variant(f)
    as_str = F.try_variant_get(v, path, "string")
    num = F.try_variant_get(v, path, "double")
    return (F.when(f.isNull() | (s == "VOID"), F.lit(""))
            .when(s == "BOOLEAN", F.when(F.try_variant_get(v, path, "boolean"), F.lit("True")).otherwise(F.lit("")))
            .when(s == "STRING", F.coalesce(as_str, F.lit("")))
            .when(s.startswith("OBJECT") | s.startswith("ARRAY"),
                  F.when(F.to_json(f).isin("{}", "[]"), F.lit("")).otherwise(F.to_json(f)))
            .when(num == 0, F.lit(""))
            .otherwise(F.coalesce(as_str, F.lit(""))))


def normalize_qa(v) -> Column:
    """struct(question, reasoning, answer), never null."""
    x = col_of(v)
    return F.struct(_falsy_text(x, "$.question").alias("question"),
                    _falsy_text(x, "$.reasoning").alias("reasoning"),
                    _falsy_text(x, "$.answer").alias("answer"))


def jsonl_objects(c) -> Column:
    """JSONL fast path: ARRAY<VARIANT> of the lines that parse to objects."""
    lines = F.split(strip_code_fence(c), "\n")
    parsed = F.transform(lines, lambda ln: F.try_parse_json(ln))
    return F.filter(parsed, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))
