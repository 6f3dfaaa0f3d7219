"""SQL fragments for the DuckDB oracle side (RE2 regex dialect)."""

from __future__ import annotations

# RE2 spelling of papertrail.functions.text.PY_WS
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
WS_NO_NL = r"[\t\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


# the markdown rules in RE2 syntax (same order as MARKDOWN_RULES)
MD_RULES = [
    (r"<[^>]+>", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", r"\1"),
    (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
    (r"(?m)^#{1,6}\s*", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", r"\1"),
    (r"_{1,3}([^_]+)_{1,3}", r"\1"),
    (r"~~([^~]+)~~", r"\1"),
    (r"```[a-zA-Z]*\n?", ""),
    (r"`([^`]+)`", r"\1"),
    (r"(?m)^>\s*", ""),
    (r"(?m)^[\s]*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"\|", " "),
    (r"(?m)^[-:\s]+$", ""),
    (r"(?m)^[-*_]{3,}$", ""),
    (r"\n{3,}", "\n\n"),
]


def clean_markdown(x: str) -> str:
    for pat, rep in MD_RULES:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    x = f"regexp_replace({x}, {q('(?m)^' + WS_NO_NL + '+|' + WS_NO_NL + '+$')}, '', 'g')"
    return strip(x)


def nl(s: str) -> str:
    """SQL expression for a string with real newlines (DuckDB literals keep them)."""
    return q(s)


def render(template: str, **cols) -> str:
    """SQL concat expression filling ``{slot}`` with column expressions."""
    import string

    parts = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        if lit:
            parts.append(q(lit))
        if field is not None:
            parts.append(f"coalesce(CAST({cols[field]} AS VARCHAR), '')")
    return "(" + " || ".join(parts) + ")"


HASH32 = "CAST(('0x' || substr(md5({seed} || CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT)"


def hash32(x: str, seed: int = 42) -> str:
    return HASH32.format(seed=q(str(seed)), x=x)
