"""ROUGE-L and ROUGE on stems (A14) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import stem as S
from papertrail.operators import metrics as M
from papertrail.plans.q_metrics import _TOK, _r6, _rouge_pairs
from papertrail.plans.registry import register

# ------------------------------------------------------------------ SQL builders

_PAIRS = """pairs AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS pair, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def _m(cv: str) -> str:
    return f"((length({cv}) - length(replace({cv}, 'vc', ''))) / 2)"


def _cut(n: int, c: str = "w") -> str:
    return f"substr({c}, 1, length({c}) - {n})"


def _cvc(w: str, cv: str) -> str:
    return f"(({cv} LIKE '%cvc' AND NOT regexp_matches({w}, '[wxy]$')) OR {cv} = 'vc')"


def _rules(rules, holds) -> str:
    cases = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {holds(s, _cut(len(s), 'cv'))} THEN {_cut(len(s))} || '{put}' ELSE w END" for s, put in rules]
    return f"CASE {' '.join(cases)} ELSE w END"


def sql_stems(words: str) -> str:
    """CTEs ending in ``stemmed(word, stem)`` of ``words(word)``: Porter's steps
    as CASE expressions, one CTE a step."""
    classes = ("list_reduce(list_concat([''], string_split(w, '')), lambda acc, x: acc || CASE WHEN x IN ('a','e','i','o','u') "
               "OR (x = 'y' AND acc LIKE '%c') THEN 'v' ELSE 'c' END)")
    positive = lambda s, cv: f"{_m(cv)} > 0"
    long = lambda s, cv: f"{_m(cv)} > 1" + (f" AND regexp_matches({_cut(3)}, '[st]$')" if s == "ion" else "")
    r, rcv = "CASE WHEN w LIKE '%ed' THEN {0} ELSE {1} END".format(_cut(2), _cut(3)), "CASE WHEN w LIKE '%ed' THEN {0} ELSE {1} END".format(_cut(2, "cv"), _cut(3, "cv"))
    again = f"""CASE WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e'
      WHEN length(r) > 1 AND substr(r, -1) = substr(r, -2, 1) AND rcv LIKE '%c' THEN CASE WHEN regexp_matches(r, '[lsz]$') THEN r ELSE substr(r, 1, length(r) - 1) END
      WHEN {_m('rcv')} = 1 AND {_cvc('r', 'rcv')} THEN r || 'e' ELSE r END"""
    one, e = _m(_cut(1, "cv")), _cvc(_cut(1), _cut(1, "cv"))
    steps = [
        f"CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN {_cut(1)} ELSE {_rules(S.STEP_1A, lambda s, cv: 'true')} END",
        f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END
      WHEN w LIKE '%eed' THEN CASE WHEN {_m(_cut(3, 'cv'))} > 0 THEN {_cut(1)} ELSE w END
      WHEN (w LIKE '%ed' AND contains({_cut(2, 'cv')}, 'v')) OR (w LIKE '%ing' AND contains({_cut(3, 'cv')}, 'v')) THEN {again} ELSE w END""",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND cv LIKE '%c_' THEN {_cut(1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {_m(_cut(4, 'cv'))} > 0 THEN {_cut(2)} ELSE w END",
        f"CASE WHEN w LIKE '%logi' AND {_m(_cut(3, 'cv'))} > 0 THEN {_cut(1)} ELSE {_rules(S.STEP_2, positive)} END",
        _rules(S.STEP_3, positive),
        _rules([(s, "") for s in S.STEP_4], long),
        f"CASE WHEN w LIKE '%e' AND ({one} > 1 OR ({one} = 1 AND NOT {e})) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {one} > 1 THEN {_cut(1)} ELSE w END",
    ]
    out = [f"k0 AS (SELECT word, word AS w FROM {words})"]
    for k, step in enumerate(steps, 1):
        out.append(f"k{k} AS (SELECT word, {step} AS w FROM (SELECT *, {r} AS r, {rcv} AS rcv FROM (SELECT *, {classes} AS cv FROM k{k - 1})))")
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.IRREGULAR.items())
    out.append(f"stemmed AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE CASE word {irregular} ELSE w END END AS stem FROM k{len(steps)})")
    return ",\n".join(out)


def sql_lcs(src: str, out: str) -> str:
    """``out(pair, np, nr, lcs)`` of ``src(pair, tp, tr)`` by the usual table, a row a step."""
    return f"""{out}_walk AS (
  SELECT pair, 0 AS i, list_transform(tr, lambda x: 0) AS prev FROM {src}
  UNION ALL
  SELECT pair, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j]))
  FROM (SELECT w.pair, w.i, list_transform(range(1, len(s.tr) + 1), lambda j: greatest(w.prev[j],
          CASE WHEN s.tr[j] = s.tp[w.i + 1] THEN coalesce(w.prev[j - 1], 0) + 1 ELSE 0 END)) AS cand
        FROM {out}_walk w JOIN {src} s USING (pair) WHERE w.i < len(s.tp))),
{out} AS (SELECT s.pair, len(s.tp) AS np, len(s.tr) AS nr, coalesce(list_max(w.prev), 0) AS lcs
          FROM {src} s JOIN {out}_walk w ON w.pair = s.pair AND w.i = len(s.tp))"""


def _scores(src: str, hit: str) -> str:
    f = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"
    return f"""SELECT pair, {{metric}} AS metric, round(p, 6) AS precision, round(r, 6) AS recall, round({f}, 6) AS fmeasure
FROM (SELECT pair, CASE WHEN np > 0 THEN {hit} / np ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN {hit} / nr ELSE 0.0 END AS r FROM {src})"""


# ------------------------------------------------------------------ A14


def _rouge_l(spark, sf):
    r = M.rouge_l(_rouge_pairs(spark, sf), "pair", "answer", "question")
    return r.select("pair", _r6("precision").alias("precision"), _r6("recall").alias("recall"), _r6("fmeasure").alias("fmeasure"))


register("a_rouge_l", sql=f"""
WITH RECURSIVE {_PAIRS},
toks AS (SELECT pair, {_TOK.format(x='answer')} AS tp, {_TOK.format(x='question')} AS tr FROM pairs),
{sql_lcs('toks', 'lcs')}
SELECT pair, precision, recall, fmeasure FROM ({_scores('lcs', 'lcs').format(metric="'l'")})
""")(_rouge_l)


def _rouge_stem(spark, sf):
    pairs = _rouge_pairs(spark, sf).select("pair", M.rouge_tokens("answer").alias("tp"), M.rouge_tokens("question").alias("tr"))
    stems = M.stemmed_tokens(pairs, "pair", ["tp", "tr"]).checkpoint()
    found = {"1": M.rouge_n_tokens(stems, "pair", "tp", "tr", 1), "2": M.rouge_n_tokens(stems, "pair", "tp", "tr", 2),
             "l": M.rouge_l_tokens(stems, "pair", "tp", "tr")}
    out = None
    for metric, r in found.items():
        r = r.select("pair", F.lit(metric).alias("metric"), *[_r6(c).alias(c) for c in ("precision", "recall", "fmeasure")])
        out = r if out is None else out.unionByName(r)
    return out


def _sql_grams(n: int) -> str:
    def grams(x):
        return x if n == 1 else f"CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE [] END"
    return f"""g{n} AS (SELECT pair, {grams('tp')} AS gp, {grams('tr')} AS gr FROM toks),
h{n} AS (SELECT pair, len(gp) AS np, len(gr) AS nr, coalesce(CAST(list_sum(list_transform(list_distinct(gp), lambda g:
  least(len(list_filter(gp, lambda x: x = g)), len(list_filter(gr, lambda x: x = g))))) AS BIGINT), 0) AS hit FROM g{n})"""


register("a_rouge_stem", sql=f"""
WITH RECURSIVE {_PAIRS},
plain AS (SELECT pair, {_TOK.format(x='answer')} AS tp, {_TOK.format(x='question')} AS tr FROM pairs),
words AS (SELECT DISTINCT word FROM (SELECT unnest(tp) AS word FROM plain UNION ALL SELECT unnest(tr) FROM plain) WHERE length(word) > 3),
{sql_stems('words')},
flat AS (SELECT pair, 'p' AS side, unnest(tp) AS word, unnest(range(len(tp))) AS i FROM plain
         UNION ALL SELECT pair, 'r', unnest(tr), unnest(range(len(tr))) FROM plain),
back AS (SELECT pair, side, list(coalesce(stem, word) ORDER BY i) AS t FROM flat LEFT JOIN stemmed USING (word) GROUP BY pair, side),
toks AS (SELECT pair, coalesce(p.t, []) AS tp, coalesce(r.t, []) AS tr FROM pairs LEFT JOIN (SELECT * FROM back WHERE side = 'p') p USING (pair)
         LEFT JOIN (SELECT * FROM back WHERE side = 'r') r USING (pair)),
{_sql_grams(1)},
{_sql_grams(2)},
{sql_lcs('toks', 'lcs')}
{_scores('h1', 'hit').format(metric="'1'")} UNION ALL
{_scores('h2', 'hit').format(metric="'2'")} UNION ALL
{_scores('lcs', 'lcs').format(metric="'l'")}
""")(_rouge_stem)
