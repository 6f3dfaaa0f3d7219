"""Porter's stemmer (with the usual extensions for short and irregular words)
as column functions over a table of distinct words.

Letters are classed once per step by a fold over the word (``v`` or ``c``: a ``y``
after a consonant is a vowel); the measure of a stem is the number of ``vc`` in
that string, and a stem's classes are the word's first ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the published suffix tables and irregular words
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
          "ive", "ize"]
# ----

W, CV = "_w", "_cv"  # the word so far and its letters' classes


def _classes(word: Column) -> Column:
    vowel = lambda acc, x: x.isin(*"aeiou") | ((x == "y") & acc.endswith("c"))
    return F.aggregate(F.split(word, ""), F.lit(""), lambda acc, x: F.concat(acc, F.when(vowel(acc, x), F.lit("v")).otherwise(F.lit("c"))))


def _cut(n: int, c: str = W) -> Column:
    """The word (or its classes) without the last ``n`` letters."""
    return F.substring(F.col(c), F.lit(1), F.length(c) - F.lit(n))


def _measure(classes: Column) -> Column:
    return (F.length(classes) - F.length(F.replace(classes, F.lit("vc"), F.lit("")))) / 2


def _cvc(word: Column, classes: Column) -> Column:
    """Ends consonant, vowel, consonant other than w, x, y (or is vowel, consonant)."""
    return (classes.endswith("cvc") & ~word.rlike("[wxy]$")) | (classes == "vc")


def _rules(rules: list, holds: Callable[[str, Column], Column]) -> Column:
    """The first rule whose suffix fits decides: rewritten if ``holds``, else unchanged."""
    out = F
    for suffix, put in rules:
        to = F.concat(_cut(len(suffix)), F.lit(put))
        out = out.when(F.col(W).endswith(suffix), F.when(holds(suffix, _cut(len(suffix), CV)), to).otherwise(F.col(W)))
    return out.otherwise(F.col(W))


def _step_1b(df: DataFrame) -> DataFrame:
    w, n = F.col(W), F.length(W)
    vowel_before = lambda k: F.contains(_cut(k, CV), F.lit("v"))
    kind = (F.when(w.endswith("ied"), F.lit("ied")).when(w.endswith("eed"), F.lit("eed"))
            .when(w.endswith("ed") & vowel_before(2), F.lit("ed")).when(w.endswith("ing") & vowel_before(3), F.lit("ing")))
    df = df.withColumn("_kind", kind)
    eed = F.when(_measure(_cut(3, CV)) > 0, F.concat(_cut(3), F.lit("ee"))).otherwise(w)
    rest = F.when(F.col("_kind") == "ed", _cut(2)).when(F.col("_kind") == "ing", _cut(3))
    df = df.withColumn("_rest", rest).withColumn("_rest_cv", F.substring(F.col(CV), F.lit(1), F.length("_rest")))
    r, cv = F.col("_rest"), F.col("_rest_cv")
    double = r.rlike(r"(.)\1$") & cv.endswith("c")
    done = (F.when(r.rlike("(at|bl|iz)$"), F.concat(r, F.lit("e")))
            .when(double, F.when(r.rlike("[lsz]$"), r).otherwise(F.substring(r, F.lit(1), F.length(r) - 1)))
            .when((_measure(cv) == 1) & _cvc(r, cv), F.concat(r, F.lit("e"))).otherwise(r))
    out = (F.when(F.col("_kind") == "ied", F.when(n == 4, _cut(1)).otherwise(_cut(2))).when(F.col("_kind") == "eed", eed)
           .when(r.isNotNull(), done).otherwise(w))
    return df.withColumn(W, out).drop("_kind", "_rest", "_rest_cv")


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` (distinct lower-case words) with ``stem``."""
    positive = lambda suffix, cv: _measure(cv) > 0
    long = lambda suffix, cv: (_measure(cv) > 1) & (F.lit(True) if suffix != "ion" else _cut(3).rlike("[st]$"))
    last_consonant = (F.length(W) > 2) & F.col(CV).rlike("c.$")
    alli = F.when(F.col(W).endswith("alli") & (_measure(_cut(4, CV)) > 0), _cut(2)).otherwise(F.col(W))
    logi = F.when(F.col(W).endswith("logi") & (_measure(_cut(3, CV)) > 0), _cut(1))
    measure = _measure(_cut(1, CV))
    e_goes = F.col(W).endswith("e") & ((measure > 1) | ((measure == 1) & ~_cvc(_cut(1), _cut(1, CV))))
    steps = [
        F.when(F.col(W).endswith("ies") & (F.length(W) == 4), _cut(1)).otherwise(_rules(STEP_1A, lambda s, cv: F.lit(True))),
        _step_1b,
        F.when(F.col(W).endswith("y") & last_consonant, F.concat(_cut(1), F.lit("i"))).otherwise(F.col(W)),
        alli,
        F.coalesce(logi, _rules(STEP_2, positive)),
        _rules(STEP_3, positive),
        _rules([(s, "") for s in STEP_4], long),
        F.when(e_goes, _cut(1)).otherwise(F.col(W)),
        F.when(F.col(W).endswith("ll") & (measure > 1), _cut(1)).otherwise(F.col(W)),
    ]
    df = words.withColumn(W, F.col(word))
    for step in steps:
        df = df.withColumn(CV, _classes(F.col(W)))
        df = step(df) if callable(step) and not isinstance(step, Column) else df.withColumn(W, step)
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    stem = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.coalesce(irregular[F.col(word)], F.col(W)))
    return df.withColumn("stem", stem).drop(W, CV)
