"""Secret scan with a random forest that removes false positives.

1. Candidates: runs of 16 or more key characters (letters, digits, + / _ and
   -, with = only as padding at the end) that hold a digit or have at least 24
   characters, and JSON web tokens.  So ``NAME=value`` is not one run: the value
   is the finding and the name is its context.  A value that is assigned to the
   name of a credential is a candidate at any length if it is quoted, holds a
   digit or has 16 characters.
2. Features: length, entropy, the shares of character classes and of the
   transitions between them, dictionary coverage, a known key prefix, the
   path's parts, and the neighbouring words (hashed, and whether they name a credential).
3. A Spark ML random forest is trained on labelled findings, about
   ``max_train`` of each label by the hash of (id, start); that bound and the
   number of dictionary ``words``, counted over all rows, are its only limits.
   Every candidate of every whole text is scored.

Defined cases: a null text has no candidates; a null path has none of the
path features; null ids and repeated rows are scanned each; with findings
of one label only, every candidate gets that label's score; extra columns
are ignored; empty tables give no findings.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import discard, sampled, stored
from papertrail.llm.wordhash import slices

MAX_TRAIN = 10_000
DICTIONARY_WORDS = 20_000
NEAR = 48  # characters of context on either side
HASHED = 16
EMIT = 512  # findings a task holds before it passes them on

_KEY = "[A-Za-z0-9+/_-]"
_KEYS = frozenset("+/_-" + string.ascii_letters + string.digits)
_RUN = re.compile(rf"eyJ[\w-]{{8,}}\.[\w-]{{8,}}\.[\w-]*|{_KEY}{{16,}}(?:={{1,2}}(?![A-Za-z0-9+/=_-]))?", re.A)
_SHORT = re.compile(rf"(?:=>|[=:])\s*([\"']?)({_KEY}{{1,15}}+(?:={{1,2}}(?![A-Za-z0-9+/=_-]))?)")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")
_CREDENTIAL = re.compile(r"(?i)(api|auth|access|private|secret|token|passw|pwd|credential|key|bearer)")
_NAME = r"(token|((secret|auth)[ _-]?key)|secret|passw(or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential)s?[\"']?\s*"
_ASSIGNED = rf"(?i){_NAME}(=|:|=>)\s*[\"']?$"
_BEARER = r"(?i)(\bbearer\s+|\bauthorization[\"']?\s*(=|:|=>)\s*[\"']?([a-z]+\s+)?)[\"']?$"
_PREFIX = (r"^/?(A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20}|github_pat_|glpat-|[sr]k_(live|test)_|xox[abeoprs]-|AIza[\w-]{30}"
           r"|npm_[A-Za-z0-9]{30}|hf_[A-Za-z]{30}|eyJ[\w-]+\.)")
_NAMED = re.compile(rf"(?i){_NAME}$")
_ASSIGNED_RUN = re.compile(_ASSIGNED)
_KNOWN = re.compile(_PREFIX)
_PATH_PARTS = ("test", "example", "sample", "doc", "fixture", "mock", "config", "env", "lock")


def candidates(text: str) -> Iterator[tuple[int, str]]:
    found = [(m.start(), m[0]) for m in _RUN.finditer(text) if len(m[0]) >= 24 or _DIGIT.search(m[0])
             or _ASSIGNED_RUN.search(text[max(0, m.start() - NEAR):m.start()])]
    long = {at for at, _ in found}
    for m in _SHORT.finditer(text):
        if (m[1] or _DIGIT.search(m[2])) and m.start(2) not in long and text[m.end():m.end() + 1] not in _KEYS \
                and _NAMED.search(text[max(0, m.start() - NEAR):m.start()]):
            found.append((m.start(2), m[2]))
    return iter(sorted(found))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(finding: str, dictionary: frozenset) -> float:
    """Share of the characters that dictionary words of 3 to 12 letters cover,
    longest first from the left."""
    s, at, covered = finding.lower(), 0, 0
    while at < len(s):
        n = next((n for n in range(min(12, len(s) - at), 2, -1) if s[at:at + n] in dictionary), 0)
        covered += n
        at += n or 1
    return covered / len(s)


def _hashed(word: str) -> list[float]:
    out = [0.0] * HASHED
    if word:
        out[zlib.crc32(word.lower().encode()) % HASHED] = 1.0
    return out


def feature_row(finding: str, before: str, after: str, path: str | None, dictionary: frozenset) -> list[float]:
    n = len(finding)
    counts = Counter(finding)
    kinds = [_kind(c) for c in finding]
    moves = Counter(zip(kinds, kinds[1:]))
    out = [math.log2(n), float(n % 4 == 0), -sum(c / n * math.log2(c / n) for c in counts.values())]
    out += [kinds.count(k) / n for k in range(4)]
    out += [moves[i, j] / max(n - 1, 1) for i in range(4) for j in range(4)]
    out += [sum(c in "0123456789abcdefABCDEF" for c in finding) / n, coverage(finding, dictionary),
            float(bool(_KNOWN.search(finding)))]
    p = (path or "").lower()
    out += [float(p.count("/")), *(float(x in p) for x in _PATH_PARTS)]
    left, right = _WORD.findall(before)[-2:], _WORD.findall(after)[:1]
    tail = before.rstrip()
    out += [float(bool(_CREDENTIAL.search(" ".join(left)))), float(tail.endswith(("=", ":", '="', "='", ': "'))),
            float(before[-1:] in ("'", '"')), float(after[:1] in ("'", '"')), float(before[-1:].isspace() or not before)]
    return out + _hashed(left[-1] if left else "") + _hashed(right[0] if right else "")


def dictionary_of(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> frozenset:
    """The about ``words`` most frequent words of 3 to 12 letters a-z of all rows,
    counted in each task before the shuffle; ties for the last places go by the
    word's hash.  Only how many words have each count, and the words kept, are
    sent to the driver."""
    w = F.explode_outer(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}_]+"))
    counts = stored(docs.select(w.alias("w")).filter(F.regexp_like("w", F.lit("^[a-z]{3,12}$"))).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "word-counts")
    left, keep = words, F.lit(False)
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        keep = F.col("n") >= r["n"]
        if r["words"] > left:
            keep = (F.col("n") > r["n"]) | ((F.col("n") == r["n"]) & (F.pmod(F.xxhash64("w"), F.lit(r["words"])) < left))
            break
        left -= r["words"]
    out = frozenset(r["w"] for r in counts.filter(keep).collect())
    discard(counts)
    return out


def findings(docs: DataFrame, dictionary: frozenset, id_col: str = "doc_id", text_col: str = "text",
             path_col: str | None = None) -> DataFrame:
    """Every candidate: doc_id, start (characters), finding, before, after and
    its features."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)
    names = ["doc_id", "start", "finding", "before", "after", "features"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for whole in batches:
            types = [k or whole.schema.field(0).type for k in kinds]
            for b in slices(whole, 1):
                rows = []
                for doc, text, path in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    t = text.as_py()
                    for at, x in candidates(t):
                        before, after = t[max(0, at - NEAR):at], t[at + len(x):at + len(x) + NEAR]
                        rows.append((doc, at, x, before, after, feature_row(x, before, after, path, words)))
                        if len(rows) == EMIT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    path = F.lit(None).cast("string") if path_col is None else F.col(path_col).cast("string")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t"), path.alias("p"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, start long, finding string, before string, after string, features array<double>")


def reviewed(before: Column, finding: Column) -> Column:
    """Label of a finding by a reviewer's rule: it is assigned to the name of a
    credential, follows ``Bearer`` or ``Authorization:``, or has the prefix of a
    known kind of key.  Callers with findings labelled by hand use those instead."""
    found = F.regexp_like(before, F.lit(_ASSIGNED)) | F.regexp_like(before, F.lit(_BEARER)) | F.regexp_like(finding, F.lit(_PREFIX))
    return found.cast("double")


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, trees: int = 30, depth: int = 8, seed: int = 7):
    """A forest fitted on findings with a ``label`` of 0 or 1, or the only label
    that there is (0 for none)."""
    parts = [sampled(labelled.filter(F.col("label") == x), ["doc_id", "start"], max_train) for x in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("features"))
    sample = stored(sample, "secret-findings")
    known = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(known) < 2:
        return known[0] if known else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(sample)


def score(found: DataFrame, forest) -> DataFrame:
    """``found`` with ``score``, the forest's share for a real secret."""
    if isinstance(forest, float):
        return found.withColumn("score", F.lit(forest))
    v = forest.transform(found.withColumn("_x", array_to_vector("features")).withColumnsRenamed(
        {"features": "_f", "_x": "features"}))
    return v.withColumn("score", F.get(vector_to_array("probability"), 1)).withColumnsRenamed(
        {"features": "_x", "_f": "features"}).select(*found.columns, "score")
