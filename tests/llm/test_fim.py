"""Fill-in-the-middle transformation against plain string slicing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from papertrail.llm import fim

TEXTS = [None, "", "a", "é", "ab", "日本語のテキスト", "aé€😀" * 50, "plain ascii text " * 400, "holds <S> inside", "<P>", "<", "<S",
         "a\nb\tc\r\n", "\u0000", "tail é", "é head", "x" * 200_000 + "é", "😀" * 30_000]
SCHEMA = "doc_id long, text string, n string, output double, _h0 long, _text string"


@pytest.fixture(scope="module")
def rows():
    texts = TEXTS + ["".join("aé€😀 <"[(k * j) % 6] for j in range(k % 37)) for k in range(300)]
    out = [(7 * k - 3, t) for k, t in enumerate(texts)]
    return out + [(None, "no id é"), (None, None), (5, TEXTS[6]), (5, TEXTS[6])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, 2, "y") for r in rows], SCHEMA).repartition(3).checkpoint()


def expected(doc_id, text, fim_rate=90, spm_rate=20, unit="char", marks=fim.MARKS, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    size = len(t) if unit == "char" else len(t.encode())
    a, b = sorted((h[0] % (size + 1), h[1] % (size + 1)))
    if unit == "byte":
        a, b = (len(t.encode()[:x].decode(errors="ignore")) for x in (a, b))
    if not t or any(m in t for m in marks) or h[2] % 100 >= fim_rate:
        return (doc_id, len(t), "plain", None, None, t, t)
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}" if form == "spm" else f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"
    return (doc_id, len(t), form, a, b - a, out, t)


def shown(df, marks=fim.MARKS):
    back = fim.restored(F.col("output"), F.col("form"), marks)
    return sorted(map(tuple, df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()), key=repr)


@pytest.mark.parametrize("unit", ["char", "byte"])
def test_cuts_forms_outputs_and_restored_texts(docs, rows, unit):
    assert shown(fim.fill_in_middle(docs, unit=unit)) == sorted((expected(*r, unit=unit) for r in rows), key=repr)


def test_rates_marks_and_seed(docs, rows):
    marks = ("[pre]", "[suf]", "[mid]")
    got = shown(fim.fill_in_middle(docs, fim_rate=50, spm_rate=100, marks=marks, seed=9), marks)
    assert got == sorted((expected(*r, 50, 100, "char", marks, 9) for r in rows), key=repr)
    assert {r[2] for r in shown(fim.fill_in_middle(docs, fim_rate=0))} == {"plain"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")


def test_carried_columns_and_an_empty_table(spark, docs, rows):
    out = fim.fill_in_middle(docs.withColumnRenamed("output", "was"), carry=["_text"])
    assert out.columns[:2] == ["doc_id", "_text"] and {r["_text"] for r in out.select("_text").collect()} == {"y"}
    none = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
