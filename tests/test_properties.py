"""Property tests: chunk coverage, splits, LCS, partition independence."""

import random

from pyspark.sql import functions as F

from papertrail.functions.stem import stems
from papertrail.operators import chunk as K
from papertrail.operators import corpus as C
from papertrail.operators import metrics as M


def plain_chunks(text, size, overlap, seps=("\n\n", "\n", " ")):
    """Separator-aware chunks by a plain recursion and a list of pieces."""
    def pieces(t, seps):
        if len(t) <= size:
            return [t]
        if not seps:
            return [t[k:k + size] for k in range(0, len(t), size)]
        parts = t.split(seps[0])
        whole = [p + seps[0] for p in parts[:-1]] + parts[-1:]
        return [x for p in whole for x in pieces(p, seps[1:])]

    out, held, at = [], [], 0
    for p in filter(None, pieces(text, seps)):
        if held and at + len(p) - held[0] > size:
            out.append(text[held[0]:at])
            while held and (at - held[0] > overlap or at + len(p) - held[0] > size):
                held.pop(0)
        held.append(at)
        at += len(p)
    return out + [text[held[0]:at]] if held else out


def test_recursive_chunks(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randrange(300))) for _ in range(150)]
    texts += ["", "a\n\n\nb", "\n\n\n\n", "x" * 130, "é" * 61 + "\n\n" + "日本 " * 40, "one two\r\n\r\nthree"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*texts, None])], "id long, text string, _text string").repartition(3)
    for size, overlap in ((5, 0), (23, 7), (60, 59), (400, 100)):
        got = {}
        for r in sorted(K.chunk_recursive(df, "id", "text", size, overlap).collect()):
            got.setdefault(r["id"], []).append((r["chunk_id"], r["chunk"]))
        want = {k: list(enumerate(plain_chunks(t, size, overlap))) for k, t in enumerate(texts) if t}
        assert got == want
        assert all(len(c) <= size for cs in got.values() for _, c in cs)
        if not overlap:
            assert all("".join(c for _, c in cs) == texts[k] for k, cs in got.items())


def test_fixed_chunks_cover_text(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abc \n") for _ in range(rnd.randint(0, 200))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = K.chunk_fixed(df, "t", 40, 10).select("id", "chunk_id", "chunk").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.chunk_id, r.chunk))
    for i, t in enumerate(texts):
        cs = [c for _, c in sorted(by.get(i, []))]
        assert all(len(c) <= 40 for c in cs)
        rebuilt = cs[0] + "".join(c[10:] for c in cs[1:]) if cs else ""
        assert rebuilt == t


def test_split_disjoint_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("label", (F.col("doc_id") % 3).cast("long"))
    s = C.split(df, (0.8, 0.1, 0.1), by="doc_id")
    assert s.count() == 2000 and s.select("doc_id").distinct().count() == 2000
    st_ = C.split(df, (0.8, 0.2), by="doc_id", names=("train", "test"), stratify="label")
    counts = {(r.label, r.split): r["count"] for r in st_.groupBy("label", "split").count().collect()}
    for lab in range(3):
        n = counts[(lab, "train")] + counts[(lab, "test")]
        assert counts[(lab, "train")] == sum(1 for p in range(n) if p < n * 0.8)


def test_sequence_after_sort_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    s = C.sequence_after_sort(df, "k", start=3).orderBy("k").collect()
    assert [r.seq for r in s] == list(range(3, 5003))


def test_lcs_matches_dp(spark):
    rnd = random.Random(2)

    def ref(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]
    rows = [([rnd.choice("abc") for _ in range(rnd.randint(0, n))], [rnd.choice("abc") for _ in range(rnd.randint(0, m))])
            for n, m in [(15, 15)] * 100 + [(200, 200)] * 20 + [(62, 62), (124, 3)] * 10 for _ in range(1)]
    rows += [(["a"] * 62, ["a"] * 62), (["a"] * 63, ["a"] * 200), (["a", "b"] * 62, ["b", "a"] * 62), ([], []), (["x"], [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, a array<string>, b array<string>").repartition(4)
    got = df.select("id", M.lcs_length("a", "b").alias("n"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["n"] for r in got.collect()} == {k: ref(*r) for k, r in enumerate(rows)}


# published examples: the vocabulary of the algorithm's own description, and the extensions
STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll died die flies fli dying die news news enjoy enjoy geology geolog
analogically analog by by syzygies syzygi as as 1990s 1990""".split()


def test_stems_are_the_published_ones(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    words = spark.createDataFrame([(w,) for w in want], "word string")
    assert {r["word"]: r["stem"] for r in stems(words).collect()} == want


def test_stemmed_tokens_keep_order_and_short_words(spark):
    df = spark.createDataFrame([(1, ["running", "the", "cats", "cats"], []), (2, [], ["skies", "sses", "running"])],
                               "id long, a array<string>, b array<string>")
    for bound in (500_000, 0):
        got = {r["id"]: (r["a"], r["b"]) for r in M.stemmed_tokens(df, "id", ["a", "b"], bound).collect()}
        assert got == {1: (["run", "the", "cat", "cat"], []), 2: ([], ["sky", "ss", "run"])}


def test_partition_count_independence(spark, sf):
    import __spark_entry__ as E

    q = E.queries()
    out = {}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out[parts] = sorted(map(tuple, q["f_bm25_topk"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out["1"] == out["8"]
