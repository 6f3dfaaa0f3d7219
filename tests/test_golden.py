"""Golden cases from the reference's sample inputs and stated rules."""

from pyspark.sql import functions as F

from papertrail.functions import bib as B
from papertrail.functions import jsonx as J
from papertrail.functions import text as X
from papertrail.functions.records import split_records
from papertrail.operators import corpus as C
from papertrail.operators import metrics as M
from papertrail.operators import qa_scan
from papertrail.operators.extraction import flatten_json
from papertrail.operators.chunk import token_windows


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_doi_normalisation(spark):
    assert one(spark, X.extract_doi("x"), "doi: 10.1002/Chem.20.") == "10.1002/chem.20"
    assert one(spark, X.extract_doi("x"), "DOI:\n10.1002/Chem.20;") == "10.1002/chem.20"
    assert one(spark, X.extract_doi("x"), "no identifier") is None


def test_citekey(spark):
    df = spark.createDataFrame([("10.1002/chem.202200167", 0), (None, 4)], "d string, i long")
    got = [r[0] for r in df.select(X.citekey("d", "i")).collect()]
    assert got == ["10_1002_chem", "article_5"]


def test_split_only_at_three_newlines(spark):
    text = "a\n\nb\n\n\nc\r\n\r\n\r\nd\n\n\n\n\n\ne"
    assert one(spark, split_records("x"), text) == ["a\n\nb", "c", "d", "e"]


def test_bib_escape_and_empty_entry(spark):
    df = spark.createDataFrame([("article", "k", {"title": "a{b}&c"}), ("article", "e", {})],
                               "t string, i string, f map<string,string>")
    got = [r[0] for r in df.select(B.render_bib("t", "i", "f")).collect()]
    assert got[0] == "@article{k,\n  title = {a{{b}}\\&c}\n}"
    assert got[1] == "@article{e,\n}"


def test_bib_missing_id_is_invalid(spark):
    df = spark.createDataFrame([(None, None, {"title": "x"})], "t string, i string, f map<string,string>")
    assert df.select(B.render_bib("t", "i", "f")).first()[0] is None


def test_later_bib_entry_wins(spark):
    recs = spark.createDataFrame([(1, "text doi: 10.1234/ABC.")], "record_id long, text string")
    bib = spark.createDataFrame([(0, "10.1234/abc", "old"), (1, " 10.1234/ABC ", "new")], "entry_no long, doi string, title string")
    j = C.pair_by_doi(recs, bib)
    assert j.select("entry.title").first()[0] == "new"


def test_lenient_json(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("\"a\": 1",), ("[1]",), ("",), ('{"a":1} trailing',)], "x string")
    got = [r[0] for r in df.select(J.parse_json_lenient("x").isNotNull()).collect()]
    assert got == [True, True, True, False, False]


def test_qa_scanner_rules(spark):
    cases = ['{"question": "q1", "reasoning": "r", "answer": "a"}\n{"question": "q2"}', '{\n  "question": "q",\n  "answer": "a"\n}',
             '["{\\"question\\": \\"a\\"}", "{\\"question\\": \\"b\\"}"]', '{"question":"q","refs":[{"question":"inner"}]}',
             'Sure! [ {"question":"a]"} ] and [[{"question":"b"}], [[[["{\\"question\\": \\"deep\\"}"]]]]]', "", None, "none",
             '```json\n[{"question":"z"}]\n```', 'open "quote { [', '[1, 2] {"question":"k"}', '{"question": 0, "answer": null}']
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {}
    for r in qa_scan.extract_qa(df, "k", "t").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append(r.question)
    assert got == {0: ["q1", "q2"], 1: ["q"], 2: ["a", "b"], 3: ["inner"], 4: ["a]", "b", "deep"], 8: ["z"], 10: ["k"], 11: [""]}


def test_ingest_accepts_arrays_and_pretty_objects(spark):
    from papertrail.plans import jobs

    texts = ['[{"question": "a"}, {"question": "b"}]', '{\n "question": "c"\n}', '{"question": "d"}\n{"question": "e"}', "sorry"]
    res = spark.createDataFrame([(str(i), "succeeded", t, None) for i, t in enumerate(texts)] + [("9", "errored", "x" * 5000, "busy")],
                                "custom_id string, type string, text string, error_type string")
    names = spark.createDataFrame([("0", "paper")], "custom_id string, name string")
    qa, dead, _ = jobs.ingest_results(res, names)
    assert sorted((r.name, r.question) for r in qa.collect()) == [("1", "c"), ("2", "d"), ("2", "e"), ("paper", "a"), ("paper", "b")]
    assert {(r.name, r.stage, len(r.raw)) for r in dead.collect()} == {("3", "PARSE_ERROR", 5), ("9", "API_ERROR", 5000)}


def test_unanswered_requests_stay(spark):
    req = spark.createDataFrame([(1,), (2,)], "id long")
    resp = spark.createDataFrame([(1, "x")], "id long, r string")
    assert sorted(map(tuple, C.response_join(req, resp, "id").collect())) == [(1, "x"), (2, None)]


def test_made_names_never_meet(spark):
    names = ["x.md", "x.md", "x_1.md", "x.md", "x_1.md", "y", "x_1_1.md", "x.md"]
    df = spark.createDataFrame([(i, "A", n) for i, n in enumerate(names)], "i long, label string, f string")
    got = [r[0] for r in C.resolve_name_conflicts(df, "label", "f", order=["i"]).orderBy("i").select("target_name").collect()]
    assert got == ["x.md", "x_1.md", "x_1_1.md", "x_2.md", "x_1_2.md", "y", "x_1_1_1.md", "x_3.md"]


def test_normalize_qa_falsy(spark):
    df = spark.createDataFrame([('{"question":0,"answer":null}',)], "x string")
    r = df.select(J.normalize_qa(F.parse_json("x")).alias("q")).first()["q"]
    assert (r.question, r.reasoning, r.answer) == ("", "", "")


def test_custom_id(spark):
    df = spark.createDataFrame([("a b/ü", 7)], "n string, i long")
    assert df.select(X.custom_id("n", "i")).first()[0] == "req_000007_a_b__"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_custom_id_replaces_only_what_stays(spark):
    df = spark.createDataFrame([("é b" * 40, 7), ("", 8), (None, 9), ("x", 10**70 // 10**52)], "n string, i long")
    ids = df.select(X.custom_id("n", "i").alias("c"), X.custom_id("n", "i", max_len=11).alias("short"))
    assert [tuple(r) for r in ids.collect()] == [
        ("req_000007_" + ("__b" * 40)[:53], "req_000007"), ("req_000008", "req_000008"), ("req_000009", "req_000009"),
        ("req_1000000000000000000_x", "req_1000000000000000000")]
    assert "regexp_replace(substring(n" in plan_of(ids)


def test_flatten_json_repeats_paths(spark):
    got = one(spark, flatten_json("x"), '{"a":{"b":1,"c":[null,true]}}')
    assert got == "a: a.b: 1; a.c: a.c.item_0: None; a.c.item_1: True"


def test_leaves_of_any_depth(spark):
    from papertrail.operators.extraction import flatten_leaves, flatten_text

    deep = '{"a": ' * 20 + '[1, "x]"]' + "}" * 20
    df = spark.createDataFrame([(1, deep), (2, "[]"), (3, "5")], "k int, j string")
    assert sorted((r.k, r.path.count("."), r.value) for r in flatten_leaves(df, "k", "j").collect()) == [(1, 20, "1"), (1, 20, "x]")]
    text = {r.k: r.t for r in flatten_text(df, F.col("j"), "t").collect()}
    assert text[1].endswith(".item_0: 1; " + ".".join("a" * 20) + ".item_1: x]") and text[3] == "5"


ODD_JSON = [('{"a": "{\\"b\\": [1, \\"[2]\\"]}", "c": " [3"}', [("a.b.item_0", "1"), ("a.b.item_1.item_0", "2"), ("c", " [3")],
             'a: a.b: a.b.item_0: 1; a.b.item_1: a.b.item_1.item_0: 2; c:  [3'),
            ('{"u": "\\u007b\\"x\\": true}", "v": [true, " true", "true", {}]}',
             [("u.x", "True"), ("v.item_0", "True"), ("v.item_1", "False"), ("v.item_2", "True")],
             'u: u.x: True; v: v.item_0: True; v.item_1: False; v.item_2: True; v.item_3: '),
            ('{"d": 1, "d": 2}', [], '{"d": 1, "d": 2}'), ('[1.50, null', [], '[1.50, null'),
            (' [1.50, null]', [("item_0", "1.5"), ("item_1", "None")], 'item_0: 1.5; item_1: None')]


def test_flattening_takes_json_in_strings(spark):
    from papertrail.operators.extraction import flatten_leaves, flatten_text

    df = spark.createDataFrame([(k, j) for k, (j, _, _) in enumerate(ODD_JSON)], "k int, j string")
    got = sorted((r.k, r.path, r.value) for r in flatten_leaves(df, "k", "j").collect())
    assert got == sorted((k, *x) for k, (_, want, _) in enumerate(ODD_JSON) for x in want)
    assert {r.k: r.t for r in flatten_text(df, F.col("j"), "t").collect()} == {k: t for k, (_, _, t) in enumerate(ODD_JSON)}


def test_leaves_come_from_one_pass(spark):
    """No level reads the rows again."""
    from papertrail.operators.extraction import flatten_leaves

    df = spark.createDataFrame([(1, '{"a": ' * 9 + "1" + "}" * 9)], "k int, j string")
    plan = plan_of(flatten_leaves(df, "k", "j"))
    assert plan.count("Generate ") == 1 and "Union" not in plan


def test_flatten_json_parses_a_level_once(spark):
    df = spark.createDataFrame([("{}",)], "j string")
    parsed = [plan_of(df.select(flatten_json("j", depth))).count("parse_json") for depth in (3, 5)]
    assert parsed[1] - parsed[0] <= 2 * 2  # a level: whether it is a container, and of a scalar whether it is a boolean


def test_products_and_stage_type_of_the_wrapped_shape(spark):
    from papertrail.operators.extraction import normalize_extraction

    j = '{"finalStage": {"type": "Tip", "activation": {"conditions": {"bias": "1 V"}}, "products": {"products": [{"abbreviation": "A"}, {"abbreviation": "B"}]}}}'
    r = normalize_extraction(spark.createDataFrame([(j,)], "j string"), "j").first()["record"]
    assert [(f.type, f.products.abbreviation, f.conditions.bias) for f in r.finalStage] == [("Tip", "A", "1 V"), ("Tip", "B", "1 V")]


def test_window_counts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 512, 513, 5000)], "n int")
    toks = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda i: i.cast("string"))
    toks = F.when(F.col("n") > 0, toks).otherwise(F.array().cast("array<string>"))
    got = [r[0] for r in df.select(F.size(token_windows(toks, 512, 384, 8))).collect()]
    assert got == [0, 1, 2, 8]


def test_absent_class_zero_and_weight_one(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "label long")
    counts = {r.label: r["count"] for r in M.label_counts(df, "label", [0, 1, 2]).collect()}
    assert counts == {0: 2, 1: 1, 2: 0}
    w = {r.label: r.weight for r in M.class_weights(df, "label", [0, 1, 2]).collect()}
    assert w[2] == 1.0 and abs(w[0] - 3 / (3 * 2)) < 1e-12


def test_name_conflicts(spark):
    df = spark.createDataFrame([(1, "PPT", "x.md"), (2, "PPT", "x.md"), (3, "PPT", "x.md")], "i long, label string, f string")
    got = [r[0] for r in C.resolve_name_conflicts(df, "label", "f", order=["i"]).orderBy("i").select("target_name").collect()]
    assert got == ["x.md", "x_1.md", "x_2.md"]


def test_route_and_answer(spark):
    assert one(spark, X.route_query("x"), "What is the REACTION order?") == "synthesis"
    assert one(spark, X.answer_part("x"), "no marker here") == "no marker here"
    assert one(spark, X.answer_part("x"), "p ### Answer:  yes ") == "yes"


def test_restore_names_fallback(spark):
    res = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    mp = spark.createDataFrame([("a", "paper")], "custom_id string, name string")
    got = {r.custom_id: r.name for r in C.restore_names(res, mp).collect()}
    assert got == {"a": "paper", "b": "b"}


PUBMED = (
    "1. Chemistry. 2022 May 16;28(28):e202200167. doi: 10.1002/chem.202200167. Epub 2022 \r\n"
    "Apr 5.\r\n\r\nOn-Surface Metathesis of an Ionic Liquid on Ag(111).\r\n\r\n"
    "Massicot S(1), Sasaki T(2), Lexow M(1), Maier F(1), Kuwabata S(2), Steinrück \r\nHP(1).\r\n\r\n"
    "Author information:\r\n(1)Lehrstuhl für Physikalische Chemie II, Erlangen, Germany.\r\n\r\n"
    "We investigated the adsorption, surface enrichment, ion exchange, and on-surface \r\n"
    "metathesis of ultrathin mixed IL films on Ag(111). Hereby, a wetting layer is formed \r\n"
    "by on-surface metathesis at the IL/metal interface.\r\n\r\n"
    "DOI: 10.1002/chem.202200167\r\nPMCID: PMC9321566\r\nPMID: 35363397\r\n")


def test_parse_citation_golden(spark):
    e = one(spark, B.parse_citation("x"), PUBMED)
    f = e["fields"]
    assert f["title"] == "On-Surface Metathesis of an Ionic Liquid on Ag(111)"
    assert f["author"] == "Massicot, S. and Sasaki, T. and Lexow, M. and Maier, F. and Kuwabata, S. and Steinrück, H. P."
    assert (f["journal"], f["year"], f["volume"], f["number"]) == ("Chemistry", "2022", "28", "28")
    assert f["doi"] == "10.1002/chem.202200167"
    assert f["abstract"].startswith("We investigated the adsorption") and "on-surface metathesis of" in f["abstract"]


BIB = """@article{_calcium-decorated_2011,
 abstract = {Among the carbon allotropes, carbyne chains appear {accessible}.},
 author = {Сорокин, Павел Б. and Sorokin, Pavel},
 pmcid = {null},
 title = {Calcium-decorated carbyne networks.},
 year = {2011}
}
@article{g_binnig_atomic_1986,
  title = {Atomic force microscope},
  author = {{G. Binnig} and {C. F. Quate}},
  year = {1986},
}
"""


def test_read_bib_entries(spark):
    df = spark.createDataFrame([(BIB,)], "t string")
    es = df.select(F.explode(B.split_entries("t")).alias("e")).select(B.parse_entry("e").alias("p")).collect()
    assert [e.p.id for e in es] == ["_calcium-decorated_2011", "g_binnig_atomic_1986"]
    assert es[0].p.fields["pmcid"] == "null"
    assert es[0].p.fields["abstract"].endswith("{accessible}.")
    assert es[1].p.fields["author"] == "{G. Binnig} and {C. F. Quate}"


def test_entries_without_id_get_a_citekey(spark):
    bib = "@article{,\n doi = {10.1002/Chem.2022},\n}\n@misc{,\n title = {no doi},\n}\n@book{own,\n doi = {10.1/x},\n}"
    df = spark.createDataFrame([(bib,)], "t string").select(F.posexplode(B.split_entries("t")).alias("pos", "e"))
    got = df.select(B.entry_key(B.parse_entry("e"), "pos").alias("k"), B.parse_entry("e")["fields"].alias("f")).collect()
    assert [r.k for r in got] == ["10_1002_chem", "article_2", "own"]
    assert got[1].f == {"title": "no doi"}


def test_predicted_bib_without_doi_is_kept(spark):
    from papertrail.plans import jobs

    recs = spark.createDataFrame([("7_0", "1. Chem. 2020 May;1(2):3.\n\nA title.\n\nDoe J.")], "record_id string, text string")
    bib, dead = jobs.predict_bib(recs)
    assert bib.first().bib.startswith("@article{article_7_0,") and dead.count() == 0
    numbered = recs.withColumn("record_id", F.lit(4))
    assert jobs.predict_bib(numbered)[0].first().bib.startswith("@article{article_5,")


def test_evaluation_row(spark):
    import math

    rows = [(0, 0, [0.8, 0.2]), (1, 1, [0.2, 0.8]), (1, 0, [0.6, 0.4]), (0, 1, [0.4, 0.6])]
    df = spark.createDataFrame(rows, "y long, p long, probs array<double>")
    r = M.evaluation_row(df, "y", "p", "probs", [0, 1]).first()
    assert (r.accuracy, r.n_test, r.f1_0, r.f1_1, r.balanced_accuracy, r.mcc) == (0.5, 4, 0.5, 0.5, 0.5, 0.0)
    assert r.roc_auc_macro == 0.75 and abs(r.pr_auc_macro - 5 / 6) < 1e-12
    want = sum((1 - p) ** 2 * -math.log(p) for p in (0.8, 0.8, 0.4, 0.4)) / 4
    assert abs(r.test_loss - want) < 1e-12
