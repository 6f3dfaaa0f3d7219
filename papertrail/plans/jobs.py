"""Job compositions (requests, results, extraction, fine-tuning sets,
bib prediction).  Model calls happen outside; their outputs arrive as
tables keyed by request/record id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.functions import jsonx as J
from papertrail.functions import prompts as PR
from papertrail.functions.text import custom_id
from papertrail.operators import corpus as C
from papertrail.operators.qa_scan import with_objects
from papertrail.sources.sinks import dead_letter, split_status

DEFAULT_MAX_TOKENS = 64000
DEFAULT_TEMPERATURE = 0.3


def build_requests(txt: DataFrame, js: DataFrame, name: str = "name", text: str = "text", json_text: str = "json",
                   start: int = 0, *, model: str, max_tokens: int = DEFAULT_MAX_TOKENS,
                   temperature: float = DEFAULT_TEMPERATURE) -> tuple:
    """(requests, mapping) for every name present in both corpora (M9).

    Names are sorted, numbered from ``start`` and turned into custom ids;
    the request carries the system prompt and the filled user prompt.
    """
    # the names alone are sorted and numbered; texts join by name afterwards
    names = C.intersect_keys(txt, js, name)
    numbered = C.sequence_after_sort(names, name, 0, "idx").filter(F.col("idx") >= start)
    s = C.match_by_name(txt.select(name, text), js.select(name, json_text), name).join(numbered, name)
    cid = custom_id(F.col(name), F.col("idx") - F.lit(start), start=start)
    user = C.render_prompt(PR.QA_USER_TEMPLATE, text=text, json_template_content=json_text)
    params = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
                      F.lit(float(temperature)).alias("temperature"), F.lit(PR.QA_SYSTEM_PROMPT).alias("system"),
                      F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))
    req = s.select(cid.alias("custom_id"), params.alias("params"), F.col(name).alias("name"), "idx")
    return req.select("custom_id", "params"), req.select("custom_id", "name")


def ingest_results(results: DataFrame, mapping: DataFrame) -> tuple:
    """(qa rows, dead letters, counts) from batch results.

    results: custom_id, type ('succeeded' / 'errored' / …), text, error_type.
    Errored → dead letter API_ERROR; a succeeded result without any QA
    object in any of the accepted shapes → PARSE_ERROR; else one row per QA
    object.
    """
    r = C.restore_names(results, mapping)
    ok, failed = split_status(r, F.col("type") == "succeeded")
    api_err = dead_letter(failed, "API_ERROR", "name", F.coalesce(F.col("error_type"), F.lit("unknown")), "text")
    objs = with_objects(ok.select("custom_id", "name", "text"), "text", "objs")
    parsed, unparsed = split_status(objs, F.size("objs") > 0)
    parse_err = dead_letter(unparsed, "PARSE_ERROR", "name", F.lit("no QA object could be parsed"), "text")
    qa = parsed.select("name", F.posexplode_outer("objs").alias("ord", "v")).filter("v is not null").select(
        "name", "ord", J.normalize_qa("v").alias("qa")).select("name", "ord", "qa.*")
    counts = r.agg(F.count_if(F.col("type") == "succeeded").alias("succeeded"),
                   F.count_if(F.col("type") != "succeeded").alias("failed"))
    return qa, api_err.unionByName(parse_err), counts


def extract_records(responses: DataFrame, name: str = "name", text: str = "response",
                    failed_marker: str = "API call failed") -> tuple:
    """(records, log) for one model response per document.

    A failed call stores the marker text, which then also fails to parse,
    so such a document gets two log rows: API_CALL and JSON_PARSE.
    """
    p = responses.withColumn("parsed", J.parse_json_lenient(F.col(text)))
    api = responses.filter(F.col(text) == failed_marker)
    log_api = dead_letter(api, "API_CALL", name, F.lit("API call failed"))
    good, bad = split_status(p, F.col("parsed").isNotNull())
    log_parse = dead_letter(bad, "JSON_PARSE", name, F.lit("Response could not be parsed as valid JSON"), text)
    return good.select(name, "parsed"), log_api.unionByName(log_parse)


def build_sft(qa: DataFrame, id_col: str, eos: str = PR.EOS, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Prompt text per QA row and a 90/10 train/test split."""
    t = F.concat(C.render_prompt(PR.SFT_TRAIN_TEMPLATE, question="question", reasoning="reasoning", answer="answer"),
                 F.lit(eos))
    d = qa.withColumn("text", t)
    return C.split(d, (1.0 - test_size, test_size), by=id_col, seed=seed, names=("train", "test"))


def rule_model(records: DataFrame, text: str = "text") -> DataFrame:
    """Default 'model' of the text → BibTeX step: the rule-based citation
    parser, emitting the JSON text a seq2seq model would produce."""
    from papertrail.functions.bib import parse_citation

    e = parse_citation(F.col(text))
    raw = F.to_json(F.map_concat(F.create_map(F.lit("ENTRYTYPE"), e["entrytype"]), e["fields"]))
    return records.withColumn("raw_prediction", raw)


def predicted(records: DataFrame, fn=None, id_col: str = "record_id", text: str = "text") -> DataFrame:
    """``records`` with raw_prediction, bib and ok, from one pass.

    Model output (``fn``: pandas Series of texts → Series of JSON texts,
    run in Arrow batches; default :func:`rule_model`) → brace repair →
    strict JSON parse, else regex salvage of the fields → type defaults
    to article, a missing ID becomes the DOI citekey (without DOI
    ``article_{n}`` of a numeric id, else ``article_{id}``) → rendered entry.  Outputs with no usable field are
    not ``ok``.
    """
    from papertrail.functions._col import let
    from papertrail.functions.bib import RESERVED, render_bib
    from papertrail.functions.text import citekey, extract_doi

    if fn is None:
        p = rule_model(records, text)
    else:
        from papertrail.operators.arrow_fns import text_udf
        p = records.withColumn("raw_prediction", text_udf(fn)(F.col(text)))
    m = let(J.brace_repair(F.col("raw_prediction")), lambda rep: F.coalesce(
        F.try_variant_get(J.strict_parse_json(rep), "$", "map<string,string>"), J.salvage_fields(rep)))
    key = F.coalesce(citekey(extract_doi(F.col(text)), F.col(id_col).try_cast("long")),
                     F.concat(F.lit("article_"), F.col(id_col).cast("string")))

    def to_bib(mm):
        typ = F.coalesce(F.nullif(F.element_at(mm, F.lit("ENTRYTYPE")), F.lit("")), F.lit("article"))
        eid = F.coalesce(F.nullif(F.element_at(mm, F.lit("ID")), F.lit("")), key)
        bib = render_bib(typ, eid, F.map_filter(mm, lambda k, v: ~k.isin(*RESERVED)))
        return F.struct(bib.alias("bib"), F.size(mm).alias("n"))
    p = p.withColumn("_r", let(m, to_bib)).withColumn("bib", F.col("_r.bib"))
    return p.withColumn("ok", F.coalesce(F.col("bib").isNotNull() & (F.col("_r.n") > 0), F.lit(False))).drop("_r")


def predict_bib(records: DataFrame, fn=None, id_col: str = "record_id", text: str = "text") -> tuple:
    """(bib rows, dead letters) of :func:`predicted`."""
    good, bad = split_status(predicted(records, fn, id_col, text), F.col("ok"))
    dead = dead_letter(bad.withColumn("_name", F.col(id_col).cast("string")), "PREDICT", "_name",
                       F.lit("BibTeX generation failed"), "raw_prediction")
    return good.select(id_col, "bib"), dead
