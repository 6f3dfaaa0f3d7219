"""Structured-extraction records: typed normalisation of the two record
shapes, JSON flattening to text and to leaf rows, JSON document tables,
and the contract checks that the prompts state but never enforce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.functions._col import col_of, let
from papertrail.functions.jsonx import strict_parse_json
from papertrail.functions.text import strip

# ------------------------------------------------------------------ F12 schema

S = T.StringType()


def _st(*names) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


COND = _st("wavelength", "irradiationTime", "annealingTemperature", "annealingTime", "bias", "tunnelingCurrent",
           "setpoint", "tipHeight", "operationTime_s", "operationSite")
PRECURSOR = T.StructType([
    T.StructField("iupacName", S), T.StructField("abbreviation", S), T.StructField("morphology", S),
    T.StructField("geometry", S), T.StructField("source", S),
    T.StructField("deposition", T.StructType([
        T.StructField("method", S),
        T.StructField("parameters", _st("Temperature", "pressure", "rate", "time", "substrateTemperature"))])),
    T.StructField("substrate", _st("material", "notes"))])
STAGE = T.StructType([
    T.StructField("activation", T.StructType([T.StructField("type", S), T.StructField("conditions", COND)])),
    T.StructField("intermediate", _st("abbreviation", "morphology", "coverage")),
    T.StructField("mechanism", _st("reactionType"))])
FINAL = T.StructType([
    T.StructField("type", S), T.StructField("conditions", COND),
    T.StructField("products", _st("abbreviation", "morphology", "coverage")),
    T.StructField("mechanism", _st("reactionType"))])
LITERATURE = _st("doi", "journal", "year", "title", "pages")


def _array_or_wrapped(v: Column, path: str, inner: str, elem: T.DataType) -> Column:
    """The array at ``path``, or at ``path.inner`` (wrapped shape), or a
    single object at ``path`` as a one-item array."""
    at = T.ArrayType(elem)
    return F.coalesce(F.try_variant_get(v, f"$.{path}.{inner}", at.simpleString()),
                      F.try_variant_get(v, f"$.{path}", at.simpleString()),
                      F.when(F.try_variant_get(v, f"$.{path}", elem.simpleString()).isNotNull(),
                             F.array(F.try_variant_get(v, f"$.{path}", elem.simpleString()))))


def normalize_extraction(df: DataFrame, c) -> DataFrame:
    """Adds ``record``: STRUCT<precursors, reactionStages, finalStage,
    literature> typed per the template for both shapes (plain arrays, or
    arrays wrapped one level deeper such as ``precursors.precursors``;
    ``finalStage`` as an array, as an object, or as
    ``finalStage.activation`` + ``finalStage.products.products``, one entry
    per product).  Missing values are null; unknown keys are dropped (F12)."""
    def build(v):
        product = FINAL["products"].dataType.simpleString()

        def final_obj(p):
            return F.struct(
                F.coalesce(F.try_variant_get(v, "$.finalStage.activation.type", "string"),
                           F.try_variant_get(v, "$.finalStage.type", "string")).alias("type"),
                F.try_variant_get(v, "$.finalStage.activation.conditions", COND.simpleString()).alias("conditions"),
                p.alias("products"),
                F.try_variant_get(v, "$.finalStage.mechanism", FINAL["mechanism"].dataType.simpleString()).alias("mechanism"))
        products = F.try_variant_get(v, "$.finalStage.products.products", f"array<{product}>")
        one = F.array(F.try_variant_get(v, "$.finalStage.products", product))
        several = F.transform(F.when(F.size(products) > 0, products).otherwise(one), final_obj)
        final = F.coalesce(F.try_variant_get(v, "$.finalStage", T.ArrayType(FINAL).simpleString()),
                           F.when(F.try_variant_get(v, "$.finalStage.activation", "variant").isNotNull(), several),
                           F.when(F.try_variant_get(v, "$.finalStage", FINAL.simpleString()).isNotNull(),
                                  F.array(F.try_variant_get(v, "$.finalStage", FINAL.simpleString()))))
        return F.struct(_array_or_wrapped(v, "precursors", "precursors", PRECURSOR).alias("precursors"),
                        _array_or_wrapped(v, "reactionStages", "reactionStages", STAGE).alias("reactionStages"),
                        final.alias("finalStage"),
                        F.try_variant_get(v, "$.literature", LITERATURE.simpleString()).alias("literature"))
    return df.withColumn("record", let(strict_parse_json(col_of(c)), build))


def precursor_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode_outer("record.precursors").alias("idx", "p")).select(key, "idx", "p.*")


def stage_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode_outer("record.reactionStages").alias("idx", "s")).select(key, "idx", "s.*")


def final_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode_outer("record.finalStage").alias("idx", "f")).select(key, "idx", "f.*")


# ------------------------------------------------------------------ F13 flattening


# a string that begins like a container
_INNER_JSON = r'"(?:\s|\\[tnrbf]|\\u00[0-2][0-9a-fA-F])*+(?:[\[{]|\\u00[57][bB])'


def _kind(v: Column, sure: Column | None = None) -> Column:
    """``{`` or ``[`` of an object's or array's JSON text, else null.  Only what
    begins like one is parsed, and not if ``sure``: it then comes from a valid
    text in which no string begins so."""
    mark = F.substring(F.ltrim(v, F.lit(" \t\r\n")), 1, 1)
    valid = F.try_parse_json(v).isNotNull()
    return F.when(mark.isin("{", "["), F.when(valid if sure is None else sure | valid, mark))


def _each(t: Column, kind: Column, fn) -> Column:
    """``fn(key, value)`` of the entries of a JSON object (keys in source
    order) or array (keys item_i); values are JSON texts (strings decoded)."""
    obj = F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: fn(e["key"], e["value"]))
    arr = F.transform(F.from_json(t, "array<string>"), lambda x, i: fn(F.concat(F.lit("item_"), i.cast("string")), x))
    return F.when(kind == "{", obj).when(kind == "[", arr)


def _entries(t: Column, kind: Column) -> Column:
    return _each(t, kind, lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def _scalar_text(v: Column) -> Column:
    """Python str() of a scalar: None, True/False, numbers and strings as is."""
    head = F.substring(F.ltrim(v, F.lit(" \t\r\n")), 1, 4)
    is_bool = F.when(head.isin("true", "fals"), F.coalesce(F.schema_of_variant(F.try_parse_json(v)) == "BOOLEAN", F.lit(False)))
    return (F.when(v.isNull(), F.lit("None"))
            .when(is_bool, F.when(v == "true", F.lit("True")).otherwise(F.lit("False")))
            .otherwise(v))


def json_depth(c) -> Column:
    """How deep the brackets of a JSON text nest; those in strings do not count."""
    bare = F.regexp_replace(col_of(c), r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[{\]}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def take(a, m):
        now = a["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))
    return F.coalesce(F.aggregate(marks, start, take, lambda a: a["most"]), F.lit(0))


def flatten_json(c, max_depth: int = 16) -> Column:
    """Text form of a JSON value (F13): ``path: value`` joined by ``; ``,
    list items as ``path.item_i``, nested containers repeat their path
    (``a: a.b: 1``), null → None, booleans → True/False, empty
    containers → empty text after the colon.  Object keys keep source
    order.  An expression has a fixed depth: what nests deeper than
    ``max_depth`` is kept as JSON text.  :func:`flatten_text` measures it."""
    def rec(t: Column, kind: Column, sure: Column, path, level: int) -> Column:
        if level >= max_depth:
            return t

        def one(e):
            kp = e["k"] if path is None else F.concat(path, F.lit("."), e["k"])
            return let(F.struct(kp.alias("p"), _kind(e["v"], sure).alias("c")), lambda x: F.concat(
                x["p"], F.lit(": "), F.when(x["c"].isNotNull(), rec(e["v"], x["c"], sure, x["p"], level + 1)).otherwise(_scalar_text(e["v"]))))
        return F.array_join(F.transform(_entries(t, kind), one), "; ")

    def top(x):
        decoded = F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "string"), x)
        return let(F.struct(_kind(x).alias("c"), (~x.rlike(_INNER_JSON)).alias("sure")), lambda s: F.when(
            s["c"].isNotNull(), rec(x, s["c"], s["sure"], None, 0)).otherwise(_scalar_text(decoded)))
    return let(col_of(c), top)


def flatten_text(df: DataFrame, c, out: str) -> DataFrame:
    """``df`` with the text form ``out`` of every value, however deep: one scan
    finds the greatest depth, for which the expression is built."""
    deepest = df.agg(F.max(json_depth(c))).first()[0] or 0
    return df.withColumn(out, flatten_json(c, deepest + 1))


def _leaves(c: Column, path: Column, levels: int) -> Column:
    """ARRAY<STRUCT<path, value, kind>> of a JSON container: its scalars, and
    with their ``kind`` the containers below ``levels`` of them."""
    def rec(t: Column, kind: Column, sure: Column, at, level: int) -> Column:
        def one(e):
            kp = F.when(at.isNull(), e["k"]).otherwise(F.concat(at, F.lit("."), e["k"])) if level == 1 else F.concat(
                at, F.lit("."), e["k"])

            def leaf(x):
                value = F.when(x["c"].isNull(), _scalar_text(e["v"])).otherwise(e["v"])
                own = F.array(F.struct(x["p"].alias("path"), value.alias("value"), x["c"].alias("kind")))
                return own if level >= levels else F.when(x["c"].isNotNull(), rec(
                    e["v"], x["c"], sure, x["p"], level + 1)).otherwise(own)
            return let(F.struct(kp.alias("p"), _kind(e["v"], sure).alias("c")), leaf)
        return F.flatten(F.transform(_entries(t, kind), one))
    return let(F.struct(c.alias("t"), _kind(c).alias("c"), (~c.rlike(_INNER_JSON)).alias("sure"), path.alias("p")),
               lambda x: rec(x["t"], x["c"], x["sure"], x["p"], 1))


def flatten_leaves(df: DataFrame, key: str, c, levels: int = 16) -> DataFrame:
    """(key, path, value) for every scalar leaf, at any depth.  One expression
    takes ``levels`` levels of a row, without a shuffle; what one scan finds to
    be deeper, or may be JSON within a string, is checkpointed and goes on."""
    seen = df.agg(F.max(json_depth(c)), F.max(col_of(c).rlike(_INNER_JSON))).first()
    depth, inner = seen[0] or 0, bool(seen[1])
    cur = df.select(F.col(key), F.lit(None).cast("string").alias("path"), col_of(c).alias("v"))
    leaves = None
    while True:
        step = max(1, min(levels, depth))
        found = cur.select(key, F.explode_outer(_leaves(F.col("v"), F.col("path"), step)).alias("e")).select(key, "e.*")
        leaf = found.filter("kind is null and path is not null").select(key, "path", "value")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if depth <= levels and not inner:
            return leaves
        cur = found.filter("kind is not null").select(key, "path", F.col("value").alias("v")).checkpoint()
        if cur.isEmpty():
            return leaves
        depth = max(depth - step, 1) if not inner else levels


def json_docs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents from JSON texts (S4): a top-level array gives one document
    per item with ``item_index``; anything else one document; a text that
    does not parse gives one document recording the error."""
    p = df.select(key, F.col(text).alias("_t"), strict_parse_json(F.col(text)).alias("_v"))
    is_arr = F.coalesce(F.schema_of_variant("_v").startswith("ARRAY"), F.lit(False))
    items = F.from_json(F.col("_t"), "array<string>")
    parts = (p.filter(is_arr).select(key, F.posexplode(items).alias("item_index", "_item"))
             .unionByName(p.filter(F.col("_v").isNotNull() & ~is_arr).select(
                 key, F.lit(None).cast("int").alias("item_index"), F.col("_t").alias("_item"))))
    good = flatten_text(parts, F.col("_item"), "page_content").select(
        key, F.col("item_index").cast("int"), "page_content", F.lit(None).cast("string").alias("error"))
    bad = p.filter(F.col("_v").isNull()).select(
        key, F.lit(None).cast("int").alias("item_index"),
        F.concat(F.lit("Error processing file: "), F.col(key).cast("string"), F.lit(". Error: invalid JSON")).alias("page_content"),
        F.lit("invalid JSON").alias("error"))
    return good.unionByName(bad).withColumn("type", F.lit("synthesis"))


# ------------------------------------------------------------------ F28, F29 contract checks

_WORD = r"(^|[^\p{L}\p{N}_])"
_END = r"($|[^\p{L}\p{N}_])"
VAGUE = _WORD + r"(this paper|this study|this)" + _END
METADATA = _WORD + r"(doi|title|authors?)" + _END


def qa_contract_check(df: DataFrame, doc: str, min_pairs: int = 5, max_pairs: int = 10, min_chars: int = 200) -> DataFrame:
    """Adds ``violations`` per QA row: pair count of the document outside
    [min_pairs, max_pairs], vague reference, metadata question, empty
    reasoning, too short (F28).  Counting is a per-document aggregate
    joined back (one row per document)."""
    cnt = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(cnt, doc)
    q = F.lower(F.col("question"))
    checks = [
        F.when((F.col("_n") < min_pairs) | (F.col("_n") > max_pairs), F.lit("pair_count")),
        F.when(q.rlike(VAGUE), F.lit("vague_reference")),
        F.when(q.rlike(METADATA), F.lit("metadata")),
        F.when(F.length(strip(F.coalesce("reasoning", F.lit("")))) == 0, F.lit("empty_reasoning")),
        F.when(F.length(F.concat_ws("", "question", "reasoning", "answer")) < min_chars, F.lit("too_short")),
    ]
    return d.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull())).drop("_n")


# Activation types and reaction types named by the template.
ACTIVATION_TYPES = ["Thermal", "Tip", "Photo"]
REACTION_TYPES = [
    "Ullmann Coupling", "Sonogashira Coupling", "Glaser Coupling", "Other C-C homo-Coupling",
    "Other C-C cross-Coupling", "Bergman Coupling", "Intramolecular Diels-Alder", "Hopf cyclization",
    "Cyclotrimerization", "Cyclodehydrogenation", "Cyclodehydrofluorization", "Other Cycloaddition",
    "Imine formation", "Dehydration of boronic acids", "Click reaction", "Ether formation", "Desulfonylation",
    "Skeletal rearrangements of polycyclic conjugated hydrocarbons", "Metathesis reaction",
    "Decomposition reaction", "Condensation of alcohol and acyl-chloride", "Urea formation", "Heck reaction",
    "Si-Si bond formation",
]
PHOTO_FIELDS = ["wavelength", "irradiationTime"]
THERMAL_FIELDS = ["annealingTemperature", "annealingTime"]
TIP_FIELDS = ["bias", "tunnelingCurrent", "setpoint", "tipHeight", "operationTime_s", "operationSite"]
# a quantity carries a unit when letters or a degree sign follow its number
UNIT = r"[-−+]?\d+(\.\d+)?\s*(°|℃|[A-Za-zμÅ])"


def extraction_contract_check(stages: DataFrame, type_col: str = "type", cond_col: str = "conditions",
                              reaction_col: str = "reactionType") -> DataFrame:
    """Adds ``violations`` per stage row (F29): unknown activation type,
    unknown reaction type, conditions filled that belong to another
    activation type, quantities without a unit."""
    t = F.col(type_col)
    checks = [F.when(t.isNotNull() & ~t.isin(*ACTIVATION_TYPES), F.lit("activation_type")),
              F.when(F.col(reaction_col).isNotNull() & ~F.col(reaction_col).isin(*REACTION_TYPES), F.lit("reaction_type"))]
    for kind, fields in (("Photo", PHOTO_FIELDS), ("Thermal", THERMAL_FIELDS), ("Tip", TIP_FIELDS)):
        filled = F.lit(False)
        for f in fields:
            filled = filled | F.col(f"{cond_col}.{f}").isNotNull()
        checks.append(F.when(filled & (F.coalesce(t, F.lit("")) != kind), F.lit(f"{kind.lower()}_fields")))
    unitless = F.lit(False)
    for f in ["annealingTemperature", "annealingTime", "bias", "tunnelingCurrent", "wavelength", "irradiationTime"]:
        v = F.col(f"{cond_col}.{f}")
        unitless = unitless | (v.isNotNull() & ~v.rlike(UNIT))
    checks.append(F.when(unitless, F.lit("missing_unit")))
    return stages.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))
