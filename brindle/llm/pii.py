"""Personal data: pattern spans, and terms that would give a protected entity away.

Emails, addresses, cards and phone numbers are found by patterns. The values found are protected
entities. A term that stands near an entity reveals it as far as the two go together in the corpus:
PMI(entity; term) over the entity's own information, both from counts over all distinct texts. In
documents that hold the entity, terms above the upper threshold are removed, and those above the
lower one are generalised to their kind. Everything is DataFrame expressions; no Python runs on rows.

Defined results: a null text has no span (and stays null when sanitised); documents are judged row by
row, so repeated rows get equal results; an empty table gives an empty result; further columns pass
through `sanitise`, and its own helper columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, has_rows, materialize, shielded

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written without needless retries: a run is tried from its start or the last match's end, and parts that nothing follows are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What is near an entity: the whole words of either side, up to so many, within so many characters.
NEAR_WORDS, NEAR_CHARS = 8, 1000
#: Distinct texts in which an entity and a term must meet before the counts say anything.
SUPPORT = 3
#: Disclosure (part of the entity's information) from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.7, 0.9
_WORD = r"[\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _luhn_digit(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the pattern's matches, in order; places are code points, counted over gaps and matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.aggregate(
        F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("g"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["v"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), (a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["v"])).alias("end"), x["v"].alias("value")))).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, start["out"]).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = F.filter(matches(text, F.lit(PATTERNS[kind]), kind), lambda s: valid(kind, s["value"]))
    hint = F.instr(text, HINTS[kind]) > 0 if HINTS[kind] else text.rlike("[0-9]")
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def with_base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with spans_<kind>, each found once: the explode of one struct keeps the expressions from being copied upwards."""
    found = F.struct(*[base_spans(F.col(text_col), k).alias(f"spans_{k}") for k in KINDS])
    names = [c for c in docs.columns if c not in {f"spans_{k}" for k in KINDS}]
    return docs.select(*names, F.explode(F.array(found)).alias("_found")).select(*names, "_found.*")


def all_base() -> Column:
    return F.concat(*[F.col(f"spans_{k}") for k in KINDS])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosure(n: Column) -> Column:
    """PMI of entity and term over the entity's information, from n_both, n_entity, n_term and the number of texts."""
    pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    return pmi / F.greatest(F.log(n / F.col("n_entity")), F.lit(1e-9))


def revealing_terms(docs: DataFrame, text_col: str, support: int = SUPPORT, near: int = NEAR_WORDS) -> DataFrame:
    """(text_key, term, disclosure): terms that reveal an entity of the text, from co-occurrence over all distinct texts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text"))
    spans = with_base_spans(keyed, "text").withColumn("span", F.explode(all_base()))
    words = lambda part: F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    before = F.substring(F.col("text"), F.greatest(F.col("span.start") - NEAR_CHARS, F.lit(0)) + 1, F.least(F.col("span.start"), F.lit(NEAR_CHARS)))
    after = F.substring(F.col("text"), F.col("span.end") + 1, F.lit(NEAR_CHARS))
    # a word that the edge may have cut is no whole word
    before = words(F.when(F.col("span.start") > NEAR_CHARS, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before))
    after = words(F.when(F.length(after) == NEAR_CHARS, F.regexp_replace(after, r"[\p{L}\p{N}]++$", "")).otherwise(after))
    tail = lambda a: F.slice(a, F.greatest(F.size(a) - near + 1, F.lit(1)), F.lit(near))
    terms = F.array_distinct(F.concat(tail(before), F.slice(after, 1, near)))
    value = F.when(F.col("span.kind") == "email", F.lower("span.value")).otherwise(F.regexp_replace("span.value", "[^0-9.]", ""))
    seen = materialize(spans.select("text_key", F.concat_ws(":", "span.kind", value).alias("entity"), terms.alias("terms")).distinct(), "entities")
    met = seen.select("text_key", "entity", F.explode("terms").alias("term")).distinct()
    n = F.lit(float(keyed.select("text_key").distinct().count()))
    n_entity = seen.select("text_key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    joint = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support).join(n_entity, "entity")
    # a term is in at least as many texts as it stands near some entity in: what cannot reach the threshold even so needs no count
    near_any = met.select("text_key", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    joint = joint.join(near_any, "term").where(disclosure(n) >= GENERALISE).drop("n_term")
    joint = materialize(joint, "joint")
    empty = spark.createDataFrame([], "text_key long, term string, disclosure double")
    if not has_rows(joint):
        return empty
    # the terms' frequencies over the whole corpus: only words that are candidates are kept, and texts count once
    wanted = joint.select("term").distinct()
    in_text = keyed.select("text_key", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
    n_term = in_text.join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = joint.join(n_term, "term").withColumn("disclosure", disclosure(n))
    scored = scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")
    return materialize(met.select("text_key", "entity").distinct().join(scored, "entity").groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure")), "revealing")


def term_spans(text: Column, terms: Column) -> Column:
    """Where the terms stand as whole words, in any case."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return matches(text, pattern, "term")


def found_terms(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(text_key, term_spans): spans in the texts that hold revealing terms; kind is term (removed) or general (generalised); none overlaps a base span."""
    by_text = terms.groupBy("text_key").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term")))).alias("removed"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(by_text, "text_key").dropDuplicates(["text_key"])
    found = with_base_spans(keyed, "text").withColumn("base", all_base())
    spans = F.filter(term_spans(F.col("text"), F.col("terms")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    named = F.transform(spans, lambda s: F.struct(F.when(F.array_contains("removed", F.lower(s["value"])), F.lit("term")).otherwise(F.lit("general")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return found.select("text_key", named.alias("term_spans"))


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with n_<kind>, base_sha256, spans; the text itself is not moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    own = docs.select(*keep, F.col(text_col).alias("_text"), F.xxhash64(text).alias("text_key"))
    base = with_base_spans(own, "_text").drop("_text")
    base = base.select(*keep, "text_key", *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS], written(all_base()).alias("base"))
    terms = revealing_terms(docs, text_col)
    if has_rows(terms):
        base = base.join(found_terms(docs, text_col, terms), "text_key", "left")
        more = F.coalesce(written(F.col("term_spans")), F.lit(""))
        spans = F.array_join(F.filter(F.array(F.col("base"), more), lambda s: s != ""), ",")
    else:
        spans = F.col("base")
    return base.select(*keep, *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first to begin counts, and its reach is theirs."""
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    tag = lambda s: F.when(s["kind"] == "term", F.lit("[REMOVED]")).when(s["kind"] == "general", F.when(s["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    done = F.aggregate(
        sorted_,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), tag(s))).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text sanitised; only texts with revealing terms are moved."""
    names = docs.columns
    plain = with_base_spans(docs, text_col).withColumn("spans", all_base())
    terms = revealing_terms(docs, text_col)
    if has_rows(terms):
        with_span = plain.where(F.size("spans") > 0).withColumn("text_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
        with_span = with_span.join(found_terms(docs, text_col, terms), "text_key", "left").withColumn("spans", F.concat("spans", F.coalesce("term_spans", F.array().cast(SPAN))))
        plain = plain.where(F.size("spans") == 0).select(*names, "spans").unionByName(with_span.select(*names, "spans"))
    return plain.select(*[replaced(F.col(text_col), F.col("spans")).alias(text_col) if c == text_col else F.col(c) for c in names])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sanitised, n_chars counted anew; all other columns pass, whatever they are called. A null text stays null and has no n_chars."""
    plain, own, back = shielded(docs)
    out = sanitise(plain, own["text"])
    return out.select(*[F.length(own["text"]).cast("long").alias(c) if c == "n_chars" else b for c, b in zip(docs.columns, back)])
