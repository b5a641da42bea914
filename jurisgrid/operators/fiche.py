"""Assembled results of parsed documents: provisions, map, blocks, connections, relationships, timeline, amendments, quality, status, the fiche.

All of them unfold or fold the arrays of one row of :func:`jurisgrid.operators.parsing.parse_documents`, so none shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisgrid.functions.registry import CLASSIFICATION_VALUES, CONCEPTS, DIMENSIONS, TYPES


def unfold(parsed: DataFrame, column: str, key: str = "doc_id", *carry: str) -> DataFrame:
    """One row for each struct of an array column, with the key and the columns ``carry``."""
    return parsed.select(key, *carry, F.explode(column).alias("_x")).select(key, *carry, "_x.*")


def provisions(parsed: DataFrame, key: str = "doc_id", *carry: str) -> DataFrame:
    """Elements with text, one for each id: the first core unit, else the first element."""
    return unfold(parsed, "elements", key, *carry).where("chosen and not is_empty")


def document_map(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, id, label, level, type, is_empty): header, preamble and recitals, then the elements in the order of the text."""
    front = F.filter("blocks", lambda b: b["key"].isin("header", "preamble", "recitals"))
    rank = lambda b: F.when(b["key"] == "header", 0).when(b["key"] == "preamble", 1).otherwise(2)
    blocks = F.transform(front, lambda b: F.struct(rank(b).cast("long").alias("o"), F.lit("").alias("s"), b["id"].alias("id"), b["heading"].alias("label"), F.lit(0).alias("level"), b["type"].alias("type"), F.lit(False).alias("is_empty")))
    label = lambda e: F.coalesce(e["title"], F.nullif(e["heading"], F.lit("")), F.concat_ws(" ", e["type"], e["identifier"]))
    elements = F.transform(F.filter("elements", lambda e: e["chosen"]), lambda e: F.struct((e["position"] + 3).cast("long").alias("o"), e["sort_key"].alias("s"), e["id"].alias("id"), label(e).alias("label"), F.greatest(F.lit(0), e["level"]).alias("level"), e["type"].alias("type"), e["is_empty"].alias("is_empty")))
    return parsed.select(key, F.posexplode(F.concat(F.sort_array(blocks), F.sort_array(elements))).alias("n", "x")).select(key, "n", "x.id", "x.label", "x.level", "x.type", "x.is_empty")


def connections(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, refs, resolved, unresolved, summary) of documents with references."""
    n = F.size("refs")
    there = F.size(F.filter("refs", lambda r: r["resolved"]))
    text = F.concat(there.cast("string"), F.lit(" internal reference(s) resolved; "), (n - there).cast("string"), F.lit(" unresolved or external reference(s)."))
    return parsed.where("size(refs) > 0").select(key, n.alias("refs"), there.alias("resolved"), (n - there).alias("unresolved"), text.alias("summary"))


def relationships(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, type, label, source_id, target_id, source_known, target_known, confidence): known are the ids of provisions."""
    ids = F.transform(F.filter("elements", lambda e: e["chosen"] & ~e["is_empty"]), lambda e: e["id"])
    rows = parsed.select(key, ids.alias("_ids"), F.posexplode("relations").alias("n", "r"))
    known = lambda c: F.coalesce(F.array_contains("_ids", F.col(c)), F.lit(False))
    return rows.select(
        key, F.concat(F.lit("REL-"), F.lpad((F.col("n") + 1).cast("string"), 4, "0")).alias("id"), F.col("r.type").alias("type"), F.initcap(F.regexp_replace("r.type", "[-_]+", " ")).alias("label"), F.col("r.source_id").alias("source_id"), F.col("r.target_id").alias("target_id"),
        known("r.source_id").alias("source_known"), known("r.target_id").alias("target_known"), F.col("r.confidence").alias("confidence"),
    )


def timeline(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, date, type, label): dated events of a document in the order of their years."""
    m = lambda *names: F.coalesce(*[F.try_element_at("metadata", F.lit(x)) for x in names])
    event = lambda o, date, kind, label: F.struct(F.concat(rough_date_key(date), F.lit("-"), date).alias("k"), F.lit(o).alias("o"), date.alias("date"), F.lit(kind).alias("type"), label.alias("label"))
    events = F.array(
        event(0, m("adoption_date"), "adoption", F.lit("Adopted")), event(1, m("date_force", "entry_into_force"), "entry-into-force", F.lit("Entry into force")),
        event(2, m("transposition_deadline"), "deadline", F.lit("Transposition deadline")), event(3, m("signature_date"), "signature", F.when(F.col("kind") == "contract", "Signed").otherwise("Signature")),
    )
    dated = F.sort_array(F.filter(events, lambda e: e["date"].isNotNull()))
    return parsed.select(key, F.posexplode(dated).alias("n", "e")).select(key, "n", "e.date", "e.type", "e.label")


def amendment_tracker(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, heading, source_id, affected): amendments with the ids of the provisions that amend."""
    named = F.transform("amendments", lambda a: a["canonical_id"])
    touched = F.transform(F.filter("elements", lambda e: e["chosen"] & ~e["is_empty"] & (e["is_amendment"] | F.coalesce(F.array_contains(named, e["id"]), F.lit(False)))), lambda e: e["id"])
    return parsed.select(key, touched.alias("affected"), F.explode("amendments").alias("a")).select(key, "a.id", "a.heading", F.col("a.canonical_id").alias("source_id"), "affected")


def status(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, label): amendment signals, else a signed contract, else parsed (or unprocessed without any text)."""
    signed = (F.col("kind") == "contract") & F.try_element_at("metadata", F.lit("signature_date")).isNotNull()
    state = F.when(F.col("status") == "empty", "unprocessed").when(F.size("amendments") > 0, "amendment-signals").when(signed, "signed-source").otherwise("parsed")
    return parsed.select(key, state.alias("status"), F.initcap(F.regexp_replace(state, "-", " ")).alias("label"))


def quality_report(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, provisions, refs, resolved_refs, anchored, coverage, fallback, warnings) of every document."""
    own = F.filter("elements", lambda e: e["chosen"] & ~e["is_empty"])
    anchored = F.size(F.filter(own, lambda e: e["position"].isNotNull()))
    return parsed.select(
        key, F.size(own).alias("provisions"), F.size("refs").alias("refs"), F.size(F.filter("refs", lambda r: r["resolved"])).alias("resolved_refs"), anchored.alias("anchored"),
        F.when(F.size(own) > 0, F.round(anchored / F.size(own), 3)).otherwise(0.0).alias("coverage"), ((F.col("kind") == "unknown") & (F.col("status") == "no-structure")).alias("fallback"), F.size("warnings").alias("warnings"),
    )


def fiches(parsed: DataFrame, key: str = "doc_id", *carry: str) -> DataFrame:
    """One assembled row a document; a document that could not be parsed gets the fallback: one provision RAW-0001 with its title.

    Columns ``title``, ``short_title``, ``reference``, ``jurisdiction``, ``authority`` and ``date`` of an identity, if among ``carry``, override
    what the parser found.
    """
    m = lambda name: F.try_element_at("metadata", F.lit(name))
    own = lambda name, other: F.coalesce(F.col(name), other) if name in carry else other
    kept = F.transform(F.filter("elements", lambda e: e["chosen"] & ~e["is_empty"]), lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), e["heading"].alias("heading"), e["content"].alias("content"), e["citation"].alias("citation"), e["parent_id"].alias("parent_id"), e["outgoing"].alias("outgoing"), e["unresolved"].alias("unresolved")))
    raw = F.array(F.struct(F.lit("RAW-0001").alias("id"), F.lit("RAW").alias("type"), F.col("title").alias("heading"), F.lit("").alias("content"), F.col("title").alias("citation"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("outgoing"), F.lit(0).alias("unresolved")))
    number = F.coalesce(*[m(x) for x in ("regulation_number", "directive_number", "case_number", "act_number", "title")], F.lit("document"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(number), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 96)
    failed = F.col("status") == "empty"
    signals = lambda kind: F.filter("signals", lambda x: x["kind"] == kind)
    signed = (F.col("kind") == "contract") & m("signature_date").isNotNull()
    return parsed.select(
        key, slug.alias("document_id"), "kind", own("display_title", F.col("title")).alias("title"), own("short_title", m("short_title")).alias("short_title"), own("reference", m("reference")).alias("reference"), own("jurisdiction", m("jurisdiction")).alias("jurisdiction"),
        own("authority", m("authority")).alias("authority"), own("date", m("adoption_date")).alias("date"), "document_citation", "summary",
        F.when(failed, "unprocessed").when(F.size("amendments") > 0, "amendment-signals").when(signed, "signed-source").otherwise("parsed").alias("status"),
        F.when(failed, raw).otherwise(kept).alias("provisions"), "blocks", "refs", "citations", "relations", "amendments", "parties",
        *[signals(k).alias(k.replace("-", "_")) for k in ("boilerplate", "separate-opinion", "transposition")], "warnings", (failed | ((F.col("kind") == "unknown") & (F.col("status") == "no-structure"))).alias("fallback"),
    )


def concept_index(texts: DataFrame, key: str = "doc_id", text: str = "content", language: str = "lang") -> DataFrame:
    """(key, canonical_id, concept, n): whole-word counts of the dictionary's concepts; languages but French use English.

    The dictionary is unrolled into the expression, so there is no cross join.
    """
    word = lambda c: rf"(?i)(?<![A-Za-z0-9_]){c}(?![A-Za-z0-9_])"
    hits = lambda lang: F.array(*[F.struct(F.lit(c).alias("concept"), F.regexp_count(F.col(text), F.lit(word(c))).alias("n")) for c in CONCEPTS[lang]])
    rows = texts.select(key, "canonical_id", F.explode(F.when(F.col(language) == "fr", hits("fr")).otherwise(hits("en"))).alias("c"))
    return rows.select(key, "canonical_id", "c.concept", "c.n").where("n > 0")


def concept_totals(index: DataFrame) -> DataFrame:
    return index.groupBy("concept").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("provisions"))


def rough_date_key(c: Column) -> Column:
    """First number of four digits, else 9999."""
    y = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![A-Za-z0-9_])(\d{4})(?![A-Za-z0-9_])", 1)
    return F.when(y == "", "9999").otherwise(y)


def warnings_of(df: DataFrame, key: str, stage: str, rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """(key, stage, code, detail): one row for each rule whose condition holds; a null condition doesn't."""
    rows = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(d) if isinstance(d, str) else d).alias("detail"))) for code, cond, d in rules]))
    return df.select(key, F.lit(stage).alias("stage"), F.explode(rows).alias("w")).select(key, "stage", "w.code", "w.detail").distinct()


def validate_extraction(df: DataFrame, key: str = "extraction_id") -> DataFrame:
    """Warnings for missing required fields, too short and missing text."""
    need = [("VALIDATION_REQUIRED_FIELD", F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in ("filename", "raw_text", "normalized_text", "extraction_method")]
    short = F.length(F.trim(F.coalesce(F.col("normalized_text"), F.lit("")))) < 50
    return warnings_of(df, key, "extraction", [*need, ("VALIDATION_EXTRACTION_TOO_SHORT", short, ""), ("VALIDATION_RAW_TEXT_MISSING", F.coalesce(F.col("raw_text"), F.lit("")) == "", "")])


def validate_classification(df: DataFrame, key: str = "fiche_id", kind: str = "document_type") -> DataFrame:
    """Warnings for unregistered types and for dimensions that the type's default leaves open."""
    known = F.coalesce(F.col(kind).isin(*TYPES), F.lit(False))
    open_types = [t for t, d in DIMENSIONS.items() if d[1] is None]
    return warnings_of(df, key, "classification", [("VALIDATION_UNKNOWN_DOCUMENT_TYPE", ~known, F.coalesce(F.col(kind), F.lit(""))), ("VALIDATION_CLASSIFICATION_MISSING", F.col(kind).isin(*open_types), "origin")])


def validate_dimensions(df: DataFrame, key: str, stage: str) -> DataFrame:
    """Warnings for each of the four dimensions (columns of these names) that is missing or has a value that isn't registered."""
    rules: list[tuple[str, Column, Column | str]] = []
    for name, values in CLASSIFICATION_VALUES.items():
        empty = F.coalesce(F.col(name), F.lit("")) == ""
        rules += [("VALIDATION_CLASSIFICATION_MISSING", empty, name), ("VALIDATION_CLASSIFICATION_VALUE", ~empty & ~F.col(name).isin(*values), F.concat(F.lit(f"{name}="), F.col(name)))]
    return warnings_of(df, key, stage, rules)


def validate_detection(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Warnings for detections of an unregistered type, and for types taken below a confidence of 70."""
    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    return warnings_of(df, key, "detection", [("VALIDATION_UNKNOWN_DOCUMENT_TYPE", ~known, F.coalesce(F.col("type"), F.lit(""))), ("VALIDATION_LOW_AUTO_CONFIDENCE", (F.col("decision") == "auto") & (F.col("confidence") < 70), "")])


def validate_parsed(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Warnings for documents without elements."""
    return warnings_of(parsed, key, "parserOutput", [("VALIDATION_NO_PARSED_ELEMENTS", F.size("elements") == 0, "")])


def validate_fiche(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Warnings for fiches (columns provisions and canonical_id) without an array of provisions or an identity."""
    return warnings_of(df, key, "fiche", [("VALIDATION_PROVISIONS_NOT_ARRAY", F.col("provisions").isNull(), ""), ("VALIDATION_FICHE_IDENTITY_MISSING", F.coalesce(F.col("canonical_id"), F.lit("")) == "", "")])


def validate_identity(df: DataFrame, key: str = "identity_id") -> DataFrame:
    """Warnings for unknown jurisdiction, authority, date and reference, and for an id that doesn't hold its fingerprint."""
    unknown = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "unknown")
    return warnings_of(df, key, "identity", [
        ("IDENTITY_JURISDICTION_UNKNOWN", unknown("jurisdiction"), ""), ("IDENTITY_AUTHORITY_UNKNOWN", unknown("authority"), ""), ("IDENTITY_DATE_UNKNOWN", unknown("identity_date"), ""), ("IDENTITY_REFERENCE_UNKNOWN", unknown("reference"), ""),
        ("VALIDATION_IDENTITY_NOT_FINGERPRINTED", ~F.col("canonical_id").contains(F.substring("fingerprint", 1, 10)), ""),
    ])


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose concatenated columns contain the query, whatever the case; a blank query finds all."""
    q = query.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q))) if q else df


def highlight(c: Column, query: str) -> Column:
    """Text with the query's occurrences marked, after escaping markup."""
    import re

    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, "(?iu)(" + re.escape(query) + ")", "<mark>$1</mark>") if query.strip() else safe


def explanations(citation: Column, heading: Column, concepts: Column) -> Column:
    """Map of reading mode to the explanation of a provision in that mode."""
    text = {
        "lawyer": F.concat(citation, F.lit(" should be read as a source rule. Key legal hooks: "), concepts, F.lit(".")),
        "policy": F.concat(F.lit("In policy terms, "), F.lower(heading), F.lit(" explains how the rule changes institutional and business behaviour.")),
        "plain": F.concat(F.lit("In everyday terms: "), heading, F.lit(" tells what one can or cannot do, and what to check first.")),
        "student": F.concat(F.lit("Exam hook: connect this provision to "), concepts, F.lit(", then cite "), citation, F.lit(" as the source before giving examples.")),
    }
    return F.create_map(*[x for k, v in text.items() for x in (F.lit(k), v)])
