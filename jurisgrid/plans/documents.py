"""Queries of parsed documents: structure by type, references, blocks, metadata, fiches, and the whole pipeline over extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisgrid.common import cut, latest, table
from jurisgrid.functions import forms
from jurisgrid.functions.numbers import parse_canonical_id
from jurisgrid.operators import detection, fiche, identity
from jurisgrid.operators.parsing import parse_documents
from jurisgrid.plans.documents_sql import SQL  # noqa: F401 - read by the contract
from jurisgrid.plans.reference import docs_of
from jurisgrid.sources import files


def _parsed(spark: SparkSession, d: str, content: bool = False, kind: str | None = None) -> DataFrame:
    """Documents by their delivered type, parsed; of one type only if ``kind`` is given."""
    docs = docs_of(spark, d)
    return parse_documents(docs if kind is None else docs.where(F.col("kind") == kind), content=content)


def _of_type(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = fiche.unfold(_parsed(spark, d, kind=kind), "elements")
        if kind == "judgment":
            rows = rows.where("type in ('SECT', 'PARA', 'SUBPARA')")
        elif kind in ("regulation", "directive"):
            rows = rows.where("type <> 'PARA'")
        columns = ["doc_id", "type", "level", "identifier", "position", "line_no"]
        return rows.select(*columns) if kind == "judgment" else rows.select(*columns, "end_position", "tree_parent", "char_length", "is_empty")

    run.__name__, run.__doc__ = f"elements_{kind}", f"Elements of {kind} documents with extents, parents and sizes."
    return run


def article_paragraphs(spark, d):
    return fiche.unfold(_parsed(spark, d), "elements").where("type = 'PARA' and parent_id like 'ART-%'").select("doc_id", "id", "parent_id", "position", "char_length", "is_empty")


def judgment_blocks(spark, d):
    """Prose blocks of French judgments."""
    return fiche.unfold(_parsed(spark, d, kind="judgment"), "elements").where("type not in ('SECT', 'PARA', 'SUBPARA')").select("doc_id", "id", "type", "role", "heading", "position", "end_position", "char_length")


def elements(spark, d):
    return fiche.unfold(_parsed(spark, d), "elements", "doc_id", "kind").select("doc_id", "kind", "id", "type", "level", "sort_key", "position", "line_no", "title")


def elements_by_type(spark, d):
    return fiche.unfold(_parsed(spark, d), "elements", "doc_id", "kind").groupBy("kind", "type", "level").agg(F.count(F.lit(1)).alias("n"))


def hierarchy_tree(spark, d):
    """The tree of each document in pre-order, flattened."""
    return fiche.unfold(_parsed(spark, d), "elements").select("doc_id", "id", "position", "tree_parent", "depth", "children")


def element_contents(spark, d):
    return fiche.unfold(_parsed(spark, d, content=True), "elements").select("doc_id", "id", "position", "char_length", "word_count", "is_empty", F.md5("content").alias("hash"))


def canonical_parts(spark, d):
    """Ids of elements taken apart again."""
    ids = table(spark, d, "elements").select("canonical_id").where("canonical_id is not null").distinct()
    return ids.withColumn("p", parse_canonical_id(F.col("canonical_id"))).select("canonical_id", "p.*")


def xrefs(spark, d):
    return fiche.unfold(_parsed(spark, d), "refs").select("doc_id", "source_id", "source_type", "target_id", "kind", "position", "resolved")


def xref_kinds(spark, d):
    return fiche.unfold(_parsed(spark, d), "refs", "doc_id", "language").groupBy("language", F.col("kind").alias("reference"), "resolved").agg(F.count(F.lit(1)).alias("n"))


def xref_contexts(spark, d):
    return fiche.unfold(_parsed(spark, d, content=True), "refs").select("doc_id", "source_id", "target_id", "position", "context")


def connections(spark, d):
    return fiche.connections(_parsed(spark, d))


def _xrefs_of(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _parsed(spark, d, kind=kind).select("doc_id", F.transform("elements", lambda e: F.struct(e["id"], e["position"])).alias("es"), F.explode("refs").alias("r")).where(~F.col("r.source_type").isin("TREATY_PREAMBLE", "CLOSING", "ENACTMENT", "RECITALS", "SIGNATURES", "HEADER"))
        # The element that refers: the last of its id that begins before the reference.
        before = F.filter("es", lambda e: (e["id"] == F.col("r.source_id")) & (e["position"] <= F.col("r.position")))
        return rows.select("doc_id", F.array_max(F.transform(before, lambda e: e["position"])).alias("source_position"), "r.source_type", "r.prefix", "r.target", "r.kind", "r.position")

    run.__name__, run.__doc__ = f"xrefs_{kind}", f"References from the elements of {kind} documents."
    return run


def citations(spark, d):
    """Citations of judgments."""
    return fiche.unfold(_parsed(spark, d, kind="judgment"), "citations").select("doc_id", "id", "kind", "text", "position")


def citation_owner(spark, d):
    """Citations of judgments with the narrowest element that holds each."""
    return fiche.unfold(_parsed(spark, d, kind="judgment"), "citations").select("doc_id", "id", "kind", "text", "position", "owner_id", "owner_type", "section_role")


def section_linkback(spark, d):
    rows = fiche.unfold(_parsed(spark, d, kind="judgment"), "elements").where("type in ('PARA', 'SUBPARA')")
    return rows.select("doc_id", "id", "position", "section_id", "section_role")


def relations(spark, d):
    return fiche.unfold(_parsed(spark, d, kind="judgment"), "relations").select("doc_id", "type", "source_id", "target_id", F.size("source_ids").alias("sources"), F.size("target_ids").alias("targets"), "confidence")


def relationships(spark, d):
    return fiche.relationships(_parsed(spark, d))


def provisions(spark, d):
    return fiche.provisions(_parsed(spark, d)).select("doc_id", "id", "type", "level", "position", "parent_id", "word_count", "outgoing", "unresolved", "incoming", "citation", "is_amendment")


def document_map(spark, d):
    return fiche.document_map(_parsed(spark, d))


def special_blocks(spark, d):
    """Header, preamble, recitals, enactment, closing, signatures and disposition of each document."""
    return fiche.unfold(_parsed(spark, d, content=True), "blocks").select("doc_id", "key", "type", "heading", "position", "end_position", "detail", F.length("content").alias("characters"), "citation")


def concept_index(spark, d):
    """Concepts over the provisions of all documents."""
    own = fiche.provisions(_parsed(spark, d, content=True), "doc_id", "language").select("doc_id", "language", F.col("id").alias("canonical_id"), "content")
    return fiche.concept_totals(fiche.concept_index(own, language="language"))


def amendments(spark, d):
    return fiche.unfold(_parsed(spark, d), "amendments").select("doc_id", "id", "canonical_id", "heading", "position", "found_by")


def amendment_tracker(spark, d):
    return fiche.amendment_tracker(_parsed(spark, d)).select("doc_id", "id", "heading", "source_id", F.size("affected").alias("affected"))


def _signal(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fiche.unfold(_parsed(spark, d), "signals").where(F.col("kind") == kind).select("doc_id", "detail", "id", "heading", "position")

    run.__name__ = {"boilerplate": "boilerplate", "separate-opinion": "separate_opinions", "transposition": "transposition_articles", "commencement": "commencement", "claim": "judgment_claims", "authority": "judgment_authorities", "facts": "judgment_facts"}[kind]
    return run


def parties(spark, d):
    return _parsed(spark, d).where("size(parties) > 0").select("doc_id", "kind", F.posexplode("parties").alias("n", "party"))


def _metadata(kind: str, *fields: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _parsed(spark, d, kind=kind).where("status <> 'empty'")
        return rows.select("doc_id", *(["title"] if kind != "judgment" else []), *[F.try_element_at("metadata", F.lit(f)).alias(f) for f in fields])

    run.__name__ = f"metadata_{kind}"
    return run


def metadata_provenance(spark, d):
    """Where the metadata of judgments stand in the text: the first place of each value, whatever its case."""
    rows = fiche.unfold(_parsed(spark, d, kind="judgment"), "signals").where("kind = 'provenance'")
    return rows.select("doc_id", F.col("heading").alias("field"), F.col("detail").alias("value"), "position")


def parser_warnings(spark, d):
    return _parsed(spark, d).select("doc_id", "kind", F.explode("warnings").alias("code"))


def parser_stats(spark, d):
    n = lambda c: F.size(c).alias(c)
    return _parsed(spark, d).select("doc_id", "kind", "status", "core_units", n("elements"), n("refs"), n("citations"), n("relations"), n("amendments"), n("blocks"))


def summaries(spark, d):
    return _parsed(spark, d).where("status <> 'empty'").select("doc_id", "summary", "document_citation")


def document_status(spark, d):
    return fiche.status(_parsed(spark, d))


def timeline(spark, d):
    return fiche.timeline(_parsed(spark, d))


def quality_report(spark, d):
    return fiche.quality_report(_parsed(spark, d))


def validate_parsed(spark, d):
    return fiche.validate_parsed(_parsed(spark, d))


def validate_detection(spark, d):
    docs = docs_of(spark, d)
    return fiche.validate_detection(detection.decide(docs, detection.score_types(detection.scan_signals(docs))))


def validate_dimensions(spark, d):
    kinds = docs_of(spark, d).select("doc_id", F.col("kind").alias("type"))
    return fiche.validate_dimensions(detection.dimensions(kinds), "doc_id", "classification")


def study_counts(spark, d):
    """Articles and concepts of the corpus."""
    p = cut(_parsed(spark, d, content=True))
    own = fiche.provisions(p, "doc_id", "language").select("doc_id", "language", F.col("id").alias("canonical_id"), "type", "content")
    used = fiche.concept_index(own, language="language").agg(F.count_distinct("concept").alias("concepts"))
    return own.where("type = 'ART'").agg(F.count(F.lit(1)).alias("articles")).crossJoin(used)  # one row each


def study_search(spark, d):
    """Provisions that hold a phrase in heading or text, with the phrase marked in the heading; chapters without hits drop out."""
    own = fiche.provisions(_parsed(spark, d, content=True))
    return fiche.search(own, "contract", "heading", "content").select("doc_id", "id", "tree_parent", fiche.highlight(F.col("heading"), "contract").alias("marked"))


def study_explanations(spark, d):
    """For each article with concepts: its first three concepts in the order of the dictionary, in the words of the four reading modes."""
    own = fiche.provisions(_parsed(spark, d, content=True), "doc_id", "language").where("type = 'ART'").select("doc_id", "language", F.col("id").alias("canonical_id"), "heading", "content", "citation")
    found = fiche.concept_index(own, language="language").groupBy("doc_id", "canonical_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("concept")), 1, 3), ", ").alias("concepts"))
    return found.join(own.select("doc_id", "canonical_id", "heading", "citation"), ["doc_id", "canonical_id"]).select("doc_id", "canonical_id", F.explode(fiche.explanations(F.col("citation"), F.col("heading"), F.col("concepts"))).alias("mode", "text"))


def study_article(spark, d):
    """The article that is asked for in each document (the second), or its first one where it has no such."""
    own = fiche.provisions(_parsed(spark, d)).where("type = 'ART'")
    wanted = F.max_by(F.struct("id", "heading", "position"), F.struct(F.col("id") == "ART-0002", -F.col("position")))
    return own.groupBy("doc_id").agg(wanted.alias("a")).select("doc_id", "a.*")


def source_anchors(spark, d):
    """The unit that each heading of an extraction's elements comes from: the first that equals it or begins with it."""
    f = latest(table(spark, d, "fiches").select("fiche_id", "extraction_id", "loaded_at"), ["fiche_id"], "loaded_at").select("fiche_id", "extraction_id")
    e = table(spark, d, "elements").where("heading is not null").select("fiche_id", "canonical_id", "heading").distinct()
    u = latest(table(spark, d, "source_units").select("unit_id", "extraction_id", "unit_ref", "unit_order", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("t"), "page_number", "loaded_at"), ["unit_id"], "loaded_at")
    # Headings and units meet on their first eight characters in the document, so the comparison is an equi-join.
    head = F.lower(F.regexp_replace(F.trim("heading"), r"\s+", " "))
    left = e.join(f, "fiche_id").withColumn("h", head).where("length(h) >= 1").withColumn("k", F.substring("h", 1, 8))
    lengths = left.select("extraction_id", F.length("k").alias("n")).distinct()
    right = u.join(lengths, "extraction_id").withColumn("k", F.expr("substring(t, 1, n)"))
    hits = left.join(right, ["extraction_id", "k"]).where(F.col("t").startswith(F.col("h")))
    best = hits.groupBy("fiche_id", "canonical_id", "heading").agg(F.min_by(F.struct("unit_ref", "page_number"), F.struct("unit_order", "unit_ref")).alias("u"))
    return best.select("fiche_id", "canonical_id", "heading", "u.unit_ref", "u.page_number")


def extraction_defaults(spark, d):
    """Stored extractions as the pipeline takes them: text with fallbacks, figures."""
    ext = latest(table(spark, d, "extractions").select("extraction_id", "filename", "extraction_method", "raw_text", "normalized_text", "loaded_at").where("extraction_id is not null"), ["extraction_id"], "loaded_at")
    return files.normalize_extractions(ext).select("extraction_id", "filename", "extraction_method", "characters", "words", "units")


def _pipeline(spark: SparkSession, d: str, forced: str | None = None) -> DataFrame:
    """Extractions through detection, routing, parsing and identity: one row each."""
    ext = latest(table(spark, d, "extractions").select("extraction_id", "filename", "extraction_method", "raw_text", "normalized_text", "loaded_at").where("extraction_id is not null"), ["extraction_id"], "loaded_at")
    ext = cut(files.normalize_extractions(ext).select("extraction_id", "filename", "normalized_text"))
    decided = detection.decide(ext, detection.score_types(detection.scan_signals(ext, "extraction_id", "normalized_text", "filename"), "extraction_id"), "extraction_id")
    routed = detection.route(decided.withColumn("forced", F.lit(forced).cast("string")), "forced").select("extraction_id", F.col("type").alias("detected"), "parser", "reason", F.col("confidence").alias("detection_confidence"), "language_override", F.col("warning").alias("routing_warning"))
    docs = ext.join(routed, "extraction_id").withColumn("lang", F.coalesce("language_override", detection.detect_language(F.col("normalized_text"))))
    parsed = parse_documents(docs, "extraction_id", "normalized_text", "parser", "lang", "filename")
    kept = parsed.withColumnRenamed("status", "parse_status").join(docs.select("extraction_id", "filename", F.col("normalized_text").alias("text"), "detected", "reason", "detection_confidence", "routing_warning"), "extraction_id")
    out = identity.build_identity(kept, "text", "kind", "metadata", "filename")
    return cut(out.drop("text"))


def identities(spark, d):
    return _pipeline(spark, d).select("extraction_id", "display_title", "short_title", "jurisdiction", "authority", "date", "reference", "fingerprint", "canonical_id", "identity_confidence")


def process(spark, d):
    """The whole pipeline: one row for each extraction with its status (failed, duplicate-detected or complete), stage, parser and figures.

    The library is all extractions before: a duplicate names the first of them. A text too short to parse is failed at parsing and has
    the fallback fiche; a specialised parser that finds no structure is no failure.
    """
    run = _pipeline(spark, d)
    lib = run.where("parse_status <> 'empty'").select(F.col("extraction_id").alias("id"), F.col("extraction_id").alias("ord"), "fingerprint", "canonical_id", F.coalesce("reference", F.lit("Unknown")).alias("reference"), F.col("display_title").alias("title"))
    twice = identity.first_duplicates(lib, lib).where("library_id < new_id").select(F.col("new_id").alias("extraction_id"), F.col("library_id").alias("duplicate_of"), F.col("reason").alias("duplicate_reason"))
    state = F.when(F.col("parse_status") == "empty", "failed").when(F.col("duplicate_of").isNotNull(), "duplicate-detected").otherwise("complete")
    gathered = F.array_distinct(F.concat(F.array_compact(F.array("routing_warning")), "warnings", "identity_warnings"))
    return run.join(twice, "extraction_id", "left").select(
        "extraction_id", state.alias("status"), F.when(F.col("parse_status") == "empty", "parsing").otherwise("complete").alias("stage"), "detected", F.col("kind").alias("parser"), "reason", F.size("elements").alias("elements"), F.size("refs").alias("refs"),
        F.size(F.filter("elements", lambda e: e["chosen"] & ~e["is_empty"])).alias("provisions"), "canonical_id", "duplicate_of", "duplicate_reason", F.array_join(F.array_sort(gathered), ",").alias("warnings"),
    )


def fiches(spark, d):
    run = _pipeline(spark, d).withColumnRenamed("parse_status", "status")
    out = fiche.fiches(run, "extraction_id", "display_title", "short_title", "reference", "jurisdiction", "authority", "date")
    return out.select("extraction_id", "document_id", "kind", "title", "short_title", "reference", "jurisdiction", "authority", "date", "status", F.size("provisions").alias("provisions"), F.size("refs").alias("refs"), "summary", "fallback")


def validate_fiches(spark, d):
    run = _pipeline(spark, d).withColumnRenamed("parse_status", "status")
    out = fiche.fiches(run, "extraction_id", "display_title").select("extraction_id", "provisions")
    return fiche.validate_fiche(out.join(run.select("extraction_id", "canonical_id"), "extraction_id"), "extraction_id")


QUERIES = {f.__name__: f for f in (
    *[_of_type(k) for k in forms.HEADINGS], article_paragraphs, judgment_blocks, elements, elements_by_type, hierarchy_tree, element_contents, canonical_parts, xrefs, *[_xrefs_of(k) for k in ("treaty", "contract", "statute", "judgment", "unknown")], xref_kinds, xref_contexts, connections, citations, citation_owner,
    section_linkback, relations, relationships, provisions, document_map, special_blocks, concept_index, amendments, amendment_tracker, *[_signal(k) for k in ("boilerplate", "separate-opinion", "transposition", "commencement", "claim", "authority", "facts")], parties,
    _metadata("constitution", "short_title", "jurisdiction", "authority", "adoption_date", "reference"), _metadata("regulation", "regulation_number", "jurisdiction", "adoption_date", "adopting_body"), _metadata("directive", "directive_number", "jurisdiction", "adoption_date", "adopting_body", "transposition_deadline"),
    _metadata("treaty", "jurisdiction", "signature_date", "signature_place", "depositary", "authentic_languages"), _metadata("statute", "short_title", "act_number", "jurisdiction", "adoption_date"), _metadata("judgment", "court", "case_number", "judgment_date", "formation", "publication_status", "outcome", "jurisdiction"),
    _metadata("contract", "contract_type", "agreement_date"), _metadata("unknown", "best_guess"), metadata_provenance, parser_warnings, parser_stats, summaries, document_status, timeline, quality_report, validate_parsed, validate_detection, validate_dimensions,
    study_counts, study_search, study_explanations, study_article, source_anchors, extraction_defaults, identities, process, fiches, validate_fiches,
)}
