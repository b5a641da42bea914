"""Queries of the document pipeline over the corpus, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisgrid.common import cut, latest, table
from jurisgrid.functions import numbers, registry, text
from jurisgrid.operators import detection, fiche, identity
from jurisgrid.plans.documents_sql import UNIT_TYPE, units_sql
from jurisgrid.sources import files


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("document_type").isin(*registry.TYPES), F.col("document_type")).otherwise("unknown")
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("en")).alias("lang"), kind.alias("kind"))
    # An input of fewer splits than cores would leave cores idle in the pattern scans; larger inputs are read as they are.
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", detection.detect_language(F.col("text")).alias("detected"))


def lang_confusion(spark, d):
    return table(spark, d, "documents").groupBy("lang", detection.detect_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def normalize_core(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.normalize_core(F.col("text"))).alias("hash"))


def normalize_extractor(spark, d):
    return table(spark, d, "extractions").where("raw_text is not null").select("extraction_id", F.md5(text.normalize_extractor(F.col("raw_text"))).alias("hash")).distinct()


def normalize_detector(spark, d):
    return table(spark, d, "extractions").where("raw_text is not null").select("extraction_id", F.md5(text.normalize_detector(F.col("raw_text"))).alias("hash")).distinct()


def word_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.count_words(F.col("text")).alias("words"), F.md5(text.preview(F.regexp_replace("text", r"\s+", " "), 120)).alias("preview"))


def source_units(spark, d):
    ext = latest(table(spark, d, "extractions").select("extraction_id", "raw_text", "loaded_at").where("raw_text is not null"), ["extraction_id"], "loaded_at")
    return files.units_of_text(ext, "extraction_id", "raw_text").select("extraction_id", "unit_order", "unit_ref", F.md5("text").alias("hash"))


def unit_types(spark, d):
    ext = table(spark, d, "extractions").select("extraction_id", "raw_text").where("raw_text is not null").distinct()
    return files.units_of_text(ext, "extraction_id", "raw_text").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _hits(spark, d):
    return detection.scan_signals(docs_of(spark, d))


def signal_hits(spark, d):
    return _hits(spark, d).groupBy("type", "signal").agg(F.count(F.lit(1)).alias("documents"), F.sum("matches").alias("matches"))


def signal_contexts(spark, d):
    """Places and contexts of the signals of each document."""
    return _hits(spark, d).select("doc_id", "signal", F.posexplode("contexts").alias("n", "context"), F.col("positions")[0].alias("first_position"))


def detection_warnings(spark, d):
    docs = docs_of(spark, d)
    return detection.detection_warnings(docs, _decided(spark, d))


_ANYWHERE = [s for s in registry.SIGNALS if s[3] == "anywhere" and all(ord(c) < 128 for p in s[5] for c in p)]


def signal_anywhere(spark, d):
    names = [s[1] for s in _ANYWHERE]
    return _hits(spark, d).where(F.col("signal").isin(*names)).select("doc_id", "signal", "matches")


def _decided(spark, d):
    docs = docs_of(spark, d)
    return detection.decide(docs, detection.score_types(detection.scan_signals(docs)))


def signal_scores(spark, d):
    return detection.score_types(_hits(spark, d)).select("doc_id", "type", F.round("score", 3).alias("score"), "positives", "negatives")


def detect_types(spark, d):
    return _decided(spark, d).select("doc_id", "type", "candidate", F.round("score", 3).alias("score"), F.round("gap", 3).alias("gap"), "confidence", "decision")


def route_parsers(spark, d):
    return detection.route(_decided(spark, d)).groupBy("parser", "reason", "auto_routed", "warning").agg(F.count(F.lit(1)).alias("n"))


def reclassify(spark, d):
    forced = table(spark, d, "documents").select("doc_id", F.when(F.col("document_type") == "judgment", "judgement").alias("forced"))
    return detection.route(_decided(spark, d).join(forced, "doc_id"), "forced").select("doc_id", "parser", "reason", "auto_routed")


def type_dimensions(spark, d):
    return detection.dimensions(docs_of(spark, d).select("doc_id", F.col("kind").alias("type")))


def normalize_number(spark, d):
    """Identifiers of the stored elements in their normal form, and their value as Roman numerals."""
    raw = table(spark, d, "elements").where("identifier is not null").select(F.col("identifier").alias("raw")).distinct()
    return raw.select("raw", numbers.normalize_number(F.col("raw"), "en").alias("number"), numbers.roman_to_int(F.col("raw")).alias("roman"))


def sort_keys(spark, d):
    ids = table(spark, d, "elements").select("canonical_id").distinct()
    return ids.select("canonical_id", numbers.sort_key(F.col("canonical_id")).alias("sort_key"))


def fingerprint_dups(spark, d):
    """Documents of one fingerprint: equal normalised texts have equal fingerprints, so a built-in hash of them groups the rows."""
    prints = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(identity.fingerprint_text(F.col("text"))).alias("same"))
    return prints.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).select("first_doc", "n")


def fingerprints(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", identity.fingerprint(F.col("text")).alias("fingerprint"))


def _library(spark, d):
    ids = latest(table(spark, d, "identities").select("identity_id", "fiche_id", "fingerprint", "canonical_id", "reference", "loaded_at"), ["identity_id"], "loaded_at")
    titles = latest(table(spark, d, "fiches").select("fiche_id", "title", "loaded_at"), ["fiche_id"], "loaded_at").select("fiche_id", "title")
    return ids.join(titles, "fiche_id", "left").select(F.col("identity_id").alias("id"), F.col("identity_id").alias("ord"), "fingerprint", "canonical_id", "reference", "title")


def duplicates(spark, d):
    lib = cut(_library(spark, d))
    return identity.first_duplicates(lib, lib)


def slugs(spark, d):
    return table(spark, d, "fiches").select("fiche_id", text.slugify(F.col("title"), 96).alias("slug")).distinct()


def stored_dates(spark, d):
    """Dates that fiches were delivered with, with their year."""
    f = latest(table(spark, d, "fiches").select("fiche_id", "judgment_date", "adoption_date", "loaded_at"), ["fiche_id"], "loaded_at")
    e = F.explode(F.array(F.struct(F.lit("judgment").alias("event"), F.col("judgment_date").alias("date")), F.struct(F.lit("adoption").alias("event"), F.col("adoption_date").alias("date"))))
    return f.select("fiche_id", e.alias("e")).select("fiche_id", "e.event", "e.date", fiche.rough_date_key(F.col("e.date")).alias("year_key")).where("date is not null")


def validate_extractions(spark, d):
    return fiche.validate_extraction(table(spark, d, "extractions"))


def validate_classification(spark, d):
    return fiche.validate_classification(table(spark, d, "fiches"))


def validate_identity(spark, d):
    return fiche.validate_identity(table(spark, d, "identities"))


def resolved_flags(spark, d):
    """Stored ``resolved`` against the elements that are there: counts by kind of disagreement."""
    refs = latest(table(spark, d, "cross_references").select("ref_id", "fiche_id", "target_canonical_id", "resolved", "loaded_at"), ["ref_id"], "loaded_at")
    el = table(spark, d, "elements").select("fiche_id", F.col("canonical_id").alias("target_canonical_id")).distinct().withColumn("there", F.lit(True))
    return refs.join(el, ["fiche_id", "target_canonical_id"], "left").groupBy("resolved", F.coalesce("there", F.lit(False)).alias("there")).agg(F.count(F.lit(1)).alias("n"))


def search(spark, d):
    return fiche.search(table(spark, d, "documents"), "supply contract", "text").select("doc_id")


def highlight(spark, d):
    return fiche.search(table(spark, d, "fiches"), "judgment", "title").select("fiche_id", fiche.highlight(F.col("title"), "judgment").alias("marked")).distinct()


def chapter_articles(spark, d):
    """Children in list order with their heading; parents and children are joined on exact ids, dangling ids drop out."""
    p = latest(table(spark, d, "provisions").select("provision_id", "fiche_id", "canonical_id", "parent_id", "loaded_at"), ["provision_id"], "loaded_at")
    e = table(spark, d, "elements").groupBy("fiche_id", "canonical_id").agg(F.min("heading").alias("heading"))
    return p.where("parent_id is not null").join(e.withColumnRenamed("canonical_id", "parent_id"), ["fiche_id", "parent_id"]).select("fiche_id", "parent_id", "canonical_id", F.col("heading").alias("parent_heading"))


QUERIES = {f.__name__: f for f in (
    normalize_number, lang_detect, lang_confusion, normalize_core, normalize_extractor, normalize_detector, word_counts, source_units, unit_types, signal_hits, signal_contexts, detection_warnings, signal_anywhere, signal_scores, detect_types, route_parsers,
    reclassify, type_dimensions, sort_keys, fingerprints, fingerprint_dups, duplicates, slugs, stored_dates, validate_extractions, validate_classification, validate_identity, resolved_flags, search, highlight, chapter_articles,
)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(c: str, *rules: tuple[str, str]) -> str:
    return reduce(lambda x, r: f"regexp_replace({x}, {_q(r[0])}, {_q(r[1])}, 'g')", rules, c)


_LF = ("\r\n?", "\n")
_SQL_CORE = _chain("@", _LF, (" ", " "), ("[​-‍﻿]", ""), (r"[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), ("^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$", ""))
_SQL_EXTRACT = _chain("@", _LF, (" ", " "), ("[​-‍﻿]", ""), (r"[ \t]+", " "), ("(?m)^ | $", ""), ("\n{3,}", "\n\n"), ("^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$", ""))
_marks = {lang: " + ".join(f"(length(s) - length(replace(s, {_q(m)}, ''))) // {len(m)}" for m in ms) for lang, ms in registry.LANGUAGE_MARKERS.items()}
_SQL_LANG = f"""(select doc_id, lang, case when top = 0 or top - second <= 1 then 'unknown' when en = top then 'en' when fr = top then 'fr' when de = top then 'de' else 'es' end as detected from
  (select *, greatest(en, fr, de, es) as top, list_reverse_sort([en, fr, de, es])[2] as second from
    (select doc_id, lang, {", ".join(f"{e} as {lang}" for lang, e in _marks.items())} from (select doc_id, lang, ' ' || lower(substr(coalesce(text, ''), 1, 6000)) || ' ' as s from documents))))"""
_DOCS = f"""docs as (select doc_id, {_SQL_CORE.replace("@", "text")} as t, case when lang in ('fr', 'de', 'es') then lang else 'en' end as lang, case when document_type in ({", ".join(map(_q, registry.TYPES))}) then document_type else 'unknown' end as kind from documents where text is not null)"""


_SQL_DETECTOR = _chain(
    "translate(" + _chain("@", _LF, ("\u00a0", " "), ("[​-‍﻿]", ""), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), (r"\bArtic[1I]e\b", "Article")) + ", '‘’“”–—', " + _q("''\"\"--") + ")",
    (r"[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), ("^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$", ""),
)
_SIGNAL_ROWS = ", ".join(f"({n}, '{kind}', '{name}', {weight}, '{zone}', {least}, {_q('(?i)' + p)})" for n, (kind, name, weight, zone, least, patterns) in enumerate(registry.SIGNALS) for p in patterns)
# Places of matches: the pieces between them and the matches before, added up.
_SQL_HITS = f"""docs as (select doc_id, substr({_SQL_DETECTOR.replace("@", "coalesce(text, '')")}, 1, 120000) as t from documents), signals(ord, type, signal, weight, zone, least, pattern) as (values {_SIGNAL_ROWS}),
  tries as (select doc_id, t, length(t) as n, s.*, row_number() over () as k from docs join signals s on regexp_matches(t, pattern)),
  found as (select *, unnest(regexp_extract_all(t, pattern, 0)) as whole, generate_subscripts(regexp_extract_all(t, pattern, 0), 1) as i, string_split_regex(t, pattern) as pieces from tries),
  placed as (select *, sum(length(pieces[i])) over w + sum(length(whole)) over w - length(whole) as place, greatest(1, floor(n * 0.2)) as early, floor(n * 0.8) as late from found window w as (partition by k order by i)),
  hits as (select doc_id, type, signal, weight, ord, count(*) as matches from placed where zone = 'anywhere' or zone = case when place < early then 'early' when place >= late then 'late' else 'body' end group by doc_id, type, signal, weight, ord, least having count(*) >= least)"""
_SQL_SCORES = f"""{_SQL_HITS}, sums as (select doc_id, type, coalesce(sum(weight) filter (weight > 0), 0) as p, coalesce(sum(-weight) filter (weight <= 0), 0) as m, count(*) filter (weight > 0) as positives, count(*) filter (weight <= 0) as negatives,
    count(*) filter (weight >= 45) as strong, count(*) filter (weight >= 20) as solid, count(*) filter (weight > 0 and weight < 20) as weak, min(ord) as ord from hits group by 1, 2),
  scores as (select *, greatest(0.0::double, p + case when strong > 0 and solid >= 2 then 12 else 0 end + case when strong = 0 and solid >= 3 then 10 else 0 end + case when weak >= 4 then 8 else 0 end - m * 1.4::double) as score from sums)"""
_SQL_DECIDED = f"""{_SQL_SCORES}, best as (select *, lead(score) over w as second, row_number() over w as r from scores where score > 0 window w as (partition by doc_id order by score desc, ord)),
  one as (select *, score - coalesce(second, 0) as gap from best where r = 1),
  sure as (select *, least(greatest(floor(20 + 0.55::double * least(score, 90) + 0.35::double * least(greatest(gap, 0), 50) + 3 * least(positives, 6) + case when strong > 0 then 8 else 0 end - 8 * negatives + 0.5::double), 0), 96)::int as confidence from one),
  decided as (select d.doc_id, s.type as candidate, coalesce(s.score, 0) as score, coalesce(s.gap, 0) as gap, coalesce(s.confidence, 0) as confidence, case when s.score is null then 'unknown' when s.score >= 42 and s.confidence >= 62 and s.gap >= 12 then 'auto' else 'needs-review' end as decision from docs d left join sure s using (doc_id))"""
_REQUIRED = ["filename", "raw_text", "normalized_text", "extraction_method"]
SQL = {
    "lang_detect": f"select doc_id, detected from {_SQL_LANG}",
    "lang_confusion": f"select lang, detected, count(*) as n from {_SQL_LANG} group by 1, 2",
    "normalize_core": f"select doc_id, md5({_SQL_CORE.replace('@', 'text')}) as hash from documents where text is not null",
    "normalize_extractor": f"select distinct extraction_id, md5({_SQL_EXTRACT.replace('@', 'raw_text')}) as hash from extractions where raw_text is not null",
    "signal_anywhere": " union all ".join(f"select doc_id, '{s[1]}' as signal, m as matches from (select doc_id, ({' + '.join(f'len(regexp_extract_all(text, {_q('(?i)' + p)}))' for p in s[5])})::int as m from documents where text is not null) where m >= {s[4]}" for s in _ANYWHERE),
    "type_dimensions": "select doc_id, d.* from (select doc_id, case when document_type in (" + ", ".join(map(_q, registry.TYPES)) + ") then document_type else 'unknown' end as type from documents) join (values "
    + ", ".join("(" + ", ".join("null" if x is None else _q(x) for x in (t, *v)) + ")" for t, v in registry.DIMENSIONS.items()) + ") as d(type, label, origin, document_family, authority_class, binding_character) using (type)",
    "normalize_detector": f"select distinct extraction_id, md5({_SQL_DETECTOR.replace('@', 'raw_text')}) as hash from extractions where raw_text is not null",
    "word_counts": r"""select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::int as words, md5(case when length(t) <= 120 then t when contains(h, ' ') and length(h) - strpos(reverse(h), ' ') > 84 then substr(h, 1, (length(h) - strpos(reverse(h), ' '))::bigint) || '...' else h || '...' end) as preview
      from (select *, substr(t, 1, 120) as h from (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents where text is not null))""",
    "source_units": units_sql(_SQL_EXTRACT, "select extraction_id, n::int as unit_order, 'raw-' || lpad(n::varchar, 5, '0') as unit_ref, md5(b) as hash from units"),
    "unit_types": units_sql(_SQL_EXTRACT, f"select {UNIT_TYPE} as type, count(*) as n from units group by 1"),
    "signal_hits": f"with {_SQL_HITS} select type, signal, count(*) as documents, sum(matches)::bigint as matches from hits group by 1, 2",
    "signal_scores": f"with {_SQL_SCORES} select doc_id, type, round(score, 3) as score, positives, negatives from scores",
    "detect_types": f"with {_SQL_DECIDED} select doc_id, case when decision = 'auto' then candidate else 'unknown' end as type, candidate, round(score, 3) as score, round(gap, 3) as gap, confidence, decision from decided",
    "route_parsers": f"""with {_SQL_DECIDED}, routed as (select case when decision = 'auto' and confidence >= 70 then 'auto' when confidence >= 40 then 'review-suggested' else 'generic-fallback' end as reason, case when decision = 'auto' then candidate else 'unknown' end as type from decided)
      select case when reason = 'generic-fallback' then 'unknown' else type end as parser, reason, reason <> 'generic-fallback' as auto_routed, case reason when 'review-suggested' then 'ROUTED_WITH_REVIEW' when 'generic-fallback' then 'GENERIC_ROUTING' end as warning, count(*) as n from routed group by 1, 2, 3, 4""",
    "sort_keys": "select canonical_id, " + reduce(lambda c, x: f"regexp_replace({c}, '{x[1]}$', '{str(998 + x[0]).rjust(4, '0')}')", enumerate(["BIS", "TER", "QUATER", "QUINQUIES", "SEXIES", "SEPTIES", "OCTIES", "NOVIES", "DECIES"]), "canonical_id") + " as sort_key from (select distinct canonical_id from elements)",
    "slugs": "select distinct fiche_id, substr(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 96) as slug from fiches",
    "normalize_number": r"""with ids as (select distinct identifier as raw, trim(regexp_replace(trim(identifier), '[.,;:]+$', '')) as x from elements where identifier is not null), ones(d, r) as (values (0, ''), (1, 'I'), (2, 'II'), (3, 'III'), (4, 'IV'), (5, 'V'), (6, 'VI'), (7, 'VII'), (8, 'VIII'), (9, 'IX')),
      romans as (select h.d * 100 + t.d * 10 + o.d as n, translate(h.r, 'IVX', 'CDM') || translate(t.r, 'IVX', 'XLC') || o.r as r from ones h, ones t, ones o)
      select raw, case when x = '' then '0000' when regexp_full_match(x, '\d+') then lpad(x, greatest(4, length(x))::int, '0') when regexp_full_match(x, '\d+[A-Za-z]') then lpad(x[:-2], greatest(4, length(x) - 1)::int, '0') || lower(x[-1:]) when n is not null then lpad(n::varchar, 4, '0') else upper(x) end as number,
        (select q.n from romans q where q.r = upper(raw) and raw <> '')::int as roman from ids left join romans on romans.r = upper(x) and x <> ''""",
    "duplicates": r"""with ids as (select * from identities qualify row_number() over (partition by identity_id order by loaded_at desc) = 1), f as (select * from fiches qualify row_number() over (partition by fiche_id order by loaded_at desc) = 1),
      norm as (select identity_id as id, lower(regexp_replace(trim(coalesce(fingerprint, '')), '\s+', ' ', 'g')) as fp, lower(regexp_replace(trim(coalesce(ids.canonical_id, '')), '\s+', ' ', 'g')) as cid, lower(regexp_replace(trim(coalesce(reference, '')), '\s+', ' ', 'g')) as ref, lower(regexp_replace(trim(coalesce(title, '')), '\s+', ' ', 'g')) as title from ids left join f using (fiche_id)),
      lib as (select *, list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) > 2)) as ws from norm),
      pairs as (select a.id as new_id, b.id as library_id, case when a.fp <> '' and a.fp = b.fp then 'fingerprint' when a.cid <> '' and a.cid = b.cid then 'canonical_id' when a.ref <> '' and a.ref = b.ref then 'reference' when a.title <> '' and a.title = b.title then 'title'
        when length(a.title) > 20 and length(b.title) > 20 and len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws), 1) > 0.82 then 'similar-title' end as reason from lib a join lib b on b.id < a.id)
      select new_id, library_id, reason from pairs where reason is not null qualify row_number() over (partition by new_id order by library_id) = 1""",
    "fingerprint_dups": "select min(doc_id) as first_doc, count(*) as n from documents where text is not null group by md5(" + _chain("nfc_normalize(text)", _LF, (" ", " "), (r"[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), ("^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$", "")) + ")",
    "stored_dates": "select fiche_id, event, date, case when regexp_extract(date, '\\b(\\d{4})\\b', 1) = '' then '9999' else regexp_extract(date, '\\b(\\d{4})\\b', 1) end as year_key from (select fiche_id, event, date from (select *, row_number() over (partition by fiche_id order by loaded_at desc) as rn from fiches) cross join lateral (values ('judgment', judgment_date), ('adoption', adoption_date)) as v(event, date) where rn = 1) where date is not null",
    "validate_extractions": " union ".join([f"select extraction_id, 'extraction' as stage, 'VALIDATION_REQUIRED_FIELD' as code, '{c}' as detail from extractions where coalesce({c}, '') = ''" for c in _REQUIRED]
        + ["select extraction_id, 'extraction', 'VALIDATION_EXTRACTION_TOO_SHORT', '' from extractions where length(trim(coalesce(normalized_text, ''))) < 50", "select extraction_id, 'extraction', 'VALIDATION_RAW_TEXT_MISSING', '' from extractions where coalesce(raw_text, '') = ''"]),
    "validate_classification": "select distinct fiche_id, 'classification' as stage, 'VALIDATION_UNKNOWN_DOCUMENT_TYPE' as code, coalesce(document_type, '') as detail from fiches where document_type is null or document_type not in (" + ", ".join(map(_q, registry.TYPES)) + ") union select fiche_id, 'classification', 'VALIDATION_CLASSIFICATION_MISSING', 'origin' from fiches where document_type = 'unknown'",
    "validate_identity": " union ".join([f"select identity_id, 'identity' as stage, 'IDENTITY_{n}_UNKNOWN' as code, '' as detail from identities where lower(trim(coalesce({c}, ''))) in ('', 'unknown')" for n, c in (("JURISDICTION", "jurisdiction"), ("AUTHORITY", "authority"), ("DATE", "identity_date"), ("REFERENCE", "reference"))]
        + ["select identity_id, 'identity', 'VALIDATION_IDENTITY_NOT_FINGERPRINTED', '' from identities where not contains(canonical_id, substr(fingerprint, 1, 10))"]),
    "resolved_flags": "select resolved, there, count(*) as n from (select r.resolved, e.fiche_id is not null as there from (select *, row_number() over (partition by ref_id order by loaded_at desc) as rn from cross_references) r left join (select distinct fiche_id, canonical_id from elements) e on e.fiche_id = r.fiche_id and e.canonical_id = r.target_canonical_id where rn = 1) group by 1, 2",
    "search": "select doc_id from documents where contains(lower(text), 'supply contract')",
    "highlight": "select distinct fiche_id, regexp_replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(judgment)', '<mark>\\1</mark>', 'g') as marked from fiches where contains(lower(title), 'judgment')",
    "chapter_articles": "select p.fiche_id, p.parent_id, p.canonical_id, e.heading as parent_heading from (select *, row_number() over (partition by provision_id order by loaded_at desc) as rn from provisions) p join (select fiche_id, canonical_id, min(heading) as heading from elements group by 1, 2) e on e.fiche_id = p.fiche_id and e.canonical_id = p.parent_id where rn = 1",
}
