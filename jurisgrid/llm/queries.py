"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisgrid.common import cut, latest, table
from jurisgrid.llm.canonical import free_entered, match_names
from jurisgrid.llm.language import label_languages, train, wrong_labels
from jurisgrid.llm.leakage import find_leaks
from jurisgrid.llm.mixing import mix
from jurisgrid.llm.quality import quality
from jurisgrid.llm.scan_repair import ScanNoise
from jurisgrid.llm.skeleton import lookalike_classes, lookalike_pairs, skeleton_hash, skeleton_text


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    ext = table(spark, sf_dir, "extractions").select("extraction_id", "loaded_at", "normalized_text").where("extraction_id is not null")
    labelled = latest(label_languages(ext, ["extraction_id", "loaded_at"], "normalized_text", model), ["extraction_id"], "loaded_at")
    fiches = latest(table(spark, sf_dir, "fiches").select("fiche_id", "extraction_id", "language", "loaded_at").where("fiche_id is not null"), ["fiche_id"], "loaded_at")
    return wrong_labels(fiches, labelled)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("fiche_id", "segment_no", "language")


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in another language than the main one of normalized_text, by block and word, also within a block."""
    ext = table(spark, sf_dir, "extractions").select("extraction_id", "loaded_at", "normalized_text").where("extraction_id is not null")
    labelled = latest(label_languages(ext, ["extraction_id", "loaded_at"], "normalized_text", train(table(spark, sf_dir, "documents"))), ["extraction_id"], "loaded_at")
    return labelled.select("extraction_id", "main", F.explode("spans").alias("s")).select("extraction_id", "main", "s.*")


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def _free_entered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fiches = latest(table(spark, sf_dir, "fiches").select("fiche_id", "court", "loaded_at").where("fiche_id is not null"), ["fiche_id"], "loaded_at")
    ids = latest(table(spark, sf_dir, "identities").select("identity_id", "authority", "jurisdiction", "loaded_at").where("identity_id is not null"), ["identity_id"], "loaded_at")
    rows = fiches.select(F.lit("court").alias("kind"), F.col("fiche_id").alias("record_id"), F.col("court").alias("value"))
    for kind in ("authority", "jurisdiction"):
        rows = rows.unionByName(ids.select(F.lit(kind).alias("kind"), F.col("identity_id").alias("record_id"), F.col(kind).alias("value")))
    entries = table(spark, sf_dir, "canonical_entries")
    return free_entered(rows, entries), entries


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, entries = _free_entered(spark, sf_dir)
    rows = cut(rows)
    return rows.join(match_names(rows, entries), ["kind", "value"]).select(F.col("kind").alias("field_name"), "record_id", "entry_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that match no entry, with the number of records."""
    rows, entries = _free_entered(spark, sf_dir)
    rows = cut(rows)
    return rows.join(match_names(rows, entries).where("entry_id = -1"), ["kind", "value"]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cut(lookalike_classes(table(spark, sf_dir, "extractions"), "extraction_id", "raw_text", "loaded_at"))
    return lookalike_pairs(classes, "extraction_id").select(F.col("a").alias("extraction_a"), F.col("b").alias("extraction_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each extraction with the smallest id of its look-alike class, and the number of rows and forms of the class."""
    classes = cut(lookalike_classes(table(spark, sf_dir, "extractions"), "extraction_id", "raw_text", "loaded_at"))
    sizes = classes.groupBy("class_id").agg(F.min("extraction_id").alias("representative"), F.count(F.lit(1)).alias("members"), F.count_distinct("form").alias("forms"))
    return classes.join(sizes, "class_id").select("extraction_id", "representative", "members", "forms")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each extraction with the one form of raw_text and of normalized_text, and the look-alike class of each (equal across both)."""
    rows = latest(table(spark, sf_dir, "extractions").select("extraction_id", "loaded_at", "raw_text", "normalized_text").where("extraction_id is not null"), ["extraction_id"], "loaded_at")
    columns = [x for c in ("raw", "normalized") for x in (skeleton_text(F.col(f"{c}_text")).alias(f"{c}_form"), F.lower(F.hex(skeleton_hash(F.col(f"{c}_text")))).alias(f"{c}_class"))]
    return rows.select("extraction_id", *columns)


def _scans(spark: SparkSession, sf_dir: str) -> ScanNoise:
    units = latest(table(spark, sf_dir, "source_units").select("unit_id", "extraction_id", "unit_order", "text", "loaded_at").where("unit_id is not null"), ["unit_id"], "loaded_at")
    formats = table(spark, sf_dir, "extractions").groupBy("extraction_id").agg(F.max(F.lower("format") == "pdf").alias("scanned"))
    return ScanNoise(units.join(formats, "extraction_id", "left").select("unit_id", "extraction_id", "unit_order", "text", F.coalesce("scanned", F.lit(False)).alias("scanned")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).found()


def p7_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).misread()


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).repaired()


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_text of the scanned extractions as continuous paragraphs; the other files' texts are the clean ones of its lexicon."""
    ext = latest(table(spark, sf_dir, "extractions").select("extraction_id", "format", "raw_text", "loaded_at").where("extraction_id is not null and raw_text is not null"), ["extraction_id"], "loaded_at")
    blocks = F.split(F.regexp_replace("raw_text", r"\r\n?", "\n"), r"\n[ \t]*\n\s*")
    units = ext.select("extraction_id", F.coalesce(F.lower("format") == "pdf", F.lit(False)).alias("scanned"), F.posexplode(blocks).alias("unit_order", "text"))
    return ScanNoise(units.select(F.xxhash64("extraction_id", "unit_order").alias("unit_id"), "extraction_id", "unit_order", "text", "scanned")).paragraphs()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), reworked=False)
    return leaks.select("doc_id", "item_id")


def p8_reworked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an item's template in other numbers, names or units."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where("how = 'template'").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_confidence": p2_confidence, "p2_spans": p2_spans, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p6_classes": p6_classes, "p6_forms": p6_forms, "p7_found": p7_found, "p7_misread": p7_misread, "p7_repaired": p7_repaired, "p7_paragraphs": p7_paragraphs, "p8_found": p8_found, "p8_reworked": p8_reworked,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_stats": p10_stats,
}

_FOLD = "string_split(trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
SQL = {
    "p8_found": f"""with d as (select doc_id, {_FOLD.format("text")} as w from documents where text is not null), i as (select item_id, {_FOLD.format("text")} as w from eval_items where text is not null),
      dw as (select doc_id, array_to_string(w[p:p + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d where len(w) >= 20)),
      iw as (select item_id, array_to_string(w[p:p + 19], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 18)) as p from i where len(w) >= 20))
      select distinct doc_id, item_id from dw join iw using (g)""",
}
