"""Language and type of documents: markers, weighted signals, scores, decision, routing, dimensions.

Signals are searched where the text lies, in one Arrow-batched pass that gives short rows with places and contexts (built-in functions
know no places of matches, and took nine times as long here); scores are one aggregation by document and type with partial
sums. The text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisgrid.functions.registry import DIMENSIONS, FILENAME_HINTS, FILENAME_WEIGHT, LANGUAGE_MARKERS, SIGNALS, TYPES
from jurisgrid.functions.text import count_of, normalize_detector
from jurisgrid.operators.parsing import context, form

SAMPLE = 120_000
LANGUAGE_SAMPLE = 6_000


def detect_language(text: Column, sample: int = LANGUAGE_SAMPLE) -> Column:
    """Language of most marker strings in the first ``sample`` characters; 'unknown' without any or with a lead of 1 or less."""
    head = F.concat(F.lit(" "), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, sample)), F.lit(" "))
    # Each lambda binds a value once, so that no marker or ranking is computed again where its result is used.
    scores = lambda s: F.array(*[F.struct(reduce(lambda a, b: a + b, [count_of(s, m) for m in marks]).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, marks) in enumerate(LANGUAGE_MARKERS.items())])
    best = lambda r: F.when((r[0]["n"] == 0) | (r[0]["n"] - r[1]["n"] <= 1), "unknown").otherwise(r[0]["lang"])
    return F.transform(F.transform(F.array(head), lambda s: F.sort_array(scores(s), asc=False)), best)[0]


def needed_words(pattern: str) -> list[str]:
    """Runs of four letters or more, in lower case, that every match of a pattern holds: those outside groups and classes that no
    quantifier follows. A text without one of them need not be searched with the pattern."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            runs, run, i = [*runs, run], "", i + 2
            continue
        if ch == "|" and depth == 0:
            return []
        if depth == 0 and ch.isascii() and ch.isalpha():
            run += ch
        else:
            runs, run = [*runs, run[:-1] if ch in "?*{" else run], ""
            depth += (ch in "([") - (ch in ")]")
        i += 1
    return [r.lower() for r in [*runs, run] if len(r) >= 4]


@cache
def _signals() -> list[tuple]:
    return [(n, kind, name, weight, zone, least, [(needed_words(p), form(p)) for p in patterns]) for n, (kind, name, weight, zone, least, patterns) in enumerate(SIGNALS)]


def find_signals(text: str) -> list[tuple]:
    """(type, signal, weight, matches, ord, positions, contexts) of one normalised text; contexts are those of the first three matches.

    Early is the first fifth of the text, late the last, body between them; a match lies where it begins.
    """
    low, n = text.lower(), len(text)
    early, late = max(1, int(n * 0.2)), int(n * 0.8)
    zones = {"early": (0, early), "body": (early, late), "late": (late, n + 1), "anywhere": (0, n + 1)}
    out = []
    for order, kind, name, weight, zone, least, patterns in _signals():
        start, stop = zones[zone]
        found = [m for words, pattern in patterns if all(w in low for w in words) for m in pattern.finditer(text) if start <= m.start() < stop]
        if len(found) >= least:
            out.append((kind, name, weight, len(found), order, [m.start() for m in found], [context(text, m.start(), m[0]) for m in found[:3]]))
    return out


HITS = "type string, signal string, weight int, matches int, ord int, positions array<int>, contexts array<string>"


def scan_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", filename: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, type, signal, weight, matches, ord, positions, contexts): signals that reach their least number of matches in their zone of the first
    ``sample`` characters (a feature: the type shows in the opening and in the form, and the zones are shares of what is read).

    With ``filename`` the first hint in a file's name is a signal of its own. Null and empty texts have none.
    """
    base = docs.select(key, F.substring(normalize_detector(F.coalesce(F.col(text), F.lit(""))), 1, sample).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *hit) for k, t in zip(pdf[key], pdf["_t"]) for hit in find_signals(t)], columns=[key, *(c.split()[0] for c in HITS.split(", "))])

    hits = base.mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {HITS}")
    if not filename:
        return hits
    low = F.lower(F.col(filename))
    hint = F.coalesce(*[F.when(F.contains(low, F.lit(needle)), F.lit(kind)) for needle, kind in FILENAME_HINTS])
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    named = docs.select(key, hint.alias("type"), F.lit("filename").alias("signal"), F.lit(FILENAME_WEIGHT).alias("weight"), F.lit(1).alias("matches"), F.lit(len(SIGNALS)).alias("ord"), none("int").alias("positions"), none("string").alias("contexts"))
    return hits.unionByName(named.where("type is not null"))


def score_types(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, score, positives, negatives, strong, ord) of every type with a hit."""
    pos, w = F.col("weight") > 0, F.col("weight")
    n = lambda cond: F.count(F.when(cond, 1))
    agg = hits.groupBy(key, "type").agg(
        F.coalesce(F.sum(F.when(pos, w)), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~pos, -w)), F.lit(0)).alias("m"), n(pos).alias("positives"), n(~pos).alias("negatives"),
        n(w >= 45).alias("strong"), n(w >= 20).alias("solid"), n(pos & (w < 20)).alias("weak"), F.min("ord").alias("ord"),
    )
    bonus = F.when((F.col("strong") > 0) & (F.col("solid") >= 2), 12).otherwise(0) + F.when((F.col("strong") == 0) & (F.col("solid") >= 3), 10).otherwise(0) + F.when(F.col("weak") >= 4, 8).otherwise(0)
    return agg.select(key, "type", F.greatest(F.lit(0.0), F.col("p") + bonus - F.col("m") * 1.4).alias("score"), "positives", "negatives", (F.col("strong") > 0).alias("strong"), "ord")


def decide(docs: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, candidate, score, gap, confidence, decision, runner_up) of every document.

    auto needs a score of 42, a confidence of 62 and a gap of 12; other candidates need review (type unknown); no score: unknown.
    """
    order = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    # At most eight rows for each document.
    best = scores.where("score > 0").withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).withColumn("runner_up", F.lead("type").over(order)).where("r = 1")
    gap = F.col("score") - F.coalesce("second", F.lit(0.0))
    raw = 20 + 0.55 * F.least("score", F.lit(90.0)) + 0.35 * F.least(F.greatest(gap, F.lit(0.0)), F.lit(50.0)) + 3 * F.least("positives", F.lit(6)) + F.when(F.col("strong"), 8).otherwise(0) - 8 * F.col("negatives")
    best = best.withColumn("gap", gap).withColumn("confidence", F.least(F.greatest(F.floor(raw + 0.5), F.lit(0)), F.lit(96)).cast("int"))
    auto = (F.col("score") >= 42) & (F.col("confidence") >= 62) & (F.col("gap") >= 12)
    decision = F.when(F.col("score").isNull(), "unknown").when(auto, "auto").otherwise("needs-review")
    out = docs.select(key).join(best, key, "left").withColumn("decision", decision)
    return out.select(key, F.when(F.col("decision") == "auto", F.col("type")).otherwise("unknown").alias("type"), F.col("type").alias("candidate"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("gap", F.lit(0.0)).alias("gap"), F.coalesce("confidence", F.lit(0)).alias("confidence"), "decision", "runner_up")


def detection_warnings(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, code): NO_TEXT, NO_SIGNALS or LOW_CONFIDENCE_DETECTION of documents whose type wasn't taken."""
    both = docs.select(key, (F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("_none")).join(decided, key)
    code = F.when(F.col("_none"), "NO_TEXT").when(F.col("decision") == "unknown", "NO_SIGNALS").when(F.col("decision") == "needs-review", "LOW_CONFIDENCE_DETECTION")
    return both.select(key, code.alias("code")).where("code is not null")


def route(detections: DataFrame, forced: str | None = None, confirmed: str | None = None) -> DataFrame:
    """Add parser, reason, auto_routed, warning, language_override and suggestion.

    ``forced`` and ``confirmed`` name columns with a type that overrides detection (null: none): confidence 100, no automatic routing, and the
    document is read as English unless its language is given otherwise. ``suggestion`` is the next best type.
    """
    alias = lambda c: F.when(c == "judgement", "judgment").when(c == "eu-regulation", "regulation").when(c == "eu-directive", "directive").otherwise(c)
    none = F.lit(None).cast("string")
    f, u = F.col(forced) if forced else none, F.col(confirmed) if confirmed else none
    wanted = alias(F.coalesce(f, u, F.col("type")))
    reason = F.when(f.isNotNull(), "forced").when(u.isNotNull(), "user-confirmed").when((F.col("decision") == "auto") & (F.col("confidence") >= 70), "auto").when(F.col("confidence") >= 40, "review-suggested").otherwise("generic-fallback")
    out = detections.withColumn("reason", reason).withColumn("parser", F.when(F.col("reason") == "generic-fallback", "unknown").otherwise(wanted))
    known = F.col("parser").isin(*TYPES)
    by_hand = F.col("reason").isin("forced", "user-confirmed")
    return (
        out.withColumn("auto_routed", F.col("reason").isin("auto", "review-suggested"))
        .withColumn("confidence", F.when(by_hand, 100).otherwise(F.col("confidence")))
        .withColumn("decision", F.when(by_hand, F.col("reason")).otherwise(F.col("decision")))
        .withColumn("language_override", F.when(by_hand, "en"))
        .withColumn("suggestion", F.col("runner_up"))
        .withColumn("warning", F.when(~known, "PARSER_NOT_AVAILABLE").when(F.col("reason") == "review-suggested", "ROUTED_WITH_REVIEW").when(F.col("reason") == "generic-fallback", "GENERIC_ROUTING"))
        .withColumn("reason", F.when(known, F.col("reason")).otherwise("missing-parser"))
        .withColumn("parser", F.when(known, F.col("parser")).otherwise("unknown"))
    )


def dimensions(df: DataFrame, kind: str = "type") -> DataFrame:
    """Add the default classification of a type: a join with an eight-row table."""
    rows = [(t, *d) for t, d in DIMENSIONS.items()]
    small = df.sparkSession.createDataFrame(rows, f"{kind} string, label string, origin string, document_family string, authority_class string, binding_character string")
    return df.join(F.broadcast(small), kind, "left")
