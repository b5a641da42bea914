"""Per-document text quality statistics and the tails of their distributions.

One Arrow-batched pass over the whole text gives the statistics. Mergeable quantile sketches (KLL, built by partial
aggregates in the JVM) of each statistic per language turn values into percentiles and robust z-scores. The sketches are
fitted to the bulk of prose of a language, so that no amount of junk in it stretches the scale. Documents in the bad tail of
some statistic are the candidates; an exact check whether the greater part of the text is running sentences follows.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisgrid.common import cut
from jurisgrid.llm.words import ALL_WORDS

STATS = ["words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "listed_share", "sentence_share"]
SCHEMA = "words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, listed_share double, sentence_share double"
# Bad tails of the statistics: -1 low, 1 high, 0 both. The number of words is none, and sentence_share is the exact check.
TAILS = {"mean_word_length": 0, "symbol_ratio": 1, "punctuated_lines": -1, "common_words": -1, "listed_share": 1}
LANGUAGES = ("en", "fr", "de", "es")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_ITEM = re.compile(r"^\s*(?:[-*•·–—+>]\s+|\(?\d{1,4}[.)]\s+|\(?[a-z][.)]\s+|\[\d+\]\s*|[ivx]{1,5}[.)]\s+)")
_LEADER = re.compile(r"\.{4,}|(?:\. ){4,}|_{4,}|…{2,}")
_COLUMNS = re.compile(r"\t|\S {3,}\S|\|")
_END = re.compile(r"[.!?](?:(?<=[^\W_]{2}.)|(?<=[^\W\d_]\s\d.)|(?<=[^\W_][)\]»”\"’].))(?=[\s)\]»”\"’]|$)")
_TAG = re.compile(r"</?[a-z][^>]*>|\{[^}]*\}|&[a-z]+;")
_FINAL = frozenset(".!?;:…»”\"")
_MARKS = ".,;:!?()[]«»“”\"'’–—-"


def _count(tokens: list[str]) -> tuple[int, int, int, int, int]:
    """Words, letters, function words, digits and characters of the blank-separated tokens of a line."""
    words = letters = common = digits = solid = 0
    for t in tokens:
        k = len(t)
        solid += k
        if not t.isalpha():
            t = t.strip(_MARKS)
            if not t.isalpha():
                for w in _WORD.findall(t):
                    words += 1
                    letters += len(w)
                    common += w in ALL_WORDS
                digits += len(_DIGIT.findall(t))
                continue
            k = len(t)
        words += 1
        letters += k
        if t in ALL_WORDS:
            common += 1
    return words, letters, common, digits, solid


def _is_prose(run: list[tuple[str, int, int]]) -> bool:
    """Whether consecutive lines of words read as running sentences: function words, no enumeration, and sentence
    ends at the distance of prose, or long lines where the marks have been lost."""
    words, common = sum(r[1] for r in run), sum(r[2] for r in run)
    if words < 6 or common < 0.16 * words:
        return False
    ends = items = 0
    for line, _, _ in run:
        item = _ITEM.match(line)
        items += item is not None
        ends += len(_END.findall(line[item.end() :] if item else line))
    if items > 2 and words < 12 * items:
        return False
    return words >= 9 * len(run) if not ends else 5 * ends <= words <= 90 * ends or words >= 9 * len(run)


def text_stats(text: str) -> tuple[int, float, float, float, float, float, float]:
    """The statistics of one whole text, in the order of ``STATS``.

    listed_share is the share of characters in lines that are short items, rows of columns, index entries, markup, no words or the line before again;
    sentence_share is the share of non-blank characters in runs of lines that read as sentences: mostly letters, with
    function words, no bullets, leaders, columns or markup.
    """
    text = text.lower()
    n_words = n_letters = n_common = n_lines = n_final = n_digits = n_solid = n_listed = prose = 0
    run: list[tuple[str, int, int]] = []
    size = 0
    before = ""
    for line in [*text.split("\n"), ""]:
        bare = line.strip()
        texty = False
        if bare:
            n_lines += 1
            n_final += bare[-1] in _FINAL
            n, letters, common, digits, solid = _count(bare.split())
            n_words += n
            n_letters += letters
            n_common += common
            n_digits += digits
            n_solid += solid
            odd = False
            texty = n > 0 and letters >= 0.62 * solid and (common >= 0.13 * n or n < 4)
            if texty:
                marked = bool((".." in bare or "__" in bare or ". ." in bare or "…" in bare) and _LEADER.search(bare) or (("\t" in bare or "   " in bare or "|" in bare) and len(_COLUMNS.findall(bare)) >= 2) or (("<" in bare or "{" in bare or "&" in bare) and _TAG.search(bare)))
                texty = not marked
                odd = n < 12 and _ITEM.match(bare) is not None
            if odd or not texty or bare == before:
                n_listed += solid
            before = bare
        if texty:
            run.append((bare, n, common))
            size += solid
        elif run:
            if _is_prose(run):
                prose += size
            run, size = [], 0
    w = max(n_words, 1)
    return n_words, n_letters / w, (n_solid - n_letters - n_digits) / max(n_solid, 1), n_final / max(n_lines, 1), n_common / w, n_listed / max(n_solid, 1), prose / max(n_solid, 1)


def _frame(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t or "") for t in text], columns=STATS)


def quality(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", tail: float = 2.5, majority: float = 0.5) -> DataFrame:
    """key, language, the statistics, pct_* (percentile in the prose of the language), z_* (robust z-score), tails and flagged.

    ``tails`` is the number of statistics in their bad tail: at least ``tail`` robust deviations beyond the median of the
    language's prose, or beyond its 1st or 99th percentile where prose has no values near (share of lists). A document with
    a tail of which less than the share ``majority`` is running sentences is flagged.
    A language without any prose is measured by that of all languages; without prose in any, the exact check alone decides.
    Null text counts as empty: no words, and flagged only if it holds something that is not a sentence, so an
    empty text is not flagged. A null or other language is a group of its own ('und'), so the number of sketches is
    fixed. Repeated rows are kept; an empty table gives no rows.
    """
    language = F.when(F.col(lang).isin(*LANGUAGES), F.col(lang)).otherwise("und")
    rows = documents.select(F.col(key), language.alias("language"), F.pandas_udf(_frame, SCHEMA)(F.col(text)).alias("s"), (F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")) > 0).alias("filled")).select(key, "language", "filled", "s.*")
    rows = cut(rows)
    prose = rows.where(F.col("sentence_share") >= majority)
    sketch = [F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"k_{c}") for c in STATS]
    by_language = prose.groupBy("language").agg(*sketch)
    pooled = prose.agg(*sketch).select(*[F.col(f"k_{c}").alias(f"all_{c}") for c in STATS])
    groups = documents.sparkSession.createDataFrame([(x,) for x in (*LANGUAGES, "und")], "language string")
    merged = groups.join(by_language, "language", "left").crossJoin(pooled).select("language", *[F.coalesce(f"k_{c}", f"all_{c}").alias(f"k_{c}") for c in STATS])  # pooled is one row
    q = lambda c, p: F.kll_sketch_get_quantile_double(F.col(f"k_{c}"), F.lit(p))
    scales = [x for c in STATS for x in (q(c, 0.5).alias(f"m_{c}"), F.greatest((q(c, 0.75) - q(c, 0.25)) / 1.349, F.lit(0.01)).alias(f"d_{c}"), q(c, 0.01).alias(f"lo_{c}"), q(c, 0.99).alias(f"hi_{c}"))]
    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    small = F.broadcast(merged.select("language", *[F.kll_sketch_get_quantile_double(F.col(f"k_{c}"), grid).alias(f"q_{c}") for c in STATS], *scales))  # five rows
    both = rows.join(small, "language")
    out = both.select(
        key, "language", *STATS, "filled", *[f"{e}_{c}" for c in TAILS for e in ("lo", "hi")],
        *[F.expr(f"size(filter(q_{c}, q -> q <= {c})) / 101").alias(f"pct_{c}") for c in STATS],
        *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(f"z_{c}") for c in STATS],
    )
    low = lambda c: (F.col(f"z_{c}") <= -tail) | (F.col(c) < F.col(f"lo_{c}"))
    high = lambda c: (F.col(f"z_{c}") >= tail) | (F.col(c) > F.col(f"hi_{c}"))
    odd = [low(c) if side < 0 else high(c) if side > 0 else low(c) | high(c) for c, side in TAILS.items()]
    # Without any prose there are no z-scores; everything is a candidate then.
    out = out.withColumn("tails", reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(True)).cast("int") for x in odd]))
    return out.withColumn("flagged", F.col("filled") & (F.col("tails") > 0) & (F.col("sentence_share") < majority)).drop("filled", *[f"{e}_{c}" for c in TAILS for e in ("lo", "hi")])
