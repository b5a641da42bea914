"""Free-entered names mapped to a canonical list.

Distinct values are normalised and retrieved through an inverted index of character trigrams over the spellings of the
entries: a hash join of the value's rarest trigrams (those without which no entry can reach the threshold) with the
postings. Candidates are scored by the cosine of IDF-weighted trigrams over the whole list of their kind and accepted above a
threshold and a margin; an exact check follows that the entry's own words are really there, but for typing errors.

What is a type ("Tribunal judiciaire") and what an own name is learnt from the list itself: the split of a name at which the leading and the
trailing run of words are shared by most entries. Short forms of a type come from ``short_name``, abbreviations from the
letters of the words, and names of the type in another language from a glossary of legal words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.common import cut

# Legal words (or parts of compounds) of fr, de and es, and the English words for them.
GLOSSARY = {
    "cour": "court", "tribunal": "court", "gericht": "court", "juzgado": "court", "audiencia": "court", "corte": "court", "sala": "chamber", "conseil": "court council", "consejo": "council",
    "appel": "appeal", "apelacion": "appeal", "cassation": "cassation", "commerce": "commercial", "mercantil": "commercial", "handels": "commercial", "judiciaire": "judicial", "administratif": "administrative",
    "administrativo": "administrative", "verwaltung": "administrative", "prud": "labour", "arbeit": "labour", "trabajo": "labour", "social": "social", "sozial": "social", "superior": "superior high",
    "ober": "higher", "land": "regional", "amts": "local", "provincial": "provincial", "supremo": "supreme", "constitutionnel": "constitutional", "verfassung": "constitutional", "ministere": "ministry",
    "ministerium": "ministry", "justiz": "justice", "parlement": "parliament", "etat": "state", "republique": "republic", "royaume": "kingdom",
}
_STOP = frozenset("of de d du des del la le les lo the der die das el los las y and und von zu in hommes".split())
FILLERS = ("", "unknown", "n/a", "null")
THRESHOLD = 0.2
MARGIN = 0.01


def normal(text: str) -> str:
    """Lower case without accents and signs, single blanks."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^\w]+|_", " ", t).strip()


def core(text: str) -> list[str]:
    """Words of the normalised text without articles and prepositions."""
    return [w for w in normal(text).split() if w not in _STOP]


def grams(words: list[str]) -> Counter:
    """Trigrams of each word with its ends marked; the order of words does not count."""
    return Counter(w[i : i + 3] for w in (f"^{w}$" for w in words) for i in range(len(w) - 2))


def translations(kind: list[str]) -> list[list[str]]:
    """English words for the words of a type, of which at least one is in the glossary; compounds are read from left to right."""
    options: list[list[str]] = []
    known = False
    for w in kind:
        parts = sorted((w.find(stem), stem) for stem in GLOSSARY if (w.startswith(stem) if len(stem) < 5 else stem in w) or len(w) > 9 and stem in w)
        used, here = 0, []
        for at, stem in parts:
            if at >= used:
                here.append(GLOSSARY[stem].split())
                used = at + len(stem)
        known = known or bool(here)
        options += here or [[w]]
    out = [list(dict.fromkeys(p)) for p in product(*options)] if known else []
    return [p for p in out if p != kind]


_ENGLISH = frozenset(w for ws in GLOSSARY.values() for w in ws.split())


def legal_lead(words: list[str]) -> int:
    """Number of leading words that the glossary knows, at most all but one."""
    n = next((i for i, w in enumerate(words) if w not in _ENGLISH and not any(w.startswith(stem) for stem in GLOSSARY)), len(words))
    return min(n, len(words) - 1)


def typing_distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _allowed(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 5 else max(1, int(0.34 * n))


def _take(part: list[str], words: list[str]) -> list[str] | None:
    """``words`` without a run that spells ``part`` but for typing errors, or None; runs may be one word longer or shorter."""
    text = "".join(part)
    most = _allowed(len(text))
    best = None
    for k in {max(1, len(part) - 1), len(part), len(part) + 1}:
        for i in range(len(words) - k + 1):
            d = typing_distance(text, "".join(words[i : i + k]), most)
            if d <= most and (best is None or (d, k) < best[0]):
                best = ((d, k), words[:i] + words[i + k :])
    return best[1] if best else None


@lru_cache(maxsize=100_000)
def _own_left(own: tuple[str, ...], words: tuple[str, ...]) -> list[str] | None:
    return _take(list(own), list(words))


def _shortens(word: str, full: str) -> bool:
    """Whether a word of two or more letters abbreviates another: its letters in order from the first, or a part of a compound."""
    if len(word) < 2 or len(word) >= len(full):
        return False
    if word[0] == full[0]:
        letters = iter(full)
        if all(c in letters for c in word):
            return True
    if len(word) >= 5 and any(typing_distance(word, full[: len(word) + d], 2) <= _allowed(len(word)) - 1 for d in (-1, 0, 1)):
        return True
    return len(word) >= 3 and word in full


def coverage(words: list[str], own: list[str], kind: list[str]) -> float:
    """Exact check of a candidate: the share of the words of the entry's type that the value has, or 0 if it fails.

    The value must have the entry's own words and, if it says more, at least half of the words of the type ("Ministry" for a Ministry
    of Justice: whether it is the only one is for the margin to decide), each but for typing errors or abbreviated.
    """
    rest = _own_left(tuple(own), tuple(words))
    if rest is None:
        return 0.0
    if not kind:
        return float(not rest)
    got = 0
    for k in kind:
        left = _take([k], rest)
        if left is None:
            short = next((i for i, w in enumerate(rest) if _shortens(w, k)), None)
            if short is None:
                continue
            # Several parts may stand for one compound ("Verw. Ger.").
            left = [w for i, w in enumerate(rest) if i != short and not (len(k) > 9 and len(w) >= 3 and w in k)]
        got += 1
        rest = left
    return got / len(kind) if 2 * got >= len(kind) else 0.0


_WORDS = T.ArrayType(T.StringType())


@F.pandas_udf(_WORDS)
def core_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: core(t) if t is not None else [])


@F.pandas_udf(T.IntegerType())
def glossary_lead(words: pd.Series) -> pd.Series:
    return words.map(lambda w: legal_lead(list(w)))


@F.pandas_udf(T.ArrayType(_WORDS))
def translated(kind: pd.Series) -> pd.Series:
    return kind.map(lambda k: translations(list(k)))


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def gram_counts(words: pd.Series) -> pd.Series:
    return words.map(lambda w: dict(grams(list(w))))


@F.pandas_udf(T.DoubleType())
def covered(words: pd.Series, own: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([coverage(list(w), list(o), list(k)) for w, o, k in zip(words, own, kind)])


def spellings(entries: DataFrame) -> DataFrame:
    """(kind, entry_id, own, type, way): the ways to write each entry.

    The type is the leading run of words at that split of the name where the product of the logarithms of the number of names (of
    the kind) with this lead and of names (of any kind) with this end is largest. Where a name shares nothing, its leading words of the
    glossary are its type. Ways: the full name;
    every short form that some entry of the type has; the type in English; and the own name alone where no other entry of
    the kind has it. A short form that doesn't end with the own name ("HES") is a way of its own.
    """
    e = entries.where("kind is not null and entry_id is not null and entry_name is not null").select("kind", "entry_id", core_words("entry_name").alias("words"), core_words("short_name").alias("short")).where("size(words) > 0").distinct()
    cuts = e.where("size(words) > 1").select("kind", "entry_id", "words", glossary_lead("words").alias("legal"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("i"))
    cuts = cuts.select("kind", "entry_id", "words", (F.col("i") == F.col("legal")).alias("legal"), F.slice("words", F.lit(1), F.col("i")).alias("lead"), F.slice("words", F.col("i") + 1, F.size("words")).alias("end"))
    leads = cuts.groupBy("kind", "lead").agg(F.count_distinct("entry_id").alias("n_lead"))
    ends = cuts.groupBy("end").agg(F.count_distinct("kind", "entry_id").alias("n_end"))
    best = (
        cuts.join(leads, ["kind", "lead"]).join(ends, "end").where("n_lead > 1 or legal")
        .groupBy("kind", "entry_id", "words").agg(F.max_by(F.struct("lead", "end"), F.struct(F.log("n_lead") * F.log("n_end"), "legal", F.col("n_lead") * F.col("n_end"), F.size("end"))).alias("b"))
    )
    none = F.expr("cast(array() as array<string>)")
    parts = cut(e.join(best, ["kind", "entry_id", "words"], "left").select("kind", "entry_id", "short", F.coalesce("b.end", "words").alias("own"), F.coalesce("b.lead", none).alias("type")))
    full = parts.select("kind", "entry_id", "own", "type")
    tail = F.slice("short", F.greatest(F.size("short") - F.size("own") + 1, F.lit(1)), F.greatest(F.size("own"), F.lit(1)))
    fits = (F.size("short") > F.size("own")) & (tail == F.col("own"))
    forms = parts.where("size(type) > 0").where(fits).select("kind", "type", F.slice("short", F.lit(1), F.size("short") - F.size("own")).alias("form")).distinct()
    short = full.join(forms, ["kind", "type"]).select("kind", "entry_id", "own", F.col("form").alias("type"))
    alone = parts.where("size(short) > 0").where(~fits).select("kind", "entry_id", F.col("short").alias("own"), none.alias("type"))
    kinds = full.where("size(type) > 0").select("kind", "type").distinct().select("kind", "type", F.explode(translated("type")).alias("form"))
    english = full.join(kinds, ["kind", "type"]).select("kind", "entry_id", "own", F.col("form").alias("type"))
    single = full.groupBy("kind", "own").agg(F.count_distinct("entry_id").alias("n"), F.min("entry_id").alias("entry_id")).where("n = 1").select("kind", "entry_id", "own", none.alias("type"))
    every = full.unionByName(short).unionByName(alone).unionByName(english).unionByName(single).distinct()
    return every.withColumn("way", F.xxhash64("kind", "entry_id", F.array_join("own", " "), F.array_join("type", " ")))


def _weighted(rows: DataFrame, key: list[str], idf: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, gram, w: unit vectors of the trigram counts in map column ``g``; trigrams that the list lacks weigh most."""
    long = rows.select(*key, "kind", F.explode("g").alias("gram", "n")) if "kind" not in key else rows.select(*key, F.explode("g").alias("gram", "n"))
    w = long.join(idf, ["kind", "gram"], "left").join(F.broadcast(sizes), "kind").withColumn("x", F.col("n") * F.coalesce("idf", F.log1p(F.col("entries").cast("double"))))
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return w.join(norm, key).select(*dict.fromkeys([*key, "kind"]), "gram", (F.col("x") / F.col("norm")).alias("w"), F.col("idf").isNotNull().alias("known"))


def match_names(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(kind, value, entry_id, score) for each distinct (kind, value); entry_id is -1 if none passes or two are as good.

    ``values`` has kind and value, ``entries`` kind, entry_id, entry_name and short_name. Null values have no row; a kind without entries,
    or an empty list, gives -1 for all its values; entries with a null name are skipped.

    Nothing is collected: postings and values are tables, joined on the trigram. Only a value's rarest trigrams look for
    candidates, so many that the others together cannot reach the threshold; which leaves out the long
    postings without losing an entry.
    """
    ways = spellings(entries)
    ways = cut(ways.withColumn("g", gram_counts(F.concat("own", "type"))))
    sizes = ways.groupBy("kind").agg(F.count_distinct("entry_id").alias("entries"))  # a row for each kind
    seen = ways.select("kind", "entry_id", F.explode(F.map_keys("g")).alias("gram")).groupBy("kind", "gram").agg(F.count_distinct("entry_id").alias("df"))
    idf = cut(seen.join(F.broadcast(sizes), "kind").select("kind", "gram", F.log1p(F.col("entries") / F.col("df")).alias("idf")))
    postings = cut(_weighted(ways.select("way", "kind", "g"), ["way"], idf, sizes))
    way_vectors = postings.groupBy("way").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("wv")).join(ways.select("way", "entry_id", "own", "type"), "way")
    distinct = values.where("kind is not null and value is not null").select("kind", "value").distinct()
    # The work is in the comparison, not in the bytes, so the partitions must not be merged by their size.
    cores = max(values.sparkSession.sparkContext.defaultParallelism, 2)
    distinct = cut(distinct.repartition(cores).withColumn("words", core_words("value")))
    vectors = cut(_weighted(distinct.select("kind", "value", gram_counts("words").alias("g")), ["kind", "value"], idf, sizes))
    order = Window.partitionBy("kind", "value").orderBy("w", "gram").rowsBetween(Window.unboundedPreceding, 0)  # the trigrams of one name
    ranked = vectors.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(order)).withColumn("low", F.col("rest") < threshold * threshold / 4)
    rare = ranked.where("not low and known").select("kind", "value", "gram", "w")
    part = rare.join(postings.select("kind", "gram", "way", F.col("w").alias("pw")), ["kind", "gram"]).groupBy("kind", "value", "way").agg(F.sum(F.col("w") * F.col("pw")).alias("part"))
    value_vectors = ranked.groupBy("kind", "value").agg(F.sqrt(F.coalesce(F.max(F.when(F.col("low"), F.col("rest"))), F.lit(0.0))).alias("most"), F.map_from_entries(F.collect_list(F.when(F.col("low") & F.col("known"), F.struct("gram", "w")))).alias("vv"))
    # The trigrams left out add at most their own length.
    pairs = part.join(value_vectors.join(distinct, ["kind", "value"]), ["kind", "value"]).where(F.col("part") + F.col("most") >= threshold).repartition(cores, "kind", "value")
    dot = F.aggregate(F.map_entries("vv"), F.col("part"), lambda a, x: a + x["value"] * F.coalesce(F.try_element_at("wv", x["key"]), F.lit(0.0)))
    scored = pairs.join(way_vectors, "way").withColumn("score", dot).where(F.col("score") >= threshold)
    checked = scored.withColumn("share", covered("words", "own", "type")).where("share > 0")
    # Among candidates with the same own name the one whose type is there in full leads.
    best = checked.withColumn("score", F.col("score") * (F.col("share") + 1) / 2).groupBy("kind", "value", "entry_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("kind", "value").orderBy(F.desc("score"), "entry_id")
    two = best.withColumn("at", F.row_number().over(top)).where("at <= 2").groupBy("kind", "value").agg(F.max(F.when(F.col("at") == 1, F.struct("entry_id", "score"))).alias("a"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("a.score") - F.col("second") >= margin)
    found = two.select("kind", "value", F.when(clear, F.col("a.entry_id")).otherwise(-1).alias("entry_id"), F.col("a.score").alias("score"))
    return distinct.select("kind", "value").join(found, ["kind", "value"], "left").select("kind", "value", F.coalesce("entry_id", F.lit(-1)).cast("long").alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def free_entered(records: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``records`` (kind, record_id, value) whose value is no filler and not, letter for letter, an entry's name."""
    real = records.where(F.col("value").isNotNull() & ~F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))).isin(*FILLERS))
    names = entries.select("kind", F.col("entry_name").alias("value")).distinct()
    return real.join(names, ["kind", "value"], "left_anti")
