"""Identifiers of legal elements as column expressions: numerals, canonical ids, sort keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words.
ORDINALS = {
    "en": "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth",
    "fr": "premier deuxième troisième quatrième cinquième sixième septième huitième neuvième dixième onzième douzième treizième quatorzième quinzième seizième",
    "de": "erste zweite dritte vierte fünfte sechste siebte achte neunte zehnte elfte zwölfte dreizehnte vierzehnte fünfzehnte sechzehnte siebzehnte achtzehnte neunzehnte zwanzigste",
    "es": "primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo",
}
SUFFIXES = ["BIS", "TER", "QUATER", "QUINQUIES", "SEXIES", "SEPTIES", "OCTIES", "NOVIES", "DECIES"]
_ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def pad4(c: Column) -> Column:
    """Zeros to four places; longer numbers stay whole."""
    return F.lpad(c, F.greatest(F.lit(4), F.length(c)), F.lit("0"))


def roman_to_int(c: Column) -> Column:
    """Value of a well-formed Roman numeral, else null: the letters' values less twice each subtractive pair's smaller one."""
    u = F.upper(c)
    count = lambda p: F.regexp_count(u, F.lit(p))
    plain = reduce(lambda a, b: a + b, [count(p) * v for p, v in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))])
    less = (count("IV|IX") * 2) + (count("XL|XC") * 20) + (count("CD|CM") * 200)
    return F.when(u.rlike(_ROMAN) & (u != ""), plain - less)


def normalize_number(raw: Column, language: Column | str = "en") -> Column:
    """Normal form of an identifier: four places, Latin suffix (12 bis: 0012-BIS), ranges part by part."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[.,;:]+$", "")
    language = F.lit(language) if isinstance(language, str) else language
    ends = F.when(language == "fr", "^(\\d+)(er|ere|ère|eme|ème|e)$").when(language == "de", "^(\\d+)(te|ste)$").when(language == "es", "^(\\d+)(°|º)$").otherwise("^(\\d+)(st|nd|rd|th)$")
    text = F.regexp_replace(text, F.concat(F.lit("(?i)"), ends), F.lit("$1"))
    words = F.create_map(*[x for words in ORDINALS.values() for i, w in enumerate(words.split(), 1) for x in (F.lit(w), F.lit(i))])

    def single(p: Column) -> Column:
        letter = F.regexp_extract(p, r"^(\d+)([A-Za-z])$", 2)
        return (
            F.when(p == "", "0000")
            .when(p.rlike(r"^\d+$"), pad4(p))
            .when(letter != "", F.concat(pad4(F.regexp_extract(p, r"^(\d+)", 1)), F.lower(letter)))
            .when(F.map_contains_key(words, F.lower(p)), pad4(F.element_at(words, F.lower(p)).cast("string")))
            .when(roman_to_int(p).isNotNull(), pad4(roman_to_int(p).cast("string")))
            .otherwise(F.upper(p))
        )

    suffix = F.regexp_extract(text, r"(?i)^(.+?)\s*\b(" + "|".join(SUFFIXES) + ")$", 2)
    base = F.trim(F.regexp_extract(text, r"(?i)^(.+?)\s*\b(" + "|".join(SUFFIXES) + ")$", 1))
    parts = F.array_join(F.transform(F.split(text, "[-–—]"), lambda p: single(F.trim(p))), "-")
    return F.when(suffix != "", F.concat(single(base), F.lit("-"), F.upper(suffix))).otherwise(parts)


def canonical_id(prefix: Column, number: Column) -> Column:
    return F.when(prefix == "PREAMBLE", F.lit("PREAMBLE")).otherwise(F.concat_ws("-", prefix, number))


def sort_key(canonical: Column) -> Column:
    """Latin suffixes as numbers from 0998 on; the first that ends the id is replaced, in the given order, so TER also ends QUATER."""
    done = canonical
    for i, s in enumerate(SUFFIXES):
        done = F.regexp_replace(done, f"{s}$", str(998 + i).rjust(4, "0"))
    return done


def parse_canonical_id(c: Column) -> Column:
    """struct<prefix, number, base, suffix> of a canonical id; an id without a number has its whole as prefix."""
    number = F.when(F.contains(c, F.lit("-")), F.regexp_extract(c, "^[^-]+-(.*)$", 1))
    suffix = F.regexp_extract(c, "-(" + "|".join(SUFFIXES) + ")$", 1)
    base = F.when(suffix != "", F.regexp_replace(number, "-[A-Z]+$", "")).otherwise(number)
    return F.struct(F.regexp_extract(c, "^([^-]+)", 1).alias("prefix"), number.alias("number"), base.alias("base"), F.nullif(suffix, F.lit("")).alias("suffix"))
