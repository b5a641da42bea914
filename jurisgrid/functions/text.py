"""Text normalisers and helpers as column expressions (whole-stage code, no Python)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _chain(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


_LINES = ("\r\n?", "\n")
_EDGES = (r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")
_ZERO = "[\\x{200B}-\\x{200D}\\x{FEFF}]"


def normalize_extractor(c: Column) -> Column:
    """Line ends, no-break and zero-width characters; blanks collapsed and trimmed in each line; at most one empty line."""
    return _chain(c, _LINES, ("\\x{A0}", " "), (_ZERO, ""), (r"[ \t]+", " "), (r"(?m)^ | $", ""), (r"\n{3,}", "\n\n"), _EDGES)


def normalize_core(c: Column) -> Column:
    """As the parsers see text: blanks collapsed, none beside a line end."""
    return _chain(c, _LINES, ("\\x{A0}", " "), (_ZERO, ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), _EDGES)


def normalize_detector(c: Column) -> Column:
    """As the type detector sees text: also ligatures, quotes, dashes, ellipses and a misread 'Article'."""
    c = _chain(c, _LINES, ("\\x{A0}", " "), (_ZERO, ""), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), (r"\bArtic[1I]e\b", "Article"))
    return _chain(F.translate(c, "‘’“”–—", "''\"\"--"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), _EDGES)


def normalize_comparable(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def preview(c: Column, n: int) -> Column:
    """At most n characters, cut back to the last blank if that is far enough, with an ellipsis."""
    t = F.trim(c)
    head = F.substring(t, 1, n)
    back = F.length(head) - F.instr(F.reverse(head), " ")
    spaced = (F.instr(head, " ") > 0) & (back > 0.7 * n)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.when(spaced, F.substring(head, F.lit(1), back)).otherwise(head), F.lit("...")))


def starts_of(text: Column, pattern: str) -> Column:
    """0-based offsets of all matches of a pattern that cannot match the empty string.

    Offset of match i: the lengths of the pieces between matches up to i plus those of the matches before it.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("p"), F.transform(found, F.length).alias("m"))
    step = lambda a, x: F.struct((a["at"] + x["p"] + F.coalesce(x["m"], F.lit(0))).alias("at"), F.when(x["m"].isNotNull(), F.concat(a["out"], F.array((a["at"] + x["p"]).cast("int")))).otherwise(a["out"]).alias("out"))
    return F.aggregate(steps, zero, step, lambda a: a["out"])


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Letters without their accents, compatibility forms decomposed; there is no such built-in function."""
    import unicodedata

    return text.map(lambda t: None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def slugify(c: Column, most: int = 80, accents: bool = True) -> Column:
    """Lower case, other characters to single dashes, cut; with ``accents`` letters lose theirs first, else they are other characters."""
    plain = F.lower(without_marks(c) if accents else c)
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def normalize_inline(c: Column) -> Column:
    """Blanks and tabs to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}|\t", " "), r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; there is no such built-in function."""
    import unicodedata

    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))
