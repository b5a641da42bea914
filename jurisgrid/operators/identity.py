"""Fingerprints, canonical identities and duplicates of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.functions.registry import TYPE_LABELS
from jurisgrid.functions.text import nfkc, normalize_comparable, slugify

_MASK = 0xFFFFFFFF


def _hash(text: str) -> str:
    """53-bit style multiply-xor fold of the UTF-16 units, as 16 hexadecimal digits."""
    a, b = 0xDEADBEEF, 0x41C6CE57
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(raw).cast("H"):
        a = ((a ^ unit) * 2654435761) & _MASK
        b = ((b ^ unit) * 1597334677) & _MASK
    return _finish(a, b)


def _finish(a: int, b: int) -> str:
    a = (((a ^ (a >> 16)) * 2246822507) & _MASK) ^ (((b ^ (b >> 13)) * 3266489909) & _MASK)
    b = (((b ^ (b >> 16)) * 2246822507) & _MASK) ^ (((a ^ (a >> 13)) * 3266489909) & _MASK)
    return f"{b:08x}{a:08x}"


def _hash_many(texts: list[str]) -> list[str]:
    """:func:`_hash` of many texts: those of like length are folded side by side, one unit of each at a time."""
    out = [""] * len(texts)
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(units[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(units[order[stop]]) <= 4_000_000:
            stop += 1
        part = order[start:stop]
        start = stop
        if len(part) < 16:  # few long texts: the plain fold is faster
            for i in part:
                out[i] = _hash(texts[i])
            continue
        lengths = np.array([len(units[i]) for i in part])
        grid = np.zeros((lengths[-1], len(part)), np.uint64)
        for c, i in enumerate(part):
            grid[: lengths[c], c] = units[i]
        a, b, mask = np.full(len(part), 0xDEADBEEF, np.uint64), np.full(len(part), 0x41C6CE57, np.uint64), np.uint64(_MASK)
        first = np.searchsorted(lengths, np.arange(lengths[-1]), side="right")  # texts still alive at a unit
        for t in range(lengths[-1]):
            f = first[t]
            a[f:] = ((a[f:] ^ grid[t, f:]) * np.uint64(2654435761)) & mask
            b[f:] = ((b[f:] ^ grid[t, f:]) * np.uint64(1597334677)) & mask
        for c, i in enumerate(part):
            out[i] = _finish(int(a[c]), int(b[c]))
    return out


@F.pandas_udf(T.StringType())
def fold_hash(text: pd.Series) -> pd.Series:
    there = text.notna()
    out = pd.Series([None] * len(text), index=text.index, dtype=object)
    out[there] = _hash_many(text[there].tolist())
    return out


def fingerprint_text(c: Column) -> Column:
    t = nfkc(F.coalesce(c, F.lit("")))
    for pattern, to in ((r"\r\n?", "\n"), ("\\x{A0}", " "), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, to)
    return t


def fingerprint(c: Column) -> Column:
    """fp- and 16 hexadecimal digits of the normalised text."""
    return F.concat(F.lit("fp-"), fold_hash(fingerprint_text(c)))


def meaningful(c: Column) -> Column:
    """The trimmed value, or null for blanks and 'unknown'."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "unknown", "null", "undefined"), t)


def first_meaningful(*columns: Column) -> Column:
    return F.coalesce(*[meaningful(c) for c in columns])


def infer_jurisdiction(title: Column, court: Column, filename: Column, text: Column, most: int = 3000) -> Column:
    """France, United States or European Union by words of the title, court, file name and the first ``most`` characters (a feature: the
    opening names the country, later words cite others)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat_ws("\n", blank(title), blank(court), blank(filename), F.substring(blank(text), 1, most))
    edge, after = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return (
        F.when(head.rlike(rf"(?iu){edge}(france|fran[cç]aise|cour d'appel|tribunal|prud'hommes|conseil d['’]etat){after}"), "France")
        .when(head.rlike(rf"(?iu){edge}(?:united states|we the people){after}|{edge}u\.s\.(?=[A-Za-z0-9_])"), "United States")
        .when(head.rlike(rf"(?iu){edge}(european union|union européenne){after}|{edge}(règlement \(ue\)|regulation \(eu\)|directive \(eu\))(?=[A-Za-z0-9_])"), "European Union")
    )


def compact_authority(c: Column) -> Column:
    """Authority with the usual short forms of four kinds of French courts."""
    for name, short in (("Tribunal de commerce", "TC"), ("Tribunal administratif", "TA"), ("Cour d'appel", "CA"), ("Conseil de prud'hommes", "CPH")):
        c = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])", short)
    return c


def build_identity(df: DataFrame, text: str, kind: str, metadata: str, filename: str) -> DataFrame:
    """Add the identity of each document: jurisdiction, authority, date, reference, titles, fingerprint, canonical id, confidence, warnings.

    ``metadata`` is a map of the fields that the parser found. Each part is its first meaningful field; a missing one is null. The confidence is 20, with
    15 for jurisdiction and date, 20 for authority and reference, 5 for a file name and 5 for more than 200 characters of text.
    """
    m = lambda name: F.try_element_at(metadata, F.lit(name))
    reference = first_meaningful(*map(m, ("regulation_number", "directive_number", "case_number", "act_number", "treaty_name", "reference")))
    authority = first_meaningful(*map(m, ("court", "body", "institution", "authority")))
    date = first_meaningful(*map(m, ("judgment_date", "adoption_date", "signature_date", "date")))
    jurisdiction = first_meaningful(m("jurisdiction"), infer_jurisdiction(m("title"), m("court"), F.col(filename), F.col(text)))
    title = first_meaningful(m("title"), m("short_title"))
    # The generators keep the parts from being computed again wherever they are used.
    found = F.struct(jurisdiction.alias("jurisdiction"), authority.alias("authority"), date.alias("date"), reference.alias("reference"), title.alias("_title"))
    parts = df.withColumn("_p", F.explode(F.array(found))).select("*", "_p.*").drop("_p")
    title = F.col("_title")
    file_title = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]+$", ""), "[-_]+", " ")), F.lit(""))
    joined = lambda *cs: F.nullif(F.concat_ws(" - ", *cs), F.lit(""))
    ref = F.when(F.col("reference").eqNullSafe(F.col("authority")), F.lit(None)).otherwise(F.col("reference"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv]), F.col(kind))
    display = F.when(F.col(kind) == "judgment", F.coalesce(joined("authority", ref, "date"), title, file_title, F.lit("Untitled Judgment"))).otherwise(F.coalesce(title, joined(label, "jurisdiction", "reference", "date"), file_title, F.lit("Untitled Legal Document")))
    out = parts.withColumn("display_title", F.explode(F.array(display)))
    year = F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])", 1), F.lit(""))
    plain = F.trim(F.regexp_replace("display_title", r"\s+", " "))
    short = F.when(F.col("reference").isNotNull(), joined(compact_authority(F.col("authority")), "reference", year)).otherwise(F.when(F.length(plain) > 72, F.concat(F.substring(plain, 1, 71), F.lit("..."))).otherwise(plain))
    out = out.withColumn("short_title", F.coalesce(meaningful(m("short_title")), short)).withColumn("fingerprint", fingerprint(F.col(text)))
    code = lambda c: F.nullif(slugify(F.substring(F.coalesce(c, F.lit("")), 1, 80), 140), F.lit(""))
    slug = slugify(F.concat_ws("-", F.col(kind), *[code(F.col(c)) for c in ("jurisdiction", "authority", "date", "reference", "display_title")]), 140)
    out = out.withColumn("canonical_id", F.concat_ws("-", slug, F.substring("fingerprint", 1, 10)))
    has = lambda c, n: F.when(c, n).otherwise(0)
    score = 20 + sum(has(F.col(c).isNotNull(), n) for c, n in (("jurisdiction", 15), ("authority", 20), ("date", 15), ("reference", 20))) + has(meaningful(F.col(filename)).isNotNull(), 5) + has(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 200, 5)
    gaps = [F.when(F.col(c).isNull(), F.lit(f"IDENTITY_{c.upper()}_UNKNOWN")) for c in ("jurisdiction", "authority", "date", "reference")] + [F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.lit("IDENTITY_EMPTY_TEXT"))]
    return out.withColumn("identity_confidence", F.least(score, F.lit(100)).cast("int")).withColumn("identity_warnings", F.array_compact(F.array(*gaps))).drop("_title")


def tokens(c: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(F.split(normalize_comparable(c), " "), lambda w: F.length(w) > 2))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger number of words."""
    return F.size(F.array_intersect(tokens(a), tokens(b))) / F.greatest(F.size(tokens(a)), F.size(tokens(b)), F.lit(1))


def first_duplicates(new: DataFrame, library: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(new_id, library_id, reason): for each row of ``new`` the first library row (by ord) that it duplicates.

    A row that is in both tables is no duplicate of itself, so a table can be checked against itself: each row then gets the
    first row before it. Both have id, fingerprint, canonical_id, reference and title; the library also ord. Equality of the fingerprint,
    canonical id, reference (compared as text, 'unknown' included) or title are four equi-joins against the first library row of
    each value, so a value that a third of the library shares costs one row. Similar titles (over 20 characters) meet through their
    prefix of rarest words, which any title over the threshold must share.
    """
    norm = lambda c: normalize_comparable(F.coalesce(F.col(c), F.lit("")))
    parts = []
    for rank, col in enumerate(("fingerprint", "canonical_id", "reference", "title")):
        first = library.select(norm(col).alias("k"), "ord", F.col("id").alias("library_id")).where("k <> ''").groupBy("k").agg(F.min(F.struct("ord", "library_id")).alias("m"))
        parts.append(new.select(F.col("id").alias("new_id"), norm(col).alias("k")).join(first, "k").select("new_id", F.col("m.ord").alias("ord"), F.lit(rank).alias("rank"), F.col("m.library_id").alias("library_id"), F.lit(col).alias("reason")))
    lib = library.select(F.col("id").alias("library_id"), "ord", norm("title").alias("t")).where("length(t) > 20").groupBy("t").agg(F.min(F.struct("ord", "library_id")).alias("m"))
    mine = new.select(norm("title").alias("t")).where("length(t) > 20").distinct()
    words = lambda df: df.select("t", tokens(F.col("t")).alias("w")).where("size(w) > 0")
    a, b = words(mine), words(lib)
    df_w = a.union(b).select("t", F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    keep = lambda d: (
        d.select("t", F.size("w").alias("k"), F.explode("w").alias("w")).join(df_w, "w").groupBy("t", "k").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("ws"))
        .select("t", F.explode(F.slice(F.col("ws"), F.lit(1), (F.col("k") - F.ceil(F.col("k") * threshold) + 1).cast("int"))).alias("x")).select("t", F.col("x.w").alias("w"))
    )
    pairs = keep(a).join(keep(b).withColumnRenamed("t", "t2"), "w").select("t", "t2").distinct().where(title_similarity(F.col("t"), F.col("t2")) > threshold)
    near = pairs.join(lib.withColumnRenamed("t", "t2"), "t2").groupBy("t").agg(F.min("m").alias("m"))
    parts.append(new.select(F.col("id").alias("new_id"), norm("title").alias("t")).join(near, "t").select("new_id", F.col("m.ord").alias("ord"), F.lit(4).alias("rank"), F.col("m.library_id").alias("library_id"), F.lit("similar-title").alias("reason")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("new_id <> library_id")
    best = every.groupBy("new_id").agg(F.min(F.struct("ord", "rank", "library_id", "reason")).alias("m"))
    return best.select("new_id", "m.library_id", "m.reason")

