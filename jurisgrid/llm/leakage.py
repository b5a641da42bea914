"""Evaluation texts leaking into training text.

Words are folded (case, accents) and canonicalised to templates: digits become one placeholder, names (any word that the items
never write in lower case) another. Windows of ``width`` template tokens are hashed and hash-joined with the windows of the items;
equal windows are checked word for word ('exact'), or for consistent slots where only the parameters of an item were changed
('template'). As a changed number or name may have another count of words, reworked items are also sought over tokens in which
each run of number words (a number with its thousand and decimal groups) and each run of name words is one placeholder, and a
unit beside a number is one of its type.

Nothing that grows with the items is collected. The lexicon of all items and the set of their window hashes reach the workers as
filters of a fixed number of bits: documents are read where they are, and only windows whose bit is set (nearly all of them true
hits) are shuffled to the join. A bit set by chance costs a row there, never a result; the lexicon's bits decide alike on both sides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisgrid.common import cut

WIDTH = 20
LEXICON_BITS = 25  # 4 MB
WINDOW_BITS = 26  # 8 MB
MIN_FIXED = 10  # words of a template window that are not placeholders
_BUCKET = 32768
_RUN = re.compile(r"[^\W_]+")
_NUMBER, _NAME = 1, 2
# Units beside a number, by type (folded: no case, no accents).
UNITS = {
    "money": "eur euro euros usd dollar dollars dolares gbp pound pounds pfund livres libras chf franc francs franken francos cent cents centimes centimos",
    "share": "percent prozent",
    "time": "second seconds minute minutes hour hours day days week weeks month months year years seconde secondes heure heures jour jours semaine semaines mois an ans annee annees sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren segundo segundos minuto minutos hora horas dia dias semana semanas mes meses ano anos",
    "length": "mm cm m km metre metres meter meters metern metro metros kilometre kilometres kilometer kilometers kilometern kilometro kilometros mile miles meile meilen",
    "area": "ha hectare hectares hektar hectarea hectareas m2 km2",
    "weight": "g kg t gramme grammes gram grams gramm gramo gramos kilogramme kilogrammes kilogram kilograms kilogramm kilogramo kilogramos tonne tonnes ton tons tonnen tonelada toneladas",
    "volume": "litre litres liter liters litern litro litros m3",
}
_UNIT = {w: _NAME + 1 + n for n, ws in enumerate(UNITS.values()) for w in ws.split()}
_MONEY, _LAST = _UNIT["eur"], _NAME + len(UNITS)  # placeholders are the codes up to _LAST
_SIGNS = {"€": " eur ", "$": " usd ", "£": " gbp ", "%": " percent "}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 500_000  # words whose codes a worker keeps


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    d = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in d if not unicodedata.combining(c)) if not d.isascii() else d


def folded_words(text: str) -> list[str]:
    return _RUN.findall(fold(text))


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def lexicon_words(text: str) -> set[str]:
    """Folded words that a text writes in lower case."""
    return {f for w in _RUN.findall(text) if w.islower() for f in [fold(w)] if not f.isdigit()}


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` codes (wrapping 64-bit polynomial)."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _BASE + codes[k : k + len(h)]
    return h


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """Well-spread top bits of hashes."""
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _set_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places of a little-endian bitmap are set."""
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Templates:
    """Texts to template windows, given the filter of lexicon words."""

    def __init__(self, lexicon: np.ndarray, width: int = WIDTH):
        self.lexicon, self.width = lexicon, width
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        new = [w for w in set(words) if w not in known]
        if new:
            h = np.fromiter((word_hash(w) for w in new), np.uint64, len(new))
            inside = _set_bits(self.lexicon, _mixed(h, LEXICON_BITS))
            for w, x, i in zip(new, h.tolist(), inside.tolist()):
                known[w] = _NUMBER if w.isdigit() else x + _LAST + 1 & 0xFFFFFFFFFFFFFFFF if i else _NAME
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    @staticmethod
    def merge(words: list[str], codes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Tokens and codes with a typed placeholder for a unit beside a number and one for each run of numbers or names."""
        if not len(codes):
            return words, codes
        unit = np.fromiter((_UNIT.get(w, 0) for w in words), np.uint64, len(words))
        number = np.r_[False, codes == _NUMBER, False]
        beside = number[:-2] | number[2:] & (unit == _MONEY)
        codes = np.where((unit > 0) & beside, unit, codes)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (codes[1:] > _NAME)])
        if len(starts) == len(words):
            return words, codes
        return [words[a] if b == a + 1 else " ".join(words[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)])], codes[starts]

    def streams(self, text: str, reworked: bool) -> list[tuple[list[str], np.ndarray]]:
        """(words, codes) of a text and, if ``reworked``, of its tokens with merged placeholders."""
        folded = fold(text)
        words = _RUN.findall(folded)
        codes = self.codes(words)
        out = [(words, codes)]
        if reworked:
            signs = [s for s in _SIGNS if s in folded]
            for s in signs:
                folded = folded.replace(s, _SIGNS[s])
            if signs:
                words = _RUN.findall(folded)
                codes = self.codes(words)
            out.append(self.merge(words, codes))
        return out

    def window(self, words: list[str], codes: np.ndarray, p: int) -> tuple[bytes, bytes | None]:
        """(form, slots) of the window at p: a hash of its words, and its placeholders with their values numbered as they come.

        Two windows of one template have consistent slots, each value on one side standing for one on the other, exactly if
        ``slots`` is equal. It is None where less than ``MIN_FIXED`` words are fixed: nearly any text would fit such a template.
        """
        part, c = words[p : p + self.width], codes[p : p + self.width].tolist()
        form = blake2b("\x1f".join(part).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        seen: dict[tuple[int, str], int] = {}
        slots = [(x, seen.setdefault((x, w), len(seen))) for w, x in zip(part, c) if x <= _LAST]
        return form, None if self.width - len(slots) < MIN_FIXED else b"".join(bytes((x, k)) for x, k in slots)


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` address bits of the distinct places in column ``at``; what is collected has at most that size."""
    maps = hashes.groupBy(F.expr(f"at div {_BUCKET}").alias("b")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        at = r["b"] * (_BUCKET // 8)
        out[at : at + len(m)] = m[: len(out) - at]
    return out


WINDOW_SCHEMA = "stream int, hash long, form binary, slots binary"


def template_windows(texts: DataFrame, lexicon: np.ndarray, width: int, reworked: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, stream, hash, form, slots) of the windows of each text (columns id and text), of those only whose bit is in ``wanted``."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((lexicon, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, want = shared.value
        make = Templates(lex, width)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["id"], pdf["text"]):
                seen = set()
                for n, (words, codes) in enumerate(make.streams(t, reworked)):
                    h = _windows(codes, width)
                    if not len(h):
                        continue
                    places = range(len(h)) if want is None else np.flatnonzero(_set_bits(want, _mixed(h, WINDOW_BITS))).tolist()
                    signed = h.view(np.int64)
                    for p in places:
                        row = (n, int(signed[p]), *make.window(words, codes, p))
                        if row not in seen:
                            seen.add(row)
                            out.append((k, *row))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["id", "stream", "hash", "form", "slots"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["id", "stream", "hash", "form", "slots"])

    return texts.mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, {WINDOW_SCHEMA}")


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, reworked: bool = True) -> DataFrame:
    """(key, item_id, how): documents that hold ``width`` or more consecutive words of an item ('exact'), or
    the item's template over such a window, of words or of merged placeholders, with other numbers, names or units in
    consistent slots ('template'). Without ``reworked`` only the words themselves are compared: 'exact' is whole.

    Null texts and items are skipped, texts shorter than a window hold no item, repeated documents and items come
    out once for each key, and rows with a null key are left out. Empty tables give no rows.
    """
    its = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).dropna()
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).dropna()

    @F.pandas_udf("array<long>")
    def lexicon_places(texts: pd.Series) -> pd.Series:
        def places(t: str) -> list[int]:
            ws = sorted(lexicon_words(t))
            return _mixed(np.fromiter((word_hash(w) for w in ws), np.uint64, len(ws)), LEXICON_BITS).astype(np.int64).tolist()

        return texts.map(places)

    @F.pandas_udf("long")
    def window_place(h: pd.Series) -> pd.Series:
        return pd.Series(_mixed(h.to_numpy(np.int64).view(np.uint64), WINDOW_BITS).astype(np.int64))

    lexicon = _filter(its.select(F.explode(lexicon_places("text")).alias("at")), LEXICON_BITS)
    theirs = cut(template_windows(its, lexicon, width, reworked).withColumnRenamed("id", "item_id"))
    wanted = _filter(theirs.select(window_place("hash").alias("at")), WINDOW_BITS)
    mine = template_windows(rows, lexicon, width, reworked, wanted)
    exact = (F.col("stream") == 0) & (F.col("d.form") == F.col("i.form"))
    same = F.when(exact, 1).when(F.col("d.slots") == F.col("i.slots"), 0) if reworked else F.when(exact, 1)
    pairs = mine.alias("d").join(theirs.alias("i"), ["stream", "hash"]).select(F.col("d.id").alias("id"), "item_id", same.alias("same")).where("same is not null")
    found = pairs.groupBy("id", "item_id").agg(F.max("same").alias("same"))
    return found.select(F.col("id").alias(key), "item_id", F.when(F.col("same") == 1, "exact").otherwise("template").alias("how"))
