"""Noise of scanned pages: running headers and page numbers, words broken at line ends, misread characters.

Running headers are the whole lines of a scanned document that come again: its opening lines, or a line with a reference number of
another unit before it. A frequency lexicon of the whole corpus is counted with partial counts in the workers. Words that scanned units
use and clean files don't, or not nearly as often, are suspects; a symmetric-delete index on confusion-folded forms (equal, or equal after one
deletion on either side) generates lexicon candidates by hash joins, a weighted edit distance with confusion pairs
accepts them, and the counts of the word before (bigrams) pick among several. Words, deletions and candidates
are never collected; what the workers get is the bounded list of the most frequent clean words, which only spares
shuffling words that are surely right.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.common import cut
from jurisgrid.llm.skeleton import skeleton

TRUSTED = 50_000  # most frequent clean words kept in the workers, with at least TRUSTED_COUNT uses
TRUSTED_COUNT = 20
FLUSH = 200_000
STRONG = 12
ODD_USE = 8  # times the expected uses in scans from which a word of clean files is suspect
# What scanners read for a letter.
CONFUSIONS = [
    ("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("i", "!"), ("i", "l"), ("i", "1"), ("i", "|"),
    ("l", "1"), ("l", "i"), ("l", "|"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("e", "6"), ("b", "8"), ("z", "2"), ("q", "9"),
]
_PAIRS: dict[str, list[str]] = {}
for _good, _read in CONFUSIONS:
    _PAIRS.setdefault(_good, []).append(_read)
# Classes of single characters that are read for each other (h and u share one, as li and ii do), then pairs read for one letter.
_SINGLE = str.maketrans({"!": "i", "|": "i", "1": "i", "l": "i", "h": "u", "0": "o", "5": "s", "9": "g", "q": "g", "6": "e", "8": "e", "b": "e", "c": "e", "f": "t", "2": "z"})
_DOUBLE = re.compile("rn|ri|ii|ei|vv")
_DOUBLES = {"rn": "m", "ri": "n", "ii": "u", "ei": "d", "vv": "w"}
SIGNS = "-‐­¬"
_BREAK = re.compile(rf"([^\W\d_]+)([{SIGNS}])[ \t]*\n[ \t]*([^\W\d_]+)")
_TAIL = re.compile(rf"([^\W\d_]+)([{SIGNS}])\s*\Z")
_HEAD = re.compile(r"\s*([^\W\d_]+)")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[!|](?=[^\W_]))*")
_HYPHENED = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_PAGE = re.compile(
    r"^\W{0,3}(?:(?:page|p(?:á|a)gina|seite|p|pag|pág|s|blatt|folio|fol)\.?\s*)?(?:\d{1,4}|[ivxl]{1,7})(?:\s*(?:/|of|sur|von|de|\|)\s*(?:\d{1,4}|[ivxl]{1,7}))?\W{0,3}$", re.I
)
_VERSUS = ("v.", "V.", "v")
_DOCKET = r"(?<![\w/.,-])\d{1,4}/\d{3,}(?![\w/])"
_READ_AS = ("OolI!|SBG", "001111586")
_NUMBER = re.compile(_DOCKET)
_FIGURES = str.maketrans(*_READ_AS)


def flat(word: str) -> str:
    """Lower case without accents."""
    w = word.lower()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def folded(word: str) -> str:
    """Confusion-folded form: a word and what a scanner makes of it fold to the same, but for rare overlaps."""
    return _DOUBLE.sub(lambda m: _DOUBLES[m[0]], flat(word).translate(_SINGLE))


def deletions(word: str) -> list[str]:
    """The folded form and all forms with one character less."""
    f = folded(word)
    return sorted({f} | ({f[:i] + f[i + 1 :] for i in range(len(f))} if len(f) > 4 else set()))


def weighted_distance(good: str, read: str, limit: float = 1.0) -> float:
    """Edit distance from the right word to what was read: confusion pairs cost 0.25, accents 0.1, other edits 1."""
    a, b = good.lower(), read.lower()
    fa, fb = flat(a), flat(b)
    if len(fa) != len(a) or len(fb) != len(b):
        a, b = fa, fb
    n = len(b)
    rows = [[float(j) for j in range(n + 1)]]
    for i in range(1, len(a) + 1):
        row = [float(i)] + [9.0] * n
        for j in range(1, n + 1):
            if a[i - 1] == b[j - 1]:
                best = rows[i - 1][j - 1]
            elif fa[i - 1] == fb[j - 1]:
                best = rows[i - 1][j - 1] + 0.1
            else:
                best = min(rows[i - 1][j - 1], rows[i - 1][j], row[j - 1]) + 1
            for r in _PAIRS.get(fa[i - 1], ()):
                k = len(r)
                if j >= k and fb[j - k : j] == r:
                    best = min(best, rows[i - 1][j - k] + 0.25)
            row[j] = best
        if min(row) >= limit + 1:
            return 9.0
        rows.append(row)
    return rows[-1][n]


def _joined(text: str) -> str:
    return _BREAK.sub(lambda m: m[1] + m[3] if m[3][0].islower() else m[0], text)


def _kind(text: str, scanned: bool) -> str:
    return _joined(text) if scanned else skeleton(text)


def count_words(units: DataFrame) -> DataFrame:
    """(word, n_clean, n_all) in lower case, and hyphened words with their own counts, over all units.

    ``units`` has text and scanned. Each worker counts its rows first, so the shuffle has about one row for each word and task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean: Counter = Counter()
        dirty: Counter = Counter()

        def out() -> pd.DataFrame:
            words = sorted({*clean, *dirty})
            return pd.DataFrame({"word": words, "n_clean": [clean[w] for w in words], "n_all": [clean[w] + dirty[w] for w in words]})

        for pdf in batches:
            for text, scanned in zip(pdf["text"], pdf["scanned"]):
                if not text:
                    continue
                t = _kind(text, scanned).lower()
                into = dirty if scanned else clean
                into.update(_TOKEN.findall(t))
                if "-" in t:
                    into.update(_HYPHENED.findall(t))
            if len(clean) + len(dirty) > FLUSH:
                yield out()
                clean.clear()
                dirty.clear()
        if clean or dirty:
            yield out()

    counted = units.select("text", "scanned").mapInPandas(run, "word string, n_clean long, n_all long")
    return counted.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_all").alias("n_all"))


def _header_key(text: str) -> str:
    return re.sub(r"[^a-z]", "", folded(text))


def header_keys(text: str) -> list[str]:
    """Folded letters of each line, page numbers at its ends aside; lines of few letters have none."""
    keys = (_header_key(re.sub(r"^\W*\d{1,4}\W+|\W+(?:\d{1,4}|[ivx]{1,5})\W*$", "", line.strip())) for line in text.split("\n"))
    return [k for k in keys if len(k) > 8]


def is_furniture(line: str, titles: frozenset[str], numbers: frozenset[str]) -> bool:
    """Whether a line is a page number, or repeats an opening line or the reference number of the document."""
    bare = line.strip()
    if bare not in _VERSUS and _PAGE.match(bare):
        return True
    if numbers and "/" in bare and not bare.endswith((".", ",", ";")) and any(n in numbers for n in _NUMBER.findall(bare.translate(_FIGURES))):
        return True
    return bool(titles) and any(k in titles for k in header_keys(bare))


def read_unit(text: str, titles: frozenset[str] = frozenset(), numbers: frozenset[str] = frozenset(), trusted: set[str] | frozenset = frozenset()) -> dict:
    """What one scanned unit holds: furniture, line breaks inside words, open ends, and words that aren't trusted.

    ``titles`` are the keys of the document's opening lines and ``numbers`` the reference numbers that an earlier unit has.
    """
    body, noise = [], []
    for n, line in enumerate(text.split("\n")):
        if line.strip() and is_furniture(line, titles, numbers):
            noise.append(n)
        else:
            body.append(line)
    rest = "\n".join(body).strip()
    tail, head = _TAIL.search(rest), _HEAD.match(rest)
    breaks = [(m[1], m[2], m[3]) for m in _BREAK.finditer(rest) if m[3][0].islower()]
    words, before = [], ""
    if rest:
        joined = _joined(rest)
        found = list(_TOKEN.finditer(joined))
        end = _TAIL.search(joined)
        for m in found:
            w = m[0].lower()
            if w not in trusted and not (end and m.start() == end.start(1)) and sum(c.isalpha() for c in w) >= 2:
                words.append((w, before, m.start() == found[0].start()))
            before = w
    return {
        "noise": noise, "body": bool(rest), "breaks": breaks, "tail": tail[1] if tail else None, "sign": tail[2] if tail else None,
        "head": head[1] if head and head[1][0].islower() else None, "words": words,
    }


class Headers:
    """Opening lines and reference numbers of the document that is being read, unit by unit in the order of the page."""

    def __init__(self) -> None:
        self.document: object = self
        self.titles: frozenset[str] = frozenset()
        self.numbers: set[str] = set()

    def before(self, document: object, text: str) -> tuple[frozenset[str], frozenset[str]]:
        """The opening lines (none for the first unit itself) and the numbers of earlier units, then take in this unit."""
        if document is None or document != document:  # units of no document share nothing
            return frozenset(), frozenset()
        if document != self.document:
            out: tuple[frozenset[str], frozenset[str]] = frozenset(), frozenset()
            self.document, self.titles, self.numbers = document, frozenset(header_keys(text)), set()
        else:
            out = self.titles, frozenset(self.numbers) if self.numbers and "/" in text else frozenset()
        if "/" in text:
            self.numbers.update(_NUMBER.findall(text.translate(_FIGURES)))
        return out


READ = (
    "unit_id long, extraction_id long, unit_order int, noise array<int>, body boolean, breaks array<struct<l:string,sign:string,r:string>>, tail string, sign string, head string, "
    "words array<struct<word:string,before:string,first:boolean>>"
)


class ScanNoise:
    """The steps over one set of units (unit_id, extraction_id, unit_order, text, scanned; one row a unit).

    Null or empty texts hold no noise; a null order counts as far down the page; repeated unit ids must be removed
    before. Nothing is evaluated until a result is used, but for the checkpoints of the lexicon and of the read units.
    """

    def __init__(self, units: DataFrame):
        self.spark = units.sparkSession
        self.units = units.where("text is not null and unit_id is not null")
        self.lexicon = cut(count_words(self.units))
        # A word of clean files is known unless scans use it far more often than their share of the words.
        total = self.lexicon.agg(F.sum("n_clean"), F.sum("n_all")).first()
        share = (total[1] - total[0]) / total[0] if total[0] else 0.0
        self.known = self.lexicon.where(f"n_clean > 0 and n_all - n_clean <= {ODD_USE} * n_clean * {share} + {ODD_USE}")
        self.top = self.known.where(f"n_clean >= {TRUSTED_COUNT}").orderBy(F.desc("n_clean"), "word").limit(TRUSTED).select("word")
        self.trusted = self.spark.sparkContext.broadcast(frozenset(r[0] for r in self.top.collect()))
        self.read = cut(self._read())

    def _scanned(self) -> DataFrame:
        return self.units.where("scanned").withColumn("unit_order", F.coalesce("unit_order", F.lit(1 << 30)))

    def _in_order(self) -> DataFrame:
        """Scanned units, those of a document in one partition and in the order of the page."""
        rows = self._scanned().select("unit_id", "extraction_id", "unit_order", "text")
        return rows.repartition("extraction_id").sortWithinPartitions("extraction_id", "unit_order", "unit_id")

    def _read(self) -> DataFrame:
        trusted = self.trusted

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = trusted.value
            headers = Headers()
            for pdf in batches:
                got = [read_unit(t, *headers.before(e, t), known) for e, t in zip(pdf["extraction_id"], pdf["text"])]
                out = pdf[["unit_id", "extraction_id", "unit_order"]].copy()
                for k in ("noise", "body", "tail", "sign", "head"):
                    out[k] = [g[k] for g in got]
                out["breaks"] = [[{"l": a, "sign": s, "r": b} for a, s, b in g["breaks"]] for g in got]
                out["words"] = [[{"word": w, "before": p, "first": f} for w, p, f in g["words"]] for g in got]
                yield out[["unit_id", "extraction_id", "unit_order", "noise", "body", "breaks", "tail", "sign", "head", "words"]]

        read = self._in_order().mapInPandas(run, READ)
        # The neighbours in reading order that hold body text; lead and lag stream over a document's units.
        order = Window.partitionBy("extraction_id").orderBy("unit_order", "unit_id")
        body = read.where("body").withColumn("next_head", F.lead("head").over(order)).withColumn("open_before", F.coalesce(F.lag("tail").over(order).isNotNull(), F.lit(False)))
        return body.unionByName(read.where("not body").withColumn("next_head", F.lit(None).cast("string")).withColumn("open_before", F.lit(False)))

    def furniture(self) -> DataFrame:
        return self.read.where("size(noise) > 0").select("unit_id")

    def broken(self) -> DataFrame:
        """(unit_id, l, r, at_end): words broken by a sign that isn't part of them.

        A plain hyphen is part of the word if the corpus writes the hyphened form, and more often than the joined one.
        """
        inner = self.read.select("unit_id", F.explode("breaks").alias("b")).select("unit_id", "b.l", "b.sign", "b.r", F.lit(False).alias("at_end"))
        ends = self.read.where("tail is not null and next_head is not null").select("unit_id", F.col("tail").alias("l"), "sign", F.col("next_head").alias("r"), F.lit(True).alias("at_end"))
        both = inner.unionByName(ends).withColumn("whole", F.lower(F.concat("l", "r"))).withColumn("hyphened", F.lower(F.concat("l", F.lit("-"), "r")))
        lex = self.lexicon.select("word", "n_all")
        counted = both.join(lex.select(F.col("word").alias("whole"), F.col("n_all").alias("n_whole")), "whole", "left").join(lex.select(F.col("word").alias("hyphened"), F.col("n_all").alias("n_hyphened")), "hyphened", "left")
        return counted.where("not (sign = '-' and coalesce(n_hyphened, 0) > coalesce(n_whole, 0))").select("unit_id", "l", "r", "at_end")

    def suspects(self) -> DataFrame:
        """(unit_id, word, before): words of scanned units that clean files don't use, or far less."""
        words = self.read.select("unit_id", "extraction_id", "open_before", F.explode("words").alias("w")).where("not (open_before and w.first)").select("unit_id", "extraction_id", "w.word", "w.before").distinct()
        return words.join(self.known.select("word"), "word", "left_anti")

    def candidates(self, suspects: DataFrame) -> DataFrame:
        """(extraction_id, word, good, cost, n_good): lexicon words that a suspect may stand for.

        A candidate must be STRONG times as frequent as the suspect; a rarer one (a name, say) counts only if the same document holds it.
        """

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def forms(words: pd.Series) -> pd.Series:
            return words.map(deletions)

        @F.pandas_udf(T.DoubleType())
        def cost(good: pd.Series, read: pd.Series) -> pd.Series:
            return pd.Series([weighted_distance(a, b) for a, b in zip(good, read)])

        counts = self.lexicon.select("word", F.col("n_all").alias("n_read"))
        left = suspects.select("word").distinct().join(counts, "word").where("length(word) >= 3").select("word", "n_read", F.explode(forms("word")).alias("form"))
        right = self.lexicon.where("(n_clean > 0 or n_all > 1) and length(word) >= 3 and not word rlike '[-0-9!|]'").select(F.col("word").alias("good"), F.col("n_all").alias("n_good"), F.explode(forms("word")).alias("form"))
        pairs = left.join(right, "form").where("n_good > n_read and abs(length(word) - length(good)) <= 4").select("word", "good", "n_good", "n_read").distinct()
        pairs = cut(pairs.withColumn("cost", cost("good", "word")).where("cost < 1"))
        strong = f"n_good >= {STRONG} * n_read"
        where = suspects.select("extraction_id", "word").distinct()
        sure = where.join(pairs.where(strong), "word")
        here = self.read.select("extraction_id", F.explode("words.word").alias("good")).unionByName(self._trusted_here(pairs.where(f"not ({strong})"))).distinct()
        named = where.join(pairs.where(f"not ({strong})"), "word").join(here, ["extraction_id", "good"])
        return sure.select("extraction_id", "word", "good", "cost", "n_good").unionByName(named.select("extraction_id", "word", "good", "cost", "n_good"))

    def _trusted_here(self, weak: DataFrame) -> DataFrame:
        """(extraction_id, good): documents that hold a trusted word, which ``read`` leaves out, that is a candidate of ``weak``."""
        words = [r[0] for r in weak.select(F.col("good").alias("word")).distinct().join(self.top, "word", "left_semi").collect()]  # TRUSTED at most
        if not words:
            return self.spark.createDataFrame([], "extraction_id long, good string")
        keep = self.spark.sparkContext.broadcast(frozenset(words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            only = keep.value
            headers = Headers()
            for pdf in batches:
                rows = zip(pdf["extraction_id"], pdf["text"])
                held = {(e, w) for e, t in rows for w, _, _ in read_unit(t, *headers.before(e, t))["words"] if w in only}
                yield pd.DataFrame(list(held), columns=["extraction_id", "good"])

        return self._in_order().where("extraction_id is not null").mapInPandas(run, "extraction_id long, good string")

    def misread(self) -> DataFrame:
        """(unit_id, word, good): misread words with their repair; good is null for a mixture of letters and signs that resembles no word."""
        suspects = cut(self.suspects())
        found = cut(self.candidates(suspects))
        many = found.groupBy("word").agg(F.count_distinct("good").alias("k")).where("k > 1").select("word")
        wanted = found.join(many, "word", "left_semi").select("good").distinct()
        pairs = self._bigrams(wanted)
        rows = suspects.join(found, ["extraction_id", "word"]).join(pairs, ["before", "good"], "left")
        # Context first lowers the cost of a candidate: each tenfold count of the bigram is worth a third of a confusion.
        score = F.col("cost") - 0.08 * F.log10(F.coalesce("n_pair", F.lit(0)) + 1) - 0.01 * F.log10(F.col("n_good") + 1)
        best = rows.groupBy("unit_id", "word").agg(F.min_by("good", F.struct(score, "good")).alias("good"))
        mixed = suspects.where(MIXED).select("unit_id", "word").distinct()
        return best.unionByName(mixed.join(best.select("unit_id", "word"), ["unit_id", "word"], "left_anti").withColumn("good", F.lit(None).cast("string")))

    def _bigrams(self, wanted: DataFrame) -> DataFrame:
        """(before, good, n_pair) of the words that are candidates among others."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter = Counter()
            for pdf in batches:
                for text, scanned in zip(pdf["text"], pdf["scanned"]):
                    if text:
                        ws = _TOKEN.findall(_kind(text, scanned).lower())
                        n.update(zip(ws, ws[1:]))
                if len(n) > FLUSH:
                    yield pd.DataFrame([(a, b, k) for (a, b), k in n.items()], columns=["before", "good", "n"])
                    n.clear()
            if n:
                yield pd.DataFrame([(a, b, k) for (a, b), k in n.items()], columns=["before", "good", "n"])

        counted = self.units.select("text", "scanned").mapInPandas(run, "before string, good string, n long")
        return counted.join(wanted, "good", "left_semi").groupBy("before", "good").agg(F.sum("n").alias("n_pair"))

    def found(self) -> DataFrame:
        """(unit_id, noise) with noise 'furniture', 'hyphenation' or 'misread'."""
        suspects = cut(self.suspects())
        good = self.candidates(suspects).select("extraction_id", "word")
        mixed = suspects.where(MIXED).select("extraction_id", "word")
        misread = suspects.join(good.union(mixed).distinct(), ["extraction_id", "word"], "left_semi").select("unit_id").distinct()
        kinds = [self.furniture().withColumn("noise", F.lit("furniture")), self.broken().select("unit_id").distinct().withColumn("noise", F.lit("hyphenation")), misread.withColumn("noise", F.lit("misread"))]
        return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])

    def repaired(self) -> DataFrame:
        """(extraction_id, unit_id, unit_order, text): body text of scanned units in one line each, with broken words joined and misread words replaced.

        A word that is broken at the end of a unit is written out there in full and left out where it goes on.
        """
        fixes = self.misread().where("good is not null").groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "good"))).alias("fixes"))
        joins = self.broken().groupBy("unit_id").agg(F.collect_set(F.when(~F.col("at_end"), F.concat_ws(" ", "l", "r"))).alias("joins"), F.max(F.when(F.col("at_end"), F.concat("l", "r"))).alias("ending"))
        facts = self.read.where("body").select("unit_id", "extraction_id", "unit_order", "open_before", "noise")

        @F.pandas_udf(T.StringType())
        def repair(text: pd.Series, noise: pd.Series, fixes: pd.Series, joins: pd.Series, ending: pd.Series, skip: pd.Series) -> pd.Series:
            return pd.Series([repair_text(*row) for row in zip(text, noise, fixes, joins, ending, skip)])

        rows = self.units.where("scanned").select("unit_id", "text").join(facts, "unit_id").join(fixes, "unit_id", "left").join(joins, "unit_id", "left")
        return rows.select("extraction_id", "unit_id", "unit_order", repair("text", "noise", F.to_json("fixes"), "joins", "ending", "open_before").alias("text"))

    def paragraphs(self) -> DataFrame:
        """(extraction_id, paragraph, text): the repaired units of a document as continuous paragraphs, numbered from 1.

        A unit goes on where the one before has no end of a sentence and this one begins with a small letter (a page break between).
        """
        units = self.repaired().where("text <> ''")
        order = Window.partitionBy("extraction_id").orderBy("unit_order", "unit_id")  # streams over the units of a document
        goes_on = ~F.lag("text").over(order).rlike(r"[.!?:;…»”\"]\s*$") & F.col("text").rlike(r"^\p{Ll}")
        placed = units.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("paragraph", F.sum("new").over(order).cast("int"))
        joined = placed.groupBy("extraction_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("unit_order", "unit_id", "text"))).alias("us"))
        return joined.select("extraction_id", "paragraph", F.array_join(F.transform("us", lambda u: u["text"]), " ").alias("text"))


MIXED = r"word rlike '\\p{L}.*\\p{L}.*\\p{L}' and word rlike '[0-9!|]' and not word rlike '^[0-9]+(\\p{L}{1,3}|h[0-9]{2})$'"


def repair_text(text: str, noise: list[int], fixes: str | None, joins: list[str] | None, ending: str | None, skip: bool) -> str:
    lines = [line for n, line in enumerate(text.split("\n")) if line.strip() and n not in set(noise)]
    body = "\n".join(lines)
    wanted = set(joins) if joins is not None else set()
    body = _BREAK.sub(lambda m: m[1] + m[3] if f"{m[1]} {m[3]}" in wanted else m[1] + (m[2] if m[3][0].islower() else m[2] + " ") + m[3], body)
    if ending:
        body = _TAIL.sub(ending, body)
    if skip:
        body = _HEAD.sub("", body, count=1)
    if fixes:
        table = json.loads(fixes)

        def fix(m: re.Match) -> str:
            good = table.get(m[0].lower())
            return m[0] if good is None else good.upper() if m[0].isupper() and len(m[0]) > 1 else good.capitalize() if m[0][0].isupper() else good

        body = _TOKEN.sub(fix, body)
    return re.sub(r"\s+", " ", body).strip()
