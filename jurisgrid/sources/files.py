"""File sources: text and HTML files to extractions and source units; pre-extracted tables; sinks.

Files are read with ``binaryFile``; only decoding and the HTML walk need Python, Arrow-batched. A file that cannot be
used becomes a row with status 'failed' and a warning, never an exception.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.functions.text import count_words, normalize_extractor

MAX_BYTES = 25 * 1024 * 1024
SUPPORTED = ("txt", "md", "html", "htm")
# Elements that are dropped, that make blocks, and that are headings.
DROPPED = {"script", "style", "noscript", "svg", "canvas", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "li", "tr", "pre", "blockquote", "caption", "div", "section", "article", "td", "th", "dt", "dd", "header", "footer", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Units(HTMLParser):
    """Text blocks of a page in order; the cells of a table row are joined by ' | '."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.cells: list[str] | None = None
        self.dropped = 0

    def _flush(self, tag: str) -> None:
        t = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(t)
        elif t:
            self.out.append(("heading" if tag in HEADINGS else "list-item" if tag == "li" else "paragraph" if tag in ("p", "pre") else "caption" if tag == "caption" else "block", t))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.text.append("\n" if tag == "br" else "")
            return
        if tag in DROPPED:
            self.dropped += 1
        if tag in BLOCKS:
            self._flush(next((t for t in reversed(self.stack) if t in BLOCKS), "div"))
            if tag == "tr":
                self.cells = []
        self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if tag in BLOCKS:
            self._flush(tag)
        if tag == "tr" and self.cells is not None:
            row = " | ".join(c for c in self.cells if c)
            self.cells = None
            if row:
                self.out.append(("table-row", row))
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)


class _Lines(HTMLParser):
    """Positioned text lines (elements of class t) of a page layout, with the number of the page that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str | None]] = []
        self.stack: list[tuple[str, str | None, bool]] = []
        self.generated = False
        self.text: list[str] | None = None
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "generator":
            self.generated = "pdf2htmlex" in a.get("content", "").lower()
        if tag in VOID:
            return
        if tag in DROPPED:
            self.dropped += 1
        page = a.get("data-page-no") or (re.sub("(?i)^pf", "", a["id"]) if re.fullmatch("(?i)pf[0-9a-z]+", a.get("id", "")) else None) or (self.stack[-1][1] if self.stack else None)
        line = "t" in a.get("class", "").split()
        if line and self.text is None:
            self.text = []
        else:
            line = False
        self.stack.append((tag, page, line))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        while self.stack:
            t, page, line = self.stack.pop()
            if line:
                self.out.append(("".join(self.text or []), page))
                self.text = None
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.text is not None and not self.dropped:
            self.text.append(data)


# Words that a single letter after them does not belong to; letters that are words; what such a letter begins; words run together.
_APART = frozenset("and the for not any may shall which who when where".split())
_LETTERS = frozenset("AI")
_BEGINS = re.compile("(ge|rticle|mendment|merica|uthority)", re.I)
_REPAIRS = [
    (re.compile("[\ue000-\uf8ff\xa0]"), " "),
    (re.compile(r"([A-Z])\s+([a-z])\s+([a-z]{2,})\b", re.A), r"\1\2\3"),
    (re.compile(r"\b([A-Za-z]{3,})\s+([a-z])\b", re.A), lambda m: m[0] if m[1].lower() in _APART else m[1] + m[2]),
    (re.compile(r"\b([A-Za-z])\s+([A-Z][a-z]{2,})\b", re.A), lambda m: m[0] if m[1] in _LETTERS and not _BEGINS.match(m[2]) else m[1] + m[2]),
    (re.compile(r"\b(a|an)(?=[A-Z][a-z])", re.A), r"\1 "),
    (re.compile(r"\b([A-Za-z]{4,}s)(a|an)(?=\s+[A-Z])", re.A), r"\1 \2"),
    (re.compile(r"\b(become|appoint|constitute|expel|receive|make|provide|maintain|hold|keep|take)(a|an)(?=\s+[A-Z])", re.A | re.I), r"\1 \2"),
    (re.compile(r"\b(be|to|for|as|is|of|in|on|by|or|and|but)(privileged|fore|cause|long|side|tween|neath|yond|half)\b", re.A | re.I), r"\1 \2"),
    (re.compile(r"\s+([,.;:!?])"), r"\1"),
]
_NOISE = re.compile(r"(?i)(?:cover|\d+)\.pdf|data:image/.*|[\W_]{1,3}", re.A | re.S)


def repair_line(text: str) -> str:
    """A line of a page layout with words put together or apart again where the layout broke or joined them."""
    for pattern, to in _REPAIRS:
        text = pattern.sub(to, text)
    return re.sub(r"[ \t]+", " ", text).strip()


def html_blocks(html: str) -> tuple[str, list[tuple[str, str, str | None]]]:
    """(method, [(type, text, page)]) of a page: its blocks, or the lines of a page layout written by a converter of PDF files.

    A layout names its converter in a meta element or in the first 1000 characters, or has more than 20 positioned lines. The type of its lines is
    null: it shows in their text.
    """
    lines = _Lines()
    lines.feed(html)
    lines.close()
    if lines.generated or "created by pdf2htmlex" in html[:1000].lower() or len(lines.out) > 20:
        kept = ((repair_line(t), page) for t, page in lines.out)
        return "pdf-layout", [("", t, page) for t, page in kept if t and not _NOISE.fullmatch(t)]
    p = _Units()
    p.feed(html)
    p.close()
    p._flush("div")
    return "html", [(kind, t, None) for kind, t in p.out]


_UNIT = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "page")])


@F.pandas_udf(T.StructType([T.StructField("method", T.StringType()), T.StructField("us", T.ArrayType(_UNIT))]))
def _html_units_udf(html: pd.Series) -> pd.DataFrame:
    got = [html_blocks(h) if h is not None else (None, None) for h in html]
    return pd.DataFrame({"method": [m for m, _ in got], "us": [None if us is None else [{"type": a, "text": b, "page": c} for a, b, c in us] for _, us in got]})


def _decode(raw: bytes) -> tuple[str, str]:
    """(encoding, text): by byte-order mark, else by the parity of NUL bytes in the first 4096; bad bytes become U+FFFD."""
    head = raw[:4096]
    even, odd = head[0::2].count(0), head[1::2].count(0)
    half = max(len(head) // 2, 1)
    if raw[:3] == b"\xef\xbb\xbf":
        enc = "utf-8"
    elif raw[:2] == b"\xff\xfe" or (odd / half > 0.3 and odd > 2 * even):
        enc = "utf-16-le"
    elif raw[:2] == b"\xfe\xff" or (even / half > 0.3 and even > 2 * odd):
        enc = "utf-16-be"
    else:
        enc = "utf-8"
    return enc, raw.decode(enc, "replace").lstrip("﻿")


def extension(name: Column) -> Column:
    base = F.regexp_replace(name, r"[?#].*$", "")
    return F.lower(F.regexp_extract(base, r"[^/.][^/]*\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as rows (filename, size, extension, encoding, raw_text, normalized_text, status, warning)."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def extract(files: DataFrame) -> DataFrame:
    """Extractions of ``binaryFile`` rows: (filename, size, extension, encoding, method, markup, raw_text, normalized_text, characters, words,
    units, preview, status, warning).

    The raw text of a page is that of its units, parted by blank lines; its markup is kept beside it.
    """
    decode = F.pandas_udf(lambda s: pd.DataFrame([_decode(bytes(b)) if b is not None else (None, None) for b in s], columns=["encoding", "text"]), "encoding string, text string")  # type: ignore[call-overload]
    base = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content").withColumn("extension", extension(F.col("filename")))
    bad = F.when(~F.col("extension").isin(*SUPPORTED), F.when(F.col("extension") == "pdf", "PDF_NOT_IMPLEMENTED").otherwise("UNSUPPORTED_FORMAT")).when(F.col("size") > MAX_BYTES, "FILE_TOO_LARGE")
    base = base.withColumn("bad", bad).withColumn("d", decode(F.when(F.col("bad").isNull(), F.col("content"))))
    page = F.col("extension").isin("html", "htm")
    base = base.withColumn("markup", F.when(page, F.col("d.text"))).withColumn("h", _html_units_udf("markup"))
    raw = F.when(page, F.array_join(F.transform("h.us", lambda u: u["text"]), "\n\n")).otherwise(F.col("d.text"))
    base = base.withColumn("raw_text", raw).withColumn("normalized_text", normalize_extractor(F.col("raw_text")))
    units = F.when(page, F.size("h.us")).otherwise(F.size(text_blocks(F.col("raw_text"))))
    empty = F.when(page, F.when(F.col("h.method") == "pdf-layout", "PDF2HTML_NO_TEXT_LINES").otherwise("HTML_NO_BLOCKS")).otherwise("EMPTY_TEXT")
    warning = F.coalesce("bad", F.when(F.length("normalized_text") == 0, empty).when(F.col("d.encoding") != "utf-8", "TEXT_ENCODING_DETECTED").when(F.col("h.method") == "pdf-layout", "PDF2HTML_LAYOUT_SOURCE"))
    return base.select(
        "filename", "size", "extension", F.col("d.encoding").alias("encoding"), F.when(F.col("bad").isNull(), F.coalesce("h.method", F.lit("text"))).alias("method"), "markup", "raw_text", "normalized_text",
        F.length("normalized_text").alias("characters"), count_words(F.col("normalized_text")).alias("words"), units.alias("units"),
        F.when(F.length("normalized_text") > 500, F.concat(F.substring("normalized_text", 1, 500), F.lit("..."))).otherwise(F.col("normalized_text")).alias("preview"),
        F.when(F.col("bad").isNotNull(), "failed").otherwise("extracted").alias("status"), warning.alias("warning"),
    )


def text_blocks(text: Column) -> Column:
    """Blocks between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(normalize_extractor(text), r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def normalize_extractions(df: DataFrame, key: str = "extraction_id") -> DataFrame:
    """Extractions that came as tables, with the defaults of their missing parts: text from the first of normalized_text, text and raw_text that
    isn't empty, a file name, the method 'pre-extracted' and their figures."""
    there = lambda c: F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    text = F.coalesce(there("normalized_text"), there("text"), there("raw_text"), F.lit(""))
    out = df.select(key, F.coalesce(there("filename"), F.lit("untitled")).alias("filename"), F.coalesce(there("extraction_method"), F.lit("pre-extracted")).alias("extraction_method"), F.coalesce(there("raw_text"), text).alias("raw_text"), text.alias("normalized_text"))
    return out.withColumn("characters", F.length("normalized_text")).withColumn("words", count_words(F.col("normalized_text"))).withColumn("units", F.size(text_blocks(F.col("normalized_text"))))


def units_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_order, unit_ref, type, text): blocks between blank lines, numbered without the empty ones; equal neighbours count once."""
    return _number(df.select(key, F.transform(text_blocks(F.col(text)), lambda b: F.struct(unit_type(b).alias("type"), b.alias("text"), F.lit(None).cast("string").alias("page"))).alias("us")), key)


def units_of_html(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, unit_order, unit_ref, type, text, page) of pages; equal neighbours count once."""
    typed = F.transform("h.us", lambda u: F.struct(F.when(u["type"] == "", unit_type(u["text"])).otherwise(u["type"]).alias("type"), u["text"].alias("text"), u["page"].alias("page")))
    return _number(df.select(key, _html_units_udf(F.col(html)).alias("h")).select(key, typed.alias("us")), key)


def _number(df: DataFrame, key: str) -> DataFrame:
    distinct = F.transform(F.filter(F.arrays_zip(F.col("us").alias("u"), F.concat(F.array(F.lit(None)), F.col("us")).alias("p")), lambda x: x["u"].isNotNull() & (x["p"].isNull() | ((x["p"]["text"] != x["u"]["text"]) | (x["p"]["type"] != x["u"]["type"])))), lambda x: x["u"])
    rows = df.select(key, F.posexplode(distinct).alias("pos", "u"))
    return rows.select(key, (F.col("pos") + 1).alias("unit_order"), F.concat(F.lit("raw-"), F.lpad((F.col("pos") + 1).cast("string"), 5, "0")).alias("unit_ref"), "u.type", "u.text", "u.page")


def unit_type(c: Column) -> Column:
    """heading for chapters, titles, sections and numbered articles or amendments, paragraph for a number first, else block."""
    heading = c.rlike(r"(?i)^(?:chapter|title|section)(?![A-Za-z0-9_])") | c.rlike(r"(?i)^(?:article|amendment)\s+(?:[ivxlcdm]+|\d+)")
    return F.when(heading, "heading").when(c.rlike(r"^\(?\d+\)?\s+"), "paragraph").otherwise("block")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet sink."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
