"""Visually identical text with different characters, brought to one form that compares equal.

Confusables skeleton: decompose, replace every character by the prototype of its look-alike
class, decompose again; then compose once more and set the width of blanks to one. Texts of plain
Latin-1 letters skip all of it but the blanks. The look-alikes are the public Unicode table of confusables as Spark's own ICU
library holds it, but for visible differences: a Latin letter, digit or sign stays what it is, so l, 1 and I stay apart.
"""

from __future__ import annotations

import functools
import glob
import hashlib
import os
import re
import struct
import unicodedata
import zipfile

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.common import latest

# Letters of other scripts that look like a Latin letter (left: look-alikes, right: prototypes).
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХԁԍһіјѕаеорсухѵԛԝЗӀӏ": "ABESIJKMHOPCTYXdGhijsaeopcyxvqw3Il",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳβ": "ABEZHIKMNOPTYXovpcjß",
    "ՕՏօսհոոՍցո": "OSouhnnUgn",
    "‐‑‒−﹣ʼ’‘ʹº˚․‚": "----- ''''°°.,".replace(" ", ""),
}
_VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


def _prototypes() -> dict[int, str | None]:
    """Prototype of each character, from a rule: compatibility forms, invisible characters, blanks, look-alikes."""
    table: dict[int, str | None] = {}
    for cp in (*range(0xA0, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d.startswith("<") and not d.startswith(_VISIBLE_TAGS):
            table[cp] = unicodedata.normalize("NFKD", ch)
        if unicodedata.category(ch) == "Zs":
            table[cp] = " "
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE01EF or cp == 0x34F:
            table[cp] = None
    table |= {0x0D: "\n", 0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    for shapes, letters in LOOKALIKES.items():
        table |= {ord(a): b for a, b in zip(shapes, letters)}
    return table


PROTOTYPES = _prototypes()
_ODD = re.compile("[^\x00-\x7e\xa1-\xac\xae-\xb9\xbb-\xff]|[\xa8\xaf\xb4\xb8]")
_RUN = re.compile(r"[ \t\x0b\x0c]{2,}|[\t\x0b\x0c]")
_EDGE = re.compile(r" *\n *")
_LINES = re.compile(r"\n{3,}")


def _icu_library() -> str | None:
    """Path of the ICU library among Spark's jars."""
    homes = [os.environ.get("SPARK_HOME"), *(os.path.join(os.path.dirname(pyspark.__file__), *up) for up in ((), ("..",), ("..", "..", "..")))]
    return next((jar for home in homes if home for jar in sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))), None)


@functools.cache
def confusables(jar: str | None = None) -> dict[int, str]:
    """Single letters and the ASCII letter that each looks like, by the Unicode table of confusables.

    ``jar`` is an ICU library (default: the one among Spark's jars; without it the table is empty). The table has one prototype for
    l, 1 and I and one for O and 0; here a look-alike goes to the one of its own kind. Letters with a mark, ligatures and Latin letters below
    U+0250 differ visibly and are left out, as are signs and digits: of those only the fixed ones of ``LOOKALIKES`` are one.
    """
    jar = jar or _icu_library()
    if jar is None:
        return {}
    with zipfile.ZipFile(jar) as z:
        name = next(n for n in z.namelist() if n.endswith("/confusables.cfu"))
        raw = z.read(name)
    data = raw[struct.unpack_from(">H", raw)[0] :]
    keys_at, n, index_at, _, table_at, size = struct.unpack_from(">6i", data, 12)
    keys, index = struct.unpack_from(f">{n}I", data, keys_at), struct.unpack_from(f">{n}H", data, index_at)
    units = data[table_at : table_at + 2 * size]
    out = {}
    for key, at in zip(keys, index):
        cp, length = key & 0xFFFFFF, (key >> 24) + 1
        proto = chr(at) if length == 1 else units[2 * at : 2 * (at + length)].decode("utf-16-be", "replace")
        kind = unicodedata.category(chr(cp))
        if cp < 0x250 or cp in PROTOTYPES or kind not in ("Lu", "Ll", "Lo") or not (proto.isascii() and proto.isalpha() and len(proto) == 1) or unicodedata.normalize("NFD", chr(cp)) != chr(cp):
            continue
        out[cp] = "I" if proto == "l" and kind == "Lu" else "o" if proto == "O" and kind == "Ll" else proto
    return out


def prototypes() -> dict[int, str | None]:
    """The whole table of prototypes; read by the driver and sent to the workers, so all use the same."""
    return PROTOTYPES | confusables()


def skeleton(text: str, table: dict[int, str | None] = PROTOTYPES) -> str:
    """One form for all texts that look the same; case, visible letters and line breaks stay."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _ODD.search(text):
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))
        text = unicodedata.normalize("NFC", text)
    text = _RUN.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _EDGE.sub("\n", text)
    return _LINES.sub("\n\n", text).strip(" \n") if "\n\n\n" in text else text.strip(" \n")


def skeleton_text(text: Column) -> Column:
    """The one form of a text; null for null."""
    table = prototypes()
    return F.pandas_udf(lambda s: s.map(lambda t: skeleton(t, table) if t is not None else None), T.StringType())(text)


def skeleton_hash(text: Column) -> Column:
    """128-bit hash of the skeleton; null for null and for texts with nothing to see."""
    table = prototypes()

    def one(t: str | None) -> bytes | None:
        s = skeleton(t, table) if t else ""
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() if s else None

    return F.pandas_udf(lambda s: s.map(one), T.BinaryType())(text)


def lookalike_classes(df: DataFrame, key: str, text: str, by: str) -> DataFrame:
    """(key, class_id, form): the look-alike class of each row's text and a hash of the text itself.

    Only two hashes of a row are shuffled, never its text. Redelivered keys count once (the last by
    ``by``). Null and blank texts have no class and are left out; an empty table gives no rows.
    """
    hashed = df.select(F.col(key), F.col(by), skeleton_hash(F.col(text)).alias("class_id"), F.unhex(F.md5(F.col(text))).alias("form"))
    return latest(hashed.where(F.col(key).isNotNull()), [key], by).where("class_id is not null").select(key, "class_id", "form")


def lookalike_pairs(classes: DataFrame, key: str) -> DataFrame:
    """Pairs (a < b) of one class whose texts are different strings.

    The pairs are the defined result; classes with one form only are dropped before the join, so
    exact copies never meet, and AQE splits a class that is hot.
    """
    mixed = classes.groupBy("class_id").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("class_id")
    some = classes.join(mixed, "class_id")
    a = some.select("class_id", F.col(key).alias("a"), F.col("form").alias("form_a"))
    b = some.select("class_id", F.col(key).alias("b"), F.col("form").alias("form_b"))
    return a.join(b, "class_id").where("a < b and form_a <> form_b").select("a", "b")
