"""Mixed timestamp formats and zones, brought to one UTC instant or one plain date.

Every format is a branch of ONE regular expression with named groups. A single
``regexp_replace`` writes all groups as one delimited record, so each value is matched once and
the whole operator stays in whole-stage code; there is no Python and no shuffle. The calendar
range is validated, the day number comes from integer arithmetic, and only the offset of a named
zone is looked up (``to_utc_timestamp``: an hour that occurs twice is the earlier instant, a
skipped hour moves forward by the gap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and abbreviations in en, fr, de, es; accents are removed before the look-up.
MONTHS = {
    1: "january jan janvier janv januar jaenner janner enero ene",
    2: "february feb fevrier fevr fev februar febrero",
    3: "march mar mars marz maerz mrz marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juin juni junio",
    7: "july jul juillet juil juli julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre setiembre set",
    10: "october oct octobre oktober okt octubre",
    11: "november nov novembre noviembre",
    12: "december dec decembre dezember dez diciembre dic",
}
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300,
}

_TIME = (
    r"(?:(?:T|[\s,]+(?:(?:à|a|um|at|las|a\s+las)\s+)?)(?<hh>\d{1,2})[:h.](?<mi>\d{2})(?:[:.](?<ss>\d{2})(?:[.,](?<ff>\d{1,9}))?)?"
    r"(?:\s*(?<ap>[ap])\.?m\.?(?![a-z]))?(?:\s*(?:h|uhr|hrs)\b\.?)?"
    r"(?:\s*(?:(?:UTC|GMT)?(?<zo>[+-]\d{2}(?::?\d{2})?)(?:\s*\[[\w/+-]+\])?|\[?(?<zn>[a-z]+(?:[/_+-][a-z0-9_]+)*)\]?))?)?"
)
_DATES = [
    r"(?<y1>\d{4})(?<s1>[-/.])(?<m1>\d{1,2})\k<s1>(?<d1>\d{1,2})",
    r"(?<fa>\d{1,2})(?<s2>[-/.])(?<fb>\d{1,2})\k<s2>(?<y2>\d{4})",
    r"(?<d3>\d{1,2})[.\s-]\s?(?<rr>[IVX]{1,4})[.\s-]\s?(?<y3>\d{4})",
    r"(?:\p{L}+[,.]?\s+)?(?:(?:le|a|den|am|el|the|on|du|vom)\s+)?(?<d4>\d{1,2})(?:(?:er|st|nd|rd|th|º|°)?\s+|\.\s*)(?:(?:of|de|day\s+of)\s+)?(?<w4>\p{L}+)\.?,?\s+(?:del?\s+)?(?<y4>\d{4})",
    r"(?:\p{L}+[,.]?\s+)?(?<w5>\p{L}+)\.?\s+(?<d5>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<y5>\d{4})",
]
_COMPACT = r"(?<y6>\d{4})(?<m6>\d{2})(?<d6>\d{2})(?:T?(?<h6>\d{2})(?<i6>\d{2})(?<e6>\d{2})?(?:[.,](?<f6>\d{1,9}))?(?:(?<o6>Z|[+-]\d{2}(?::?\d{2})?))?)?"
_EPOCH = r"(?<ep>\d{9,11}|\d{13})"
FORMATS = r"(?iu)^\s*(?:" + _COMPACT + "|" + _EPOCH + "|(?:" + "|".join(_DATES) + ")" + _TIME + r")\s*$"
# One field for each component, filled by whichever branch matched.
_FIELDS = {
    "year": "y1 y2 y3 y4 y5 y6", "month": "m1 m6", "day": "d1 d3 d4 d5 d6", "fa": "fa", "fb": "fb", "word": "w4 w5", "roman": "rr",
    "hour": "hh h6", "minute": "mi i6", "second": "ss e6", "fraction": "ff f6", "half": "ap", "offset": "zo o6", "zone": "zn", "epoch": "ep",
}
_DAY = 86_400_000_000


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _valid(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= _days_in_month(y, m)), F.lit(False))


def _day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the proleptic Gregorian calendar."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.when(m > 2, m - 3).otherwise(m + 9) * 153 + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _lookup(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _two(c: Column) -> Column:
    return F.lpad(c.cast("long").cast("string"), 2, "0")


def known_zones(spark: SparkSession) -> list[str]:
    """Names of the zones whose clock the session can look up: those of its own JVM, which also converts."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())  # type: ignore[union-attr]


def normalise_timestamps(df: DataFrame, value: str, zone: Column | str | None = None, order: Column | str | None = None, out: str = "ts") -> DataFrame:
    """Add ``out``: struct<kind, utc_value, utc_micros, zone_source> for the string column ``value``.

    kind is ``date`` (utc_value ``YYYY-MM-DD``), ``instant`` (utc_value ``YYYY-MM-DDTHH:MM:SS.ffffffZ``),
    ``empty`` (null or blank) or ``invalid`` (placeholder, month or year only, impossible date or
    time, unknown zone in the value). ``zone`` names the clock of times without a zone; where it is null or unknown UTC is assumed
    and zone_source says 'assumed-utc'. Years of two digits are invalid, as their century is open.
    ``order`` is DMY (default) or MDY for dates in figures with the year last. Digits beyond
    microseconds are cut. A column that is called ``out`` already is replaced; all others pass
    through untouched, and repeated rows, ties and an empty table need no special case.
    """
    zone = F.lit(None).cast("string") if zone is None else F.col(zone) if isinstance(zone, str) else zone
    order = F.lit("DMY") if order is None else F.col(order) if isinstance(order, str) else order
    raw = F.translate(F.regexp_replace(F.col(value), "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]", ""), "   　０１２３４５６７８９：", "    0123456789:")
    joined = "\x01" + "\x01".join("".join("${%s}" % g for g in groups.split()) for groups in _FIELDS.values())
    kept = [c for c in df.columns if c != out]
    step = df.select(*[F.col(f"`{c}`") for c in kept], F.regexp_replace(raw, FORMATS, joined).alias("_rec"), F.coalesce(F.trim(raw) == "", F.lit(True)).alias("_empty"), zone.alias("_zone"), order.alias("_order"))
    parts = F.when(F.col("_rec").startswith("\x01"), F.split(F.col("_rec"), "\x01", -1))
    step = step.withColumn("_p", parts)
    field = {n: F.when(F.get("_p", F.lit(i + 1)) != "", F.get("_p", F.lit(i + 1))) for i, n in enumerate(_FIELDS)}
    num = lambda n: field[n].cast("long")
    plain = F.translate(F.lower(field["word"]), "áàâäéèêëíìîïóòôöúùûüç", "aaaaeeeeiiiioooouuuuc")
    months = _lookup({w: n for n, words in MONTHS.items() for w in words.split()})
    romans = _lookup({r: i + 1 for i, r in enumerate(ROMAN)})
    step = step.select(
        *[F.col(f"`{c}`") for c in kept], "_empty", "_zone", "_order",
        num("year").alias("_y"), num("fa").alias("_fa"), num("fb").alias("_fb"),
        F.coalesce(num("month"), F.try_element_at(months, plain).cast("long"), F.try_element_at(romans, F.upper(field["roman"])).cast("long")).alias("_m"),
        num("day").alias("_d"), num("hour").alias("_h"), num("minute").alias("_i"), F.coalesce(num("second"), F.lit(0)).alias("_s"),
        F.rpad(F.coalesce(field["fraction"], F.lit("")), 6, "0").cast("long").alias("_f"), F.lower(field["half"]).alias("_half"),
        F.when(field["offset"].rlike("(?i)^z$"), F.lit("+00")).otherwise(field["offset"]).alias("_offset"), field["zone"].alias("_name"), num("epoch").alias("_ep"),
        F.when((F.length(field["year"]) == 4) & field["hour"].isNotNull() & F.col("_rec").rlike("^\x01\\d") & field["second"].isNull() & field["epoch"].isNull() & F.trim(raw).rlike(r"^\d{12}$"), F.trim(raw).cast("long")).alias("_ms12"),
    )
    figures = F.col("_fa").isNotNull()
    mdy = F.coalesce(F.upper(F.trim("_order")) == "MDY", F.lit(False))
    by_order = F.when(mdy, F.struct(F.col("_fa").alias("m"), F.col("_fb").alias("d"))).otherwise(F.struct(F.col("_fb").alias("m"), F.col("_fa").alias("d")))
    swapped = F.when(mdy, F.struct(F.col("_fb").alias("m"), F.col("_fa").alias("d"))).otherwise(F.struct(F.col("_fa").alias("m"), F.col("_fb").alias("d")))
    md = F.when(figures & _valid(F.col("_y"), by_order["m"], by_order["d"]), by_order).when(figures, swapped).otherwise(F.struct(F.col("_m").alias("m"), F.col("_d").alias("d")))
    step = step.withColumn("_md", md)
    y, m, d = F.col("_y"), F.col("_md.m"), F.col("_md.d")
    hour = F.when(F.col("_half").isNull(), F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    good_time = hour.between(0, 23) & F.col("_i").between(0, 59) & F.col("_s").between(0, 59)
    timed = F.col("_h").isNotNull()
    step = step.withColumn("_days", F.when(_valid(y, m, d), _day_number(y, m, d))).withColumn(
        "_local", F.when(timed & good_time, F.col("_days") * _DAY + (hour * 3600 + F.col("_i") * 60 + F.col("_s")) * 1_000_000 + F.col("_f"))
    )
    zones = known_zones(df.sparkSession)
    hh, mm = F.substring("_offset", 2, 2).cast("long"), F.coalesce(F.expr("try_cast(right(regexp_replace(substring(_offset, 4), ':', ''), 2) as long)"), F.lit(0))
    offset = F.when(F.col("_offset").isNotNull(), F.when((hh <= 18) & (mm <= 59), (hh * 60 + mm) * F.when(F.col("_offset").startswith("-"), -1).otherwise(1))).otherwise(F.try_element_at(_lookup(ABBREVIATIONS), F.upper("_name")))
    named = F.when(F.col("_name").isin(zones), F.col("_name"))
    own = F.when(F.trim("_zone").isin(zones), F.trim("_zone")).otherwise("UTC")  # flagged in zone_source
    step = step.withColumn("_shift", offset).withColumn("_clock", F.when(F.col("_shift").isNull() & F.col("_offset").isNull(), F.when(F.col("_name").isNotNull(), named).otherwise(own)))
    utc = (
        F.when(F.col("_ep").isNotNull(), F.when(F.col("_ep") < 100_000_000_000, F.col("_ep") * 1_000_000).otherwise(F.col("_ep") * 1000))
        .when(F.col("_local").isNull(), F.col("_ms12") * 1000)
        .when(F.col("_shift").isNotNull(), F.col("_local") - F.col("_shift") * 60_000_000)
        .when(F.col("_clock").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_clock"))))
    )
    step = step.withColumn("_utc", utc)
    u = F.col("_utc")
    day = F.floor(u / F.lit(_DAY).cast("decimal(20,0)")).cast("int")
    rest = u - day.cast("long") * _DAY
    sec = F.expr(f"(_utc - floor(_utc / cast({_DAY} as decimal(20,0))) * {_DAY}) div 1000000")
    text = F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), _two(F.floor(sec / 3600)), F.lit(":"), _two(F.floor(sec / 60) % 60), F.lit(":"), _two(sec % 60),
        F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
    is_date = F.col("_days").isNotNull() & ~timed & F.col("_ep").isNull()
    kind = F.when(F.col("_empty"), "empty").when(is_date, "date").when(u.isNotNull(), "instant").otherwise("invalid")
    source = F.when(F.col("_ep").isNotNull(), "epoch").when(F.col("_offset").isNotNull(), "offset").when(F.col("_name").isNotNull(), "name").when(F.coalesce(F.trim("_zone").isin(zones), F.lit(False)), "feed").otherwise("assumed-utc")
    value_out = F.when(is_date, F.date_from_unix_date(F.col("_days").cast("int")).cast("string")).otherwise(text)
    # The generator keeps filters on the result above it: pushed down they would copy the expressions of every step.
    ts = F.struct(kind.alias("kind"), value_out.alias("utc_value"), F.when(is_date, F.col("_days") * _DAY).otherwise(u).alias("utc_micros"), F.when(u.isNotNull() & ~is_date, source).alias("zone_source"))
    return step.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(ts)).alias(out))
