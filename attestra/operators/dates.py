"""Date and time surfaces: parsed with built-in columns, and the values derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx

# Month names and words for parts of a day.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
DAY_WORDS = {"morning": "morning", "dawn": "morning", "sunrise": "morning", "afternoon": "day", "midday": "day", "noon": "day", "evening": "evening", "dusk": "evening", "sunset": "evening", "tonight": "evening", "night": "night", "midnight": "night", "overnight": "night"}
CLOCK_WORDS = {"noon": 12, "midnight": 0}
PIVOT = 50

CLOCK = r"^([0-9]{1,2})(?::([0-9]{2}))?\s*([ap])\.?m?\.?$"
DATE_AND_CLOCK = r"^(.*?)\s+([0-9]{1,2}(?::[0-9]{2})?\s*[ap]\.?m?\.?)$"
MONTH_YEAR = r"^([a-z]+) ([0-9]{4})$"
ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
SLASHED = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
WORDED = r"^([a-z]+) ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})$"


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def four_digits(year: Column) -> Column:
    """D3: a two-digit year below the pivot lies in this century."""
    return F.when(year < PIVOT, 2000 + year).otherwise(1900 + year)


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of a 12-hour time such as 4p or 4:30 p.m.; null if it is none."""
    h, m = _number(text, CLOCK, 1), F.coalesce(_number(text, CLOCK, 2), F.lit(0))
    pm = F.when(F.regexp_extract(text, CLOCK, 3) == "p", 12).otherwise(0)
    return F.when(text.rlike(CLOCK) & h.between(1, 12) & (m <= 59), (h % 12 + pm) * 60 + m)


def parse_surfaces(rows: DataFrame, surface: str = "surface") -> DataFrame:
    """Rows with y, m, d, minutes, decade, day_part; all null where the surface is no date or time.

    Precedence: word or clock time, decade, year, month and year, full date with an optional clock time.
    """
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(surface), F.lit(""))), r"\s+", " "), r"^the\s+", ""))
    rows = rows.withColumn("_s", s)
    s = F.col("_s")
    timed = s.rlike(DATE_AND_CLOCK)
    rows = rows.withColumns({
        "_word": _lookup(DAY_WORDS, s), "_clock": F.coalesce(_lookup(CLOCK_WORDS, s) * 60, clock_minutes(s)),
        "_date": F.when(timed, F.btrim(F.regexp_extract("_s", DATE_AND_CLOCK, 1))).otherwise(s), "_time": F.when(timed, clock_minutes(F.regexp_extract("_s", DATE_AND_CLOCK, 2))),
        "_dec4": _number(s, r"^([0-9]{4})s$", 1), "_dec2": _number(s, r"^'?([0-9]{2})s$", 1), "_year": _number(s, r"^([0-9]{4})$", 1),
        "_mon": _lookup(MONTHS, F.regexp_extract("_s", MONTH_YEAR, 1)), "_mony": _number(s, MONTH_YEAR, 2),
    })
    date = F.col("_date")
    short = F.length(F.regexp_extract("_date", SLASHED, 3)) == 2
    iso, worded = date.rlike(ISO), _lookup(MONTHS, F.regexp_extract("_date", WORDED, 1))
    y = F.when(iso, _number(date, ISO, 1)).when(date.rlike(SLASHED), F.when(short, four_digits(_number(date, SLASHED, 3))).otherwise(_number(date, SLASHED, 3))).otherwise(_number(date, WORDED, 3))
    m = F.when(iso, _number(date, ISO, 2)).when(date.rlike(SLASHED), _number(date, SLASHED, 1)).otherwise(worded)
    d = F.when(iso, _number(date, ISO, 3)).when(date.rlike(SLASHED), _number(date, SLASHED, 2)).otherwise(_number(date, WORDED, 2))
    rows = rows.withColumns({"_y": y, "_m": m, "_d": d})
    full = F.col("_y").between(1000, 2999) & F.col("_m").between(1, 12) & F.col("_d").between(1, 31)
    kind = (
        F.when(F.col("_word").isNotNull() | F.col("_clock").isNotNull(), "time")
        .when((F.col("_dec4") % 10 == 0) | (F.col("_dec2") % 10 == 0), "decade")
        .when(F.col("_year").between(1000, 2999), "year")
        .when(F.col("_mon").isNotNull() & F.col("_mony").between(1000, 2999), "month")
        .when(full, "date")
    )
    rows = rows.withColumn("_kind", kind)
    k = F.col("_kind")
    out = rows.withColumns({
        "y": F.when(k == "year", F.col("_year")).when(k == "month", F.col("_mony")).when(k == "date", F.col("_y")),
        "m": F.when(k == "month", F.col("_mon")).when(k == "date", F.col("_m")), "d": F.when(k == "date", F.col("_d")),
        "minutes": F.when(k == "time", F.col("_clock")).when(k == "date", F.col("_time")),
        "decade": F.when(k == "decade", F.coalesce("_dec4", four_digits(F.col("_dec2")))).when(k.isin("year", "month", "date"), F.floor(F.coalesce(F.when(k == "year", F.col("_year")), F.when(k == "month", F.col("_mony")), F.col("_y")) / 10).cast("int") * 10),
        "day_part": F.when(k == "time", F.coalesce(F.when(F.col("_clock").isNull(), F.col("_word")), tx.time_of_day(F.floor(F.col("_clock") / 60)))).when(F.col("_time").isNotNull() & (k == "date"), tx.time_of_day(F.floor(F.col("_time") / 60))),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def derived_values(parsed: DataFrame) -> DataFrame:
    """A row (label, canonical) for each of up to six values; a day beyond its month rolls over."""
    month = F.format_string("%d-%02d", "y", "m")
    iso = F.format_string("%d-%02d-%02d", "y", "m", "d")
    week = F.date_format(tx.week_start(F.date_add(F.make_date("y", "m", F.lit(1)), F.col("d") - 1)), "yyyy-MM-dd")
    values = {
        "time_of_day": F.col("day_part"),
        "specific_date_time": F.when(F.col("d").isNotNull() & F.col("minutes").isNotNull(), F.concat(iso, F.lit("T"), F.format_string("%02d:%02d", F.floor(F.col("minutes") / 60), F.col("minutes") % 60))),
        "specific_week": F.when(F.col("d").isNotNull(), week),
        "specific_month": F.when(F.col("m").isNotNull(), month),
        "year": F.col("y").cast("string"),
        "decade": F.concat(F.col("decade").cast("string"), F.lit("s")),
    }
    items = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("canonical")) for k, v in values.items()])
    keep = [c for c in parsed.columns if c not in ("y", "m", "d", "minutes", "decade", "day_part")]
    return parsed.select(*keep, F.inline(F.filter(items, lambda x: x["canonical"].isNotNull())))


def derived_mentions(mentions: DataFrame) -> DataFrame:
    """The values derived from date mentions as mentions of their own: the source's span, score 1, derived_from, ids d_0001, ... in each document."""
    out = derived_values(parse_surfaces(mentions))
    w = Window.partitionBy("video_id").orderBy("start", "mention_id", "label")
    return out.withColumns({"derived_id": F.format_string("d_%04d", F.row_number().over(w)), "score": F.lit(1.0), "derived_from": F.col("mention_id")})


def time_axis(rows: DataFrame) -> DataFrame:
    """Rows (label, canonical) with sort_value, milliseconds since 1970, and axis_label; both null where the canonical is no such time."""
    c = F.col("canonical")
    forms = {"year": (r"^\d{4}$", F.concat(c, F.lit("-01-01"))), "decade": (r"^\d{4}s$", F.concat(F.substring(c, 1, 4), F.lit("-01-01"))), "specific_month": (r"^\d{4}-\d{2}$", F.concat(c, F.lit("-01"))), "specific_week": (r"^\d{4}-\d{2}-\d{2}$", c)}
    day = F.lit(None).cast("string")
    for label, (pattern, text) in forms.items():
        day = F.when((F.col("label") == label) & c.rlike(pattern), text).otherwise(day)
    at = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")
    rows = rows.withColumn("sort_value", F.unix_date(at) * F.lit(86_400_000).cast("long"))
    shown = F.when(F.col("label") == "year", F.date_format(at, "yyyy")).when(F.col("label") == "decade", F.concat(F.date_format(at, "yyyy"), F.lit("s"))).when(F.col("label") == "specific_month", F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    return rows.withColumn("axis_label", shown)
