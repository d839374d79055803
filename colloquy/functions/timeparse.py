"""Timestamp texts to instants, as native column expressions.

A text is first brought to one spelling (full-width forms, Chinese date words, padding), then one
regular expression splits it into fields; all arithmetic is on integers, so no session time zone
takes part.  A text may have several valid readings (day first or month first); the expression
returns both, and the caller decides (see ``operators.timestamps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English and German month names, zone abbreviations in minutes east of UTC,
# Chinese words for parts of the day.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "SGT": 480, "HKT": 480,
    "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MORNING, NOON, AFTERNOON, EVENING = "上午|早上|早晨|清晨|凌晨", "中午", "下午|傍晚|午后", "晚上|夜里|夜晚|深夜"

STANDARD = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
_WIDE = "０１２３４５６７８９：－／．＋，\u3000\u00a0\u200b\ufeff"  # the last two are left out
_THIN = "0123456789:-/.+,  "
_DATE = (
    r"(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"  # 1 y 2 m 3 d
    r"|(\d{1,2})([./])(\d{1,2})\5(\d{4})"  # 4 first 5 mark 6 second 7 y
    r"|(?:\p{L}{2,9}\.?,? )?(\p{L}{3,9})\.? (\d{1,2}),? (\d{4})"  # 8 month 9 d 10 y
    r"|(?:\p{L}{2,9}\.?,? )?(\d{1,2})\.? (\p{L}{3,9})\.?,? (\d{4}))"  # 11 d 12 month 13 y
)
_TIME = (
    rf",?[T ]?({MORNING}|{NOON}|{AFTERNOON}|{EVENING})? ?"  # 14 part of the day
    r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"  # 15 h 16 min 17 s 18 fraction
    r"(?: ?([AaPp])\.?[Mm]\.?)?"  # 19 half of the day
    r" ?([A-Z]{1,5})?(?:([+-])(\d{1,2}):?(\d{2})?)?(?: ?\([^)]*\))?$"  # 20 zone 21 sign 22 h 23 min
)
FIELDS = 23


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _days(text: Column) -> Column:
    """Days since 1970-01-01 of 'y-m-d'; null if there is no such date."""
    return F.unix_date(text.try_cast("date")).cast("long")


def spelled(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, one spelling of ``text``: half-width, Chinese date words as marks, padding out,
    Beijing time as +08:00, fourteen digits as date and time."""
    c = F.col(out)
    df = df.withColumn(out, F.translate(text, _WIDE, _THIN))
    df = df.withColumn(out, F.when(c.contains("北京时间"), F.concat(F.regexp_replace(c, r"[(（]?北京时间[)）]?[:：]?", " "), F.lit(" +08:00"))).otherwise(c))
    words = F.translate(F.regexp_replace(c, r"秒|(?<=\d)分(?![\d ])", ""), "年月日号时点分", "--  :::")
    df = df.withColumn(out, F.when(c.contains("年"), F.regexp_replace(words, r":(?=\s|$)", ":00")).otherwise(c))
    df = df.withColumn(out, F.trim(F.regexp_replace(c, r"(?U)[\s\p{Z}\p{Cf}]+", " ")))
    return df.withColumn(out, F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6"))


def fields(spelling: Column) -> Column:
    """Array of the 23 fields ('' where absent), or null if the text isn't of a known form."""
    joined = F.regexp_replace(spelling, "^" + _DATE + _TIME, "\u0001" + "|".join(f"${i}" for i in range(1, FIELDS + 1)))
    return F.when(joined.startswith("\u0001"), F.split(F.substring(joined, 2, 400), r"\|", -1))


def parts(f: Column, spelling: Column) -> dict[str, Column]:
    """Readings of a text: dates under both orders as days, clock fields, zone and offset."""
    g = lambda i: f.getItem(i - 1)
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    zones = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    named = F.try_element_at(months, F.lower(F.substring(F.concat(g(8), g(12)), 1, 3))).cast("string")
    iso = (
        F.when(g(1) != "", F.concat_ws("-", g(1), g(2), g(3)))
        .when(g(5) != "", F.concat_ws("-", g(7), g(6), g(4)))
        .when(named.isNotNull(), F.concat(g(10), g(13), F.lit("-"), named, F.lit("-"), g(9), g(11)))
    )
    american = F.when(g(5) == "/", F.concat_ws("-", g(7), g(4), g(6)))
    minutes = F.coalesce(_int(g(22)), F.lit(0)) * 60 + F.coalesce(_int(g(23)), F.lit(0))
    return {
        "dmy": _days(iso),
        "mdy": _days(american),
        "slash": F.coalesce(g(5) == "/", F.lit(False)),
        "first": _int(g(4)),
        "second": _int(g(6)),
        "hour": _int(g(15)),
        "minute": _int(g(16)),
        "sec": F.coalesce(_int(g(17)), F.lit(0)),
        "half": F.lower(g(19)),
        "word": g(14),
        "milli": F.when(g(18) != "", F.substring(F.concat(g(18), F.lit("000")), 1, 3).cast("int")).otherwise(0),
        "zoned": F.coalesce((g(20) != "") | (g(21) != ""), F.lit(False)),
        "zone": g(20),
        # An abbreviation that is not known makes the zone, and so the instant, unreadable.
        "base": F.when(g(20) == "", F.lit(0)).otherwise(F.try_element_at(zones, g(20))),
        "shift": F.when(g(21) == "-", -minutes).when(g(21) == "+", minutes).otherwise(0),
        "unix": F.when(spelling.rlike(r"^\d{10}$"), spelling.try_cast("long") * 1000).when(spelling.rlike(r"^\d{13}$"), spelling.try_cast("long")),
    }


def hour_of_day(hour: Column, half: Column, word: Column) -> Column:
    """Hour from 0 to 23 of an hour with AM/PM mark or Chinese part of the day; else null."""
    return (
        F.when(half == "a", F.when(hour.between(0, 12), hour % 12))
        .when(half == "p", F.when(hour.between(1, 12), hour % 12 + 12))
        .when(word == "", hour)
        .when(word.rlike(f"^(?:{MORNING})$"), F.when(hour == 12, 0).otherwise(hour))
        .when(word == NOON, F.when(hour < 10, hour + 12).otherwise(hour))
        .when(word.rlike(f"^(?:{AFTERNOON})$"), F.when(hour < 12, hour + 12).otherwise(hour))
        .otherwise(F.when(hour.between(5, 11), hour + 12).when(hour == 12, 0).otherwise(hour))
    )
