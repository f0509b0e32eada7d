"""Dates and times written as text, in mixed formats, as one Spark expression.

Understood besides what Spark casts (ISO dates and times): numbers parted by
``/``, ``-`` or ``.`` with the year last (``03/15/2024``; the month comes first
unless only the second number can be one) or first (``2024/3/15``), and month
names (``15 Mar 2024``, ``15-March-2024``, ``Mar 15, 2024``, ``March 2024``),
each with an optional weekday before it and time behind it (``3:05 PM``,
``15:05:59``).  Years of two digits are 1969 to 2068.  Everything else is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No date in one of these forms is longer; longer texts are not searched.
LONGEST = 64
_NAME = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
         r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?")
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_YEAR = r"(\d{4}|\d{2})"
_WEEKDAY = r"^(?i)(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
_TIME = r"(?i)[\sT,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d{1,9})?)?(?:\s*([ap])\.?m\.?)?$"
YEAR_LAST = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2{_YEAR}$"
YEAR_FIRST = r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})$"
DAY_NAME = rf"^(?i){_DAY}[\s/-]*{_NAME}[\s,/-]*{_YEAR}$"
NAME_DAY = rf"^(?i){_NAME}[\s-]*{_DAY}(?:,\s*|[\s-]+){_YEAR}$"
NAME_YEAR = rf"^(?i){_NAME}[\s,/-]+(\d{{4}})$"


def _full_year(year: Column) -> Column:
    short = year.cast("int")
    return F.when(F.length(year) == 4, short).when(short >= 69, short + 1900).otherwise(short + 2000)


def _month(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def parse_date(text: Column) -> Column:
    """Timestamp of a text, null if it is none."""
    t = F.trim(text)
    tail = F.regexp_extract(t, _TIME, 0)
    body = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), _WEEKDAY, "")
    part = lambda pattern, i: F.regexp_extract(body, pattern, i)
    whole = lambda pattern, i: part(pattern, i).cast("int")
    a, b = whole(YEAR_LAST, 1), whole(YEAR_LAST, 3)
    date = (
        F.when(body.rlike(YEAR_LAST), _ymd(_full_year(part(YEAR_LAST, 4)), F.when(a <= 12, a).otherwise(b), F.when(a <= 12, b).otherwise(a)))
        .when(body.rlike(YEAR_FIRST), _ymd(whole(YEAR_FIRST, 1), whole(YEAR_FIRST, 3), whole(YEAR_FIRST, 4)))
        .when(body.rlike(DAY_NAME), _ymd(_full_year(part(DAY_NAME, 3)), _month(part(DAY_NAME, 2)), whole(DAY_NAME, 1)))
        .when(body.rlike(NAME_DAY), _ymd(_full_year(part(NAME_DAY, 3)), _month(part(NAME_DAY, 1)), whole(NAME_DAY, 2)))
        .when(body.rlike(NAME_YEAR), _ymd(whole(NAME_YEAR, 2), _month(part(NAME_YEAR, 1)), F.lit(1)))
    )
    clock = lambda i: F.regexp_extract(t, _TIME, i)
    half, hour = F.lower(clock(4)), clock(1).cast("int")
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(99)).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(clock(3) == "", F.lit("00")).otherwise(clock(3))
    time = F.when(tail == "", F.lit("")).otherwise(F.format_string(" %02d:%s:%s", hour, clock(2), second))
    other = F.when(F.length(t) <= LONGEST, F.concat(date, time).try_cast("timestamp"))
    return F.coalesce(t.try_cast("timestamp"), other)
