"""Dates in text: canonical forms, anchors, as-of points and date arithmetic, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import re2

# Fixed values.
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_PT = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
SHORT_EN = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "três": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12,
}
WEEKDAYS = {
    "sunday": 0, "monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5, "saturday": 6,
    "domingo": 0, "segunda": 1, "terca": 2, "terça": 2, "quarta": 3, "quinta": 4, "sexta": 5, "sabado": 6, "sábado": 6,
}
_EN = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
_PT = "janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
YMD = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
DMY = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"
DAY_MONTH_YEAR = r"\b(\d{1,2})\s+(?:de\s+)?([\p{L}]+)\.?\s+(?:de\s+)?(\d{4})\b"
MONTH_DAY_YEAR = r"\b([\p{L}]+)\.?\s+(\d{1,2}),?\s+(\d{4})\b"
ISO = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
EN_DATE = rf"(?i)\b({_EN})\s+(\d{{1,2}})(?:[,\s]+(\d{{4}}))?\b"
PT_DATE = rf"(?i)\b(\d{{1,2}})\s+de\s+({_PT})(?:\s+de\s+(\d{{4}}))?\b"
WORD_AGO = r"(?i)\b(\d+|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|um|uma|dois|duas|tr[êe]s|quatro|cinco|seis|sete|oito|nove|dez|onze|doze)\s+(day|days|week|weeks|month|months|dia|dias|semana|semanas|m[eê]s|meses)\s+(ago|atr[áa]s)\b"
AGO = r"(?i)\b(\d+)\s+(day|days|week|weeks|month|months|year|years|dia|dias|semana|semanas|m[eê]s|meses|ano|anos)\s+(ago|atr[áa]s)\b"
DAY_EN = r"(?i)\b(?:last|past|this)\s+(sunday|monday|tuesday|wednesday|thursday|friday|saturday)\b"
DAY_PT = r"(?i)\b(?:[úu]ltim[ao]\s+(domingo|segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado)|(domingo|segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado)(?:-feira)?\s+passad[ao])\b"
DAY_BACK = rf"(?i)\b(?:last|past|[uú]ltim[oa])\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado|domingo)\b"
LAST_UNIT = r"(?i)\b(?:last|past)\s+(week|month|weekend)\b"
BEFORE = r"(?i)\b(before|prior to|antes de|antes do|antes da)\b"
AS_OF = rf"(?i)\bas of\b|\bnaquele\b|\bnaquela\b|\bem ({_PT})\b"
BACK_THEN = r"(?i)\b(back then|naquela época|naquele tempo|na época)\b"
IN_YEAR = r"\b(in|em)\s+((?:19|20|21)\d{2})\b"
BETWEEN = r"(?i)\b(between|entre)\b"
SINCE = r"(?i)\b(since|desde)\b|\bh[áa] quanto\b|\bhow (long|many days|many weeks|many months|many years)\b"
AGO_WORD = r"(?i)\b(ago|atr[áa]s)\b"
UNTIL = r"(?i)\b(from now|until|daqui a|at[eé])\b"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _months(names: list[list[str]]) -> dict[str, int]:
    return {name: i + 1 for part in names for i, name in enumerate(part)}


MONTHS = _months([MONTHS_EN, SHORT_EN, [x.replace("ç", "c") for x in MONTHS_PT]]) | {"sept": 9}


def month_of(word: Column) -> Column:
    """1 to 12 for an English or Portuguese month name, with or without accents, else null."""
    return F.try_element_at(_map(MONTHS), F.translate(F.lower(word), "áàãâçéêíóôõú", "aaaaceeiooou"))


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _iso(y: Column, m: Column, d: Column) -> Column:
    """The canonical text, without a look at the calendar; null beyond 1900 to 2200."""
    ok = y.between(1900, 2200) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))


def canonical_dates(text: Column) -> Column:
    """All dates of a text as 'YYYY-MM-DD', by kind and then as they stand, each once."""

    def found(pattern: str, y: int, m: int, d: int, month=_number) -> Column:
        # one pass over the text; the parts are read from the few characters that it finds, of which all are the pattern's
        whole = "^" + re2(pattern.removeprefix(r"\b").removesuffix(r"\b")) + "$"
        part = lambda x, g: F.regexp_extract(x, whole, g)
        return F.transform(F.regexp_extract_all(text, F.lit(re2(pattern)), F.lit(0)), lambda x: _iso(part(x, y).cast("int"), month(part(x, m)), part(x, d).cast("int")))

    every = F.concat(found(YMD, 1, 2, 3), found(DMY, 3, 2, 1), found(DAY_MONTH_YEAR, 3, 2, 1, month_of), found(MONTH_DAY_YEAR, 3, 1, 2, month_of))
    # each kind has a year of four digits
    return F.when(text.rlike(r"\d{4}"), F.array_distinct(F.filter(every, lambda x: x.isNotNull()))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def date_tokens(text: Column) -> Column:
    return F.transform(canonical_dates(text), lambda x: F.concat(F.lit("d"), F.replace(x, F.lit("-"), F.lit(""))))


def strip_context_date(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\[\s*today\s*:[^\]]*\]", " "))


def session_date(text: Column) -> Column:
    """The date of a '[Session date: Y/M/D]' mark, or of Date or Today, else null."""
    p = r"\[(?:Session date|Date|Today): *(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    y, m, d = (_number(F.regexp_extract(text, p, i)) for i in (1, 2, 3))
    return safe_date(y, m, d)


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """The calendar date, or null."""
    return F.when(y.between(1900, 2200), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def add_months(day: Column, n: Column) -> Column:
    """Months added as a calendar does that lets days run over: 31 March less a month is 3 March."""
    first = F.add_months(F.trunc(day, "month"), n)
    return F.date_add(first, F.dayofmonth(day) - 1)


def last_weekday(now: Column, weekday: Column) -> Column:
    """The latest such day strictly before ``now``; 0 is Sunday."""
    return F.date_sub(now, ((F.dayofweek(now) - 1 - weekday + 6) % 7 + 1).cast("int"))


def back(now: Column, n: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return (
        F.when(u.isin("day", "days", "dia", "dias"), F.date_sub(now, n))
        .when(u.isin("week", "weeks", "semana", "semanas"), F.date_sub(now, 7 * n))
        .when(u.isin("month", "months", "mês", "mes", "meses"), add_months(now, -n))
        .when(u.isin("year", "years", "ano", "anos"), add_months(now, -12 * n))
    )


def _part(text: Column, pattern: str, group: int) -> Column:
    x = F.regexp_extract(text, re2(pattern), group)
    return F.when(x != "", x)


def _dated(text: Column, now: Column) -> Column:
    """The first of: a numeric date, an English one, a Portuguese one; a missing year is that of ``now``."""
    n = lambda p, g: _number(_part(text, p, g))
    year = F.year(now)
    return F.coalesce(
        safe_date(n(ISO, 1), n(ISO, 2), n(ISO, 3)),
        safe_date(F.coalesce(n(EN_DATE, 3), year), month_of(_part(text, EN_DATE, 1)), n(EN_DATE, 2)),
        safe_date(F.coalesce(n(PT_DATE, 3), year), month_of(_part(text, PT_DATE, 2)), n(PT_DATE, 1)),
    )


def detect_anchor(text: Column, now: Column) -> Column:
    """The date that a question is about, or null; ``now`` is a date."""
    count = F.lower(_part(text, WORD_AGO, 1))
    n = F.coalesce(F.try_element_at(_map(NUMBERS), count), count.try_cast("int"))
    day = lambda name: last_weekday(now, F.try_element_at(_map(WEEKDAYS), F.lower(name)))
    unit = F.lower(_part(text, LAST_UNIT, 1))
    return F.coalesce(
        _dated(text, now),
        F.when(n > 0, back(now, n, _part(text, WORD_AGO, 2))),
        day(_part(text, DAY_EN, 1)),
        day(F.coalesce(_part(text, DAY_PT, 1), _part(text, DAY_PT, 2))),
        F.when(unit == "week", F.date_sub(now, 7)).when(unit == "month", add_months(now, F.lit(-1))).when(unit == "weekend", last_weekday(now, F.lit(6))),
    )


def detect_as_of(text: Column, now: Column) -> Column:
    """The moment as of which a question asks, or null; ``now`` is a timestamp."""
    today = F.to_date(now)
    clock = (F.unix_seconds(now) - F.unix_seconds(today.cast("timestamp"))).cast("long")
    at = lambda day, seconds: F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds)
    past = F.lit(False)
    for p in (BEFORE, AS_OF, BACK_THEN, IN_YEAR):
        past = past | text.rlike(re2(p))
    year = _number(_part(text, IN_YEAR, 2))
    month = month_of(_part(text, AS_OF, 1))
    month_year = F.year(today) - F.when(month > F.month(today), 1).otherwise(0)
    return F.coalesce(
        at(back(today, _number(_part(text, AGO, 1)), _part(text, AGO, 2)), clock),
        F.when(past, F.coalesce(at(_dated(text, today), 86399), at(safe_date(year, F.lit(12), F.lit(31)), 86399), at(safe_date(month_year, month, F.lit(1)), 0))),
    )


def months_between(a: Column, b: Column) -> Column:
    """Whole months from ``a`` to the later ``b``."""
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    return F.greatest(n, F.lit(0))


def _span(days: Column, a: Column, b: Column, words: Column) -> Column:
    size = F.when(days.between(14, 59), F.format_string("%d days (≈%d weeks)", days, F.floor(days / 7).cast("int"))).when(days >= 60, F.format_string("%d days (≈%d months)", days, months_between(a, b))).otherwise(F.format_string("%d days", days))
    return F.concat(size, words)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def date_math(text: Column, now: Column) -> Column:
    """Sentences that state the differences between a question's dates, or between them and ``now`` (a date)."""
    return _bound(text, lambda t: _bound(now, lambda n: _date_math(t, n)))


def _date_math(text: Column, now: Column) -> Column:
    def every(pattern: str, y: int, m: int, d: int, month) -> Column:
        # one pass over the text; the parts are read from the few characters that it finds
        part = lambda x, g: F.regexp_extract(x, re2(pattern), g)
        return F.transform(F.regexp_extract_all(text, F.lit(re2(pattern)), F.lit(0)), lambda x: safe_date(F.coalesce(_number(part(x, y)), F.year(now)), month(part(x, m)), part(x, d).cast("int")))

    ago = back(now, _number(_part(text, AGO, 1)), _part(text, AGO, 2))
    week = last_weekday(now, F.try_element_at(_map(WEEKDAYS), F.lower(_part(text, DAY_BACK, 1))))
    dates = F.concat(every(ISO, 1, 2, 3, _number), every(EN_DATE, 3, 1, 2, month_of), every(PT_DATE, 3, 2, 1, month_of), F.array(ago, week))
    dates = F.array_distinct(F.filter(dates, lambda x: x.isNotNull()))
    since = text.rlike(re2(SINCE)) | text.rlike(re2(AGO_WORD)) | text.rlike(re2(UNTIL))
    day = lambda x: F.date_format(x, "yyyy-MM-dd")

    def pair(x: Column, y: Column) -> Column:
        a, b = F.least(x, y), F.greatest(x, y)
        return _span(F.datediff(b, a), a, b, F.concat(F.lit(" between "), day(a), F.lit(" and "), day(b)))

    def to_now(x: Column) -> Column:
        ahead = F.format_string("%d days from today (today: %s, target: %s)", F.datediff(x, now), day(now), day(x))
        return F.when(x > now, ahead).otherwise(_span(F.datediff(now, x), x, now, F.concat(F.lit(" since "), day(x), F.lit(" (today: "), day(now), F.lit(")"))))

    pairs = lambda d: F.flatten(F.transform(d, lambda x, i: F.transform(F.slice(d, i + 2, F.greatest(F.size(d), F.lit(1))), lambda y: pair(x, y))))
    none = F.array().cast("array<string>")

    def facts(between: Column) -> Column:
        # dates are looked for only where they are asked about
        said = lambda d: F.when(between & (F.size(d) >= 2), F.slice(pairs(d), 1, 3)).when((F.size(d) >= 1) & since, F.transform(d, to_now)).otherwise(none)
        return F.when(between | since, _bound(dates, said)).otherwise(none)

    return _bound(text.rlike(re2(BETWEEN)), facts)


def valid_time(s: Column) -> Column:
    """A timestamp in RFC 3339, or a date, else null."""
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), s.try_cast("timestamp")), F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), s.try_cast("date").cast("timestamp")))
