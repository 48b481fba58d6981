"""Timestamps, ages and calendar text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import CONTAINER_EPOCH_OFFSET, MIN_YEAR

NTZ = "timestamp_ntz"

# The accepted spellings of a capture time, in order of trust.
EXIF_PATTERN = r"^\s*\d{4}[:\-]\d{2}[:\-]\d{2}[ T]\d{2}:\d{2}:\d{2}"
MESSENGER_LONG = (
    r"(?i)WhatsApp (?:Image|Video|Audio) (\d{4})-(\d{2})-(\d{2}) at "
    r"(\d{1,2})\.(\d{2})\.(\d{2})(?:\s*([AP]M))?"
)
MESSENGER_SHORT = r"(?i)(?:IMG|VID|AUD|PTT|STK)-(\d{8})-WA\d+"
COMPACT_DATETIME = r"(?<!\d)\d{8}[_\-T ]?\d{6}"
DASHED_DATETIME = r"(?<!\d)\d{4}-\d{2}-\d{2}[ _\-T]\d{2}[.\-:]\d{2}[.\-:]\d{2}"
DASHED_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
COMPACT_DATE = r"(?<!\d)\d{8}(?!\d)"
SEPARATORS = "-_:. \tT"


def latest_year(now: Column | None = None) -> Column:
    return F.year(F.current_date() if now is None else now) + 1


def plausible(ts: Column, max_year: Column | None = None) -> Column:
    """``ts`` when its year lies between 1980 and next year, else null."""
    top = latest_year() if max_year is None else max_year
    return F.when(F.year(ts).between(F.lit(MIN_YEAR), top), ts)


def _parts(digits: Column, with_time: bool) -> list[Column]:
    """Year to second out of a run of digits."""
    places = [(1, 4), (5, 2), (7, 2)] + ([(9, 2), (11, 2), (13, 2)] if with_time else [])
    numbers = [F.substring(digits, at, n).try_cast("int") for at, n in places]
    return numbers + [F.lit(0)] * (6 - len(numbers))


def _make(parts: list[Column]) -> Column:
    # second 60 would roll over to the next minute instead of being refused
    return F.when(parts[5] < 60, F.try_make_timestamp_ntz(*parts))


def _first_plausible(times: Column, max_year: Column | None) -> Column:
    top = latest_year() if max_year is None else max_year
    return F.get(F.filter(times, lambda t: F.year(t).between(F.lit(MIN_YEAR), top)), 0)


def parse_exif(value: Column, max_year: Column | None = None) -> Column:
    """'YYYY:MM:DD hh:mm:ss' (also '-' and 'T') at the start of the text; null when not valid."""
    digits = F.array(F.translate(F.regexp_extract(value, EXIF_PATTERN, 0), SEPARATORS, ""))
    return _first_plausible(F.transform(digits, lambda d: _make(_parts(d, True))), max_year)


def _first_valid(name: Column, pattern: str, group: int, with_time: bool, max_year: Column | None) -> Column:
    # one step per transform, so that nothing is computed twice within a step
    hits = F.regexp_extract_all(name, F.lit(pattern), F.lit(group))
    digits = F.transform(hits, lambda m: F.translate(m, SEPARATORS, ""))
    return _first_plausible(F.transform(digits, lambda d: _make(_parts(d, with_time))), max_year)


def _messenger_long(name: Column, max_year: Column | None) -> Column:
    def group(i):
        return F.regexp_extract(name, MESSENGER_LONG, i)

    def number(i):
        return group(i).try_cast("int")

    half = F.upper(group(7))
    hour = F.when(half == "", number(4)).otherwise(number(4) % 12 + F.when(half == "PM", 12).otherwise(0))
    made = _make([number(1), number(2), number(3), hour, number(5), number(6)])
    return F.when(F.lower(name).contains("whatsapp"), _first_plausible(F.array(made), max_year))


def date_from_name(name: Column, max_year: Column | None = None) -> Column:
    """First valid timestamp spelled in a file name."""
    return F.coalesce(
        _messenger_long(name, max_year),
        _first_valid(name, MESSENGER_SHORT, 1, False, max_year),
        _first_valid(name, COMPACT_DATETIME, 0, True, max_year),
        _first_valid(name, DASHED_DATETIME, 0, True, max_year),
        _first_valid(name, DASHED_DATE, 0, False, max_year),
        _first_valid(name, COMPACT_DATE, 0, False, max_year),
    )


def resolve_date(
    name: Column,
    mtime: Column,
    exif: Column | None = None,
    video_created: Column | None = None,
    max_year: Column | None = None,
) -> Column:
    """struct(taken_at, source, confidence): embedded tag, container time, name, then modified time."""

    def option(ts, source, confidence):
        return F.when(
            ts.isNotNull(),
            F.struct(ts.alias("taken_at"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")),
        )

    choices = []
    if exif is not None:
        choices.append(option(parse_exif(exif, max_year), "exif", "high"))
    if video_created is not None:
        choices.append(option(plausible(video_created.cast(NTZ), max_year), "video_meta", "high"))
    choices.append(option(date_from_name(name, max_year), "filename", "medium"))
    choices.append(option(F.timestamp_seconds(F.floor(mtime)).cast(NTZ), "mtime", "low"))
    return F.coalesce(*choices)


def container_time(seconds: Column) -> Column:
    """Seconds since 1904 to a local timestamp; null at or before the 1970 offset."""
    return F.when(
        seconds > CONTAINER_EPOCH_OFFSET, F.timestamp_seconds(seconds - CONTAINER_EPOCH_OFFSET).cast(NTZ)
    )


def minute_bucket(ts: Column, source: Column) -> Column:
    """Calendar minute, only where the time source is reliable."""
    return F.when(source.isin("exif", "video_meta"), F.date_trunc("minute", ts))


# ---------- ages ----------

def months_between_days(birth: Column, seen: Column) -> Column:
    whole = (F.year(seen) - F.year(birth)) * 12 + F.month(seen) - F.month(birth)
    return whole - F.when(F.dayofmonth(seen) < F.dayofmonth(birth), 1).otherwise(0)


def age_parts(birth: Column, seen: Column) -> Column:
    """struct(years, months, days); days only within the first month; null before birth."""
    total = months_between_days(birth, seen)
    days = F.when(total == 0, F.datediff(seen, birth)).otherwise(0)
    parts = F.struct(
        F.floor(total / 12).cast("int").alias("years"),
        F.pmod(total, F.lit(12)).cast("int").alias("months"),
        days.cast("int").alias("days"),
    )
    return F.when(seen >= birth, parts)


def _count_of(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def age_label(birth: Column, seen: Column) -> Column:
    """'Newborn', '12 days', '8 mos', '3 yrs 2 mos', '34 yrs' or 'Before birth'."""
    total = months_between_days(birth, seen)
    years = F.floor(total / 12).cast("int")
    months = F.pmod(total, F.lit(12)).cast("int")
    days = F.datediff(seen, birth)
    return (
        F.when(birth.isNull() | seen.isNull(), F.lit(None).cast("string"))
        .when(seen < birth, "Before birth")
        .when((total == 0) & (days == 0), "Newborn")
        .when(total == 0, _count_of(days, "day", "days"))
        .when(years == 0, _count_of(months, "mo", "mos"))
        .when((years >= 18) | (months == 0), _count_of(years, "yr", "yrs"))
        .otherwise(F.concat_ws(" ", _count_of(years, "yr", "yrs"), _count_of(months, "mo", "mos")))
    )


def age_years(birth: Column, day: Column) -> Column:
    """Completed years; negative before birth."""
    early = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - early.cast("int")


def chapter_age(birth: Column, start: Column, end: Column) -> Column:
    """'Age 5 – 17', 'Age 5' or 'From age 17' for a [start, end) chapter."""
    first = F.greatest(F.lit(0), age_years(birth, start))
    last = age_years(birth, end)
    return (
        F.when(birth.isNull() | start.isNull(), F.lit(None).cast("string"))
        .when(end.isNull(), F.concat(F.lit("From age "), first.cast("string")))
        .when(last <= first, F.concat(F.lit("Age "), first.cast("string")))
        .otherwise(F.concat(F.lit("Age "), first.cast("string"), F.lit(" – "), last.cast("string")))
    )


def turns_label(name: Column, birth: Column, year: Column) -> Column:
    """'X turns n' or 'X born' for a calendar year; null before the birth year."""
    n = year - F.year(birth)
    return (
        F.when(birth.isNull() | (n < 0), F.lit(None).cast("string"))
        .when(n > 0, F.concat(F.coalesce(name, F.lit("Age")), F.lit(" turns "), n.cast("string")))
        .otherwise(F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(" born"))))
    )


# ---------- calendar ----------

def last_day_number(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def on_year(month: Column, day: Column, year: Column) -> Column:
    """The (month, day) date in ``year``; 29 Feb falls on 28 Feb in common years."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.least(day, last_day_number(year, month)).cast("int") - 1)


def add_years(day: Column, years: int) -> Column:
    return F.add_months(day, 12 * years)


def span_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def widen(start: Column, end: Column, days: int = 0) -> tuple[Column, Column]:
    return F.date_sub(start, days), F.date_add(end, days)


def valid_month_day(month: Column, day: Column, year: Column) -> Column:
    """Does the day exist? A missing year counts as a leap year."""
    in_range = month.between(1, 12) & day.between(1, 31)
    safe_month = F.when(month.between(1, 12), month).otherwise(1)
    return in_range & (day <= last_day_number(F.coalesce(year, F.lit(2000)), safe_month))


def date_text(start: Column, end: Column) -> Column:
    """Range text that repeats neither a shared month nor a shared year."""
    a, b = start.cast("date"), end.cast("date")
    same_year = F.year(a) == F.year(b)
    full_b = F.date_format(b, "d MMM yyyy")
    return (
        F.when(a == b, F.date_format(a, "d MMM yyyy"))
        .when(same_year & (F.month(a) == F.month(b)), F.concat_ws(" – ", F.date_format(a, "d"), full_b))
        .when(same_year, F.concat_ws(" – ", F.date_format(a, "d MMM"), full_b))
        .otherwise(F.concat_ws(" – ", F.date_format(a, "d MMM yyyy"), full_b))
    )


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMMM yyyy")


def pair_caption(first: Column, second: Column) -> Column:
    a, b = first.cast("date"), second.cast("date")
    same_month = (F.year(a) == F.year(b)) & (F.month(a) == F.month(b))
    return (
        F.when(a == b, long_date(a))
        .when(same_month, F.concat_ws(" – ", F.date_format(a, "d"), long_date(b)))
        .otherwise(F.concat_ws("  ·  ", long_date(a), long_date(b)))
    )


def years_ago_label(n: Column) -> Column:
    return F.when(n == 1, "A year ago").otherwise(F.concat(n.cast("string"), F.lit(" years ago")))
