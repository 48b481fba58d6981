"""Festivals, recurring dates, life chapters and the joins that place them on ranges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import add_years, on_year, years_ago_label
from tidemark.functions.text import FESTIVAL_NAMES, lookup, occasion_label
from tidemark.operators.intervals import day_number, points_in_ranges
from tidemark.operators.ordering import next_on_or_after
from tidemark.session import cut

EARLY_YEARS = "Early years"


# ---------- recurring dates ----------

def derived_birthdays(occasions: DataFrame, persons: DataFrame) -> DataFrame:
    """Named, visible people with a birth date that no birthday occasion is linked to."""
    linked = occasions.where((F.col("kind") == "birthday") & (F.coalesce(F.col("person_id"), F.lit(0)) != 0))
    return persons.where(
        F.col("birth_date").isNotNull() & F.col("name").isNotNull() & ~F.col("hidden")
    ).join(linked.select(F.col("person_id").alias("id")), "id", "left_anti")


def recurring_dates(occasions: DataFrame, persons: DataFrame) -> DataFrame:
    """Explicit occasions and derived birthdays in one shape."""
    explicit = occasions.select(
        "kind",
        F.concat(F.lit("occasion:"), F.col("id").cast("string")).alias("key"),
        "name",
        F.col("month").cast("int").alias("month"),
        F.col("day").cast("int").alias("day"),
        F.col("year").cast("int").alias("first_year"),
        F.col("person_id").cast("bigint").alias("person_id"),
        F.struct(F.lit(0).alias("source"), F.col("id").cast("bigint").alias("id")).alias("listed"),
    )
    derived = derived_birthdays(occasions, persons).select(
        F.lit("birthday").alias("kind"),
        F.concat(F.lit("person:"), F.col("id").cast("string")).alias("key"),
        "name",
        F.month("birth_date").alias("month"),
        F.dayofmonth("birth_date").alias("day"),
        F.year("birth_date").alias("first_year"),
        F.col("id").cast("bigint").alias("person_id"),
        F.struct(F.lit(1).alias("source"), F.col("id").cast("bigint").alias("id")).alias("listed"),
    )
    return explicit.unionByName(derived)


def calendar_list(occasions: DataFrame, persons: DataFrame) -> DataFrame:
    """All recurring dates with the person's name and their source, by month, day, name."""
    names = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    both = recurring_dates(occasions, persons).join(names, "person_id", "left")
    explicit = F.col("listed.source") == 0
    return both.select(
        F.when(explicit, F.col("listed.id")).alias("id"),
        "kind",
        "name",
        "month",
        "day",
        F.col("first_year").alias("year"),
        "person_id",
        "person_name",
        F.when(explicit, "occasion").otherwise("person").alias("source"),
    ).orderBy("month", "day", "name", F.col("id").asc_nulls_last(), "person_id")


# ---------- placing occasions on date ranges ----------

def overlaps(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Pairs of rows (of the same owner) whose date ranges share a day: one of the two starts within the other."""
    a = left.where(F.col(left_range[0]).cast("date") <= F.col(left_range[1]).cast("date"))
    b = right.where(F.col(right_range[0]).cast("date") <= F.col(right_range[1]).cast("date"))
    (la, ha), (lb, hb) = ([day_number(F.col(c)) for c in names] for names in (left_range, right_range))
    within = points_in_ranges(a, la, b, lb, hb, by)
    after = points_in_ranges(b, lb, a, la + 1, ha, by)
    return within.unionByName(after)


def festival_hits(ranges: DataFrame, festivals: DataFrame, key: str = "event_id") -> DataFrame:
    windows = festivals.select(
        "festival", "year", F.col("date").alias("date"), F.col("start").alias("_start"), F.col("end").alias("_end")
    )
    hits = overlaps(ranges.select(key, "start_date", "end_date"), windows, ("start_date", "end_date"), ("_start", "_end"))
    title = F.concat_ws(" ", lookup(F.col("festival"), FESTIVAL_NAMES, F.col("festival")), F.col("year").cast("string"))
    return hits.select(
        key,
        F.lit("festival").alias("kind"),
        F.col("festival").alias("key"),
        title.alias("name"),
        "date",
        F.lit(None).cast("bigint").alias("person_id"),
        F.struct(F.lit(1).alias("late"), F.col("date"), F.col("_start").alias("tie"), F.lit(0).alias("source"), F.lit(0).cast("bigint").alias("id")).alias("rank"),
    )


def _occurrences(ranges: DataFrame, recurring: DataFrame) -> DataFrame:
    """``recurring`` with its ``date`` in every year that the ranges reach, from its first year on.

    29 Feb falls on 28 Feb in common years. Dates that no calendar has are left out.
    """
    reach = ranges.where("start_date <= end_date").agg(F.min(F.year("start_date")).alias("low"), F.max(F.year("end_date")).alias("high")).first()
    if reach["low"] is None:
        return recurring.withColumn("date", F.lit(None).cast("date")).limit(0)
    first = F.greatest(F.coalesce(F.col("first_year"), F.lit(0)), F.lit(reach["low"]))
    years = F.when(first <= reach["high"], F.sequence(first, F.lit(reach["high"])))
    leap = (F.col("month") == 2) & (F.col("day") == 29)
    on = F.when(leap, on_year(F.col("month"), F.col("day"), F.col("_year"))).otherwise(F.try_make_timestamp_ntz("_year", "month", "day", F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    return recurring.withColumn("_year", F.explode(years)).withColumn("date", on).drop("_year").where("date is not null")


def recurring_hits(ranges: DataFrame, recurring: DataFrame, key: str = "event_id") -> DataFrame:
    """Each recurring date inside each range, from its first year on.

    A recurring date is a point in every year, so that what meets are days, not the 366 days of a
    year. 28 Feb of a common year also stands for 29 Feb.
    """
    spans = ranges.select(key, "start_date", "end_date").withColumnRenamed(key, "_range")
    days = _occurrences(ranges, recurring)
    hits = points_in_ranges(days, day_number(F.col("date")), spans, day_number(F.col("start_date")), day_number(F.col("end_date")))
    return hits.select(
        F.col("_range").alias(key),
        "kind",
        "key",
        occasion_label(F.col("kind"), F.col("name"), F.year("date"), F.col("first_year")).alias("name"),
        "date",
        "person_id",
        F.struct(F.lit(0).alias("late"), F.col("date"), F.col("date").alias("tie"), F.col("listed.source").alias("source"), F.col("listed.id").alias("id")).alias("rank"),
    )


def on_any_occasion(ranges: DataFrame, festivals: DataFrame, recurring: DataFrame, key: str = "event_id") -> DataFrame:
    """The keys of the ranges that some festival or recurring date falls into.

    However many people share a birthday, a date of the year counts once: with the earliest of its
    first years there are 366 dates at most. Ranges of the same days are one range until the end.
    """
    days = ["start_date", "end_date"]
    dates = recurring.groupBy("month", "day").agg(F.min(F.coalesce("first_year", F.lit(0))).alias("first_year"))
    spans = cut(ranges.select(*days).distinct())
    on = _occurrences(spans, dates).select("date").distinct()
    recur = points_in_ranges(on, day_number(F.col("date")), spans, day_number(F.col("start_date")), day_number(F.col("end_date")))
    windows = festivals.select(F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
    fest = overlaps(spans, windows, ("start_date", "end_date"), ("_start", "_end"))
    hit = recur.select(*days).unionByName(fest.select(*days)).distinct()
    return ranges.join(hit, days, "left_semi").select(key).distinct()


def occasion_hits(ranges: DataFrame, festivals: DataFrame, recurring: DataFrame, key: str = "event_id") -> DataFrame:
    """Festivals and family dates per range (key, start_date, end_date); order by ``rank``
    (family first, then by date)."""
    return festival_hits(ranges, festivals, key).unionByName(recurring_hits(ranges, recurring, key))


# ---------- chapters ----------

def chapters(stages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """[start, end) intervals of the life stages, with a leading open one.

    An owner without stages has no row here; ``place_in_chapters`` gives it one nameless chapter.
    """
    by = by or []
    along = Window.partitionBy(*by).orderBy("start", "id")
    rows = stages.select(
        *by,
        F.col("id").cast("bigint").alias("stage_id"),
        "name",
        "kind",
        "start",
        F.lead("start").over(along).alias("end"),
        F.row_number().over(along).alias("chapter"),
    )
    opening = stages.groupBy(*by).agg(F.min("start").alias("end")).where("end is not null").select(
        *by,
        F.lit(None).cast("bigint").alias("stage_id"),
        F.lit(EARLY_YEARS).alias("name"),
        F.lit("early").alias("kind"),
        F.lit(None).cast("date").alias("start"),
        "end",
        F.lit(0).alias("chapter"),
    )
    return opening.unionByName(rows)


# Years laid out for open intervals; days outside meet the edge years.
CALENDAR_YEARS = (1900, 2100)


def _calendar_year(day: Column) -> Column:
    low, high = CALENDAR_YEARS
    return F.least(F.greatest(F.year(day), F.lit(low)), F.lit(high))


def place_in_chapters(rows: DataFrame, stages: DataFrame, day: str, by: list[str] | None = None) -> DataFrame:
    """As-of join: each row's chapter is the latest stage that started on or before its day.

    Rows and chapters meet on the calendar year; the interval decides. Owners without any
    stage get one nameless chapter.
    """
    by = by or []
    low, high = CALENDAR_YEARS
    first = F.when(F.col("chapter_start").isNull(), low).otherwise(_calendar_year(F.col("chapter_start")))
    last = F.when(F.col("chapter_end").isNull(), high).otherwise(_calendar_year(F.col("chapter_end")))
    spans = (
        chapters(stages, by)
        .withColumnsRenamed({"name": "chapter_name", "kind": "chapter_kind", "start": "chapter_start", "end": "chapter_end"})
        .withColumn("_year", F.explode(F.sequence(first, last)))
    )
    seen = F.col(day).cast("date")
    keyed = rows.withColumn("_day", seen).withColumn("_year", _calendar_year(seen))
    inside = (F.col("chapter_start").isNull() | (F.col("_day") >= F.col("chapter_start"))) & (
        F.col("chapter_end").isNull() | (F.col("_day") < F.col("chapter_end"))
    )
    same = F.col("l._year") == F.col("r._year")
    for column in by:
        same = same & F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
    picked = [c for c in spans.columns if c not in (*by, "_year")]
    return (
        keyed.alias("l")
        .join(spans.alias("r"), same & inside, "left")
        .select(
            *[F.col(f"l.{c}") for c in rows.columns],
            F.coalesce(F.col("chapter"), F.lit(0)).alias("chapter"),
            F.coalesce(F.col("chapter_kind"), F.lit("all")).alias("chapter_kind"),
            F.coalesce(F.col("chapter_name"), F.lit("")).alias("chapter_name"),
            *[F.col(c) for c in picked if c not in ("chapter", "chapter_kind", "chapter_name")],
        )
    )


def suggest_stages(
    owners: DataFrame, persons: DataFrame, occasions: DataFrame, kept: DataFrame, today: Column
) -> DataFrame:
    """Life stages (person_id, kind, name, start) of every owner with a birth date.

    Fixed offsets from the birth date, the first dated anniversary at 16 or later, and the
    first child born in adulthood. ``kept`` (person_id, kind) lists kinds the user has edited;
    stages that would start after ``today`` are left out.
    """
    base = owners.where(F.col("birth_date").isNotNull()).select(F.col("id").alias("person_id"), "birth_date")
    weddings = occasions.where((F.col("kind") == "anniversary") & F.col("year").isNotNull()).select(
        on_year(F.col("month"), F.col("day"), F.col("year")).alias("day")
    )
    base = base.withColumn("_from", add_years(F.col("birth_date"), 16))
    base = next_on_or_after(base, weddings, "_from", "day", "wedding", "person_id")
    base = base.withColumn("_from", F.coalesce("wedding", add_years(F.col("birth_date"), 18)))
    births = persons.where(F.col("birth_date").isNotNull() & ~F.col("hidden")).select(F.col("birth_date").alias("day"))
    base = next_on_or_after(base, births, "_from", "day", "first_child", "person_id")

    birth, wedding = F.col("birth_date"), F.col("wedding")
    unsettled = wedding.isNull() | (wedding > add_years(birth, 23))
    # The stages in order, with their names and offsets in years.
    plan = [
        ("childhood", "Childhood", birth),
        ("school", "School days", add_years(birth, 5)),
        ("college", "College", add_years(birth, 17)),
        ("career", "Finding my way", F.when(unsettled, add_years(birth, 22))),
        ("marriage", "Marriage", wedding),
        ("kids", "Our little ones", F.col("first_child")),
    ]
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("kind"), F.lit(n).alias("name"), s.alias("start"))
        for i, (k, n, s) in enumerate(plan)
    ]
    return (
        base.select("person_id", F.inline(F.array(*rows)))
        .where(F.col("start") <= today)
        .join(kept.select("person_id", "kind"), ["person_id", "kind"], "left_anti")
        .select("person_id", "position", "kind", "name", "start", F.lit(True).alias("suggested"))
    )


# ---------- on this day ----------

def calendar_days(day: date, reach: int) -> list[tuple[int, int]]:
    """(month, day) of the real dates around ``day``."""
    around = [day + timedelta(days=d) for d in range(-reach, reach + 1)]
    return sorted({(d.month, d.day) for d in around})


def in_calendar_days(ts: Column, days: list[tuple[int, int]]) -> Column:
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin([m * 100 + d for m, d in days])


def on_this_day(rows: DataFrame, day: date, ts: str = "taken_at", reach: int = 3) -> DataFrame:
    """Rows of the same calendar day in earlier years or, when there are none at all, of the
    days around it. Adds ``year``, ``years_ago``, ``label`` and ``span``."""
    seen = F.col(ts)
    near = rows.where((F.year(seen) < day.year) & (seen < F.lit(date(day.year, 1, 1))))
    near = near.where(in_calendar_days(seen, calendar_days(day, reach)))
    exact = in_calendar_days(seen, calendar_days(day, 0))
    any_exact = near.agg(F.coalesce(F.max(exact), F.lit(False)).alias("any")).scalar()
    n = F.lit(day.year) - F.year(seen)
    return near.where(exact | ~any_exact).select(
        "*",
        F.year(seen).alias("year"),
        n.alias("years_ago"),
        years_ago_label(n).alias("label"),
        F.when(any_exact, "day").otherwise("week").alias("span"),
    )
