"""What a caller asks of a collection: lists, details, summaries.

Lists of unbounded length stay flat rows with their group's key, in a stated order; only
lists of bounded length are nested.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import age_label, chapter_age, date_text, span_days, turns_label
from tidemark.functions.text import FESTIVAL_NAMES, FESTIVAL_NOTES, TAG_LABELS, TAG_TITLES, lookup
from tidemark.operators import browse, curation, entities, rollups
from tidemark.operators import occasions as occ
from tidemark.plans.library import Library

TOP_PEOPLE = 6
TITLE_SPAN_DAYS = 4


# ---------- items ----------

def list_media(lib: Library, include_duplicates: bool = False, newest_first: bool = True, offset: int = 0, limit: int = 200, **filters):
    """(total, page) of the library."""
    hidden = None if include_duplicates else lib.hidden()
    rows = browse.browse(lib["media"], lib["media_tags"], hidden, **filters)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total, browse.library_page(rows, lib["dup_groups"], lib["dup_members"], newest_first, offset, limit)


def duplicate_review(lib: Library, kind: str | None = None, offset: int = 0, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(counts by kind, rows): members of a page of groups, newest group first, best member first."""
    groups = lib["dup_groups"]
    chosen = groups if kind is None else groups.where(F.col("kind") == kind)
    chosen = browse.page(chosen, [F.col("taken_at").desc(), F.col("id")], offset, limit)
    chosen = chosen.select(
        F.col("id").alias("group_id"), F.col("kind").alias("group_kind"), "size", F.col("taken_at").alias("group_at"), "best_media_id"
    )
    quality = lib["quality"].select("media_id", *browse.quality_columns())
    rows = (
        lib["dup_members"]
        .join(chosen, "group_id")
        .join(lib["media"].withColumnRenamed("size", "bytes").withColumnRenamed("id", "media_id"), "media_id")
        .join(quality, "media_id", "left")
        .withColumn("is_best", F.col("media_id") == F.col("best_media_id"))
    )
    rows = rows.select(
        "group_id", "group_kind", "size", "group_at", "best_media_id", "media_id", "filename", "rel_path", "bytes",
        "is_best", F.col("pinned_best").alias("pinned"), "distance", "total",
        (F.col("is_best") & F.col("pinned_best")).alias("user_chosen"),
    )
    order = [F.col("group_at").desc(), F.col("group_id"), ~F.col("is_best"), F.coalesce("total", F.lit(0.0)).desc(), F.col("media_id")]
    return rollups.kind_counts(groups), rows.orderBy(*order)


def item_event(lib: Library) -> DataFrame:
    """(media_id, event_id, title, date_text) of every item that is in an event."""
    titles = event_summaries(lib).select(F.col("id").alias("event_id"), "title", "date_text")
    return lib["event_media"].select("media_id", "event_id").join(titles, "event_id")


def item_detail(lib: Library, ids: list[int] | None = None) -> DataFrame:
    """Everything about the given items, or all: group, quality, faces, tags and event."""
    def of(table: str, column: str = "media_id") -> DataFrame:
        return lib[table] if ids is None else lib[table].where(F.col(column).isin(ids))

    info = of("dup_members").join(lib["dup_groups"].select(F.col("id").alias("group_id"), F.col("size").alias("group_size")), "group_id")
    names = lib["persons"].select(F.col("id").alias("person_id"), F.col("name").alias("person_name"), F.col("hidden").alias("person_hidden"))
    faces = of("faces").join(names, "person_id", "left").groupBy("media_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("x", "id", "y", "w", "h", "person_id", "person_name", F.coalesce("person_hidden", F.lit(False)).alias("person_hidden"))
            )
        ).alias("faces")
    )
    tags = of("media_tags").groupBy("media_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "tag", "score"))).alias("tags")
    )
    quality = of("quality").select("media_id", F.struct(*browse.quality_columns()).alias("quality"))
    inside = Library(lib.spark, {**lib.tables, "event_media": of("event_media")}, lib.settings)
    events = item_event_of(lib, inside)
    return (
        of("media", "id")
        .withColumnRenamed("id", "media_id")
        .join(info.select("media_id", "group_id", "group_size"), "media_id", "left")
        .join(quality, "media_id", "left")
        .join(faces, "media_id", "left")
        .join(tags, "media_id", "left")
        .join(events, "media_id", "left")
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    )


def item_event_of(lib: Library, inside: Library) -> DataFrame:
    touched = inside["event_media"].select(F.col("event_id").alias("id")).distinct()
    few = lib.having(events=lib["events"].join(touched, "id", "left_semi"))
    titles = event_summaries(few).select(F.col("id").alias("event_id"), "title", "date_text")
    return inside["event_media"].select("media_id", "event_id").join(titles, "event_id")


# ---------- people ----------

def people_list(lib: Library, include_hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    stats = entities.entity_stats(lib["faces"], lib["media"], lib.hidden())
    return entities.entity_directory(lib["persons"], stats, include_hidden), entities.directory_counts(
        lib["persons"], lib["faces"], lib["media"]
    )


def person_timeline(lib: Library, person_id: int | None = None) -> DataFrame:
    """Shown items of each person, oldest first, with the age on that day; one row per item."""
    faces = lib["faces"].where(F.col("person_id").isNotNull())
    persons = lib["persons"]
    if person_id is not None:
        faces, persons = faces.where(F.col("person_id") == person_id), persons.where(F.col("id") == person_id)
    first = faces.groupBy("person_id", "media_id").agg(F.min("id").alias("face_id"))
    shown = entities.live_visible(lib["media"], lib.hidden()).select(F.col("id").alias("media_id"), "filename", "kind", "taken_at")
    births = persons.select(F.col("id").alias("person_id"), "birth_date")
    return (
        first.join(shown, "media_id")
        .join(births, "person_id")
        .withColumn("age", age_label(F.col("birth_date"), F.col("taken_at").cast("date")))
        .select("person_id", "media_id", "face_id", "filename", "kind", "taken_at", "age")
        .orderBy("person_id", "taken_at", "media_id")
    )


# ---------- events ----------

def event_occasions(lib: Library) -> DataFrame:
    """Festivals and family dates within each event; month buckets have none."""
    ranges = lib["events"].where("kind <> 'moments'").select(
        F.col("id").alias("event_id"),
        F.col("start_at").cast("date").alias("start_date"),
        F.col("end_at").cast("date").alias("end_date"),
    )
    return occ.occasion_hits(ranges, lib["festivals"], occ.recurring_dates(lib["occasions"], lib["persons"]))


def event_summaries(lib: Library) -> DataFrame:
    """One row per event: title, range, counts, leading tags and people.

    The title is the given one; "Moments · Month Year" for a month bucket; the first occasion
    for up to four days; the leading tag with the dates; or the dates.
    """
    members = lib.live_members().select("event_id", "id")
    items = lib.curation_items().select("id", "kind", "hidden_copy")
    first = event_occasions(lib).groupBy("event_id").agg(
        F.min_by("name", "rank").alias("first_occasion"), F.count(F.lit(1)).alias("occasion_count")
    )
    tags = rollups.dominant_tags(members, items, lib["media_tags"], "event_id").groupBy("event_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "tag"))),
            lambda t: F.struct(t["tag"].alias("tag"), lookup(t["tag"], TAG_LABELS).alias("label")),
        ).alias("tags")
    )
    counts = rollups.people_counts(members, items, lib["faces"], lib["persons"], "event_id")
    top = rollups.top_k_per_group(counts, ["event_id"], [F.col("n").desc(), F.col("person_id")], TOP_PEOPLE)
    names = lib["persons"].select(F.col("id").alias("person_id"), "name")
    people = top.join(names, "person_id", "left").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("person_id").alias("id"), "name", "n"))).alias("people")
    )
    kinds = rollups.media_kind_counts(members, items, "event_id")
    rows = lib["events"].withColumnRenamed("id", "event_id")
    for part in (first, tags, people, kinds):
        rows = rows.join(part, "event_id", "left")
    start, end = F.col("start_at"), F.col("end_at")
    days = span_days(start.cast("date"), end.cast("date"))
    text = date_text(start, end)
    lead = F.get("tags", 0)["tag"]
    title = (
        F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
        .when(F.col("kind") == "moments", F.concat(F.lit("Moments · "), F.date_format(start, "MMMM yyyy")))
        .when(F.col("first_occasion").isNotNull() & (days <= TITLE_SPAN_DAYS), F.col("first_occasion"))
        .when(lead.isNotNull(), F.concat_ws(" · ", lookup(lead, TAG_TITLES), text))
        .otherwise(text)
    )
    return rows.select(
        F.col("event_id").alias("id"),
        "kind",
        title.alias("title"),
        F.col("title").alias("custom_title"),
        "description",
        text.alias("date_text"),
        "start_at",
        "end_at",
        days.alias("days"),
        "locked",
        "hero_media_id",
        "hero_by_user",
        F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
        F.coalesce("video_count", F.lit(0)).alias("video_count"),
        F.coalesce("occasion_count", F.lit(0)).alias("occasion_count"),
        "tags",
        "people",
    )


def event_list(lib: Library, year: int | None = None, include_moments: bool = True, newest_first: bool = True) -> DataFrame:
    """Event summaries; events without live items are left out, unless custom."""
    events = lib["events"]
    if year:
        events = events.where(browse.in_year("start_at", year))
    if not include_moments:
        events = events.where("kind <> 'moments'")
    rows = event_summaries(lib.having(events=events))
    rows = rows.where((F.col("photo_count") + F.col("video_count") > 0) | (F.col("kind") == "custom"))
    return rows.orderBy(F.col("start_at").desc() if newest_first else F.col("start_at").asc(), "id")


def event_detail(lib: Library, event_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, curated picks in time order, all items in time order) of one event."""
    one = lib.having(
        events=lib["events"].where(F.col("id") == event_id), event_media=lib["event_media"].where(F.col("event_id") == event_id)
    )
    members, items = one.live_members(), one.curation_items()
    picks, _ = curation.curate(members, items, "event_id")
    media = members.select("id").join(one["media"], "id").select(*browse.summary_columns())
    tags = one["media_tags"].groupBy(F.col("media_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    copies = items.select("id", "hidden_copy")
    everything = media.join(copies, "id").join(tags, "id", "left").orderBy("taken_at", "id")
    return event_summaries(one), media.join(picks.select("id"), "id").orderBy("taken_at", "id"), everything


# ---------- calendar ----------

def _shown_events(lib: Library) -> DataFrame:
    """Summaries of dated events with the columns a calendar shows."""
    rows = event_summaries(lib.having(events=lib["events"].where("kind <> 'moments'")))
    return rows.select(F.col("id").alias("event_id"), "title", "kind", "date_text", "hero_media_id", "photo_count", "start_at", "end_at")


def festival_year(lib: Library, year: int | None = None) -> DataFrame:
    """Festivals (of one year) with the events that overlap them; one row per event, or one
    with nulls when there is none."""
    fests = lib["festivals"] if year is None else lib["festivals"].where(F.col("year") == year)
    fests = fests.select(
        F.col("id").alias("festival_id"),
        "festival",
        lookup(F.col("festival"), FESTIVAL_NAMES, F.col("festival")).alias("name"),
        lookup(F.col("festival"), FESTIVAL_NOTES).alias("note"),
        "year",
        "date",
        "start",
        "end",
        "user_edited",
    )
    events = _shown_events(lib)
    hits = occ.overlaps(
        fests.select("festival_id", "start", "end"), events, ("start", "end"), ("start_at", "end_at")
    ).drop("start", "end")
    return fests.join(hits, "festival_id", "left").orderBy("date", "festival_id", "start_at", "event_id")


def festival_history(lib: Library, festival: str) -> DataFrame:
    """Every year of one festival that has events."""
    rows = festival_year(lib.having(festivals=lib["festivals"].where(F.col("festival") == festival)))
    return rows.where("event_id is not null")


def occasion_history(lib: Library, month: int, day: int, first_year: int | None) -> DataFrame:
    """One recurring date across all years from ``first_year`` on, with its events."""
    events = _shown_events(lib)
    single = lib.spark.createDataFrame(
        [(month, day, first_year)], "month int, day int, first_year int"
    ).select(
        F.lit("other").alias("kind"), F.lit("asked").alias("key"), F.lit("").alias("name"), "month", "day", "first_year",
        F.lit(None).cast("bigint").alias("person_id"),
        F.struct(F.lit(0).alias("source"), F.lit(0).cast("bigint").alias("id")).alias("listed"),
    )
    ranges = events.select(
        "event_id", F.col("start_at").cast("date").alias("start_date"), F.col("end_at").cast("date").alias("end_date")
    )
    hits = occ.recurring_hits(ranges, single).select("event_id", "date", F.year("date").alias("year"))
    return hits.join(events, "event_id").orderBy("year", "start_at", "event_id")


# ---------- story ----------

def best_of_year(lib: Library, k: int = 24, year: int | None = None) -> DataFrame:
    """Diverse picks of each year (or one), in time order."""
    items = lib.curation_items().where((F.col("kind") == "photo") & F.col("has_thumb") & ~F.col("hidden_copy"))
    if year is not None:
        items = items.where(browse.in_year("ts", year))
    picks = curation.diverse_top_k(items.withColumn("year", F.year("ts")), ["year"], k)
    return picks.join(items.select("id", "ts"), "id").orderBy("year", "ts", "id")


def story_reel(lib: Library) -> DataFrame:
    """Picks of all years in time order; fewer per year when there are many years."""
    years = rollups.best_years(lib["media"], lib["quality"], lib.hidden()).select("year")
    k = years.agg(F.count(F.lit(1)).alias("n")).select(rollups.reel_size(F.col("n")).alias("k")).first()["k"]
    return best_of_year(lib, k)


def on_this_day(lib: Library, day: date, per_year: int = 8) -> tuple[DataFrame, DataFrame]:
    """(years: year, years_ago, label, span, total; picks: year, id) for a calendar day."""
    items = lib.curation_items().where(F.col("has_thumb") & ~F.col("hidden_copy")).withColumnRenamed("ts", "taken_at")
    rows = occ.on_this_day(items, day)
    years = rows.groupBy("year", "years_ago", "label", "span").agg(F.count(F.lit(1)).alias("total"))
    photos = rows.where("kind = 'photo'").withColumnRenamed("taken_at", "ts")
    picks = curation.diverse_top_k(photos, ["year"], per_year).select("year", "id")
    without = rows.join(picks.select("year").distinct(), "year", "left_anti")
    earliest = rollups.top_k_per_group(without, ["year"], [F.col("taken_at"), F.col("id")], per_year).select("year", "id")
    return years.orderBy(F.col("year").desc()), picks.unionByName(earliest)


def story(lib: Library) -> dict[str, DataFrame]:
    """The life story: span, chapters with ages, years in chapters, their events and milestones."""
    owner_id = lib.settings.story_person_id
    persons = lib["persons"]
    owner = persons.where((F.col("id") == (owner_id or 0)) & ~F.col("hidden")).select("name", "birth_date")
    birth = owner.agg(F.max("birth_date").alias("b")).select("b").scalar()
    owner_name = owner.agg(F.max("name").alias("n")).select("n").scalar()

    events = event_summaries(lib).where((F.col("photo_count") + F.col("video_count") > 0) | (F.col("kind") == "custom"))
    placed = occ.place_in_chapters(events, lib["stages"], "start_at").withColumn("year", F.year("start_at"))
    marks = occ.place_in_chapters(rollups.milestones(persons, lib["occasions"]), lib["stages"], "date")
    heroes = placed.join(lib.curation_items().select(F.col("id").alias("hero_media_id"), "hero_score"), "hero_media_id", "left")
    rank = F.when(F.col("hero_score").isNotNull(), F.struct("hero_score", -F.col("hero_media_id")))
    chapter = ["chapter", "stage_id", "chapter_name", "chapter_kind", "chapter_start", "chapter_end"]
    from_events = heroes.groupBy(*chapter, "year").agg(
        F.sum("photo_count").alias("photo_count"),
        F.max_by("hero_media_id", rank).alias("cover_media_id"),
        F.count(F.lit(1)).alias("events"),
    )
    from_marks = marks.groupBy(*chapter, "year").agg(F.count(F.lit(1)).alias("milestones"))
    both = from_events.unionByName(from_marks, allowMissingColumns=True).groupBy(*chapter, "year").agg(
        F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photo_count"),
        F.max("cover_media_id").alias("cover_media_id"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("milestones"), F.lit(0)).alias("milestones"),
    )
    years = both.withColumn("chapter_age", chapter_age(birth, F.col("chapter_start"), F.col("chapter_end"))).withColumn(
        "age", turns_label(owner_name, birth, F.col("year"))
    )
    shown = placed.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    span = rollups.collection_span(lib["media"]).select(
        "*", shown.alias("event_count"), owner_name.alias("owner_name"), birth.alias("owner_birth_date")
    )
    return {
        "span": span,
        "years": years.orderBy("chapter", "year"),
        "events": placed.orderBy("chapter", "start_at", "id"),
        "milestones": marks.orderBy("chapter", "year", "date"),
        "stages": lib["stages"].orderBy("start", "id"),
    }
