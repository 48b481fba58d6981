"""Counts, covers and per-group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def library_stats(media: DataFrame) -> DataFrame:
    """Counts per kind, per date source, per year and in total over live items, in one pass.

    ``facet`` names the grouping, ``value`` its key.
    """
    live = media.where(~F.col("missing")).select(
        "kind", "date_source", F.year("taken_at").cast("string").alias("year"), F.col("error").isNotNull().alias("bad")
    )
    grouped = live.groupingSets(
        [[F.col("kind")], [F.col("date_source")], [F.col("year")], []],
        F.col("kind"),
        F.col("date_source"),
        F.col("year"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("with_errors"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "date_source").when(F.col("g") == 6, "year").otherwise("total")
    return grouped.select(facet.alias("facet"), F.coalesce("kind", "date_source", "year").alias("value"), "n", "with_errors")


def library_totals(media: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: photos, videos, total, with_errors, missing, duplicate_groups, hidden_duplicates."""
    live = ~F.col("missing")
    counts = media.agg(
        F.count_if(live).alias("total"),
        F.count_if(live & (F.col("kind") == "photo")).alias("photos"),
        F.count_if(live & (F.col("kind") == "video")).alias("videos"),
        F.count_if(live & F.col("error").isNotNull()).alias("with_errors"),
        F.count_if("missing").alias("missing"),
    )
    dup = groups.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("h")
    )
    return counts.select(
        "*",
        dup.select("n").scalar().alias("duplicate_groups"),
        dup.select("h").scalar().alias("hidden_duplicates"),
    )


def folder_counts(folders: DataFrame, media: DataFrame) -> DataFrame:
    counts = media.where(~F.col("missing")).groupBy(F.col("folder_id").alias("id")).agg(
        F.count(F.lit(1)).alias("media_count")
    )
    return folders.join(counts, "id", "left").withColumn("media_count", F.coalesce("media_count", F.lit(0)))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def media_kind_counts(members: DataFrame, items: DataFrame, group: str) -> DataFrame:
    return (
        members.select(group, "id")
        .join(items.select("id", "kind"), "id")
        .groupBy(group)
        .agg(
            F.count_if(F.col("kind") == "photo").alias("photo_count"),
            F.count_if(F.col("kind") == "video").alias("video_count"),
        )
    )


def dominant_tags(members: DataFrame, items: DataFrame, tags: DataFrame, group: str, share: float = 0.3) -> DataFrame:
    """(group, tag, n): tags on at least ``share`` of a group's visible photos (and on one)."""
    photos = members.select(group, "id").join(
        items.where((F.col("kind") == "photo") & ~F.col("hidden_copy")).select("id"), "id"
    )
    sizes = photos.groupBy(group).agg(F.count(F.lit(1)).alias("_photos"))
    counts = photos.join(tags.select(F.col("media_id").alias("id"), "tag"), "id").groupBy(group, "tag").agg(
        F.count(F.lit(1)).alias("n")
    )
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_photos")))
    return counts.join(sizes, group).where(F.col("n") >= need).select(group, "tag", "n")


def top_k_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; the window group limit drops the rest before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def people_counts(members: DataFrame, items: DataFrame, faces: DataFrame, persons: DataFrame, group: str) -> DataFrame:
    """(group, person_id, n): items with each visible person, copies left out."""
    shown = members.select(group, "id").join(items.where(~F.col("hidden_copy")).select("id"), "id")
    seen = (
        faces.join(persons.where(~F.col("hidden")).select(F.col("id").alias("person_id")), "person_id")
        .select(F.col("media_id").alias("id"), "person_id")
        .distinct()
    )
    return shown.join(seen, "id").groupBy(group, "person_id").agg(F.count(F.lit(1)).alias("n"))


def best_years(media: DataFrame, quality: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible photos per year with the best rated one as cover, newest year first."""
    shown = media.where(~F.col("missing") & (F.col("kind") == "photo")).join(
        hidden.select(F.col("media_id").alias("id")), "id", "left_anti"
    )
    rated = shown.join(quality.select(F.col("media_id").alias("id"), "total"), "id", "left")
    rank = F.when(F.col("total").isNotNull(), F.struct("total", -F.col("id")))
    return (
        rated.groupBy(F.year("taken_at").alias("year"))
        .agg(F.count(F.lit(1)).alias("photo_count"), F.max_by("id", rank).alias("cover_media_id"))
        .orderBy(F.col("year").desc())
    )


def collection_span(media: DataFrame) -> DataFrame:
    live = ~F.col("missing")
    return media.agg(
        F.min(F.when(live, F.col("taken_at"))).alias("first"),
        F.max(F.when(live, F.col("taken_at"))).alias("last"),
        F.count_if(live & (F.col("kind") == "photo")).alias("photo_count"),
    )


def milestones(persons: DataFrame, occasions: DataFrame) -> DataFrame:
    """Births of named visible people and dated anniversaries: year, date, label, kind, person."""
    from tidemark.functions.dates import on_year

    births = persons.where(F.col("birth_date").isNotNull() & F.col("name").isNotNull() & ~F.col("hidden")).select(
        F.year("birth_date").alias("year"),
        F.col("birth_date").alias("date"),
        F.concat("name", F.lit(" was born")).alias("label"),
        F.lit("birth").alias("kind"),
        F.col("id").alias("person_id"),
    )
    weddings = occasions.where((F.col("kind") == "anniversary") & F.col("year").isNotNull()).select(
        F.col("year").cast("int").alias("year"),
        on_year(F.col("month"), F.col("day"), F.col("year")).alias("date"),
        F.concat("name", F.lit(": wedding day")).alias("label"),
        F.lit("wedding").alias("kind"),
        F.lit(None).cast("bigint").alias("person_id"),
    )
    return births.unionByName(weddings)


def runs_by_month(rows: DataFrame, ts: str = "taken_at", key: str = "id", newest_first: bool = True) -> DataFrame:
    """Month headers of a time-ordered list: month, label, number and range of its items."""
    month = F.date_trunc("month", ts)
    out = rows.groupBy(month.alias("month")).agg(
        F.date_format(F.first(month), "MMMM yyyy").alias("label"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(key, F.struct(ts, key)).alias("first_id"),
        F.max_by(key, F.struct(ts, key)).alias("last_id"),
    )
    return out.orderBy(F.col("month").desc() if newest_first else F.col("month"))


def runs_by_year(rows: DataFrame, ts: str = "taken_at", key: str = "id") -> DataFrame:
    return rows.groupBy(F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(key, F.struct(ts, key)).alias("first_id"),
        F.max_by(key, F.struct(ts, key)).alias("last_id"),
    )


def distinct_years(rows: DataFrame, *columns: str) -> DataFrame:
    """Years that appear in any of the columns, newest first."""
    years = F.explode(F.array(*[F.year(c) for c in columns]))
    return rows.select(years.alias("year")).where("year is not null").distinct().orderBy(F.col("year").desc())


def reel_size(years: Column) -> Column:
    """Picks per year in a story reel: fewer when there are many years."""
    return F.when(years > 15, 5).when(years > 6, 8).otherwise(12)
