"""Filtering, paging and the flat projections of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(media: DataFrame, thumb: bool = False, clean: bool = False) -> DataFrame:
    rows = media.where(~F.col("missing"))
    if thumb:
        rows = rows.where("has_thumb")
    return rows.where(F.col("error").isNull()) if clean else rows


def hide_copies(media: DataFrame, hidden: DataFrame) -> DataFrame:
    return media.join(hidden.select(F.col("media_id").alias("id")), "id", "left_anti")


def in_year(ts: str, year: int) -> Column:
    """A range predicate, so that Parquet statistics can skip files."""
    return (F.col(ts) >= F.lit(f"{year:04d}-01-01 00:00:00")) & (F.col(ts) < F.lit(f"{year + 1:04d}-01-01 00:00:00"))


def browse(
    media: DataFrame,
    tags: DataFrame | None = None,
    hidden: DataFrame | None = None,
    kind: str | None = None,
    date_source: str | None = None,
    year: int | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Live items that pass every given filter; ``hidden`` leaves out lesser copies."""
    rows = live(media)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if date_source:
        rows = rows.where(F.col("date_source") == date_source)
    if year:
        rows = rows.where(in_year("taken_at", year))
    if tag:
        tagged = tags.where(F.col("tag") == tag).select(F.col("media_id").alias("id"))
        rows = rows.join(tagged, "id", "left_semi")
    return rows if hidden is None else hide_copies(rows, hidden)


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 200) -> DataFrame:
    """One page in a total order (a top-k of offset + limit rows, never a full sort)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def library_page(
    rows: DataFrame, groups: DataFrame, members: DataFrame, newest_first: bool = True, offset: int = 0, limit: int = 200
) -> DataFrame:
    """A page of items with the id and size of their duplicate group (size 1 without one)."""
    when = F.col("taken_at").desc() if newest_first else F.col("taken_at").asc()
    info = members.join(groups.select(F.col("id").alias("group_id"), "size"), "group_id").select(
        F.col("media_id").alias("id"), "group_id", F.col("size").alias("group_size")
    )
    shown = page(rows, [when, F.col("id")], offset, limit)
    joined = shown.join(info, "id", "left").withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    return joined.select(*summary_columns(), "group_id", "group_size").orderBy(when, "id")


def summary_columns() -> list[Column]:
    names = ["id", "filename", "kind", "taken_at", "date_source", "date_confidence", "width", "height", "duration_s", "has_thumb"]
    return [*map(F.col, names), F.col("user_rotation").alias("rotation"), F.col("error")]


def quality_columns() -> list[Column]:
    return [
        F.col("total"),
        F.round("sharpness", 3).alias("sharpness"),
        F.round("exposure", 3).alias("exposure"),
        F.round("resolution", 3).alias("resolution"),
        F.col("faces"),
        F.col("face_score"),
        F.col("eyes_open"),
        F.col("aesthetic"),
        F.round("aesthetic_raw", 2).alias("aesthetic_raw"),
    ]
