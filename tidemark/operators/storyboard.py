"""A timeline of cards, slides, pairs and clips from a time-ordered collection (table only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import long_date, pair_caption
from tidemark.operators.ordering import carried_last, dense_index, running
from tidemark.session import cut

# Seconds per segment kind and the length of a crossfade.
FADE_S = 0.9
TITLE_S = 4.5
YEAR_S = 2.8
PHOTO_S = 4.2
PAIR_S = 4.8
END_S = 4.0
CLIP_MAX_S = 6.0


def slides(items: DataFrame, ts: str = "taken_at", key: str = "id") -> DataFrame:
    """One row per slide or clip: ``at`` (position of its first item), kind, items, caption.

    Consecutive portrait photos of one year are shown two by two: (1, 2), (3, 4), ...; an odd
    one stays single and a clip ends the run. Runs are found along a dense index, and a slide
    is at most two rows.
    """
    portrait = (F.col("kind") == "photo") & (
        F.coalesce("height", F.lit(0)) > F.coalesce("width", F.lit(0))
    )
    rows = items.select(
        key, ts, "kind", portrait.alias("portrait"), F.year(ts).alias("year"), F.col("duration_s").alias("duration_s")
    )
    rows = cut(dense_index(rows, [F.col(ts), F.col(key)]))
    rows = carried_last(rows, F.struct("portrait", "year"), "_before")
    continues = F.col("portrait") & F.coalesce(F.col("_before.portrait"), F.lit(False)) & (F.col("_before.year") == F.col("year"))
    start = F.when(~F.coalesce(continues, F.lit(False)), F.col("_idx"))
    rows = carried_last(rows, start, "_run", inclusive=True)
    step = F.col("_idx") - F.col("_run")
    at = F.when(F.col("portrait"), F.col("_run") + step - step % 2).otherwise(F.col("_idx"))
    return (
        rows.withColumn("at", at)
        .groupBy("at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(key, "_idx").alias("first_id"),
            F.max_by(key, "_idx").alias("last_id"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.first("year").alias("year"),
            F.first("kind").alias("media"),
            F.first("duration_s").alias("duration_s"),
        )
        .select(
            "at",
            F.when(F.col("media") == "video", "clip").when(F.col("n") == 2, "pair").otherwise("slide").alias("segment"),
            "first_id",
            F.when(F.col("n") == 2, F.col("last_id")).alias("second_id"),
            "year",
            F.when(F.col("n") == 2, pair_caption(F.col("first_ts"), F.col("last_ts")))
            .otherwise(long_date(F.col("first_ts")))
            .alias("caption"),
            F.when(
                F.col("media") == "video",
                F.least(F.lit(CLIP_MAX_S), F.coalesce(F.nullif("duration_s", F.lit(0.0)), F.lit(CLIP_MAX_S))),
            )
            .when(F.col("n") == 2, PAIR_S)
            .otherwise(PHOTO_S)
            .alias("duration"),
        )
    )


def year_counts(items: DataFrame, ts: str = "taken_at") -> DataFrame:
    return items.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("moments"))


def storyboard(items: DataFrame, ts: str = "taken_at", key: str = "id") -> DataFrame:
    """Title card, a card per year, slides and clips, end card; each starts one fade early.

    Cards name their background: the first photo of all, of the year, or the last photo.
    """
    shown = cut(slides(items, ts, key))
    photo = F.col("kind") == "photo"
    per_year = items.groupBy(F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("moments"),
        F.min_by(F.when(photo, F.col(key)), F.when(photo, F.struct(ts, key))).alias("first_id"),
        F.max_by(F.when(photo, F.col(key)), F.when(photo, F.struct(ts, key))).alias("last_photo"),
        F.max(F.when(photo, F.struct(ts, key))).alias("_late"),
        F.min(F.when(photo, F.struct(ts, key))).alias("_early"),
    )
    noun = F.when(F.col("moments") == 1, " moment").otherwise(" moments")
    cards = per_year.join(shown.groupBy("year").agg(F.min("at").alias("at")), "year").select(
        "at",
        F.lit(0).alias("layer"),
        F.lit("year").alias("segment"),
        "first_id",
        F.lit(None).cast("bigint").alias("second_id"),
        "year",
        F.concat(F.col("moments").cast("string"), noun).alias("caption"),
        F.lit(YEAR_S).alias("duration"),
    )
    span = F.concat_ws(" – ", F.min("year").cast("string"), F.when(F.min("year") != F.max("year"), F.max("year").cast("string")))
    whole = per_year.agg(
        F.sum("moments").alias("moments"),
        F.min_by("first_id", "_early").alias("first_photo"),
        F.max_by("last_photo", "_late").alias("last_photo"),
        span.alias("span"),
    )
    last = F.lit((1 << 62) - 1)
    ends = whole.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(-1).cast("bigint").alias("at"),
                    F.lit(0).alias("layer"),
                    F.lit("title").alias("segment"),
                    F.col("first_photo").alias("first_id"),
                    F.concat(F.col("span"), F.lit(" · "), F.col("moments").cast("string"), F.lit(" moments")).alias("caption"),
                    F.lit(TITLE_S).alias("duration"),
                ),
                F.struct(
                    last.alias("at"),
                    F.lit(0).alias("layer"),
                    F.lit("end").alias("segment"),
                    F.col("last_photo").alias("first_id"),
                    F.lit(None).cast("string").alias("caption"),
                    F.lit(END_S).alias("duration"),
                ),
            )
        )
    )
    parts = (
        shown.withColumn("layer", F.lit(1))
        .unionByName(cards)
        .unionByName(ends, allowMissingColumns=True)
    )
    parts = dense_index(parts, [F.col("at"), F.col("layer")], "position")
    parts = cut(parts)
    timed = running(parts, F.col("duration") - FADE_S, "start", inclusive=False, index="position")
    return timed.select("position", "segment", "first_id", "second_id", "year", "caption", "duration", F.round("start", 3).alias("start"))
