"""Entities (people) built from member embeddings, stable under human corrections.

``faces``: id, media_id, quality, embedding, person_id, assigned_by, not_person_ids.
``persons``: id, name, birth_date, hidden, cover_face_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import iou
from tidemark.operators.leaders import leader_clusters
from tidemark.operators.ordering import dense_index
from tidemark.operators.vectors import centroids, nearest_class, similarity_to_own
from tidemark.params import (
    CARRY_OVER_IOU,
    LINK_THRESHOLD,
    MATCH_THRESHOLD,
    MIN_MOMENTS,
    SEED_QUALITY,
)
from tidemark.session import cut


def vector_size(rows: DataFrame, vector: str) -> int:
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return first["n"] if first else 0


def with_moment(faces: DataFrame, dup_members: DataFrame) -> DataFrame:
    """Copies of one item are a single moment: its duplicate group, else the item."""
    groups = dup_members.select("media_id", "group_id")
    moment = F.coalesce(F.concat(F.lit("g"), F.col("group_id")), F.concat(F.lit("m"), F.col("media_id")))
    return faces.join(groups, "media_id", "left").withColumn("moment", moment).drop("group_id")


def _match(faces: DataFrame, persons: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Give unassigned faces to their most similar person."""
    named = persons.select(F.col("id").alias("person_id"), F.col("name").isNotNull().alias("named"))
    classes = (
        centroids(faces, "person_id", "embedding", dim)
        .join(named, "person_id", "left")
        .select(
            F.col("person_id").alias("class_id"),
            F.col("centroid").alias("class_vector"),
            F.coalesce("named", F.lit(False)).alias("named"),
        )
    )
    loose = faces.where(F.col("person_id").isNull())
    found = nearest_class(loose, classes, threshold, "id", "embedding", forbidden="not_person_ids")
    joined = faces.join(found.select("id", "class_id"), "id", "left")
    return joined.withColumn("person_id", F.coalesce("person_id", "class_id")).drop("class_id")


def new_clusters(
    faces: DataFrame, link: float = LINK_THRESHOLD, seed_quality: float = SEED_QUALITY, min_moments: int = MIN_MOMENTS
) -> DataFrame:
    """(id, cluster, lead_quality) of new clusters of unassigned, uncorrected, good faces that
    were seen in enough distinct moments."""
    seeds = faces.where(
        F.col("person_id").isNull() & (F.col("quality") >= seed_quality) & (F.size("not_person_ids") == 0)
    )
    placed = leader_clusters(seeds, link).join(seeds.select("id", "moment", "quality"), "id")
    enough = (
        placed.groupBy("cluster")
        .agg(F.count_distinct("moment").alias("moments"), F.max("quality").alias("lead_quality"))
        .where(F.col("moments") >= min_moments)
    )
    return placed.join(enough, "cluster").select("id", "cluster", "lead_quality")


def assign_entities(
    faces: DataFrame,
    persons: DataFrame,
    dup_members: DataFrame,
    match: float = MATCH_THRESHOLD,
    link: float = LINK_THRESHOLD,
    seed_quality: float = SEED_QUALITY,
    min_moments: int = MIN_MOMENTS,
    last_id: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match to known people, cluster the rest, match again. Assigned faces never move.

    New people get ids above ``last_id`` and above all present ones. Returns (faces, persons,
    summary).
    """
    dim = vector_size(faces, "embedding")
    columns = faces.columns
    rows = with_moment(faces, dup_members)
    free = faces.where(F.col("person_id").isNull()).select("id", F.lit(True).alias("_free"))

    rows = cut(_match(rows, persons, dim, match))
    found = new_clusters(rows, link, seed_quality, min_moments)
    top = max(last_id, persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"])
    leads = dense_index(
        found.select("cluster", "lead_quality").distinct(), [F.col("lead_quality").desc(), F.col("cluster")]
    ).select("cluster", (F.lit(top) + 1 + F.col("_idx")).alias("new_id"))
    leads = cut(leads)
    rows = rows.join(found.join(leads, "cluster").select("id", "new_id"), "id", "left")
    rows = cut(rows.withColumn("person_id", F.coalesce("person_id", "new_id")).drop("new_id"))
    created = leads.select(F.col("new_id").alias("id"), F.lit(False).alias("hidden"))
    people = persons.unionByName(created, allowMissingColumns=True)
    rows = cut(_match(rows, people, dim, match))

    rows = rows.join(free, "id", "left")
    fresh = F.col("_free") & F.col("person_id").isNotNull()
    rows = rows.withColumn("assigned_by", F.when(F.coalesce(fresh, F.lit(False)), "auto").otherwise(F.col("assigned_by")))
    summary = rows.agg(
        F.count_if(fresh).alias("assigned"), F.count_if(F.col("person_id").isNull()).alias("unassigned")
    ).withColumn("new_people", F.lit(leads.count()))
    rows = rows.select(*columns)
    return rows, tidy_persons(people, rows), summary


def tidy_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Drop empty, unnamed, undated people; keep a cover that is still a member, else the best face."""
    members = faces.where(F.col("person_id").isNotNull())
    best = members.groupBy(F.col("person_id").alias("id")).agg(
        F.max_by("id", F.struct("quality", -F.col("id"))).alias("_best"), F.count(F.lit(1)).alias("_faces")
    )
    covers = members.select(F.col("id").alias("cover_face_id"), F.col("person_id").alias("_of"))
    kept = F.coalesce(F.col("_faces"), F.lit(0)) > 0
    described = (F.coalesce(F.col("name"), F.lit("")) != "") | F.col("birth_date").isNotNull()
    return (
        persons.join(best, "id", "left")
        .where(kept | described)
        .join(covers, "cover_face_id", "left")
        .withColumn("cover_face_id", F.when(F.col("_of") == F.col("id"), F.col("cover_face_id")).otherwise(F.col("_best")))
        .select(*persons.columns)
    )


def recluster_unnamed(faces: DataFrame, persons: DataFrame, dup_members: DataFrame, last_id: int = 0, **thresholds):
    """Dissolve automatic assignments to unnamed, visible people and cluster again.

    Ids of dissolved people are not used again.
    """
    last_id = max(last_id, persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"])
    unnamed = persons.where(F.col("name").isNull() & ~F.col("hidden")).select(
        F.col("id").alias("person_id"), F.lit(True).alias("_unnamed")
    )
    loosened = faces.join(unnamed, "person_id", "left")
    dissolve = F.col("_unnamed") & (F.col("assigned_by") == "auto")
    loosened = loosened.withColumn("person_id", F.when(F.coalesce(dissolve, F.lit(False)), None).otherwise(F.col("person_id")))
    loosened = cut(loosened.select(*faces.columns))
    return assign_entities(loosened, tidy_persons(persons, loosened), dup_members, last_id=last_id, **thresholds)


def likely_mistakes(faces: DataFrame, media: DataFrame, dim: int) -> DataFrame:
    """Live members with their similarity to their person's mean, least similar first."""
    live = faces.where(F.col("person_id").isNotNull()).join(
        media.where(~F.col("missing")).select(F.col("id").alias("media_id"), "taken_at", "filename"), "media_id"
    )
    means = centroids(live, "person_id", "embedding", dim, mean=True)
    return (
        similarity_to_own(live, means, "person_id", "embedding")
        .select(
            "person_id",
            "id",
            "media_id",
            "taken_at",
            "filename",
            F.round("similarity", 3).alias("similarity"),
            "assigned_by",
            "quality",
        )
        .orderBy("person_id", "similarity", "id")
    )


def carry_over(new: DataFrame, old: DataFrame, parent: str = "media_id", at_least: float = CARRY_OVER_IOU) -> DataFrame:
    """Re-extracted boxes take person and corrections from the old box they overlap most.

    An old box may serve several new ones.
    """
    kept = ["person_id", "assigned_by", "not_person_ids"]
    boxes = old.select(parent, *[F.col(c).alias(f"_{c}") for c in ("id", "x", "y", "w", "h", *kept)])
    overlap = iou(*[F.col(f"_{c}") for c in "xywh"], *[F.col(c) for c in "xywh"])
    best = (
        new.join(boxes, parent)
        .withColumn("_iou", overlap)
        .where(F.col("_iou") >= at_least)
        .groupBy("id")
        .agg(F.max_by(F.struct(*[f"_{c}" for c in kept]), F.struct("_iou", -F.col("_id"))).alias("_m"))
    )
    plain = [c for c in new.columns if c not in kept]
    return new.select(*plain).join(best, "id", "left").select(*plain, *[F.col(f"_m._{c}").alias(c) for c in kept])


def subject_quality(media: DataFrame, faces: DataFrame, judge_pixels: int) -> DataFrame:
    """Per item: number of sub-objects, share with open eyes, mean sharpness of those judged.

    Sharpness is added up in decimals: a sum of doubles depends on the order of its rows.
    """
    judged = F.col("size_px") >= judge_pixels
    sharpness = F.col("sharpness").try_cast("decimal(20,14)")
    return (
        media.select(F.col("id").alias("media_id"))
        .join(faces, "media_id", "left")
        .groupBy("media_id")
        .agg(
            F.count("id").alias("faces"),
            F.avg(F.when(judged, F.col("eyes_open").cast("double"))).alias("eyes_open"),
            F.avg(F.when(judged, sharpness)).cast("double").alias("subject_sharpness"),
        )
    )


# ---------- statistics and lists ----------

def live_visible(media: DataFrame, hidden: DataFrame) -> DataFrame:
    return media.where(~F.col("missing")).join(hidden.select(F.col("media_id").alias("id")), "id", "left_anti")


def entity_stats(faces: DataFrame, media: DataFrame, hidden: DataFrame, approximate: bool = False) -> DataFrame:
    """Faces, distinct items, first and last time per person, over live items that are shown."""
    shown = live_visible(media, hidden).select(F.col("id").alias("media_id"), "taken_at")
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return (
        faces.where(F.col("person_id").isNotNull())
        .join(shown, "media_id")
        .groupBy("person_id")
        .agg(
            F.count(F.lit(1)).alias("face_count"),
            distinct("media_id").alias("photo_count"),
            F.min("taken_at").alias("first_taken"),
            F.max("taken_at").alias("last_taken"),
        )
    )


def entity_directory(persons: DataFrame, stats: DataFrame, include_hidden: bool = False) -> DataFrame:
    """People with their stats: named ones first, then by items, then by name."""
    shown = persons if include_hidden else persons.where(~F.col("hidden"))
    return (
        shown.join(stats.withColumnRenamed("person_id", "id"), "id", "left")
        .select(
            "id",
            "name",
            "birth_date",
            "hidden",
            "cover_face_id",
            F.coalesce("face_count", F.lit(0)).alias("face_count"),
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
            "first_taken",
            "last_taken",
        )
        .orderBy(F.col("name").isNull(), F.col("photo_count").desc(), F.coalesce("name", F.lit("")), "id")
    )


def directory_counts(persons: DataFrame, faces: DataFrame, media: DataFrame) -> DataFrame:
    """One row: unassigned faces of live items, and hidden people."""
    live = media.where(~F.col("missing")).select(F.col("id").alias("media_id"))
    loose = faces.where(F.col("person_id").isNull()).join(live, "media_id", "left_semi")
    counted = loose.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unassigned_faces").alias("what"), "n")
    hidden = persons.agg(F.count_if("hidden").alias("n")).select(F.lit("hidden_people").alias("what"), "n")
    return counted.unionByName(hidden)


def review_queue(faces: DataFrame, media: DataFrame, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(total, page) of unassigned faces of live items, best quality first."""
    live = media.where(~F.col("missing")).select(F.col("id").alias("media_id"), "taken_at", "filename")
    rows = faces.where(F.col("person_id").isNull()).join(live, "media_id")
    rows = rows.select("id", "media_id", "taken_at", "filename", "quality", "size_px")
    page = rows.orderBy(F.col("quality").desc(), "id").offset(offset)
    return rows.agg(F.count(F.lit(1)).alias("total")), page if limit is None else page.limit(limit)


def first_per_item(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """First row per key in the given order, by partial aggregation instead of a window."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}") for c in columns])
