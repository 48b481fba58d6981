"""The batch that follows new results: groups, people, tags, events, one summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import face_score, total_score
from tidemark.operators import changes, entities
from tidemark.operators.duplicates import regroup_summary
from tidemark.params import JUDGE_PIXELS, RESULT_VERSION
from tidemark.plans.library import Library
from tidemark.plans.rebuild import rebuild_events, regroup, retag
from tidemark.session import cut


def to_analyse(lib: Library, models_used: str) -> DataFrame:
    return changes.stale_rows(lib["media"], lib["quality"], RESULT_VERSION, models_used)


def assemble_quality(measured: DataFrame, faces: DataFrame, judge_pixels: int = JUDGE_PIXELS) -> DataFrame:
    """Quality rows from item measurements and their sub-objects.

    The subject counts, not the background: sharpness is the larger of the item's and of the
    judged sub-objects' mean.
    """
    per_item = entities.subject_quality(measured.select(F.col("media_id").alias("id")), faces, judge_pixels)
    rows = measured.join(per_item, "media_id", "left")
    rows = rows.withColumn("face_score", face_score(F.col("eyes_open"), F.col("subject_sharpness")))
    rows = rows.withColumn("sharpness", F.greatest("sharpness", "subject_sharpness"))
    parts = {c: F.col(c) for c in ("sharpness", "exposure", "resolution", "aesthetic")}
    return rows.withColumn("total", total_score({**parts, "face": F.col("face_score")}))


def attach_results(lib: Library, quality: DataFrame, signatures: DataFrame, embeddings: DataFrame, faces: DataFrame | None) -> Library:
    """Put new results in place of old ones; people and corrections follow the boxes."""
    done = quality.select("media_id")

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(done, "media_id", "left_anti").unionByName(new.select(*old.columns))

    sig = signatures.select(F.col("media_id").alias("id"), F.col("phash").alias("_new"))
    media = lib["media"].join(sig, "id", "left").withColumn("phash", F.coalesce("_new", "phash"))
    changed = {
        "media": media.select(*lib["media"].columns),
        "quality": replaced(lib["quality"], quality),
        "embeddings": replaced(lib["embeddings"], embeddings),
    }
    if faces is not None:
        before = lib["faces"].join(done, "media_id", "left_semi")
        changed["faces"] = replaced(lib["faces"], entities.carry_over(faces, before))
    return lib.having(**changed)


def run_analysis(lib: Library, classes: DataFrame | None = None) -> tuple[Library, DataFrame]:
    """Rebuild all derived tables and report one row of counts."""
    lib = regroup(lib)
    faces, persons, people = entities.assign_entities(lib["faces"], lib["persons"], lib["dup_members"], last_id=lib.top_id("persons"))
    lib = lib.having(faces=cut(faces), persons=cut(persons))
    lib = lib.marked("persons", lib.top_id("persons"))
    if classes is not None:
        lib = retag(lib, classes)
        lib = lib.having(media_tags=cut(lib["media_tags"]))
    lib, events = rebuild_events(lib)
    dup, tagged = regroup_summary(lib["dup_groups"]), lib["media_tags"].agg(F.count_distinct("media_id").alias("tagged"))

    def one(frame: DataFrame, column: str):
        return frame.select(column).scalar().alias(column)

    summary = events.select(
        "*",
        one(dup, "groups"),
        one(dup, "hidden"),
        one(people, "assigned"),
        one(people, "new_people"),
        one(people, "unassigned"),
        one(tagged, "tagged"),
    )
    return lib, summary
