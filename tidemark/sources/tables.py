"""Library tables: schemas, loading, storing and growing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "folders": "id long, path string, enabled boolean, added_at timestamp_ntz, last_scanned_at timestamp_ntz",
    "media": (
        "id long, folder_id long, rel_path string, filename string, ext string, kind string, size long, mtime_ns long, "
        "sha256 string, width int, height int, duration_s double, orientation int, taken_at timestamp_ntz, "
        "date_source string, date_confidence string, gps_lat double, gps_lon double, camera string, phash string, "
        "pinned_best boolean, user_rotation int, has_thumb boolean, missing boolean, error string, scanned_at timestamp_ntz"
    ),
    "quality": (
        "media_id long, version int, media_mtime_ns long, sharpness_raw double, sharpness double, exposure double, "
        "resolution double, faces int, face_score double, eyes_open double, aesthetic_raw double, aesthetic double, "
        "total double, models_used string, analyzed_at timestamp_ntz"
    ),
    "embeddings": "media_id long, model string, vector array<float>",
    "dup_groups": "id long, kind string, best_media_id long, size long, taken_at timestamp_ntz",
    "dup_members": "media_id long, group_id long, distance int",
    "faces": (
        "id long, media_id long, x double, y double, w double, h double, landmarks array<array<double>>, "
        "det_score double, size_px int, quality double, eyes_open boolean, embedding array<float>, person_id long, "
        "assigned_by string, not_person_ids array<bigint>"
    ),
    "persons": "id long, name string, birth_date date, hidden boolean, cover_face_id long, created_at timestamp_ntz",
    "media_tags": "media_id long, tag string, score double",
    "events": (
        "id long, kind string, title string, description string, start_at timestamp_ntz, end_at timestamp_ntz, "
        "locked boolean, hero_media_id long, hero_by_user boolean, created_at timestamp_ntz"
    ),
    "event_media": "media_id long, event_id long, assigned_by string",
    "occasions": "id long, kind string, name string, month int, day int, year int, person_id long, created_at timestamp_ntz",
    "festivals": "id long, festival string, year int, date date, start date, end date, user_edited boolean",
    "stages": "id long, name string, start date, kind string, suggested boolean, created_at timestamp_ntz",
    "settings": "key string, value string",
    # highest id ever given out per table, so that ids of deleted rows are not used again
    "id_marks": "name string, top long",
    # what each derivation read when it last ran
    "derivations": "step string, fingerprint string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")


def store(df: DataFrame, base: str, name: str, partition_by: list[str] | None = None) -> None:
    """Replace a table in full; with partitions, only those present in ``df``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{base}/{name}")


def add_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Grow a table by columns (name -> type, default); existing columns keep their values."""
    for name, (kind, default) in defaults.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def combine_versions(frames: list[DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """Union of tables written with older and newer schemas."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.fillna(defaults) if defaults else out
