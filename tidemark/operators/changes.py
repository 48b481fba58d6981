"""Change detection between a stored snapshot and what is found now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _differs(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def classify_changes(found: DataFrame, known: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """``keys`` with status added, updated, unchanged, revived, missing or gone.

    ``known`` has a ``missing`` flag. ``missing`` rows vanished just now; ``gone`` ones were
    missing before. A revived row is unchanged, but was missing.
    """
    a, b = found.select(*keys, *compare).alias("a"), known.select(*keys, *compare, "missing").alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    here, there = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    status = (
        F.when(~there, "added")
        .when(here & _differs(compare, "a", "b"), "updated")
        .when(here & F.col("b.missing"), "revived")
        .when(here, "unchanged")
        .when(F.col("b.missing"), "gone")
        .otherwise("missing")
    )
    return a.join(b, on, "full_outer").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], status.alias("status")
    )


def reachable_roots(roots: DataFrame, only: int | None = None) -> DataFrame:
    """Ids of enabled roots that can be read now. Rows of other roots are left alone."""
    rows = roots.where(F.col("enabled") & F.col("available"))
    rows = rows if only is None else rows.where(F.col("id") == only)
    return rows.select(F.col("id").alias("folder_id"))


def unreachable_notes(roots: DataFrame) -> DataFrame:
    return roots.where(F.col("enabled") & ~F.col("available")).select(
        F.concat(F.lit("Folder not found, skipped: "), F.col("path")).alias("note")
    )


def scan_changes(found: DataFrame, media: DataFrame, roots: DataFrame, only: int | None = None) -> DataFrame:
    """Change status of every file within the reachable roots."""
    scope = reachable_roots(roots, only)
    return classify_changes(
        found.join(scope, "folder_id", "left_semi"),
        media.join(scope, "folder_id", "left_semi"),
        ["folder_id", "rel_path"],
        ["size", "mtime_ns"],
    )


def apply_scan(media: DataFrame, processed: DataFrame, changes: DataFrame) -> DataFrame:
    """The media table after a scan. ``processed`` holds complete rows, without id, of added
    and updated files. Vanished rows are flagged, never deleted; ids are never reused."""
    from tidemark.operators.edits import allocate

    keys = ["folder_id", "rel_path"]
    marks = changes.select(*keys, "status")
    old = media.join(marks, keys, "left")
    changed = old.where("status = 'updated'").select("id", *keys)
    kept = old.where("status is null or status <> 'updated'").withColumn(
        "missing", F.when(F.col("status") == "missing", True).when(F.col("status") == "revived", False).otherwise(F.col("missing"))
    )
    updated = changed.join(processed, keys)
    fresh = processed.join(marks.where("status = 'added'"), keys, "left_semi")
    top = media.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    added = allocate(fresh, [F.col(k) for k in keys], top)
    return (
        kept.select(*media.columns)
        .unionByName(updated.select(*media.columns))
        .unionByName(added.select(*media.columns))
    )


def change_counters(changes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row of job counters. Revived files count as unchanged; an added file may be an error too."""

    def n(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names)).alias(names[0])

    if errors is not None:
        keys = [c for c in changes.columns if c != "status"]
        changes = changes.join(errors.select(*keys, F.lit(True).alias("_bad")), keys, "left")
    else:
        changes = changes.withColumn("_bad", F.lit(False))
    return changes.agg(
        F.count_if(~F.col("status").isin("missing", "gone")).alias("total"),
        n("added"),
        n("updated"),
        n("unchanged", "revived"),
        n("missing"),
        F.count_if(F.coalesce("_bad", F.lit(False))).alias("errors"),
    )


def observed(changes: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The same rows, with the counters filled in by whatever action runs over them."""
    seen = Observation(name)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged", "revived", "missing")]
    return changes.observe(seen, *counts), seen


def stale_rows(media: DataFrame, quality: DataFrame, version: int, models_used: str) -> DataFrame:
    """Live photos whose result is absent or was made from another file, version or model set."""
    results = quality.select(
        F.col("media_id").alias("id"),
        "version",
        F.col("media_mtime_ns").alias("_mtime"),
        "models_used",
        F.lit(True).alias("_done"),
    )
    current = (
        F.coalesce(F.col("_done"), F.lit(False))
        & F.col("phash").isNotNull()
        & F.col("version").eqNullSafe(F.lit(version))
        & F.col("_mtime").eqNullSafe(F.col("mtime_ns"))
        & F.col("models_used").eqNullSafe(F.lit(models_used))
    )
    candidates = media.where((F.col("kind") == "photo") & ~F.col("missing") & F.col("has_thumb"))
    return candidates.join(results, "id", "left").where(~current).select(*media.columns)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change) with ADDED, REMOVED or CHANGED; no rows for identical snapshots."""
    a, b = before.select(key, *compare).alias("a"), after.select(key, *compare).alias("b")
    change = (
        F.when(F.col(f"a.{key}").isNull(), "ADDED")
        .when(F.col(f"b.{key}").isNull(), "REMOVED")
        .when(_differs(compare, "a", "b"), "CHANGED")
    )
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), change.alias("change")).where(
        "change is not null"
    )


def forget_folder(tables: dict[str, DataFrame], folder_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove a folder and everything that hangs on its items; also the number forgotten.

    Derived tables (groups, events) are rebuilt by the caller.
    """
    media = tables["media"]
    gone = media.where(F.col("folder_id") == folder_id).select(F.col("id").alias("media_id"))
    out = dict(tables)
    out["media"] = media.where(F.col("folder_id") != folder_id)
    if "folders" in out:
        out["folders"] = out["folders"].where(F.col("id") != folder_id)
    for name in ("quality", "embeddings", "faces", "media_tags", "event_media", "dup_members"):
        if name in out:
            out[name] = out[name].join(gone, "media_id", "left_anti")
    return out, gone.agg(F.count(F.lit(1)).alias("media_forgotten"))


# Columns that say when a row was written, not what it says.
BOOKKEEPING = ("scanned_at", "analyzed_at", "created_at", "added_at", "last_scanned_at")


def fingerprint(rows: DataFrame, ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """One row with a digest of a table's rows, whatever their order and partitions; equal rows count each.

    Two sums of 64-bit hashes and the number of rows, added up in each task before they meet. Columns count by name, nulls by place;
    nulls inside arrays are not told apart from their absence where the length is the same.
    """
    names = sorted(c for c in rows.columns if c not in ignore)
    values = [F.col(f"`{c}`") for c in names]
    shape = F.concat_ws(",", *[v.isNull().cast("int").cast("string") for v in values]) if values else F.lit("")

    def total(salt: int):
        return F.coalesce(F.sum(F.xxhash64(F.lit(salt), shape, *values).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")

    return rows.agg(F.sha2(F.concat_ws("|", F.lit(",".join(names)), F.count(F.lit(1)).cast("string"), total(1), total(2)), 256).alias("fingerprint"))
