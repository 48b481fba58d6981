"""Rebuilding the derived tables: duplicate groups, tags and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import curation, duplicates, sessions
from tidemark.operators.edits import allocate, highest_id
from tidemark.operators.occasions import on_any_occasion, recurring_dates
from tidemark.operators.vectors import zero_shot_tags
from tidemark.params import Settings
from tidemark.plans.library import Library
from tidemark.session import cut

# Which derived tables a change asks for.
DEPENDENTS = {
    "near_dup_threshold": ("duplicates", "events"),
    "burst_threshold": ("duplicates", "events"),
    "burst_enabled": ("duplicates", "events"),
    "event_gap_hours": ("duplicates", "events"),
    "event_gps_km": ("duplicates", "events"),
    "event_min_photos": ("duplicates", "events"),
    "tag_threshold": ("duplicates", "tags", "events"),
    "occasions": ("events",),
    "festivals": ("events",),
    "persons": ("events",),
    "pins": ("heroes",),
}


def regroup(lib: Library) -> Library:
    items = cut(duplicates.duplicate_items(lib["media"], lib["quality"]))
    groups, members = duplicates.duplicate_groups(items, lib.settings)
    return lib.having(dup_groups=cut(groups), dup_members=cut(members))


def retag(lib: Library, classes: DataFrame) -> Library:
    tags = zero_shot_tags(lib["embeddings"], classes, lib.settings.tag_threshold)
    return lib.having(media_tags=tags)


def choose_best(lib: Library, pins: DataFrame) -> tuple[Library, DataFrame]:
    """Apply pins to groups: new best and distances, then heroes. Also the rejected pins."""
    from tidemark.operators.edits import pin_best

    media, rejected = pin_best(lib["media"], lib["dup_members"], pins)
    items = duplicates.duplicate_items(media, lib["quality"])
    members = lib["dup_members"].select(F.col("media_id").alias("id"), "group_id")
    kinds = lib["dup_groups"].select(F.col("id").alias("group_id"), "kind")
    groups = duplicates.best_members(members, items).join(kinds, "group_id")
    groups = cut(groups.select(F.col("group_id").alias("id"), "kind", "best_media_id", "size", "taken_at"))
    lib = lib.having(media=media, dup_groups=groups, dup_members=duplicates.with_distance(members, groups, items))
    return refresh_heroes(lib), rejected


# ---------- events ----------

def fit_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Fit each event's range to its live members (event_id, id, taken_at).

    A locked custom event only widens. Empty events go, unless custom.
    """
    range_of = members.groupBy(F.col("event_id").alias("id")).agg(
        F.min("taken_at").alias("_first"), F.max("taken_at").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    widen = F.col("locked") & (F.col("kind") == "custom")
    has = F.col("_n").isNotNull()
    fitted = events.join(range_of, "id", "left").where(has | (F.col("kind") == "custom"))
    return (
        fitted.withColumn(
            "start_at",
            F.when(has & widen, F.least("start_at", "_first")).when(has, F.col("_first")).otherwise(F.col("start_at")),
        )
        .withColumn(
            "end_at",
            F.when(has & widen, F.greatest("end_at", "_last")).when(has, F.col("_last")).otherwise(F.col("end_at")),
        )
        .select(*events.columns)
    )


def pick_heroes(events: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Automatic heroes; a hero chosen by hand stays while it is a live member."""
    own = members.select(F.col("event_id").alias("id"), F.col("id").alias("hero_media_id"), F.lit(True).alias("_in"))
    checked = events.join(own, ["id", "hero_media_id"], "left")
    checked = checked.withColumn("hero_by_user", F.coalesce("hero_by_user", F.lit(False)) & F.coalesce("_in", F.lit(False)))
    open_events = checked.where(~F.col("hero_by_user")).select(F.col("id").alias("event_id"))
    _, heroes = curation.curate(members.join(open_events, "event_id", "left_semi"), items, "event_id")
    heroes = heroes.select(F.col("event_id").alias("id"), F.col("hero_id").alias("_hero"))
    out = checked.join(heroes, "id", "left").withColumn(
        "hero_media_id", F.when(F.col("hero_by_user"), F.col("hero_media_id")).otherwise(F.col("_hero"))
    )
    return out.select(*events.columns)


def refresh_events(lib: Library, members: DataFrame | None = None) -> Library:
    """``members``: the live members (event_id, id, taken_at), where they are at hand."""
    members = cut(lib.live_members()) if members is None else members
    fitted = cut(fit_events(lib["events"], members))
    return lib.having(events=pick_heroes(fitted, members, lib.curation_items()))


def refresh_heroes(lib: Library) -> Library:
    members = lib.live_members()
    return lib.having(events=pick_heroes(lib["events"], members, lib.curation_items()))


def place_items(lib: Library, by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sticky, absorbed, placed): items held by hand or by locked events, items inside a
    locked window, and the regrouped rest as (id, kind, group_id). All have their ``taken_at``.

    ``by`` optionally names owner columns of ``media`` whose items are never mixed.
    """
    by = by or []
    s: Settings = lib.settings
    live = lib["media"].where("not missing").select("id", "taken_at", "gps_lat", "gps_lon", *by)
    events = lib["events"]
    locked = events.where("locked")
    member_of = lib["event_media"].join(events.select(F.col("id").alias("event_id"), "locked"), "event_id")
    sticky = member_of.where((F.col("assigned_by") == "user") | F.col("locked")).select("media_id", "event_id", "assigned_by")
    sticky = sticky.join(live.select(F.col("id").alias("media_id"), "taken_at"), "media_id")
    rest = live.join(sticky.select(F.col("media_id").alias("id")), "id", "left_anti")
    windows = locked.select(F.col("id").alias("event_id"), "start_at", "end_at")
    if by:
        # a locked event belongs to the owners of its items
        owners = lib["event_media"].join(lib["media"].select(F.col("id").alias("media_id"), *by), "media_id").select("event_id", *by).distinct()
        windows = windows.join(owners, "event_id")
    absorbed = sessions.absorb(rest, windows, by=by, timed=True)
    absorbed = cut(absorbed)
    free = rest.join(absorbed.select("id"), "id", "left_anti")

    keys = [*by, "session", "place"]
    clustered = cut(sessions.split_clusters(free, s.event_gap_hours, s.event_gps_km, by, whole=False))
    spans = cut(sessions.cluster_spans(clustered, keys))
    small = spans.where(F.col("size") < s.event_min_photos).select(
        "cluster", F.col("start_at").cast("date").alias("start_date"), F.col("end_at").cast("date").alias("end_date")
    )
    recurring = recurring_dates(lib["occasions"], lib["persons"])
    special = on_any_occasion(small, lib["festivals"], recurring, key="cluster")
    placed = sessions.roll_up_small(clustered, spans, keys, s.event_min_photos, special, by, timed=True)
    return sticky, absorbed, cut(placed)


def rebuild_events(lib: Library, by: list[str] | None = None) -> tuple[Library, DataFrame]:
    """Regroup everything that no one placed by hand, keeping ids of events that persist.

    Returns the library with new events and memberships, and a one-row summary.
    """
    sticky, absorbed, placed = place_items(lib, by)
    events = lib["events"]
    groups = placed.groupBy("group_id", "kind").agg(
        F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at")
    )
    position = F.struct(
        F.when(F.col("kind") == "moments", 1).otherwise(0).alias("late"), F.col("start_at"), F.col("group_id")
    )
    groups = cut(groups.withColumn("position", position))
    open_events = events.where("not locked")
    old = lib["event_media"].join(open_events.select(F.col("id").alias("event_id"), "kind"), "event_id")
    old = old.select(F.col("media_id").alias("id"), "event_id", "kind")
    reused = sessions.reuse_ids(groups.select("group_id", "kind", "position"), placed.select("id", "group_id"), old)
    top = lib.top_id("events")
    fresh = allocate(groups.join(reused, "group_id", "left_anti"), [F.col("position")], top, "event_id")
    ids = cut(reused.unionByName(fresh.select("group_id", "event_id")))

    auto = F.lit("auto").alias("assigned_by")
    membership = (
        sticky.select("media_id", "event_id", "assigned_by", "taken_at")
        .unionByName(absorbed.select(F.col("id").alias("media_id"), "event_id", auto, "taken_at"))
        .unionByName(placed.join(ids, "group_id").select(F.col("id").alias("media_id"), "event_id", auto, "taken_at"))
    )
    kept = events.where(F.col("locked") | (F.col("kind") == "custom")).unionByName(
        open_events.where("kind <> 'custom'").join(reused.select(F.col("event_id").alias("id")), "id", "left_semi")
    )
    created = fresh.select(
        F.col("event_id").alias("id"), "kind", "start_at", "end_at", F.lit(False).alias("locked"), F.lit(False).alias("hero_by_user")
    )
    membership = cut(membership)
    lib = lib.having(event_media=membership.drop("taken_at"), events=kept.unionByName(created, allowMissingColumns=True))
    # all of them are live, so they need not meet the items again
    out = refresh_events(lib, membership.select("event_id", F.col("media_id").alias("id"), "taken_at"))
    out = out.having(events=cut(out["events"]))
    out = out.marked("events", max(top, highest_id(out["events"])))
    old_ids = events.select("id", "locked")
    summary = out["events"].join(old_ids.select("id", F.lit(True).alias("_old")), "id", "left").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("_old").isNull()).alias("created")
    )
    gone = open_events.where("kind <> 'custom'").join(reused.select(F.col("event_id").alias("id")), "id", "left_anti")
    summary = summary.select(
        "*",
        gone.agg(F.count(F.lit(1)).alias("n")).select("n").scalar().alias("removed"),
        old_ids.agg(F.count_if("locked").alias("n")).select("n").scalar().alias("kept_edited"),
    )
    return out, summary


def recompute(lib: Library, changed: list[str], classes: DataFrame | None = None) -> Library:
    """Rebuild exactly the derived tables that depend on what changed."""
    wanted = {t for name in changed for t in DEPENDENTS[name]}
    if "duplicates" in wanted:
        lib = regroup(lib)
    if "tags" in wanted and classes is not None:
        lib = retag(lib, classes)
    if "events" in wanted:
        lib, _ = rebuild_events(lib)
    elif "heroes" in wanted:
        lib = refresh_heroes(lib)
    return lib


def forget(lib: Library, folder_id: int) -> tuple[Library, DataFrame]:
    """Forget a folder, then rebuild what was derived from its items."""
    from tidemark.operators.changes import forget_folder
    from tidemark.operators.entities import tidy_persons

    left, count = forget_folder({name: lib[name] for name in lib.tables}, folder_id)
    lib = regroup(Library(lib.spark, left, lib.settings))
    lib = lib.having(persons=tidy_persons(lib["persons"], lib["faces"]))
    return rebuild_events(lib)[0], count
