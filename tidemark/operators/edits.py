"""Human corrections applied in bulk from edit logs.

Each function takes current tables and a log, and returns new tables; the caller writes them
out. Logs carry ``ts`` where the order of edits matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_index
from tidemark.operators.sessions import absorb
from tidemark.session import cut


def allocate(rows: DataFrame, order: list[Column], top: int, name: str = "id") -> DataFrame:
    """Give new rows the ids after ``top`` in a fixed order; ids are never reused."""
    return dense_index(rows, order, "_new").withColumn(name, F.lit(top) + 1 + F.col("_new")).drop("_new")


def highest_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]


# ---------- last write wins ----------

def overlay(table: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Patch, insert and delete rows by key. ``edits``: ts, key, op, field, value (text).

    ``op`` is set, insert or delete. The latest value per field wins, also when it is null; a
    key is deleted when its latest insert or delete is a delete. Inserted rows start empty.
    """
    types = {f.name: f.dataType for f in table.schema}
    is_set = F.col("op") == "set"
    latest = [
        F.max_by(F.struct("value"), F.when(is_set & (F.col("field") == f), F.col("ts"))).alias(f"_{f}") for f in fields
    ]
    life = F.max_by("op", F.when(F.col("op") != "set", F.col("ts"))).alias("_life")
    per_key = edits.groupBy(key).agg(*latest, life)
    joined = table.withColumn("_old", F.lit(True)).join(per_key, key, "full_outer")
    alive = F.coalesce(F.col("_old"), F.lit(False)) | (F.col("_life") == "insert")
    deleted = F.coalesce(F.col("_life") == "delete", F.lit(False))

    def patched(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        new = F.col(f"_{c}")
        return F.when(new.isNotNull(), new["value"].cast(types[c])).otherwise(F.col(c)).alias(c)

    return joined.where(F.coalesce(alive, F.lit(False)) & ~deleted).select(*[patched(c) for c in table.columns])


def overlay_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, value): defaults overridden by stored JSON values; unknown stored keys are ignored."""
    own = stored.select("key", F.col("value").alias("_stored"))
    return defaults.join(own, "key", "left").select("key", F.coalesce("_stored", "value").alias("value"))


def parse_setting(value: Column, type_name: str) -> Column:
    """Typed value of a JSON scalar; JSON null becomes null."""
    if type_name == "string":
        return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    return F.nullif(value, F.lit("null")).try_cast(type_name)


# ---------- entities ----------

def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(source, target, root, depth, entered): final target of each merge, by pointer doubling."""
    state = cut(
        aliases.where("source <> target").select(
            "source", "target", F.col("target").alias("root"), F.lit(1).alias("depth"), "ts", F.col("ts").alias("entered")
        )
    )
    while True:
        hop = state.select(
            F.col("source").alias("root"),
            F.col("root").alias("_root"),
            F.col("depth").alias("_depth"),
            F.col("entered").alias("_entered"),
        )
        joined = state.join(hop, "root", "left")
        moved = F.col("_root").isNotNull()
        state = cut(
            joined.select(
                "source",
                "target",
                F.coalesce("_root", "root").alias("root"),
                F.when(moved, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
                "ts",
                F.when(moved, F.col("_entered")).otherwise(F.col("entered")).alias("entered"),
                moved.alias("_moved"),
            )
        )
        if state.where("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")


def merge_entities(faces: DataFrame, persons: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, persons) after ``merges`` (ts, source, target).

    The target keeps its own name and birth date, or takes the first one of what was merged
    into it. "Not the source" becomes "not the target".
    """
    from tidemark.operators.entities import tidy_persons

    alias = resolve_aliases(merges)
    roots = alias.select(F.col("source").alias("person_id"), F.col("root"))
    moved = faces.join(roots, "person_id", "left").withColumn("person_id", F.coalesce("root", "person_id")).drop("root")
    refusals = faces.where(F.size("not_person_ids") > 0).select("id", F.explode("not_person_ids").alias("person_id"))
    rewritten = refusals.join(roots, "person_id", "left").groupBy("id").agg(
        F.array_sort(F.collect_set(F.coalesce("root", "person_id"))).alias("_not")
    )
    moved = moved.join(rewritten, "id", "left").withColumn("not_person_ids", F.coalesce("_not", "not_person_ids"))
    moved = moved.select(*faces.columns)

    chain = persons.join(alias.select(F.col("source").alias("id"), "root", "entered", "depth", "ts"), "id", "left")
    rank = F.struct(F.col("entered").isNotNull().alias("_late"), "entered", "depth", "ts", "id")
    name = F.nullif("name", F.lit(""))
    merged = chain.groupBy(F.coalesce("root", "id").alias("id")).agg(
        F.min_by(name, F.when(name.isNotNull(), rank)).alias("_name"),
        F.min_by("birth_date", F.when(F.col("birth_date").isNotNull(), rank)).alias("_birth"),
    )
    kept = persons.join(alias.select(F.col("source").alias("id")), "id", "left_anti").join(merged, "id", "left")
    kept = kept.withColumn("name", F.coalesce("_name", "name")).withColumn("birth_date", F.col("_birth"))
    kept = kept.select(*persons.columns)
    return moved, tidy_persons(kept, moved)


def reassign_members(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """Faces after ``edits`` (ts, id, person_id): to a person by hand, or away from the present one.

    The edits of one face are folded in order. Being sent away is remembered; being placed by
    hand is a confirmation.
    """
    log = edits.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ts", F.col("person_id").cast("bigint").alias("person_id")))).alias("_log")
    )
    start = F.struct(
        F.col("person_id").cast("bigint").alias("person_id"),
        F.col("assigned_by").alias("assigned_by"),
        F.coalesce("not_person_ids", F.array().cast("array<bigint>")).alias("not_ids"),
    )

    def step(acc: Column, edit: Column) -> Column:
        to = edit["person_id"]
        away = F.when(
            acc["person_id"].isNotNull(), F.array_sort(F.array_union(acc["not_ids"], F.array(acc["person_id"])))
        ).otherwise(acc["not_ids"])
        return F.struct(
            to.alias("person_id"),
            F.when(to.isNull(), "auto").otherwise("user").alias("assigned_by"),
            F.when(to.isNull(), away).otherwise(F.array_sort(F.array_remove(acc["not_ids"], to))).alias("not_ids"),
        )

    done = faces.join(log, "id", "left").withColumn("_s", F.when(F.col("_log").isNotNull(), F.aggregate("_log", start, step)))
    edited = F.col("_s").isNotNull()
    swap = {"person_id": "person_id", "assigned_by": "assigned_by", "not_person_ids": "not_ids"}
    return done.select(
        *[F.when(edited, F.col(f"_s.{swap[c]}")).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in faces.columns]
    )


def new_entities(persons: DataFrame, faces: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, edits for reassign_members) for ``requests`` (ts, request, name, face_ids)."""
    named = requests.select("ts", "request", F.nullif(F.trim("name"), F.lit("")).alias("name"), "face_ids")
    ids = cut(allocate(named, [F.col("ts"), F.col("request")], highest_id(persons)))
    people = persons.unionByName(ids.select("id", "name", F.lit(False).alias("hidden")), allowMissingColumns=True)
    return people, ids.select("ts", F.explode("face_ids").alias("face"), F.col("id").alias("person_id")).withColumnRenamed("face", "id")


def pin_best(media: DataFrame, members: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, rejected pins) for ``pins`` (ts, group_id, media_id or null for automatic).

    The latest pin per group counts. Pins to an item outside the group are returned as errors.
    """
    inside = pins.join(members.select("group_id", "media_id", F.lit(True).alias("_in")), ["group_id", "media_id"], "left")
    valid = F.col("media_id").isNull() | F.coalesce(F.col("_in"), F.lit(False))
    rejected = inside.where(~valid).drop("_in")
    latest = inside.where(valid).groupBy("group_id").agg(F.max_by(F.struct("media_id"), "ts").alias("_p"))
    chosen = members.join(latest, "group_id").select(
        F.col("media_id").alias("id"), F.coalesce(F.col("_p.media_id") == F.col("media_id"), F.lit(False)).alias("_pin")
    )
    out = media.join(chosen, "id", "left").withColumn("pinned_best", F.coalesce("_pin", "pinned_best"))
    return out.select(*media.columns), rejected


# ---------- events ----------

def merge_events(events: DataFrame, event_media: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merges``: batch, event_id. Each batch goes into its earliest event.

    That event takes the first title and description in order of start, becomes locked, and a
    month bucket becomes an ordinary event.
    """
    rank = F.struct("start_at", F.col("id"))
    picked = merges.distinct().join(events.withColumnRenamed("id", "event_id"), "event_id").withColumn("id", F.col("event_id"))
    title, text = F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))
    targets = picked.groupBy("batch").agg(
        F.min_by("id", rank).alias("target"),
        F.min_by(title, F.when(title.isNotNull(), rank)).alias("_title"),
        F.min_by(text, F.when(text.isNotNull(), rank)).alias("_text"),
    )
    moves = picked.select("batch", "event_id").join(targets, "batch").select("event_id", "target")
    moved = event_media.join(moves, "event_id", "left").withColumn("event_id", F.coalesce("target", "event_id"))
    gone = moves.where("event_id <> target").select(F.col("event_id").alias("id"))
    kept = events.join(gone, "id", "left_anti").join(
        targets.select(F.col("target").alias("id"), "_title", "_text", F.lit(True).alias("_hit")), "id", "left"
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    kept = (
        kept.withColumn("title", F.when(hit, F.col("_title")).otherwise(F.col("title")))
        .withColumn("description", F.when(hit, F.col("_text")).otherwise(F.col("description")))
        .withColumn("kind", F.when(hit & (F.col("kind") == "moments"), "auto").otherwise(F.col("kind")))
        .withColumn("locked", F.col("locked") | hit)
    )
    return kept.select(*events.columns), moved.select(*event_media.columns)


def split_events(
    events: DataFrame, event_media: DataFrame, media: DataFrame, splits: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, event_media, rejected) for ``splits`` (event_id, media_id).

    The pivot and everything after it, by (time, id), form a new event; both halves are
    locked. A pivot outside the event or with nothing before it is rejected.
    """
    times = media.where(~F.col("missing")).select(F.col("id").alias("media_id"), "taken_at")
    members = event_media.join(times, "media_id")
    pivots = splits.join(members.select("event_id", "media_id", F.col("taken_at").alias("pivot_at")), ["event_id", "media_id"], "left")
    pivots = pivots.withColumnRenamed("media_id", "pivot")
    sides = members.join(pivots.where("pivot_at is not null"), "event_id").withColumn(
        "later", F.struct("taken_at", "media_id") >= F.struct("pivot_at", "pivot")
    )
    ends = sides.groupBy("event_id", "pivot", "pivot_at").agg(
        F.count_if(~F.col("later")).alias("before"), F.max(F.when(~F.col("later"), F.col("taken_at"))).alias("left_end")
    )
    good = cut(allocate(ends.where("before > 0"), [F.col("event_id")], highest_id(events), "new_id"))
    rejected = splits.join(good.select("event_id"), "event_id", "left_anti")
    new_rows = good.select(
        F.col("new_id").alias("id"),
        F.lit("auto").alias("kind"),
        F.lit(True).alias("locked"),
        F.col("pivot_at").alias("start_at"),
        F.col("pivot_at").alias("end_at"),
        F.lit(False).alias("hero_by_user"),
    )
    mark = good.select(F.col("event_id").alias("id"), "left_end")
    hit = F.col("left_end").isNotNull()
    old = (
        events.join(mark, "id", "left")
        .withColumn("locked", F.col("locked") | hit)
        .withColumn("end_at", F.when(hit & (F.col("kind") == "custom"), F.col("left_end")).otherwise(F.col("end_at")))
        .withColumn("kind", F.when(hit & (F.col("kind") == "moments"), "auto").otherwise(F.col("kind")))
        .select(*events.columns)
    )
    later = sides.where("later").join(good.select("event_id", "new_id"), "event_id").select("media_id", "new_id")
    placed = event_media.join(later, "media_id", "left").withColumn("event_id", F.coalesce("new_id", "event_id"))
    return old.unionByName(new_rows, allowMissingColumns=True), placed.select(*event_media.columns), rejected


def move_items(event_media: DataFrame, media: DataFrame, moves: DataFrame) -> DataFrame:
    """event_media after ``moves`` (ts, media_id, event_id): placed by hand; the last move wins.

    Items without an event yet are added; unknown items are ignored.
    """
    last = moves.groupBy("media_id").agg(F.max_by("event_id", "ts").alias("_to"))
    last = last.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    joined = event_media.join(last, "media_id", "full_outer")
    return joined.select(
        "media_id",
        F.coalesce("_to", "event_id").alias("event_id"),
        F.when(F.col("_to").isNotNull(), "user").otherwise(F.col("assigned_by")).alias("assigned_by"),
    )


def move_to_new_events(
    events: DataFrame, event_media: DataFrame, media: DataFrame, moves: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(events, event_media) for ``moves`` (ts, request, title, media_id): one locked event each."""
    ranges = (
        moves.join(media.select(F.col("id").alias("media_id"), "taken_at"), "media_id")
        .groupBy("request")
        .agg(
            F.first("title", ignorenulls=True).alias("title"),
            F.min("taken_at").alias("start_at"),
            F.max("taken_at").alias("end_at"),
        )
    )
    made = cut(allocate(ranges, [F.col("request")], highest_id(events)))
    rows = made.select(
        "id",
        F.lit("auto").alias("kind"),
        F.nullif(F.trim("title"), F.lit("")).alias("title"),
        "start_at",
        "end_at",
        F.lit(True).alias("locked"),
        F.lit(False).alias("hero_by_user"),
    )
    placed = moves.join(made.select("request", F.col("id").alias("event_id")), "request").select("ts", "media_id", "event_id")
    return events.unionByName(rows, allowMissingColumns=True), move_items(event_media, media, placed)


def create_events(
    events: DataFrame, event_media: DataFrame, media: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``requests``: request, title, description, start, end (dates). A custom event claims every
    automatically placed item in its range; the first of overlapping new events wins."""
    clock = events.schema["start_at"].dataType
    midnight = F.date_add("end", 1).cast("timestamp")
    made = cut(
        allocate(requests.where("start <= end"), [F.col("request")], highest_id(events)).select(
            "id",
            F.lit("custom").alias("kind"),
            F.trim("title").alias("title"),
            "description",
            F.col("start").cast("timestamp").cast(clock).alias("start_at"),
            (midnight - F.expr("INTERVAL 1 MICROSECOND")).cast(clock).alias("end_at"),
            F.lit(True).alias("locked"),
            F.lit(False).alias("hero_by_user"),
        )
    )
    auto = event_media.where("assigned_by = 'auto'").join(media.select(F.col("id").alias("media_id"), "taken_at"), "media_id")
    claimed = absorb(auto, made.withColumnRenamed("id", "event_id"), "taken_at", "media_id").withColumnRenamed("event_id", "_to")
    placed = event_media.join(claimed, "media_id", "left").withColumn("event_id", F.coalesce("_to", "event_id"))
    return events.unionByName(made, allowMissingColumns=True), placed.select(*event_media.columns)


def dissolve_events(events: DataFrame, event_media: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop events (``event_id``); their items are free for the next rebuild."""
    return (
        events.join(gone.select(F.col("event_id").alias("id")), "id", "left_anti"),
        event_media.join(gone.select("event_id"), "event_id", "left_anti"),
    )


def edit_event_texts(events: DataFrame, event_media: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected hero picks) for ``edits`` (ts, id, field, value).

    A title or description locks the event. A hero must be a member; a null hero returns to the
    automatic choice and does not lock.
    """
    hero = edits.where("field = 'hero_media_id'").select("ts", "id", F.col("value").cast("bigint").alias("media_id"))
    inside = event_media.select(F.col("event_id").alias("id"), "media_id", F.lit(True).alias("_in"))
    checked = hero.join(inside, ["id", "media_id"], "left")
    valid = F.col("media_id").isNull() | F.coalesce(F.col("_in"), F.lit(False))
    heroes = checked.where(valid).groupBy("id").agg(F.max_by(F.struct("media_id"), "ts").alias("_hero"))
    texts = [
        F.max_by(F.struct(F.nullif(F.trim("value"), F.lit("")).alias("v")), F.when(F.col("field") == f, F.col("ts"))).alias(f"_{f}")
        for f in ("title", "description")
    ]
    changed = edits.where("field in ('title', 'description')").groupBy("id").agg(*texts).withColumn("_text", F.lit(True))
    out = events.join(changed, "id", "left").join(heroes, "id", "left")
    for f in ("title", "description"):
        out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)))
    picked = F.col("_hero").isNotNull()
    out = (
        out.withColumn("locked", F.col("locked") | F.coalesce("_text", F.lit(False)))
        .withColumn("hero_by_user", F.when(picked, F.col("_hero.media_id").isNotNull()).otherwise(F.col("hero_by_user")))
        .withColumn("hero_media_id", F.coalesce("_hero.media_id", "hero_media_id"))
    )
    return out.select(*events.columns), checked.where(~valid).drop("_in")


def move_windows(festivals: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(festivals, rejected) for ``edits`` (id, new_date, new_start, new_end).

    Without a new start or end the window keeps its shape around the main day. Edits whose main
    day would lie outside the window are rejected.
    """
    joined = festivals.join(edits, "id", "left")
    start = F.coalesce("new_start", F.date_sub("new_date", F.datediff("date", "start")))
    end = F.coalesce("new_end", F.date_add("new_date", F.datediff("end", "date")))
    joined = joined.withColumn("_start", start).withColumn("_end", end)
    edited = F.col("new_date").isNotNull()
    valid = edited & F.col("new_date").between(F.col("_start"), F.col("_end"))
    good = F.coalesce(valid, F.lit(False))
    out = joined.select(
        *[c for c in festivals.columns if c not in ("date", "start", "end", "user_edited")],
        F.when(good, F.col("new_date")).otherwise(F.col("date")).alias("date"),
        F.when(good, F.col("_start")).otherwise(F.col("start")).alias("start"),
        F.when(good, F.col("_end")).otherwise(F.col("end")).alias("end"),
        (F.col("user_edited") | good).alias("user_edited"),
    )
    return out.select(*festivals.columns), joined.where(edited & ~good).select(*edits.columns)


def reset_windows(festivals: DataFrame, builtin: DataFrame, ids: DataFrame) -> DataFrame:
    """Restore the built-in dates of the given rows."""
    base = builtin.select("festival", "year", *[F.col(c).alias(f"_{c}") for c in ("date", "start", "end")])
    marked = festivals.join(ids.select("id", F.lit(True).alias("_reset")), "id", "left").join(base, ["festival", "year"], "left")
    reset = F.coalesce(F.col("_reset"), F.lit(False)) & F.col("_date").isNotNull()
    return marked.select(
        *[c for c in festivals.columns if c not in ("date", "start", "end", "user_edited")],
        *[F.when(reset, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("date", "start", "end")],
        (F.col("user_edited") & ~reset).alias("user_edited"),
    ).select(*festivals.columns)


def valid_occasions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by whether the month and day exist and the fields are in range."""
    from tidemark.functions.dates import valid_month_day

    ok = (
        F.col("kind").isin("birthday", "anniversary", "other")
        & F.length(F.col("name")).between(1, 120)
        & (F.col("year").isNull() | F.col("year").between(1900, 2100))
        & valid_month_day(F.col("month"), F.col("day"), F.col("year"))
    )
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good).withColumn("name", F.trim("name")), rows.where(~good)
