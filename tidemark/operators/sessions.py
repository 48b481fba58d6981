"""Sessions by time gap and place jump, absorption into fixed windows, and roll-up.

Naive local times are compared as they are: run the session in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import haversine_km, valid_geo
from tidemark.operators.intervals import day_number, points_in_ranges
from tidemark.operators.ordering import carried_last, dense_index, join_same, running
from tidemark.session import cut


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def gap_sessions(items: DataFrame, gap_hours: float, by: list[str] | None = None, ts: str = "taken_at") -> DataFrame:
    """Add ``session`` (1, 2, ... per owner): a new one when the gap is strictly longer.

    Items in one time bucket as wide as the gap can never be separated, so only the first and
    last time of each bucket is ordered: one row per owner and bucket, however many items an
    owner has.
    """
    by = by or []
    gap = round(gap_hours * 3_600_000_000)
    bucketed = items.withColumn("_bucket", F.floor(micros(F.col(ts)) / gap))
    spans = bucketed.groupBy(*by, "_bucket").agg(
        F.min(micros(F.col(ts))).alias("_first"), F.max(micros(F.col(ts))).alias("_last")
    )
    along = Window.partitionBy(*by).orderBy("_bucket")
    split = F.coalesce((F.col("_first") - F.lag("_last").over(along) > gap).cast("bigint"), F.lit(0))
    numbered = spans.withColumn("_split", split).select(
        *by, "_bucket", (F.sum("_split").over(along) + 1).alias("session")
    )
    return join_same(bucketed, numbered, [*by, "_bucket"]).drop("_bucket")


def session_spans(items: DataFrame, gap_hours: float, by: list[str] | None = None, ts: str = "taken_at") -> DataFrame:
    """(by, start_at, end_at, n) of every session."""
    by = by or []
    rows = gap_sessions(items.select(*by, ts), gap_hours, by, ts)
    return rows.groupBy(*by, "session").agg(F.min(ts).alias("start_at"), F.max(ts).alias("end_at"), F.count(F.lit(1)).alias("n")).drop("session")


def repair_spans(spans: DataFrame, late: DataFrame, gap_hours: float, by: list[str] | None = None, ts: str = "taken_at") -> DataFrame:
    """``spans`` after the ``late`` rows have come in: what sessions of all rows would be, without reading the others again.

    Late rows make sessions of their own first. Only stored sessions within the gap of one of those can
    change; they are merged with them, and all others stay as they are. What is ordered per owner is a row
    per changed session, not the rows in it.
    """
    from tidemark.operators.occasions import overlaps

    by = by or []
    gap = F.expr(f"INTERVAL '{round(gap_hours * 3600)}' SECOND")
    fresh = cut(session_spans(late, gap_hours, by, ts))
    reach = fresh.select(*by, (F.col("start_at") - gap).alias("_low"), (F.col("end_at") + gap).alias("_high"))
    met = overlaps(spans.select(*by, "start_at", "end_at"), reach, ("start_at", "end_at"), ("_low", "_high"), by)
    touched = met.where((F.col("start_at") <= F.col("_high")) & (F.col("end_at") >= F.col("_low"))).select(*by, "start_at").distinct()
    named = touched.withColumnsRenamed({c: f"_t_{c}" for c in touched.columns}).withColumn("_touched", F.lit(True))
    same = F.lit(True)
    for c in touched.columns:
        same = same & spans[c].eqNullSafe(named[f"_t_{c}"])
    marked = cut(spans.join(named, same, "left").select(*spans.columns, F.coalesce("_touched", F.lit(False)).alias("_touched")))
    changed = marked.where("_touched").drop("_touched").unionByName(fresh.select(*spans.columns))
    along = Window.partitionBy(*by).orderBy("start_at", "end_at")
    before = F.max("end_at").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("start_at") > before + gap).cast("bigint"), F.lit(0))
    islands = changed.withColumn("_new", apart).withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*by, "_island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n"))
    return marked.where("not _touched").drop("_touched").unionByName(merged.drop("_island"))


def split_clusters(
    items: DataFrame,
    gap_hours: float,
    gps_km: float,
    by: list[str] | None = None,
    ts: str = "taken_at",
    key: str = "id",
    lat: str = "gps_lat",
    lon: str = "gps_lon",
    whole: bool = True,
) -> DataFrame:
    """Add ``session`` and ``place``; together (with ``by``) they identify a cluster.

    Without ``whole`` only ``by``, ``ts`` and ``key`` are kept of the items, which need not be joined again.

    Within a session a cluster ends where a located item lies more than ``gps_km`` from the
    last located item before it.
    """
    by = by or []
    sessions = gap_sessions(items, gap_hours, by, ts)
    geo = valid_geo(F.col(lat), F.col(lon))
    narrow = sessions.select(*by, "session", ts, key, geo.alias("_geo"))
    rows = dense_index(narrow, [*map(F.col, by), F.col(ts), F.col(key)])
    here = F.struct(*by, F.col("session"), F.col("_geo"))
    rows = carried_last(rows, F.when(F.col("_geo").isNotNull(), here), "_before", chunks=True)
    same = F.col("_before.session") == F.col("session")
    for column in by:
        same = same & F.col(f"_before.{column}").eqNullSafe(F.col(column))
    far = haversine_km(F.col("_before._geo.lat"), F.col("_before._geo.lon"), F.col("_geo.lat"), F.col("_geo.lon"))
    jump = F.coalesce((same & (far > gps_km)).cast("bigint"), F.lit(0))
    rows = running(rows, jump, "place")
    if not whole:
        return rows.select(*by, ts, key, "session", "place")
    return items.join(cut(rows.select(key, "session", "place")), key)


def absorb(
    items: DataFrame, windows: DataFrame, ts: str = "taken_at", key: str = "id", by: list[str] | None = None, timed: bool = False
) -> DataFrame:
    """(key, event_id) of items inside a window, ``timed`` with their time; the first window by (start, end, id) wins.

    ``by`` names owner columns of both tables: a window takes items of its own owner only.
    Windows are cut into blocks of days, at most two per power of two, see ``intervals``.
    """
    by = by or []
    spans = windows.where("start_at <= end_at").select(*by, "event_id", "start_at", "end_at")
    seen = items.select(F.col(key).alias("_item"), F.col(ts).alias("_at"), *by)
    hits = points_in_ranges(seen, day_number(F.col("_at")), spans, day_number(F.col("start_at")), day_number(F.col("end_at")), by)
    hits = hits.where(F.col("_at").between(F.col("start_at"), F.col("end_at")))
    first = F.min(F.struct("start_at", "end_at", "event_id"))
    kept = [F.col("_item").alias(key), *([F.col("_at").alias(ts)] if timed else [])]
    return hits.groupBy(*kept).agg(first.alias("_w")).select(key, *([ts] if timed else []), F.col("_w.event_id").alias("event_id"))


def first_windows(windows: DataFrame) -> DataFrame:
    """(start_at, until, event_id): stretches of time that do not overlap, each with the first window by
    (start, end, id) of those that hold it; ``until`` is not part of it.

    Whatever joins them meets one row at most, and needs no aggregate to find the first window.
    """
    spans = windows.where("start_at <= end_at").select("event_id", "start_at", "end_at")
    kind = dict(spans.dtypes)["start_at"]
    us = spans.select("event_id", "start_at", "end_at", F.unix_micros(F.col("start_at").cast("timestamp")).alias("_s"), F.unix_micros(F.col("end_at").cast("timestamp")).alias("_e"))
    edges = us.select(F.col("_s").alias("_edge")).unionByName(us.select((F.col("_e") + 1).alias("_edge"))).distinct()
    placed = cut(dense_index(edges, [F.col("_edge")], "_n"))
    ahead = placed.select((F.col("_n") - 1).alias("_n"), F.col("_edge").alias("_until"))
    pieces = placed.join(ahead, "_n").drop("_n")

    def day(c: str) -> Column:
        return F.floor(F.col(c) / 86_400_000_000)

    hits = points_in_ranges(pieces, day("_edge"), us, day("_s"), day("_e")).where(F.col("_edge").between(F.col("_s"), F.col("_e")))
    first = hits.groupBy("_edge", "_until").agg(F.min(F.struct("start_at", "end_at", "event_id")).alias("_w"))

    def time(c: str) -> Column:
        return F.timestamp_micros(F.col(c)).cast(kind)

    return first.select(time("_edge").alias("start_at"), time("_until").alias("until"), F.col("_w.event_id").alias("event_id"))


def cluster_spans(clustered: DataFrame, keys: list[str], ts: str = "taken_at", key: str = "id") -> DataFrame:
    """One row per cluster: ``cluster`` (its lowest id), size and time range."""
    return clustered.groupBy(*keys).agg(
        F.min(key).alias("cluster"),
        F.count(F.lit(1)).alias("size"),
        F.min(ts).alias("start_at"),
        F.max(ts).alias("end_at"),
    )


def roll_up_small(
    clustered: DataFrame,
    spans: DataFrame,
    keys: list[str],
    min_items: int,
    special: DataFrame,
    by: list[str] | None = None,
    ts: str = "taken_at",
    key: str = "id",
    timed: bool = False,
) -> DataFrame:
    """(key, kind, group_id): clusters that are large or special stay; the others' items go to
    one bucket per month of the item itself. A group's id is its lowest item. ``timed`` rows have ``ts`` too.

    ``special`` holds the ``cluster`` ids that fall on an occasion.
    """
    by = by or []
    marked = spans.join(special.select("cluster").distinct().withColumn("_special", F.lit(True)), "cluster", "left")
    keep = (F.col("size") >= min_items) | F.coalesce(F.col("_special"), F.lit(False))
    kinds = marked.select(*keys, "cluster", F.when(keep, "auto").otherwise("moments").alias("kind"))
    month = F.when(F.col("kind") == "moments", F.trunc(F.col(ts), "MONTH"))
    placed = (
        join_same(clustered, kinds, keys)
        .withColumn("_month", month)
        .withColumn("_cluster", F.when(F.col("kind") == "auto", F.col("cluster")))
        .select(*by, key, ts, "kind", "_month", "_cluster")
    )
    bucket, kept = [*by, "_month"], [key, *([ts] if timed else []), "kind"]
    months = placed.where("kind = 'moments'").groupBy(*bucket).agg(F.min(key).alias("_first"))
    moments = join_same(placed.where("kind = 'moments'"), months, bucket).select(*kept, F.col("_first").alias("group_id"))
    autos = placed.where("kind = 'auto'").select(*kept, F.col("_cluster").alias("group_id"))
    return autos.unionByName(moments)


def reuse_ids(groups: DataFrame, members: DataFrame, old: DataFrame) -> DataFrame:
    """(group_id, event_id): give each new group the old event it overlaps most.

    ``groups``: group_id, kind, position (sortable). ``members``: id, group_id. ``old``: id,
    event_id, kind. Groups choose in order of position, each old event is used once, and only
    an event of the same kind qualifies.

    All groups ask for the best event they were not refused; an event keeps the earliest that
    asked and refuses all later ones for good. As every event prefers earlier groups, this ends
    where choosing one after the other would. There are as many rounds as refusals follow from
    each other, not as many as groups overlap.
    """
    seen = old.groupBy("event_id").agg(F.min("id").alias("seen"))
    edges = (
        members.join(groups, "group_id")
        .join(old, ["id", "kind"])
        .groupBy("group_id", "position", "event_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(seen, "event_id")
        .withColumn("turn", F.struct("position", "group_id"))
        .drop("position")
    )
    while True:
        edges = cut(edges)
        asked = edges.groupBy("group_id", "turn").agg(F.max_by("event_id", F.struct("n", -F.col("seen"))).alias("event_id"))
        held = asked.groupBy("event_id").agg(F.min("turn").alias("holder"))
        if asked.join(held, "event_id").where("turn > holder").isEmpty():
            return asked.select("group_id", "event_id")
        edges = edges.join(held, "event_id", "left").where("holder is null or turn <= holder").drop("holder")
