"""Sessions, clusters, roll-up, absorption and event rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.checks.registry import big, query, time_text
from tidemark.checks.standin import library, table, with_tables
from tidemark.operators import sessions
from tidemark.params import Settings
from tidemark.plans import rebuild


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, 1 + CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_at
FROM s GROUP BY 1, 2""")
def gap_sessions(spark, sf):
    """Sessions of every user, with range and size."""
    e = table(spark, sf, "events").select("user_id", "ts")
    return (
        sessions.gap_sessions(e, 6, ["user_id"], "ts")
        .groupBy("user_id", "session")
        .agg(F.count(F.lit(1)).alias("n"), time_text(F.min("ts")).alias("start_at"), time_text(F.max("ts")).alias("end_at"))
    )


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL 9 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, 1 + CAST(sum(b) OVER (ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_at
FROM s GROUP BY 1""")
def global_sessions(spark, sf):
    """Sessions of one list without owners: no single-task window over the rows."""
    e = table(spark, sf, "events").select("ts")
    return (
        sessions.gap_sessions(e, 0.15, [], "ts")
        .groupBy("session")
        .agg(F.count(F.lit(1)).alias("n"), time_text(F.min("ts")).alias("start_at"), time_text(F.max("ts")).alias("end_at"))
    )


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_at, count(*) AS n FROM s GROUP BY user_id, k""")
def late_sessions(spark, sf):
    """Sessions of every user after the clicks came late: those that they touch are merged, the others stay."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_type")
    stored = sessions.session_spans(e.where("event_type <> 'click'"), 6, ["user_id"], "ts")
    whole = sessions.repair_spans(stored, e.where("event_type = 'click'"), 6, ["user_id"], "ts")
    return whole.select("user_id", time_text("start_at").alias("start_at"), time_text("end_at").alias("end_at"), "n")


PLACED = """
p AS (SELECT event_id, user_id, ts,
    CASE WHEN event_id%5=0 THEN NULL WHEN event_id%7=0 THEN 0.0 ELSE 17.0::DOUBLE + (event_id*7919%60)/100.0::DOUBLE END AS lat,
    CASE WHEN event_id%5=0 THEN NULL WHEN event_id%7=0 THEN 0.0 ELSE 78.0::DOUBLE END AS lon FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b,
    lat IS NOT NULL AND NOT (abs(lat)<1e-6 AND abs(lon)<1e-6) AS ok FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
l AS (SELECT *, last_value(CASE WHEN ok THEN lat END IGNORE NULLS) OVER w AS plat, last_value(CASE WHEN ok THEN lon END IGNORE NULLS) OVER w AS plon
    FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CASE WHEN ok AND plat IS NOT NULL AND 2*6371.0*asin(sqrt(pow(sin((radians(lat)-radians(plat))/2),2)
      + cos(radians(plat))*cos(radians(lat))*pow(sin((radians(lon)-radians(plon))/2),2))) > 30 THEN 1 ELSE 0 END AS jump FROM l),
c AS (SELECT *, sum(jump) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS place FROM j),
k AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, session, place) AS cluster, count(*) OVER (PARTITION BY user_id, session, place) AS size,
    min(CAST(ts AS DATE)) OVER (PARTITION BY user_id, session, place) AS d0, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id, session, place) AS d1 FROM c)"""


def _placed_events(spark, sf):
    e = table(spark, sf, "events")
    key = F.col("event_id")

    def coordinate(value):
        return F.when(key % 5 == 0, None).when(key % 7 == 0, 0.0).otherwise(value)

    return e.select(
        key.alias("id"),
        "user_id",
        F.col("ts").alias("taken_at"),
        coordinate(F.lit(17.0) + (key * 7919 % 60) / 100.0).alias("gps_lat"),
        coordinate(F.lit(78.0)).alias("gps_lon"),
    )


@query(f"""WITH {PLACED}
SELECT cluster, user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_at
FROM k GROUP BY 1, 2""")
def geo_clusters(spark, sf):
    """Sessions split further where consecutive located events lie far apart."""
    rows = sessions.split_clusters(_placed_events(spark, sf), 12, 30, ["user_id"])
    spans = sessions.cluster_spans(rows, ["user_id", "session", "place"])
    return spans.select(
        "cluster", "user_id", F.col("size").alias("n"), time_text("start_at").alias("start_at"), time_text("end_at").alias("end_at")
    )


@query(f"""WITH {PLACED},
f(s, e) AS (VALUES (DATE '2024-01-13', DATE '2024-01-15'), (DATE '2024-01-26', DATE '2024-01-26')),
z AS (SELECT *, CASE WHEN size >= 4 OR EXISTS (SELECT 1 FROM f WHERE f.s <= d1 AND f.e >= d0) THEN 'auto' ELSE 'moments' END AS kind FROM k),
y AS (SELECT *, CASE WHEN kind='auto' THEN cluster ELSE min(event_id) OVER (PARTITION BY kind, user_id, date_trunc('month', ts)) END AS group_id FROM z)
SELECT kind, group_id, count(*) AS n FROM y GROUP BY 1, 2""")
def moments_rollup(spark, sf):
    """Small clusters gathered per month, unless they touch a festival."""
    from tidemark.operators.occasions import overlaps

    keys = ["user_id", "session", "place"]
    rows = sessions.split_clusters(_placed_events(spark, sf), 12, 30, ["user_id"])
    spans = sessions.cluster_spans(rows, keys)
    fests = spark.createDataFrame([("2024-01-13", "2024-01-15"), ("2024-01-26", "2024-01-26")], "s string, e string")
    fests = fests.select(F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    special = overlaps(spans.select("cluster", "start_at", "end_at"), fests, ("start_at", "end_at"), ("s", "e"))
    placed = sessions.roll_up_small(rows, spans, keys, 4, special, ["user_id"])
    return placed.groupBy("kind", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH v AS (SELECT o_custkey % 200 AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(max(o_orderkey) % 29 AS INTEGER)) AS start_at,
    TIMESTAMP '2024-01-01' + to_days(CAST(max(o_orderkey) % 29 AS INTEGER)) + to_hours(CAST(6 + count(*) % 50 AS INTEGER)) AS end_at FROM orders GROUP BY 1),
hit AS (SELECT e.event_id AS id, arg_min(v.event_id, {'s': start_at, 'e': end_at, 'i': v.event_id}) AS window_id FROM events e JOIN v ON e.ts BETWEEN v.start_at AND v.end_at GROUP BY 1)
SELECT id, window_id FROM hit""")
def absorb_windows(spark, sf):
    """Events inside fixed windows (one for every 200th customer's orders); the first window wins."""
    windows = (
        table(spark, sf, "orders").groupBy((F.col("o_custkey") % 200).alias("event_id"))
        .agg(F.max("o_orderkey").alias("k"), F.count(F.lit(1)).alias("n"))
        .withColumn("start_at", F.timestamp_add("DAY", (F.col("k") % 29).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).cast("timestamp_ntz"))
        .withColumn("end_at", F.timestamp_add("HOUR", (6 + F.col("n") % 50).cast("int"), "start_at").cast("timestamp_ntz"))
    )
    items = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("taken_at"))
    return sessions.absorb(items, windows.select("event_id", "start_at", "end_at")).withColumnRenamed("event_id", "window_id")


def _sessions(hours: int) -> str:
    return f"""
m{hours} AS (SELECT event_id AS id, user_id AS u, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {hours} HOUR THEN 1 ELSE 0 END AS fresh FROM events)),
g{hours} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY u, k) AS g, min(ts) OVER (PARTITION BY u, k) AS s FROM m{hours})"""


@query(f"""WITH RECURSIVE {_sessions(4)}, {_sessions(6)},
edge AS (SELECT a.g, a.s, b.g AS e, count(*) AS n FROM g4 a JOIN g6 b USING (id) GROUP BY ALL),
turn AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY s, g) AS rn, wish FROM (SELECT g, s, list(e ORDER BY n DESC, e) AS wish FROM edge GROUP BY 1, 2)),
walk(rn, g, e, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT t.rn, t.g, x.e, CASE WHEN x.e IS NULL THEN w.used ELSE list_append(w.used, x.e) END
  FROM walk w JOIN turn t ON t.rn = w.rn + 1, LATERAL (SELECT list_filter(t.wish, lambda v: NOT list_contains(w.used, v))[1] AS e) x)
SELECT g AS group_id, e AS event_id FROM walk WHERE e IS NOT NULL""")
def id_reuse(spark, sf):
    """New 4 hour sessions take over the ids of the 6 hour sessions they overlap most."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("taken_at"))

    def grouped(hours):
        rows = sessions.gap_sessions(e, hours, ["user_id"])
        first = rows.groupBy("user_id", "session").agg(F.min("id").alias("group_id"), F.min("taken_at").alias("start_at"))
        return rows.join(first, ["user_id", "session"]).select("id", "group_id", "start_at")

    new, old = grouped(4), grouped(6)
    groups = new.select("group_id", F.lit("auto").alias("kind"), F.struct("start_at", "group_id").alias("position")).distinct()
    before = old.select("id", F.col("group_id").alias("event_id"), F.lit("auto").alias("kind"))
    return sessions.reuse_ids(groups, new.select("id", "group_id"), before)


REBUILT = with_tables(["media", "festivals", "recurring"], """,
p AS (SELECT id, taken_at, gps_lat AS lat, gps_lon AS lon FROM media WHERE NOT missing),
g AS (SELECT *, CASE WHEN taken_at - lag(taken_at) OVER (ORDER BY taken_at, id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b, lat IS NOT NULL AS ok FROM p),
s AS (SELECT *, sum(b) OVER (ORDER BY taken_at, id) AS session FROM g),
l AS (SELECT *, last_value(lat IGNORE NULLS) OVER w AS plat, last_value(lon IGNORE NULLS) OVER w AS plon
    FROM s WINDOW w AS (PARTITION BY session ORDER BY taken_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CASE WHEN ok AND plat IS NOT NULL AND 2*6371.0*asin(sqrt(pow(sin((radians(lat)-radians(plat))/2),2)
      + cos(radians(plat))*cos(radians(lat))*pow(sin((radians(lon)-radians(plon))/2),2))) > 300 THEN 1 ELSE 0 END AS jump FROM l),
c AS (SELECT *, sum(jump) OVER (PARTITION BY session ORDER BY taken_at, id) AS place FROM j),
k AS (SELECT *, min(id) OVER q AS cluster, count(*) OVER q AS size, min(CAST(taken_at AS DATE)) OVER q AS d0, max(CAST(taken_at AS DATE)) OVER q AS d1
    FROM c WINDOW q AS (PARTITION BY session, place)),
special AS (SELECT DISTINCT cluster FROM k WHERE size < 3 AND (EXISTS (SELECT 1 FROM festivals f WHERE f.start_date <= d1 AND f.end_date >= d0)
    OR EXISTS (SELECT 1 FROM recurring r, generate_series(d0, d1, INTERVAL 1 DAY) t(d) WHERE month(t.d)=r.month
      AND day(t.d) = least(r.day, day(last_day(t.d))) AND (coalesce(r.first_year,0)=0 OR year(t.d) >= r.first_year)))),
z AS (SELECT *, CASE WHEN size >= 3 OR cluster IN (SELECT cluster FROM special) THEN 'auto' ELSE 'moments' END AS kind FROM k),
y AS (SELECT *, CASE WHEN kind='auto' THEN cluster ELSE min(id) OVER (PARTITION BY kind, date_trunc('month', taken_at)) END AS group_id FROM z),
e AS (SELECT kind, group_id, min(taken_at) AS t0, max(taken_at) AS t1, count(*) AS n FROM y GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY CASE WHEN kind='moments' THEN 1 ELSE 0 END, t0, group_id) AS id, kind, n,
  strftime(t0, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(t1, '%Y-%m-%d %H:%M:%S') AS end_at FROM e""")


@query(REBUILT)
def event_rebuild(spark, sf):
    """All events of the collection from scratch, heroes aside."""
    lib = library(spark, sf, Settings(event_gps_km=300), without=("events", "event_media", "faces", "embeddings"))
    built, _ = rebuild.rebuild_events(lib)
    n = built["event_media"].groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return built["events"].join(n, "id").select("id", "kind", "n", time_text("start_at").alias("start_at"), time_text("end_at").alias("end_at"))
