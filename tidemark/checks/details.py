"""Details of items, corrections by hand, rebuilt and analysed collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.checks.calendar import calendar_sql
from tidemark.checks.copies import LIB_COMPONENTS, LIB_GROUPS
from tidemark.checks.embedding import CENTROIDS, CUR_TABLES, GREEDY, LEADERS, PEOPLE, _centroids, _matched, _vectors
from tidemark.checks.pages import EVENT_TABLES, SUMMARY
from tidemark.checks.registry import big, day_text, query, time_text
from tidemark.checks.standin import library, with_tables
from tidemark.checks.timelines import REBUILT
from tidemark.functions.numeric import display_size, is_landscape
from tidemark.operators import browse, edits, entities, storyboard
from tidemark.params import Settings
from tidemark.plans import analysis, rebuild, views
from tidemark.plans.library import Library


@query(calendar_sql([*EVENT_TABLES, "festivals", "recurring", "quality", "dup_groups", "dup_members"], SUMMARY + """,
fs AS (SELECT media_id, string_agg(f.id || ':' || coalesce(p.name, '-') || ':' || CASE WHEN coalesce(p.hidden, false) THEN 'true' ELSE 'false' END, ',' ORDER BY f.id) AS faces
  FROM faces f LEFT JOIN persons p ON p.id = f.person_id GROUP BY 1),
ts AS (SELECT media_id, string_agg(tag, ',' ORDER BY score DESC, tag) AS tags FROM media_tags GROUP BY 1)
SELECT m.id AS media_id, d.group_id, coalesce(g.size, 1) AS group_size, q.total, round(q.media_mtime_ns // 1000 % 100 / 100.0::DOUBLE, 3) AS sharpness,
  coalesce(fs.faces, '') AS faces, coalesce(ts.tags, '') AS tags, e.event_id, s.title
FROM media m LEFT JOIN dup_members d ON d.media_id = m.id LEFT JOIN dup_groups g ON g.id = d.group_id LEFT JOIN quality q ON q.media_id = m.id
  LEFT JOIN fs ON fs.media_id = m.id LEFT JOIN ts ON ts.media_id = m.id LEFT JOIN event_media e ON e.media_id = m.id LEFT JOIN summary s ON s.id = e.event_id"""))
def item_details(spark, sf):
    """Every item with its group, quality, faces from left to right, tags and event."""
    rows = views.item_detail(library(spark, sf))
    faces = F.transform("faces", lambda f: F.concat_ws(":", f["id"].cast("string"), F.coalesce(f["person_name"], F.lit("-")), f["person_hidden"].cast("string")))
    return rows.select(
        "media_id", "group_id", "group_size", F.col("quality.total").alias("total"), F.col("quality.sharpness").alias("sharpness"),
        F.coalesce(F.array_join(faces, ","), F.lit("")).alias("faces"),
        F.coalesce(F.array_join(F.transform("tags", lambda t: t["tag"]), ","), F.lit("")).alias("tags"), "event_id", "title",
    )


@query(with_tables(CUR_TABLES, PEOPLE + """,
per AS (SELECT CASE WHEN n > 15 THEN 5 WHEN n > 6 THEN 8 ELSE 12 END AS k FROM (SELECT count(DISTINCT year(ts)) AS n FROM cur WHERE kind='photo' AND NOT copy)),
cand AS (SELECT id, sig, vec, score, ts, year(ts) AS g FROM cur WHERE kind='photo' AND has_thumb AND NOT copy),""" + GREEDY.replace("{k}", "(SELECT k FROM per)") + """
SELECT CAST(g AS BIGINT) AS year, id FROM final"""))
def story_reel(spark, sf):
    """Picks of all years, as many of each as suit the number of years."""
    return views.story_reel(library(spark, sf)).select(big("year"), "id")


@query(calendar_sql([*EVENT_TABLES, "festivals", "recurring"], SUMMARY + """
SELECT strftime((SELECT min(taken_at) FROM media WHERE NOT missing), '%Y-%m-%d %H:%M:%S') AS first, strftime((SELECT max(taken_at) FROM media WHERE NOT missing), '%Y-%m-%d %H:%M:%S') AS last,
  (SELECT count(*) FROM media WHERE NOT missing AND kind='photo') AS photo_count, count(*) AS event_count,
  (SELECT name FROM persons WHERE id = 6 AND NOT hidden) AS owner_name, (SELECT strftime(birth_date, '%Y-%m-%d') FROM persons WHERE id = 6 AND NOT hidden) AS owner_birth
FROM summary WHERE photo_count + video_count > 0"""))
def story_span(spark, sf):
    """First and last moment, photos, events and owner of the life story."""
    rows = views.story(library(spark, sf, Settings(story_person_id=6)))["span"]
    return rows.select(
        time_text("first").alias("first"), time_text("last").alias("last"), "photo_count", "event_count", "owner_name", day_text("owner_birth_date").alias("owner_birth")
    )


@query(with_tables(["media"], """,
o AS (SELECT * FROM media WHERE NOT missing AND error IS NULL), y AS (SELECT year(taken_at) AS y, count(*) AS n FROM o GROUP BY 1)
SELECT 'year' AS segment, CAST(y AS BIGINT) AS year, n || CASE WHEN n = 1 THEN ' moment' ELSE ' moments' END AS caption FROM y
UNION ALL SELECT 'title', NULL, min(y) || CASE WHEN min(y) <> max(y) THEN ' – ' || max(y) ELSE '' END || ' · ' || CAST(sum(n) AS BIGINT) || ' moments' FROM y"""))
def year_cards(spark, sf):
    """What the title card and the card of each year say."""
    rows = storyboard.storyboard(browse.live(library(spark, sf)["media"], clean=True))
    return rows.where("segment in ('title', 'year')").select("segment", big("year"), "caption")


@query(with_tables(["media"], """
SELECT id, CAST(CASE WHEN t THEN height ELSE width END AS BIGINT) AS width, CAST(CASE WHEN t THEN width ELSE height END AS BIGINT) AS height,
  CASE WHEN t THEN height >= width ELSE width >= height END AS wide FROM (SELECT *, mtime_ns // 1000 % 9 BETWEEN 5 AND 8 AS t FROM media)"""))
def shown_sizes(spark, sf):
    """Width and height as shown, for all orientations and none."""
    turn = F.nullif(F.floor(F.col("mtime_ns") / 1000) % 9, F.lit(0))
    rows = library(spark, sf)["media"].select("id", display_size(F.col("width"), F.col("height"), turn).alias("s"))
    return rows.select("id", big("s.width", "width"), big("s.height", "height"), is_landscape(F.col("s.width"), F.col("s.height")).alias("wide"))


@query(with_tables(["quality"], """
SELECT media_id, total, round(total / 7919, 3) AS sharpness, round(total / 7907, 3) AS exposure, round(total / 104729, 3) AS resolution, round(total / 1299709, 2) AS aesthetic_raw, aesthetic
FROM quality"""))
def quality_projection(spark, sf):
    """Scores as pages show them, rounded."""
    total = F.col("total")
    parts = {"sharpness": total / 7919, "exposure": total / 7907, "resolution": total / 104729, "aesthetic_raw": total / 1299709}
    rows = library(spark, sf)["quality"].withColumns(parts).select("media_id", *browse.quality_columns())
    return rows.select("media_id", "total", "sharpness", "exposure", "resolution", "aesthetic_raw", "aesthetic")


@query(with_tables(["quality", "faces"], """,
f AS (SELECT media_id, count(*) AS n, avg(CASE WHEN size_px >= 20 THEN CASE WHEN assigned_by='user' THEN 1.0 ELSE 0.0 END END) AS eyes, avg(CASE WHEN size_px >= 20 THEN quality END) AS sharp FROM faces GROUP BY 1),
j AS (SELECT q.media_id, coalesce(n, 0) AS n, greatest(q.media_mtime_ns // 1000 % 100 / 100.0::DOUBLE, sharp) AS sharpness, 0.6::DOUBLE*eyes + 0.4::DOUBLE*sharp AS face, aesthetic FROM quality q LEFT JOIN f USING (media_id))
SELECT media_id, n AS faces, round(sharpness, 6) AS sharpness, round(face, 6) AS face_score,
  round_even(100 * (0.30::DOUBLE*sharpness + 0.15::DOUBLE*0.4871 + 0.10::DOUBLE*0.5 + coalesce(0.20::DOUBLE*face, 0) + coalesce(0.25::DOUBLE*aesthetic, 0))
    / (0.55::DOUBLE + CASE WHEN face IS NULL THEN 0 ELSE 0.20::DOUBLE END + CASE WHEN aesthetic IS NULL THEN 0 ELSE 0.25::DOUBLE END), 1) AS total FROM j"""))
def assembled_quality(spark, sf):
    """Quality of every measured item after its judged sub-objects had their say."""
    lib = library(spark, sf)
    faces = lib["faces"].withColumn("eyes_open", F.col("assigned_by") == "user").withColumn("sharpness", F.col("quality"))
    measured = lib["quality"].select("media_id", "sharpness", F.lit(0.4871).alias("exposure"), "resolution", "aesthetic")
    rows = analysis.assemble_quality(measured, faces, 20)
    return rows.select("media_id", "faces", F.round("sharpness", 6).alias("sharpness"), F.round("face_score", 6).alias("face_score"), "total")


@query(calendar_sql(["events", "event_media"], """
SELECT e.id, kind, count(media_id) AS members FROM events_ e LEFT JOIN event_media m ON m.event_id = e.id WHERE e.id % 3 <> 0 GROUP BY ALL"""))
def dissolved_events(spark, sf):
    """What is left of events and memberships after every third event was dissolved."""
    lib = library(spark, sf)
    events, members = edits.dissolve_events(lib["events"], lib["event_media"], lib["events"].where("id % 3 = 0").select(F.col("id").alias("event_id")))
    n = members.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    return events.join(n, "id", "full").select("id", "kind", F.coalesce("members", F.lit(0)).alias("members"))


@query(with_tables(["faces", "persons"], """,
r AS (SELECT media_id, (SELECT max(id) FROM persons) + row_number() OVER (ORDER BY media_id % 10, media_id) AS person FROM faces WHERE size_px >= 45 GROUP BY 1)
SELECT f.id, CASE WHEN size_px >= 45 THEN person ELSE person_id END AS person_id, CASE WHEN size_px >= 45 THEN 'user' ELSE assigned_by END AS assigned_by,
  CASE WHEN size_px >= 45 AND f.media_id % 3 <> 0 THEN 'Who ' || f.media_id END AS new_name FROM faces f LEFT JOIN r USING (media_id)"""))
def new_people(spark, sf):
    """The large faces of an item become a new person, every third without a name."""
    lib = library(spark, sf)
    name = F.when(F.col("media_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Who "), F.col("media_id").cast("string"), F.lit(" ")))
    asked = lib["faces"].where("size_px >= 45").groupBy("media_id").agg(F.collect_list("id").alias("face_ids"))
    requests = asked.select((F.col("media_id") % 10).alias("ts"), F.col("media_id").alias("request"), name.alias("name"), "face_ids")
    people, log = edits.new_entities(lib["persons"], lib["faces"], requests)
    faces = edits.reassign_members(lib["faces"], log)
    made = people.join(lib["persons"].select("id"), "id", "left_anti").select(F.col("id").alias("person_id"), F.col("name").alias("new_name"))
    return faces.join(made, "person_id", "left").select("id", "person_id", "assigned_by", "new_name")


@query(with_tables(["festivals"], """
SELECT id, strftime(date + k, '%Y-%m-%d') AS date, strftime(start_date + k, '%Y-%m-%d') AS start, strftime(end_date + k, '%Y-%m-%d') AS stop, k > 0 AS user_edited
FROM (SELECT *, CASE WHEN festival <> 'sankranti' AND year % 2 = 1 THEN 3 ELSE 0 END AS k FROM festivals)"""))
def restored_windows(spark, sf):
    """Windows moved by three days, then those of even years set back to the built-in dates."""
    fests = library(spark, sf)["festivals"]
    none = F.lit(None).cast("date")
    log = fests.where("festival <> 'sankranti'").select("id", F.date_add("date", 3).alias("new_date"), none.alias("new_start"), none.alias("new_end"))
    moved, _ = edits.move_windows(fests, log)
    back = edits.reset_windows(moved, fests, moved.where("year % 2 = 0").select("id"))
    return back.select("id", day_text("date").alias("date"), day_text("start").alias("start"), day_text("end").alias("stop"), "user_edited")


@query(with_tables(["media"], """,
f AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN media m ON m.id = vec_id WHERE NOT missing),
s AS (SELECT label, i, avg(v[i]) AS a FROM f, range(1, 65) r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(a*a)) + 1e-8 AS l FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT s.label, list(a / l ORDER BY i) AS c FROM s JOIN n USING (label) GROUP BY 1)
SELECT CAST(f.label + 1 AS BIGINT) AS person_id, f.id, round(list_dot_product(v, c), 3) AS similarity FROM f JOIN c USING (label)"""))
def likely_mistakes(spark, sf):
    """Live members of each person with their similarity to its mean."""
    lib = library(spark, sf)
    faces = _vectors(spark, sf).select("id", F.col("id").alias("media_id"), (F.col("label") + 1).alias("person_id"), "embedding", F.lit("auto").alias("assigned_by"), F.lit(0.5).alias("quality"))
    return entities.likely_mistakes(faces, lib["media"], 64).select("person_id", "id", "similarity")


def _underived(spark, sf, *more: str) -> Library:
    """The collection as it is before anything was derived."""
    return library(spark, sf, Settings(event_gps_km=300, burst_threshold=26), without=("events", "event_media", "dup_groups", "dup_members", "media_tags", *more))


@query(f"""SELECT 'group ' || kind AS what, count(*) AS rows, CAST(sum(size) AS BIGINT) AS items FROM ({LIB_GROUPS}) GROUP BY 1
UNION ALL SELECT 'event ' || kind, count(*), CAST(sum(n) AS BIGINT) FROM ({REBUILT}) GROUP BY 1""")
def recomputed_library(spark, sf):
    """Groups and events by kind after a change of the gap between events, from which both follow."""
    lib = rebuild.recompute(_underived(spark, sf, "faces", "embeddings"), ["event_gap_hours"])
    sizes = lib["dup_groups"].select("kind", F.col("size").alias("n"))
    groups = sizes.groupBy(F.concat(F.lit("group "), F.col("kind")).alias("what")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items"))
    n = lib["event_media"].groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    events = lib["events"].join(n, "id").groupBy(F.concat(F.lit("event "), F.col("kind")).alias("what")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items"))
    return groups.unionByName(events)


@query(LIB_COMPONENTS + """,
f0 AS MATERIALIZED (SELECT vec_id AS id, (vec_id * 37 % 101) / 100.0 AS quality, CAST(embedding AS DOUBLE[]) AS v,
  CASE WHEN label < 5 AND vec_id < 100 THEN CAST(label + 1 AS BIGINT) END AS person FROM embeddings),""" + _matched("f0", "f1").replace("0.35", "0.42") + """,
seed AS MATERIALIZED (SELECT id, quality, v FROM f1 WHERE person IS NULL AND quality >= 0.30),""" + LEADERS.replace("{link}", "0.50") + """,
many AS (SELECT cluster FROM clusters k LEFT JOIN comp ON comp.id = k.id GROUP BY 1 HAVING count(DISTINCT coalesce('g' || g, 'm' || k.id)) >= 2),
fresh AS MATERIALIZED (SELECT cluster, 1000000000 + row_number() OVER (ORDER BY cluster) AS person FROM many),
f2 AS MATERIALIZED (SELECT f.id, quality, v, coalesce(f.person, n.person) AS person FROM f1 f LEFT JOIN clusters c ON c.id = f.id LEFT JOIN fresh n ON n.cluster = c.cluster),"""
+ _matched("f2", "f3").replace("0.35", "0.42") + f""",
built AS MATERIALIZED (SELECT count(*) AS n FROM ({REBUILT})),
tags AS (SELECT id FROM (WITH {CENTROIDS},
  l AS (SELECT vec_id AS id, label AS k, 100 * list_dot_product(CAST(embedding AS DOUBLE[]), c) AS x FROM (SELECT vec_id, embedding FROM embeddings) e, cents),
  p AS (SELECT id, k, exp(x - max(x) OVER (PARTITION BY id)) AS w FROM l), q AS (SELECT id, k, w / sum(w) OVER (PARTITION BY id) AS p FROM p)
  SELECT DISTINCT id FROM q WHERE p >= 0.35 AND k < 7))
SELECT (SELECT n FROM built) AS events, (SELECT n FROM built) AS created, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS kept_edited,
  (SELECT count(DISTINCT g) FROM comp) AS groups, (SELECT count(*) - count(DISTINCT g) FROM comp) AS hidden,
  (SELECT count(*) FROM f3 JOIN f0 ON f0.id = f3.id WHERE f0.person IS NULL AND f3.person IS NOT NULL) AS assigned, (SELECT count(*) FROM fresh) AS new_people,
  (SELECT count(*) FROM f3 WHERE person IS NULL) AS unassigned, (SELECT count(*) FROM tags) AS tagged""")
def analysis_batch(spark, sf):
    """The whole batch over a collection without derived tables: its one row of counts."""
    faces = _vectors(spark, sf).select(
        "id", F.col("id").alias("media_id"), (F.col("id") * 37 % 101 / 100.0).alias("quality"), "embedding",
        F.when((F.col("label") < 5) & (F.col("id") < 100), F.col("label") + 1).alias("person_id"), F.lit("auto").alias("assigned_by"),
        F.array().cast("array<bigint>").alias("not_person_ids"),
    )
    label = F.col("label")
    classes = _centroids(spark, sf).select(label.alias("class_id"), F.col("centroid").alias("class_vector"), F.concat(F.lit("tag"), label).alias("tag"), (label >= 7).alias("background"))
    _, summary = analysis.run_analysis(_underived(spark, sf).having(faces=faces), classes)
    return summary
