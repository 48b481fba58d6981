"""Lists, statistics, details and the story."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.checks.calendar import DAYS, STAGE_ROWS, _stages, calendar_sql
from tidemark.checks.registry import big, day_text, query, time_text
from tidemark.checks.standin import library, table, with_tables
from tidemark.operators import browse, changes, edits, entities, rollups, storyboard
from tidemark.operators.ordering import dense_index
from tidemark.params import Settings
from tidemark.plans import rebuild, views


@query(with_tables(["media"], """
SELECT CASE WHEN GROUPING_ID(kind, date_source, y) = 3 THEN 'kind' WHEN GROUPING_ID(kind, date_source, y) = 5 THEN 'date_source'
    WHEN GROUPING_ID(kind, date_source, y) = 6 THEN 'year' ELSE 'total' END AS facet, coalesce(kind, date_source, y) AS value, count(*) AS n,
  count(*) FILTER (error IS NOT NULL) AS with_errors
FROM (SELECT *, CAST(year(taken_at) AS VARCHAR) AS y FROM media WHERE NOT missing) GROUP BY GROUPING SETS ((kind), (date_source), (y), ())"""))
def library_stats(spark, sf):
    return rollups.library_stats(library(spark, sf)["media"])


@query(with_tables(["media", "dup_groups"], """
SELECT count(*) FILTER (NOT missing) AS total, count(*) FILTER (NOT missing AND kind='photo') AS photos, count(*) FILTER (NOT missing AND kind='video') AS videos,
  count(*) FILTER (NOT missing AND error IS NOT NULL) AS with_errors, count(*) FILTER (missing) AS missing,
  (SELECT count(*) FROM dup_groups) AS duplicate_groups, (SELECT CAST(coalesce(sum(size-1),0) AS BIGINT) FROM dup_groups) AS hidden_duplicates FROM media"""))
def library_totals(spark, sf):
    lib = library(spark, sf)
    return rollups.library_totals(lib["media"], lib["dup_groups"])


@query(with_tables(["media"], """
SELECT f.id, coalesce(n, 0) AS media_count FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS id FROM part) f
LEFT JOIN (SELECT folder_id, count(*) AS n FROM media WHERE NOT missing GROUP BY 1) m ON m.folder_id = f.id"""))
def folder_counts(spark, sf):
    folders = table(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("id")).distinct()
    return rollups.folder_counts(folders, library(spark, sf)["media"])


@query(with_tables(["media", "media_tags", "dup_groups", "dup_members", "hidden"], """
SELECT m.id, filename, date_source, strftime(m.taken_at, '%Y-%m-%d %H:%M:%S') AS taken_at, group_id, coalesce(g.size, 1) AS group_size
FROM media m LEFT JOIN dup_members d ON d.media_id = m.id LEFT JOIN dup_groups g ON g.id = d.group_id
WHERE NOT missing AND m.kind='photo' AND year(m.taken_at) = 1997 AND m.id IN (SELECT media_id FROM media_tags WHERE tag='temple')
  AND m.id NOT IN (SELECT media_id FROM hidden) ORDER BY m.taken_at DESC, m.id LIMIT 50 OFFSET 25"""))
def browse_page(spark, sf):
    """A filtered page of the library, newest first."""
    _, rows = views.list_media(library(spark, sf), kind="photo", year=1997, tag="temple", offset=25, limit=50)
    return rows.select("id", "filename", "date_source", time_text("taken_at").alias("taken_at"), "group_id", "group_size")


@query(with_tables(["media", "hidden"], """
SELECT date_source, count(*) AS n FROM media WHERE NOT missing AND id NOT IN (SELECT media_id FROM hidden) GROUP BY 1"""))
def visible_items(spark, sf):
    """Items after hiding lesser copies."""
    lib = library(spark, sf)
    return browse.browse(lib["media"], hidden=lib.hidden()).groupBy("date_source").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables(["media", "quality", "dup_groups", "dup_members"], """,
p AS (SELECT * FROM dup_groups ORDER BY taken_at DESC, id LIMIT 40)
SELECT group_id, p.size, media_id, d.media_id = best_media_id AS is_best, pinned_best AS pinned, q.total
FROM p JOIN dup_members d ON d.group_id = p.id JOIN media m ON m.id = d.media_id LEFT JOIN quality q USING (media_id)"""))
def duplicate_review(spark, sf):
    """Members of the newest 40 groups."""
    _, rows = views.duplicate_review(library(spark, sf), limit=40)
    return rows.select("group_id", "size", "media_id", "is_best", "pinned", "total")


@query(with_tables(["media", "quality", "hidden"], """,
v AS (SELECT m.*, total FROM media m LEFT JOIN quality q ON q.media_id = m.id WHERE NOT missing AND kind='photo' AND m.id NOT IN (SELECT media_id FROM hidden))
SELECT CAST(year(taken_at) AS BIGINT) AS year, count(*) AS photo_count, arg_max(id, (total, -id)) FILTER (total IS NOT NULL) AS cover_media_id FROM v GROUP BY 1"""))
def best_years(spark, sf):
    lib = library(spark, sf)
    rows = rollups.best_years(lib["media"], lib["quality"], lib.hidden())
    return rows.select(big("year"), "photo_count", "cover_media_id")


@query(with_tables(["media", "faces", "hidden"], """
SELECT person_id, count(*) AS face_count, count(DISTINCT media_id) AS photo_count, strftime(min(taken_at), '%Y-%m-%d %H:%M:%S') AS first_taken, strftime(max(taken_at), '%Y-%m-%d %H:%M:%S') AS last_taken
FROM faces f JOIN media m ON m.id = f.media_id WHERE person_id IS NOT NULL AND NOT missing AND m.id NOT IN (SELECT media_id FROM hidden) GROUP BY 1"""))
def entity_stats(spark, sf):
    lib = library(spark, sf)
    rows = entities.entity_stats(lib["faces"], lib["media"], lib.hidden())
    return rows.select("person_id", "face_count", "photo_count", time_text("first_taken").alias("first_taken"), time_text("last_taken").alias("last_taken"))


@query(with_tables(["media", "faces", "persons", "hidden"], """,
s AS (SELECT person_id, count(*) AS fc, count(DISTINCT media_id) AS pc FROM faces f JOIN media m ON m.id = f.media_id
  WHERE person_id IS NOT NULL AND NOT missing AND m.id NOT IN (SELECT media_id FROM hidden) GROUP BY 1)
SELECT row_number() OVER (ORDER BY name IS NULL, coalesce(pc, 0) DESC, coalesce(name, ''), id) AS position, id, name, coalesce(fc, 0) AS face_count, coalesce(pc, 0) AS photo_count
FROM persons LEFT JOIN s ON s.person_id = id WHERE NOT hidden"""))
def entity_directory(spark, sf):
    """Visible people in display order."""
    people, _ = views.people_list(library(spark, sf))
    order = [F.col("name").isNull(), F.col("photo_count").desc(), F.coalesce("name", F.lit("")), F.col("id")]
    return dense_index(people, order).select((F.col("_idx") + 1).alias("position"), "id", "name", "face_count", "photo_count")


@query(with_tables(["media", "faces", "persons"], """
SELECT 'unassigned_faces' AS what, (SELECT count(*) FROM faces JOIN media m ON m.id = media_id WHERE person_id IS NULL AND NOT missing) AS n
UNION ALL SELECT 'hidden_people', (SELECT count(*) FROM persons WHERE hidden)"""))
def directory_counts(spark, sf):
    return views.people_list(library(spark, sf))[1]


@query(with_tables(["media", "faces"], """
SELECT f.id, f.media_id, quality FROM faces f JOIN media m ON m.id = f.media_id WHERE person_id IS NULL AND NOT missing ORDER BY quality DESC, f.id LIMIT 120 OFFSET 60"""))
def review_queue(spark, sf):
    """A page of unassigned members, best first."""
    lib = library(spark, sf)
    return entities.review_queue(lib["faces"], lib["media"], 60, 120)[1].select("id", "media_id", "quality")


@query(with_tables(["media", "faces", "persons", "hidden"], """,
f AS (SELECT person_id, media_id, min(id) AS face_id FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT f.*, taken_at, birth_date AS birth, CAST(taken_at AS DATE) AS seen FROM f JOIN media m ON m.id = f.media_id AND NOT missing JOIN persons p ON p.id = f.person_id WHERE m.id NOT IN (SELECT media_id FROM hidden)),
a AS (SELECT *, (year(seen)-year(birth))*12 + month(seen)-month(birth) - CASE WHEN day(seen)<day(birth) THEN 1 ELSE 0 END AS mo, date_diff('day', birth, seen) AS d FROM b)
SELECT person_id, media_id, face_id, CASE WHEN birth IS NULL THEN NULL WHEN seen<birth THEN 'Before birth' WHEN mo=0 AND d=0 THEN 'Newborn'
  WHEN mo=0 THEN d || CASE WHEN d=1 THEN ' day' ELSE ' days' END WHEN mo<12 THEN mo || CASE WHEN mo=1 THEN ' mo' ELSE ' mos' END
  WHEN mo>=216 OR mo%12=0 THEN (mo//12) || CASE WHEN mo//12=1 THEN ' yr' ELSE ' yrs' END
  ELSE (mo//12) || CASE WHEN mo//12=1 THEN ' yr' ELSE ' yrs' END || ' ' || (mo%12) || CASE WHEN mo%12=1 THEN ' mo' ELSE ' mos' END END AS age FROM a"""))
def person_timeline(spark, sf):
    """Every person's items with the age on that day."""
    return views.person_timeline(library(spark, sf)).select("person_id", "media_id", "face_id", "age")


EVENT_PARTS = """,
copies AS (SELECT m.*, m.id IN (SELECT media_id FROM hidden) AS copy FROM media m WHERE NOT missing),
mem AS MATERIALIZED (SELECT event_id, c.* FROM event_media JOIN copies c ON c.id = media_id),
size_ AS (SELECT event_id, count(*) FILTER (kind='photo') AS photo_count, count(*) FILTER (kind='video') AS video_count, count(*) FILTER (kind='photo' AND NOT copy) AS shown FROM mem GROUP BY 1),
tag_n AS (SELECT event_id, tag, count(*) AS n FROM mem JOIN media_tags t ON t.media_id = mem.id WHERE kind='photo' AND NOT copy GROUP BY 1, 2),
top_tags AS MATERIALIZED (SELECT event_id, tag, n FROM tag_n JOIN size_ USING (event_id) WHERE n >= greatest(1, ceil(0.3::DOUBLE * shown))),
face_n AS (SELECT event_id, person_id, count(*) AS n FROM (SELECT DISTINCT event_id, mem.id, f.person_id FROM mem JOIN faces f ON f.media_id = mem.id JOIN persons p ON p.id = f.person_id AND NOT p.hidden WHERE NOT copy) GROUP BY 1, 2),
top_people AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, person_id) AS r FROM face_n) WHERE r <= 6)"""
EVENT_TABLES = ["events", "event_media", "media_tags", "faces", "persons", "hidden"]


@query(calendar_sql(EVENT_TABLES, EVENT_PARTS + "SELECT event_id, tag, n FROM top_tags"))
def dominant_tags(spark, sf):
    lib = library(spark, sf)
    members, items = lib.live_members().select("event_id", "id"), lib.curation_items()
    return rollups.dominant_tags(members, items, lib["media_tags"], "event_id")


@query(calendar_sql(EVENT_TABLES, EVENT_PARTS + "SELECT event_id, person_id, n, r AS rank FROM top_people"))
def top_people(spark, sf):
    lib = library(spark, sf)
    members, items = lib.live_members().select("event_id", "id"), lib.curation_items()
    counts = rollups.people_counts(members, items, lib["faces"], lib["persons"], "event_id")
    top = rollups.top_k_per_group(counts, ["event_id"], [F.col("n").desc(), F.col("person_id")], 6)
    return top.select("event_id", "person_id", "n", big("rank"))


SUMMARY = EVENT_PARTS + DAYS + """,
first_hit AS (SELECT event_id, arg_min(name, rank) AS name, count(*) AS n FROM hits GROUP BY 1),
lead_tag AS (SELECT event_id, arg_min(tag, (-n, tag)) AS tag, string_agg(tag, ',' ORDER BY n DESC, tag) AS tags FROM top_tags GROUP BY 1),
txt AS (SELECT id, CASE WHEN CAST(start_at AS DATE) = CAST(end_at AS DATE) THEN strftime(start_at, '%-d %b %Y') ELSE 'range' END AS t FROM events_),
summary AS MATERIALIZED (SELECT e.id, e.kind, CASE WHEN e.id % 50 = 0 THEN 'Day ' || e.id WHEN e.kind='moments' THEN 'Moments · ' || strftime(start_at, '%B %Y') WHEN h.name IS NOT NULL THEN h.name
    WHEN l.tag IS NOT NULL THEN CASE l.tag WHEN 'temple' THEN 'Temple visit' WHEN 'travel' THEN 'Trip' ELSE 'Beach day' END || ' · ' || txt.t ELSE txt.t END AS title,
  coalesce(photo_count, 0) AS photo_count, coalesce(video_count, 0) AS video_count, coalesce(h.n, 0) AS occasions, coalesce(l.tags, '') AS tags,
  coalesce((SELECT string_agg(person_id, ',' ORDER BY r) FROM top_people p WHERE p.event_id = e.id), '') AS people, start_at
FROM events_ e LEFT JOIN size_ s ON s.event_id = e.id LEFT JOIN first_hit h ON h.event_id = e.id LEFT JOIN lead_tag l ON l.event_id = e.id JOIN txt ON txt.id = e.id)"""


@query(calendar_sql([*EVENT_TABLES, "festivals", "recurring"], SUMMARY + """
SELECT id, kind, title, photo_count, video_count, occasions, tags, people FROM summary WHERE photo_count + video_count > 0"""))
def event_list(spark, sf):
    """Titles, counts, tags and people of every event."""
    rows = views.event_list(library(spark, sf))
    return rows.select(
        "id", "kind", "title", "photo_count", "video_count", F.col("occasion_count").alias("occasions"),
        F.coalesce(F.array_join(F.transform("tags", lambda t: t["tag"]), ","), F.lit("")).alias("tags"),
        F.coalesce(F.array_join(F.transform("people", lambda p: p["id"].cast("string")), ","), F.lit("")).alias("people"),
    )


ST = ",".join(f"({i},'{n}',DATE '{d}','{k}')" for i, n, d, k in STAGE_ROWS)


@query(calendar_sql([*EVENT_TABLES, "festivals", "recurring"], SUMMARY + f""",
st(id, name, start, kind) AS (VALUES {ST}),
ch AS (SELECT row_number() OVER (ORDER BY start, id) AS chapter, name, start, lead(start) OVER (ORDER BY start, id) AS stop FROM st UNION ALL SELECT 0, 'Early years', NULL, min(start) FROM st),
mile AS (SELECT year(birth_date) AS y, birth_date AS d FROM persons WHERE birth_date IS NOT NULL AND name IS NOT NULL AND NOT hidden
  UNION ALL SELECT year, make_date(year::INTEGER, month::INTEGER, least(day, day(last_day(make_date(year::INTEGER, month::INTEGER, 1))))::INTEGER) FROM occasions WHERE kind='anniversary' AND year IS NOT NULL),
pe AS (SELECT chapter, name, year(start_at) AS y, photo_count AS p, 1 AS e, 0 AS m FROM summary JOIN ch ON (start IS NULL OR CAST(start_at AS DATE) >= start) AND (stop IS NULL OR CAST(start_at AS DATE) < stop) WHERE photo_count + video_count > 0
  UNION ALL SELECT chapter, name, y, 0, 0, 1 FROM mile JOIN ch ON (start IS NULL OR d >= start) AND (stop IS NULL OR d < stop))
SELECT CAST(chapter AS BIGINT) AS chapter, name, CAST(y AS BIGINT) AS year, CAST(sum(p) AS BIGINT) AS photo_count, CAST(sum(e) AS BIGINT) AS events, CAST(sum(m) AS BIGINT) AS milestones,
  (SELECT CASE WHEN y < year(birth_date) THEN NULL WHEN y = year(birth_date) THEN o.name || ' born' ELSE o.name || ' turns ' || (y - year(birth_date)) END FROM persons o WHERE id = 6 AND NOT hidden) AS age
FROM pe GROUP BY chapter, name, y"""))
def life_story(spark, sf):
    """Chapters and years of the collection with their events and milestones."""
    lib = library(spark, sf, Settings(story_person_id=6)).having(stages=_stages(spark))
    rows = views.story(lib)["years"]
    return rows.select(
        big("chapter"), F.col("chapter_name").alias("name"), big("year"), big("photo_count"), big("events"), big("milestones"), "age"
    )


@query(with_tables(["media"], """
SELECT strftime(date_trunc('month', taken_at), '%B %Y') AS label, count(*) AS n, arg_min(id, (taken_at, id)) AS first_id, arg_max(id, (taken_at, id)) AS last_id
FROM media WHERE NOT missing GROUP BY 1"""))
def month_headers(spark, sf):
    rows = rollups.runs_by_month(browse.live(library(spark, sf)["media"]))
    return rows.select("label", "n", "first_id", "last_id")


@query(with_tables(["media"], """,
o AS (SELECT *, row_number() OVER (ORDER BY taken_at, id) - 1 AS idx, kind='photo' AND height > width AS por FROM media WHERE NOT missing AND error IS NULL),
l AS (SELECT *, CASE WHEN por AND lag(por) OVER (ORDER BY idx) AND lag(year(taken_at)) OVER (ORDER BY idx) = year(taken_at) THEN NULL ELSE idx END AS st FROM o),
r AS (SELECT *, last_value(st IGNORE NULLS) OVER (ORDER BY idx) AS run FROM l),
s AS (SELECT *, CASE WHEN por THEN idx - (idx - run) % 2 ELSE idx END AS at_ FROM r),
g AS (SELECT at_, count(*) AS n, arg_min(id, idx) AS first_id, CASE WHEN count(*) = 2 THEN arg_max(id, idx) END AS second_id, any_value(year(taken_at)) AS y, any_value(kind) AS k, any_value(duration_s) AS d FROM s GROUP BY 1),
slide AS (SELECT at_, 1 AS layer, CASE WHEN k='video' THEN 'clip' WHEN n=2 THEN 'pair' ELSE 'slide' END AS segment, first_id, second_id, y,
   CASE WHEN k='video' THEN least(6.0, CASE WHEN coalesce(d,0)=0 THEN 6.0 ELSE d END) WHEN n=2 THEN 4.8 ELSE 4.2 END::DOUBLE AS duration FROM g),
yc AS (SELECT min(at_) AS at_, 0, 'year', (SELECT arg_min(id, (taken_at, id)) FROM o WHERE kind='photo' AND year(taken_at) = y), NULL, y, 2.8::DOUBLE FROM slide GROUP BY y),
al AS (SELECT * FROM slide UNION ALL SELECT * FROM yc
  UNION ALL SELECT -1, 0, 'title', (SELECT arg_min(id, (taken_at, id)) FROM o WHERE kind='photo'), NULL, NULL, 4.5
  UNION ALL SELECT 1000000000, 0, 'end', (SELECT arg_max(id, (taken_at, id)) FROM o WHERE kind='photo'), NULL, NULL, 4.0)
SELECT row_number() OVER w - 1 AS position, segment, first_id, second_id, CAST(y AS BIGINT) AS year, duration,
  round(coalesce(sum(duration - 0.9) OVER (ORDER BY at_, layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start
FROM al WINDOW w AS (ORDER BY at_, layer)"""))
def storyboard_plan(spark, sf):
    """Cards, slides, pairs and clips of the whole collection with their start times."""
    rows = storyboard.storyboard(browse.live(library(spark, sf)["media"], clean=True))
    return rows.select("position", "segment", "first_id", "second_id", big("year"), "duration", F.round("start", 2).alias("start"))


@query(calendar_sql([*EVENT_TABLES, "festivals", "recurring"], SUMMARY + """
SELECT media_id, event_id, title FROM event_media JOIN summary ON summary.id = event_id"""))
def item_events(spark, sf):
    """The event of every item, with its title."""
    return views.item_event(library(spark, sf)).select("media_id", "event_id", "title")


@query(with_tables(["events"], "").replace("events AS MATERIALIZED", "events_ AS MATERIALIZED") + """
SELECT DISTINCT CAST(y AS BIGINT) AS year FROM (SELECT year(start_at) AS y FROM events_ UNION ALL SELECT year(end_at) FROM events_)""")
def event_years(spark, sf):
    return rollups.distinct_years(library(spark, sf)["events"], "start_at", "end_at").select(big("year"))


@query(calendar_sql(["events", "event_media"], """
SELECT e.id, strftime(CASE WHEN e.id % 50 = 0 THEN least(e.start_at - INTERVAL 2 HOUR, min(taken_at)) ELSE min(taken_at) END, '%Y-%m-%d %H:%M:%S') AS start_at,
  strftime(CASE WHEN e.id % 50 = 0 THEN greatest(e.end_at - INTERVAL 2 HOUR, max(taken_at)) ELSE max(taken_at) END, '%Y-%m-%d %H:%M:%S') AS end_at
FROM events_ e JOIN event_media ON event_id = e.id JOIN media m ON m.id = media_id AND NOT missing GROUP BY e.id, e.start_at, e.end_at"""))
def fitted_events(spark, sf):
    """Event ranges fitted to their live members; locked custom ones only widen."""
    lib = library(spark, sf)
    early = F.timestamp_add("HOUR", F.lit(-2), F.col("start_at")).cast("timestamp_ntz")
    ends = F.timestamp_add("HOUR", F.lit(-2), F.col("end_at")).cast("timestamp_ntz")
    custom = lib["events"].withColumn("kind", F.when(F.col("locked"), "custom").otherwise(F.col("kind")))
    custom = custom.withColumn("start_at", early).withColumn("end_at", ends)
    members = lib.live_members()
    rows = rebuild.fit_events(custom, members).join(members.select(F.col("event_id").alias("id")).distinct(), "id")
    return rows.select("id", time_text("start_at").alias("start_at"), time_text("end_at").alias("end_at"))


@query(with_tables(["media", "faces"], """
SELECT m.id AS media_id, count(f.id) AS faces, round(avg(CASE WHEN size_px >= 20 THEN CASE WHEN assigned_by='user' THEN 1.0 ELSE 0.0 END END), 6) AS eyes_open,
  round(avg(CASE WHEN size_px >= 20 THEN quality END), 6) AS subject_sharpness FROM media m LEFT JOIN faces f ON f.media_id = m.id GROUP BY 1"""))
def subject_quality(spark, sf):
    """Judged sub-objects of every item."""
    lib = library(spark, sf)
    faces = lib["faces"].withColumn("eyes_open", F.col("assigned_by") == "user").withColumn("sharpness", F.col("quality"))
    rows = entities.subject_quality(lib["media"], faces, 20)
    return rows.select("media_id", "faces", F.round("eyes_open", 6).alias("eyes_open"), F.round("subject_sharpness", 6).alias("subject_sharpness"))


@query(with_tables(["media", "dup_members"], """,
p AS (SELECT group_id, max(media_id) AS pin FROM dup_members GROUP BY 1)
SELECT m.id, CASE WHEN d.media_id IS NOT NULL THEN m.id = p.pin ELSE pinned_best END AS pinned FROM media m LEFT JOIN dup_members d ON d.media_id = m.id LEFT JOIN p USING (group_id)"""))
def pinned_items(spark, sf):
    """Items after pinning the newest member of every group."""
    lib = library(spark, sf)
    pins = lib["dup_members"].groupBy("group_id").agg(F.max("media_id").alias("media_id")).withColumn("ts", F.lit(1))
    media, _ = edits.pin_best(lib["media"], lib["dup_members"], pins)
    return media.select("id", F.col("pinned_best").alias("pinned"))


@query(with_tables(["media", "faces", "media_tags"], """
SELECT 'media' AS name, count(*) AS n FROM media WHERE folder_id <> 2
UNION ALL SELECT 'faces', count(*) FROM faces WHERE media_id NOT IN (SELECT id FROM media WHERE folder_id = 2)
UNION ALL SELECT 'media_tags', count(*) FROM media_tags WHERE media_id NOT IN (SELECT id FROM media WHERE folder_id = 2)
UNION ALL SELECT 'forgotten', count(*) FROM media WHERE folder_id = 2"""))
def forgotten_folder(spark, sf):
    """Rows that stay in each table after forgetting one folder."""
    lib = library(spark, sf)
    names = ("media", "faces", "media_tags")
    left, gone = changes.forget_folder({n: lib[n] for n in names}, 2)
    out = gone.select(F.lit("forgotten").alias("name"), F.col("media_forgotten").alias("n"))
    for n in names:
        out = out.unionByName(left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n"))
    return out
