"""Festivals, recurring dates, chapters, stages, on this day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.checks.embedding import CUR_TABLES, GREEDY, PEOPLE
from tidemark.checks.registry import big, day_text, query, time_text
from tidemark.checks.standin import library, table, with_tables
from tidemark.functions.dates import chapter_age, turns_label
from tidemark.operators import occasions as occ
from tidemark.plans import views

DAYS = """,
ranges AS (SELECT id, CAST(start_at AS DATE) AS d0, CAST(end_at AS DATE) AS d1 FROM events_ WHERE kind <> 'moments'),
hits AS MATERIALIZED (
  SELECT e.id AS event_id, 'festival' AS kind, festival AS key,
    CASE festival WHEN 'sankranti' THEN 'Sankranti' WHEN 'holi' THEN 'Holi' ELSE 'Deepavali' END || ' ' || f.year AS name, f.date AS date, NULL::BIGINT AS person_id,
    (1, f.date, f.start_date, 0, 0::BIGINT) AS rank
  FROM ranges e JOIN festivals f ON f.start_date <= e.d1 AND f.end_date >= e.d0
  UNION ALL
  SELECT id, kind, key, CASE
      WHEN kind='birthday' THEN CASE WHEN n = 0 THEN name || ' is born' WHEN n > 0 THEN name || '''s ' || n || th || ' birthday' ELSE name || '''s birthday' END
      WHEN kind='anniversary' THEN CASE WHEN n = 0 THEN name || ': wedding day' WHEN n > 0 THEN name || ': ' || n || th || ' anniversary' ELSE name || ': anniversary' END
      ELSE name END, d, person_id, (0, d, d, source, ref)
  FROM (SELECT *, CASE WHEN n%100 BETWEEN 10 AND 20 THEN 'th' WHEN n%10=1 THEN 'st' WHEN n%10=2 THEN 'nd' WHEN n%10=3 THEN 'rd' ELSE 'th' END AS th
    FROM (SELECT e.id, r.*, CAST(t.d AS DATE) AS d, year(t.d) - nullif(r.first_year, 0) AS n
      FROM ranges e, generate_series(e.d0, e.d1, INTERVAL 1 DAY) t(d) JOIN recurring r
        ON month(t.d) = r.month AND day(t.d) = least(r.day, day(last_day(t.d))) AND (coalesce(r.first_year, 0) = 0 OR year(t.d) >= r.first_year))))"""


def calendar_sql(tables, rest):
    """The stand-in ``events`` table would hide the driver's; it is called ``events_``."""
    return with_tables(tables, rest).replace("events AS MATERIALIZED", "events_ AS MATERIALIZED")


@query(calendar_sql(["events", "festivals", "recurring"], DAYS + """
SELECT event_id, kind, key, name, strftime(date, '%Y-%m-%d') AS date, person_id FROM hits"""))
def event_occasions(spark, sf):
    """Festivals and family dates within every event."""
    rows = views.event_occasions(library(spark, sf))
    return rows.select("event_id", "kind", "key", "name", day_text("date").alias("date"), "person_id")


@query(with_tables(["recurring"], """
SELECT CASE WHEN source = 0 THEN r.ref END AS id, r.kind, r.name, r.month, r.day, first_year AS year, r.person_id, p.name AS person_name,
  CASE WHEN source = 0 THEN 'occasion' ELSE 'person' END AS source
FROM recurring r LEFT JOIN persons p ON p.id = r.person_id"""))
def calendar_list(spark, sf):
    """Explicit occasions and derived birthdays."""
    lib = library(spark, sf)
    rows = occ.calendar_list(lib["occasions"], lib["persons"])
    return rows.select("id", "kind", "name", big("month"), big("day"), big("year"), "person_id", "person_name", "source")


STAGE_ROWS = [(1, "School", "1995-06-01", "school"), (2, "College", "1997-01-15", "college"), (3, "Gap", "1997-01-15", "custom"), (4, "Work", "1999-09-09", "career")]


def _stages(spark):
    rows = spark.createDataFrame(STAGE_ROWS, "id long, name string, start string, kind string")
    return rows.withColumn("start", F.col("start").cast("date"))


@query("""
WITH st(id, name, start, kind) AS (VALUES (1,'School',DATE '1995-06-01','school'),(2,'College',DATE '1997-01-15','college'),(3,'Gap',DATE '1997-01-15','custom'),(4,'Work',DATE '1999-09-09','career')),
ch AS (SELECT id AS stage_id, name, kind, start, lead(start) OVER (ORDER BY start, id) AS stop FROM st
  UNION ALL SELECT NULL, 'Early years', 'early', NULL, min(start) FROM st)
SELECT coalesce(CAST(stage_id AS BIGINT), 0) AS stage, name, kind, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first,
  CASE WHEN start IS NULL THEN NULL WHEN stop IS NULL THEN 'From age ' || (year(start)-1980) ELSE
    CASE WHEN year(stop)-1980 - (CASE WHEN strftime(stop,'%m%d') < '0301' THEN 1 ELSE 0 END) <= year(start)-1980 - (CASE WHEN strftime(start,'%m%d') < '0301' THEN 1 ELSE 0 END)
      THEN 'Age ' || (year(start)-1980 - (CASE WHEN strftime(start,'%m%d') < '0301' THEN 1 ELSE 0 END))
      ELSE 'Age ' || (year(start)-1980 - (CASE WHEN strftime(start,'%m%d') < '0301' THEN 1 ELSE 0 END)) || ' – ' || (year(stop)-1980 - (CASE WHEN strftime(stop,'%m%d') < '0301' THEN 1 ELSE 0 END)) END END AS age
FROM orders JOIN ch ON (start IS NULL OR CAST(o_orderdate AS DATE) >= start) AND (stop IS NULL OR CAST(o_orderdate AS DATE) < stop)
GROUP BY stage_id, name, kind, start, stop""")
def chapters_asof(spark, sf):
    """Every order placed in its chapter of a life."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = occ.place_in_chapters(o, _stages(spark), "o_orderdate")
    birth = F.lit("1980-03-01").cast("date")
    return (
        rows.groupBy("stage_id", "chapter_name", "chapter_kind", "chapter_start", "chapter_end")
        .agg(F.count(F.lit(1)).alias("n"), day_text(F.min("o_orderdate")).alias("first"))
        .select(
            F.coalesce("stage_id", F.lit(0).cast("bigint")).alias("stage"),
            F.col("chapter_name").alias("name"),
            F.col("chapter_kind").alias("kind"),
            "n",
            "first",
            chapter_age(birth, F.col("chapter_start"), F.col("chapter_end")).alias("age"),
        )
    )


@query("""
WITH c AS (SELECT c_custkey AS id, DATE '1960-01-01' + CAST(c_custkey * 97 % 15000 AS INTEGER) AS birth, c_nationkey AS nation, c_acctbal < 0 AS hidden FROM customer),
w AS (SELECT *, (SELECT min(x.d) FROM (SELECT DISTINCT make_date(1975 + CAST(o_custkey % 30 AS INTEGER), month(o_orderdate)::INTEGER, 15) AS d FROM orders) x
    WHERE x.d >= (birth + INTERVAL 16 YEAR)) AS wedding FROM c),
k AS (SELECT w.*, (SELECT min(x.birth) FROM c x WHERE NOT x.hidden AND x.birth >= coalesce(w.wedding, w.birth + INTERVAL 18 YEAR)) AS kid FROM w),
p AS (SELECT id AS person_id, unnest([0,1,2,3,4,5]) AS position, unnest(['childhood','school','college','career','marriage','kids']) AS kind,
  unnest([birth, CAST(birth + INTERVAL 5 YEAR AS DATE), CAST(birth + INTERVAL 17 YEAR AS DATE), CASE WHEN wedding IS NULL OR wedding > birth + INTERVAL 23 YEAR THEN CAST(birth + INTERVAL 22 YEAR AS DATE) END, wedding, kid]) AS start, nation FROM k)
SELECT person_id, CAST(position AS BIGINT) AS position, kind, strftime(start, '%Y-%m-%d') AS start FROM p
WHERE start <= DATE '2001-06-01' AND NOT (kind = 'college' AND nation = 3)""")
def life_stages(spark, sf):
    """Suggested stages of every customer's life; those of one nation have edited their college."""
    c = table(spark, sf, "customer")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 97 % 15000).cast("int"))
    people = c.select(F.col("c_custkey").alias("id"), birth.alias("birth_date"), (F.col("c_acctbal") < 0).alias("hidden"), "c_nationkey")
    o = table(spark, sf, "orders")
    weddings = o.select(
        F.lit("anniversary").alias("kind"), (1975 + F.col("o_custkey") % 30).cast("int").alias("year"), F.month("o_orderdate").alias("month"), F.lit(15).alias("day")
    ).distinct()
    kept = people.where("c_nationkey = 3").select(F.col("id").alias("person_id"), F.lit("college").alias("kind"))
    rows = occ.suggest_stages(people, people, weddings, kept, F.lit("2001-06-01").cast("date"))
    return rows.select("person_id", big("position"), "kind", day_text("start").alias("start"))


OTD = """,
base AS (SELECT *, year(ts) AS y, strftime(ts, '%m%d') AS md FROM cur WHERE has_thumb AND NOT copy AND year(ts) < {year}),
rows_ AS MATERIALIZED (SELECT * FROM base WHERE md IN ({day}) OR (NOT EXISTS (SELECT 1 FROM base WHERE md IN ({day})) AND md IN ({week}))),"""


@query(with_tables(CUR_TABLES, PEOPLE + OTD.format(year=2001, day="'0714'", week="'0711','0712','0713','0714','0715','0716','0717'") + """
cand AS (SELECT id, sig, vec, score, ts, y AS g FROM rows_ WHERE kind='photo'),""" + GREEDY.replace("{k}", "3") + """,
early AS (SELECT y, id FROM (SELECT y, id, row_number() OVER (PARTITION BY y ORDER BY ts, id) AS r FROM rows_ WHERE y NOT IN (SELECT g FROM cand)) WHERE r <= 3),
totals AS (SELECT y, count(*) AS total FROM rows_ GROUP BY y)
SELECT CAST(t.y AS BIGINT) AS year, CASE WHEN 2001-t.y = 1 THEN 'A year ago' ELSE (2001-t.y) || ' years ago' END AS label,
  'day' AS span, total, p.id FROM totals t JOIN (SELECT g AS y, id FROM final UNION ALL SELECT y, id FROM early) p ON p.y = t.y"""))
def on_this_day(spark, sf):
    """What was taken on one calendar day in earlier years, with picks."""
    lib = library(spark, sf)
    years, picks = views.on_this_day(lib, date(2001, 7, 14), per_year=3)
    return years.join(picks, "year").select(big("year"), "label", "span", "total", "id")


@query("""
SELECT CAST(year(ts) AS BIGINT) AS year, 'week' AS span, count(*) AS n FROM events
WHERE strftime(ts, '%m%d') IN ('0129','0130','0131','0201','0202','0203','0204') AND NOT EXISTS (SELECT 1 FROM events WHERE strftime(ts, '%m%d') = '0201') GROUP BY 1""")
def same_week(spark, sf):
    """A day without any item falls back to the days around it: no event is on a first of February."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("taken_at"))
    rows = occ.on_this_day(e, date(2027, 2, 1))
    return rows.groupBy(big("year"), "span").agg(F.count(F.lit(1)).alias("n"))


@query(calendar_sql(["events", "festivals"], """
SELECT f.id AS festival_id, festival, CASE festival WHEN 'sankranti' THEN 'Bhogi, Sankranti & Kanuma' WHEN 'holi' THEN 'Holika Dahan & Holi' ELSE 'Naraka Chaturdashi & Deepavali' END AS note,
  CAST(f.year AS BIGINT) AS year, strftime(f.date, '%Y-%m-%d') AS date, e.id AS event_id
FROM festivals f LEFT JOIN events_ e ON e.kind <> 'moments' AND CAST(e.start_at AS DATE) <= f.end_date AND CAST(e.end_at AS DATE) >= f.start_date"""))
def festival_events(spark, sf):
    """Festivals of all years with the events that overlap them."""
    rows = views.festival_year(library(spark, sf))
    return rows.select("festival_id", "festival", "note", big("year"), day_text("date").alias("date"), "event_id")


@query(calendar_sql(["events", "festivals"], """
SELECT CAST(f.year AS BIGINT) AS year, e.id AS event_id FROM festivals f JOIN events_ e
ON e.kind <> 'moments' AND CAST(e.start_at AS DATE) <= f.end_date AND CAST(e.end_at AS DATE) >= f.start_date WHERE festival = 'diwali'"""))
def festival_history(spark, sf):
    return views.festival_history(library(spark, sf), "diwali").select(big("year"), "event_id")


@query(calendar_sql(["events"], """
SELECT CAST(year(t.d) AS BIGINT) AS year, e.id AS event_id FROM events_ e, generate_series(CAST(e.start_at AS DATE), CAST(e.end_at AS DATE), INTERVAL 1 DAY) t(d)
WHERE e.kind <> 'moments' AND month(t.d) = 2 AND day(t.d) = least(29, day(last_day(t.d))) AND year(t.d) >= 1996"""))
def leap_day_history(spark, sf):
    """A 29 February date across all years from 1996."""
    return views.occasion_history(library(spark, sf), 2, 29, 1996).select(big("year"), "event_id")


@query("""
SELECT c_custkey AS id, CAST(y AS BIGINT) AS year, CASE WHEN y < b THEN NULL WHEN y = b THEN c_name || ' born' ELSE c_name || ' turns ' || (y - b) END AS label
FROM (SELECT c_custkey, c_name, year(DATE '1960-01-01' + CAST(c_custkey * 97 % 15000 AS INTEGER)) AS b FROM customer) c
JOIN (SELECT o_custkey, year(o_orderdate) AS y FROM orders GROUP BY ALL) o ON o_custkey = c_custkey""")
def turning_years(spark, sf):
    """Age of every customer in each year in which they ordered."""
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 97 % 15000).cast("int"))
    years = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).distinct()
    rows = table(spark, sf, "customer").select("c_custkey", "c_name").join(years, "c_custkey")
    return rows.select(F.col("c_custkey").alias("id"), big("y", "year"), turns_label(F.col("c_name"), birth, F.col("y")).alias("label"))
