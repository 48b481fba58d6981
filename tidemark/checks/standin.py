"""A collection laid over the driver's tables, in Spark and in SQL.

Orders stand for items, line items for sub-objects and tags, suppliers for people, nations
for occasions, order days for events. Every table is derived from all rows of its source.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.duplicates import content_key
from tidemark.params import Settings
from tidemark.plans.library import Library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus_minutes(ts, minutes):
    return F.timestamp_add("MINUTE", minutes, ts)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cust, price = F.col("o_custkey"), F.col("o_totalprice")
    folder = F.substring("o_orderpriority", 1, 1).cast("bigint")
    trait = F.concat_ws("|", cust.cast("string"), F.year("o_orderdate").cast("string"), F.col("o_orderstatus"))
    even = cust % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("id"),
        folder.alias("folder_id"),
        F.concat(F.lit("trip/IMG_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("rel_path"),
        F.concat(F.lit("IMG_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"),
        F.lit(".jpg").alias("ext"),
        F.when(F.col("o_orderstatus") == "P", "video").otherwise("photo").alias("kind"),
        F.floor(price).alias("size"),
        (cust * 1000).alias("mtime_ns"),
        F.sha2(F.concat_ws("|", trait, F.col("o_orderpriority")), 256).alias("sha256"),
        F.when(even, 4000).otherwise(3000).alias("width"),
        F.when(even, 3000).otherwise(4000).alias("height"),
        F.when(F.col("o_orderstatus") == "P", (cust % 20).cast("double")).alias("duration_s"),
        F.lit(1).alias("orientation"),
        plus_minutes(F.col("o_orderdate"), (cust % 600).cast("int")).cast("timestamp_ntz").alias("taken_at"),
        F.when(folder <= 2, "exif").when(folder == 3, "video_meta").when(folder == 4, "filename").otherwise("mtime").alias("date_source"),
        F.when(folder <= 3, "high").when(folder == 4, "medium").otherwise("low").alias("date_confidence"),
        F.when(F.col("o_orderstatus") != "O", F.lit(10.0) + (cust * 37 % 2000) / 100.0).alias("gps_lat"),
        F.when(F.col("o_orderstatus") != "O", F.lit(70.0) + (cust * 53 % 2000) / 100.0).alias("gps_lon"),
        F.lit(None).cast("string").alias("camera"),
        F.substring(F.md5(trait), 1, 16).alias("phash"),
        ((price > 400000) & (folder == 1)).alias("pinned_best"),
        F.lit(0).alias("user_rotation"),
        (folder != 5).alias("has_thumb"),
        (price > 490000).alias("missing"),
        F.when(price < 5000, "unreadable").alias("error"),
        F.col("o_orderdate").alias("scanned_at"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "O")
    third = F.col("o_custkey") % 3
    return o.select(
        F.col("o_orderkey").alias("media_id"),
        F.when(third == 0, 1).otherwise(2).alias("version"),
        (F.col("o_custkey") * 1000).alias("media_mtime_ns"),
        F.lit(100.0).alias("sharpness_raw"),
        (F.col("o_custkey") % 100 / 100.0).alias("sharpness"),
        F.lit(0.5).alias("exposure"),
        F.lit(0.5).alias("resolution"),
        F.lit(0).alias("faces"),
        F.lit(None).cast("double").alias("face_score"),
        F.lit(None).cast("double").alias("eyes_open"),
        F.lit(None).cast("double").alias("aesthetic_raw"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 10 / 10.0).alias("aesthetic"),
        (F.floor(F.col("o_totalprice") / 500) / 10.0).alias("total"),
        F.when(third == 1, "clip").otherwise("clip,faces").alias("models_used"),
        F.col("o_orderdate").alias("analyzed_at"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_suppkey").alias("supp"),
            F.max("l_quantity").alias("q"),
            F.min("l_returnflag").alias("flag"),
        )
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("media_id"),
            (F.col("l_linenumber") / 10.0).alias("x"),
            F.lit(0.1).alias("y"),
            F.lit(0.2).alias("w"),
            F.lit(0.2).alias("h"),
            F.col("q").cast("int").alias("size_px"),
            (F.col("q") / 50.0).alias("quality"),
            F.when(F.col("flag") != "N", F.col("supp") + 1).alias("person_id"),
            F.when(F.col("flag") == "A", "user").otherwise("auto").alias("assigned_by"),
            F.array().cast("array<bigint>").alias("not_person_ids"),
        )
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("s_suppkey") * 97 % 15000).cast("int"))
    return s.select(
        (F.col("s_suppkey") + 1).alias("id"),
        F.when(F.col("s_acctbal") > 2000, F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") != 3, birth).alias("birth_date"),
        (F.col("s_nationkey") == 7).alias("hidden"),
        F.lit(None).cast("bigint").alias("cover_face_id"),
    )


def occasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(
        (key + 1).cast("bigint").alias("id"),
        F.when(F.col("n_regionkey") == 0, "birthday").when(F.col("n_regionkey") == 1, "anniversary").otherwise("other").alias("kind"),
        F.col("n_name").alias("name"),
        (key % 12 + 1).alias("month"),
        F.when(key == 13, 29).otherwise(key + 1).alias("day"),
        F.when(key % 3 != 0, 1980 + key).alias("year"),
        F.when(F.col("n_regionkey") == 0, (key + 1).cast("bigint")).alias("person_id"),
    )


def festivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows in every year in which there is an order."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    kinds = [("sankranti", 1, 14, 1, 1), ("holi", 3, 10, 1, 0), ("diwali", 11, 1, 1, 0)]
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("bigint").alias("i"),
                    F.lit(k).alias("festival"),
                    F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("date"),
                    F.date_sub(F.make_date(F.col("year"), F.lit(m), F.lit(d)), a).alias("start"),
                    F.date_add(F.make_date(F.col("year"), F.lit(m), F.lit(d)), b).alias("end"),
                )
                for i, (k, m, d, a, b) in enumerate(kinds)
            ]
        )
    )
    return years.select("year", rows).select(
        (F.col("year") * 10 + F.col("i")).alias("id"), "festival", "year", "date", "start", "end", F.lit(False).alias("user_edited")
    )


def media_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tag = F.when(F.col("l_returnflag") == "A", "temple").when(F.col("l_returnflag") == "R", "travel").otherwise("beach")
    return li.groupBy(F.col("l_orderkey").alias("media_id"), tag.alias("tag")).agg((F.max("l_quantity") / 50.0).alias("score"))


def day_number(ts):
    return (F.datediff(ts, F.lit("1995-01-01").cast("date")) + 1).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order day; days with one order are month-bucket events."""
    m = media(spark, sf_dir).select("id", "taken_at", "missing")
    return (
        m.groupBy(day_number(F.col("taken_at")).alias("id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"))
        .select(
            "id",
            F.when(F.col("n") == 1, "moments").otherwise("auto").alias("kind"),
            F.when(F.col("id") % 50 == 0, F.concat(F.lit("Day "), F.col("id").cast("string"))).alias("title"),
            F.lit(None).cast("string").alias("description"),
            "start_at",
            "end_at",
            (F.col("id") % 50 == 0).alias("locked"),
            F.lit(None).cast("bigint").alias("hero_media_id"),
            F.lit(False).alias("hero_by_user"),
        )
    )


def event_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir)
    return m.select(F.col("id").alias("media_id"), day_number(F.col("taken_at")).alias("event_id"), F.lit("auto").alias("assigned_by"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("media_id"), F.lit("m").alias("model"), F.col("embedding").alias("vector"))


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-identical items only (checked in full by the duplicate queries)."""
    m = media(spark, sf_dir).where("not missing")
    rank = F.struct("pinned_best", "size", -F.col("id"))
    return (
        m.groupBy(content_key(F.col("sha256")))
        .agg(F.min("id").alias("id"), F.max_by("id", rank).alias("best_media_id"), F.count(F.lit(1)).alias("size"), F.max_by("taken_at", rank).alias("taken_at"))
        .where("size > 1")
        .select("id", F.lit("exact").alias("kind"), "best_media_id", "size", "taken_at")
    )


def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir).where("not missing").select("id", content_key(F.col("sha256")).alias("content"))
    same = Window.partitionBy("content")
    grouped = m.where("content is not null").select("id", F.min("id").over(same).alias("group_id"), F.count(F.lit(1)).over(same).alias("n"))
    return grouped.where("n > 1").select(F.col("id").alias("media_id"), "group_id", F.lit(0).alias("distance"))


MAKERS = {
    "media": media,
    "quality": quality,
    "faces": faces,
    "persons": persons,
    "occasions": occasions,
    "festivals": festivals,
    "media_tags": media_tags,
    "events": events,
    "event_media": event_media,
    "embeddings": vectors,
    "dup_groups": dup_groups,
    "dup_members": dup_members,
}


def library(spark: SparkSession, sf_dir: str, settings: Settings = Settings(), without: tuple[str, ...] = ()) -> Library:
    return Library(spark, {k: partial(make, spark, sf_dir) for k, make in MAKERS.items() if k not in without}, settings)


# ---------- the same tables in SQL ----------

SQL = {
    "media": """
        SELECT o_orderkey AS id, CAST(substr(o_orderpriority,1,1) AS BIGINT) AS folder_id,
          'IMG_' || o_orderkey || '.jpg' AS filename,
          CASE WHEN o_orderstatus='P' THEN 'video' ELSE 'photo' END AS kind,
          CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey*1000 AS mtime_ns,
          sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR), o_orderstatus, o_orderpriority)) AS sha256,
          CASE WHEN o_custkey%2=0 THEN 4000 ELSE 3000 END AS width,
          CASE WHEN o_custkey%2=0 THEN 3000 ELSE 4000 END AS height,
          CASE WHEN o_orderstatus='P' THEN CAST(o_custkey%20 AS DOUBLE) END AS duration_s,
          o_orderdate + to_minutes(CAST(o_custkey%600 AS INTEGER)) AS taken_at,
          CASE WHEN o_orderpriority < '3' THEN 'exif' WHEN o_orderpriority < '4' THEN 'video_meta'
               WHEN o_orderpriority < '5' THEN 'filename' ELSE 'mtime' END AS date_source,
          CASE WHEN o_orderstatus<>'O' THEN 10.0::DOUBLE + (o_custkey*37%2000)/100.0::DOUBLE END AS gps_lat,
          CASE WHEN o_orderstatus<>'O' THEN 70.0::DOUBLE + (o_custkey*53%2000)/100.0::DOUBLE END AS gps_lon,
          CAST('0x' || substr(md5(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR), o_orderstatus)),1,16) AS UBIGINT) AS sig,
          (o_totalprice>400000 AND o_orderpriority='1-URGENT') AS pinned_best,
          o_orderpriority<>'5-LOW' AS has_thumb, o_totalprice>490000 AS missing,
          CASE WHEN o_totalprice<5000 THEN 'unreadable' END AS error
        FROM orders""",
    "quality": """
        SELECT o_orderkey AS media_id, CASE WHEN o_custkey%3=0 THEN 1 ELSE 2 END AS version,
          o_custkey*1000 AS media_mtime_ns, CASE WHEN o_custkey%3=1 THEN 'clip' ELSE 'clip,faces' END AS models_used,
          CASE WHEN o_orderpriority<>'5-LOW' THEN (o_custkey%10)/10.0::DOUBLE END AS aesthetic,
          floor(o_totalprice/500)/10.0::DOUBLE AS total
        FROM orders WHERE o_orderstatus<>'O'""",
    "faces": """
        SELECT l_orderkey*10+l_linenumber AS id, l_orderkey AS media_id, max(l_quantity)/50.0::DOUBLE AS quality,
          CAST(max(l_quantity) AS INTEGER) AS size_px,
          CASE WHEN min(l_returnflag)<>'N' THEN min(l_suppkey)+1 END AS person_id,
          CASE WHEN min(l_returnflag)='A' THEN 'user' ELSE 'auto' END AS assigned_by
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "persons": """
        SELECT s_suppkey+1 AS id, CASE WHEN s_acctbal>2000 THEN s_name END AS name,
          CASE WHEN s_nationkey<>3 THEN DATE '1960-01-01' + CAST(s_suppkey*97%15000 AS INTEGER) END AS birth_date,
          s_nationkey=7 AS hidden
        FROM supplier""",
    "occasions": """
        SELECT CAST(n_nationkey+1 AS BIGINT) AS id,
          CASE WHEN n_regionkey=0 THEN 'birthday' WHEN n_regionkey=1 THEN 'anniversary' ELSE 'other' END AS kind,
          n_name AS name, n_nationkey%12+1 AS month, CASE WHEN n_nationkey=13 THEN 29 ELSE n_nationkey+1 END AS day,
          CASE WHEN n_nationkey%3<>0 THEN 1980+n_nationkey END AS year,
          CASE WHEN n_regionkey=0 THEN CAST(n_nationkey+1 AS BIGINT) END AS person_id
        FROM nation""",
    "festivals": """
        SELECT y*10+i AS id, festival, y AS year, make_date(y,m,d) AS date,
          make_date(y,m,d) - a AS start_date, make_date(y,m,d) + b AS end_date
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
          (VALUES (0,'sankranti',1,14,1,1),(1,'holi',3,10,1,0),(2,'diwali',11,1,1,0)) t(i,festival,m,d,a,b)""",
    "media_tags": """
        SELECT l_orderkey AS media_id, CASE l_returnflag WHEN 'A' THEN 'temple' WHEN 'R' THEN 'travel' ELSE 'beach' END AS tag,
          max(l_quantity)/50.0::DOUBLE AS score
        FROM lineitem GROUP BY ALL""",
    "events": """
        SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(taken_at AS DATE))+1 AS BIGINT) AS id,
          CASE WHEN count(*)=1 THEN 'moments' ELSE 'auto' END AS kind,
          min(taken_at) AS start_at, max(taken_at) AS end_at
        FROM media GROUP BY 1""",
    "event_media": """
        SELECT id AS media_id, CAST(date_diff('day', DATE '1995-01-01', CAST(taken_at AS DATE))+1 AS BIGINT) AS event_id
        FROM media""",
    "dup_groups": """
        SELECT min(id) AS id, 'exact' AS kind, count(*) AS size,
          arg_max(id, (pinned_best, size, -id)) AS best_media_id, arg_max(taken_at, (pinned_best, size, -id)) AS taken_at
        FROM media WHERE NOT missing GROUP BY sha256 HAVING count(*)>1""",
    "dup_members": """
        SELECT id AS media_id, g AS group_id FROM (
          SELECT id, min(id) OVER (PARTITION BY sha256) AS g, count(*) OVER (PARTITION BY sha256) AS n FROM media WHERE NOT missing)
        WHERE n>1""",
    "hidden": """
        SELECT media_id FROM dup_members m JOIN dup_groups g ON g.id=m.group_id WHERE media_id<>best_media_id""",
    "recurring": """
        SELECT kind, 'occasion:' || id AS key, name, CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day,
          CAST(year AS BIGINT) AS first_year, person_id, 0 AS source, id AS ref
        FROM occasions
        UNION ALL
        SELECT 'birthday', 'person:' || id, name, month(birth_date), day(birth_date), year(birth_date), id, 1, id
        FROM persons p WHERE birth_date IS NOT NULL AND name IS NOT NULL AND NOT hidden
          AND NOT EXISTS (SELECT 1 FROM occasions o WHERE o.kind='birthday' AND o.person_id=p.id)""",
}
NEEDS = {
    "events": ["media"],
    "event_media": ["media"],
    "dup_groups": ["media"],
    "dup_members": ["media"],
    "hidden": ["dup_groups", "dup_members"],
    "recurring": ["occasions", "persons"],
}


def with_tables(names: list[str], rest: str) -> str:
    """A WITH clause that defines the named tables, then ``rest`` (further CTEs or a SELECT)."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}{rest}"
