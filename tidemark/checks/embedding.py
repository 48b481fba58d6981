"""Centroids, nearest class, tags, clusters, curation on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.checks.registry import big, query
from tidemark.checks.standin import library, table, with_tables
from tidemark.operators import curation, entities, leaders, vectors
from tidemark.plans import views

CENTROIDS = """
sums AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
norms AS (SELECT label, sqrt(sum(s*s)) + 1e-8 AS l FROM sums GROUP BY 1),
cents AS MATERIALIZED (SELECT s.label, list(s/l ORDER BY i) AS c, any_value(n) AS n FROM sums s JOIN norms USING (label) GROUP BY 1)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label").cast("bigint").alias("label"))


def _centroids(spark, sf):
    return vectors.centroids(_vectors(spark, sf), "label", "embedding", 64)


@query(f"""WITH {CENTROIDS}
SELECT e.vec_id AS id, CAST(e.label AS BIGINT) AS label, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 5) AS similarity
FROM embeddings e JOIN cents USING (label)""")
def centroid_outliers(spark, sf):
    """Every vector with its similarity to its class centroid."""
    rows = vectors.similarity_to_own(_vectors(spark, sf), _centroids(spark, sf), "label", "embedding")
    return rows.select("id", "label", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {CENTROIDS},
s AS (SELECT vec_id AS id, CAST(cents.label AS BIGINT) AS class_id, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS sim FROM embeddings, cents
  WHERE NOT (vec_id % 10 = cents.label))
SELECT id, arg_max(class_id, sim) AS class_id, round(max(sim), 5) AS similarity FROM s GROUP BY id HAVING max(sim) >= 0.2""")
def nearest_class(spark, sf):
    """Most similar class of every vector, one class being forbidden for each."""
    classes = _centroids(spark, sf).select(
        F.col("label").alias("class_id"), F.col("centroid").alias("class_vector"), F.lit(True).alias("named")
    )
    rows = _vectors(spark, sf).withColumn("no", F.array(F.col("id") % 10))
    found = vectors.nearest_class(rows, classes, 0.2, forbidden="no")
    return found.select("id", "class_id", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {CENTROIDS},
l AS (SELECT vec_id AS id, label AS k, 20 * list_dot_product(CAST(embedding AS DOUBLE[]), c) AS x FROM (SELECT vec_id, embedding FROM embeddings) e, cents),
p AS (SELECT id, k, exp(x - max(x) OVER (PARTITION BY id)) AS w FROM l),
q AS (SELECT id, k, w / sum(w) OVER (PARTITION BY id) AS p FROM p)
SELECT id, 'tag' || k AS tag, round(p, 3) AS score FROM q WHERE p >= 0.3 AND k < 7""")
def zero_shot_tags(spark, sf):
    """Softmax over class centroids; the last three classes are background."""
    label = F.col("label")
    classes = _centroids(spark, sf).select(
        label.alias("class_id"),
        F.col("centroid").alias("class_vector"),
        F.concat(F.lit("tag"), label).alias("tag"),
        (label >= 7).alias("background"),
    )
    return vectors.zero_shot_tags(_vectors(spark, sf), classes, 0.3, scale=20.0, key="id", vector="embedding")


# leaders best first: a seed leads if none of its better similar seeds does
LEADERS = """
seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY quality DESC, id) AS rn FROM seed),
near AS MATERIALIZED (SELECT a.rn, list(b.id) AS better FROM seq a JOIN seq b ON b.rn < a.rn AND list_dot_product(a.v, b.v) >= {link} GROUP BY 1),
walk(rn, ids) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT s.rn, CASE WHEN n.better IS NOT NULL AND list_has_any(w.ids, n.better) THEN w.ids ELSE list_append(w.ids, s.id) END
  FROM walk w JOIN seq s ON s.rn = w.rn + 1 LEFT JOIN near n ON n.rn = s.rn),
lead AS MATERIALIZED (SELECT unnest(arg_max(ids, rn)) AS id FROM walk),
clusters AS MATERIALIZED (
  SELECT s.id, coalesce(max(CASE WHEN l.id = s.id THEN l.id END), arg_max(l.id, list_dot_product(s.v, t.v))) AS cluster
  FROM seq s, lead l JOIN seq t ON t.id = l.id WHERE l.id = s.id OR list_dot_product(s.v, t.v) >= {link} GROUP BY 1)"""


@query("""WITH RECURSIVE seed AS MATERIALIZED (SELECT vec_id AS id, (vec_id * 37 % 101) / 100.0 AS quality, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"""
+ LEADERS.replace("{link}", "0.40") + """
SELECT id, cluster FROM clusters""")
def leader_clusters(spark, sf):
    """Greedy clusters of all vectors, best quality first."""
    rows = _vectors(spark, sf).withColumn("quality", F.pmod(F.col("id") * 37, F.lit(101)) / 100.0)
    return leaders.leader_clusters(rows, 0.40)


def _matched(source: str, target: str) -> str:
    """Free faces of ``source`` join the most similar person."""
    return f"""
{target}_sum AS (SELECT person, i, sum(v[i]) AS s FROM {source}, range(1, 65) r(i) WHERE person IS NOT NULL GROUP BY 1, 2),
{target}_len AS (SELECT person, sqrt(sum(s*s)) + 1e-8 AS l FROM {target}_sum GROUP BY 1),
{target}_mean AS MATERIALIZED (SELECT person, list(s/l ORDER BY i) AS c FROM {target}_sum JOIN {target}_len USING (person) GROUP BY 1),
{target}_best AS (SELECT f.id, arg_max(m.person, list_dot_product(v, c)) AS p FROM {source} f, {target}_mean m
  WHERE f.person IS NULL AND list_dot_product(v, c) >= 0.35 GROUP BY 1),
{target} AS MATERIALIZED (SELECT f.id, quality, v, coalesce(f.person, b.p) AS person FROM {source} f LEFT JOIN {target}_best b ON b.id = f.id)"""


@query("""WITH RECURSIVE f0 AS MATERIALIZED (SELECT vec_id AS id, (vec_id * 37 % 101) / 100.0 AS quality, CAST(embedding AS DOUBLE[]) AS v,
  CASE WHEN label < 5 AND vec_id < 100 THEN CAST(label + 1 AS BIGINT) END AS person FROM embeddings),""" + _matched("f0", "f1") + """,
seed AS MATERIALIZED (SELECT id, quality, v FROM f1 WHERE person IS NULL AND quality >= 0.30),""" + LEADERS.replace("{link}", "0.40") + """,
big AS (SELECT cluster, max(quality) AS q FROM clusters JOIN seed USING (id) GROUP BY 1 HAVING count(*) >= 2),
fresh AS (SELECT cluster, (SELECT greatest(coalesce(max(label), -1) + 1, 0) FROM embeddings WHERE label < 5) + row_number() OVER (ORDER BY q DESC, cluster) AS person FROM big),
f2 AS MATERIALIZED (SELECT f.id, quality, v, coalesce(f.person, n.person) AS person FROM f1 f
  LEFT JOIN clusters c ON c.id = f.id LEFT JOIN fresh n ON n.cluster = c.cluster),""" + _matched("f2", "f3") + """
SELECT id, CAST(person AS BIGINT) AS person_id, 'auto' AS assigned_by FROM f3""")
def entity_assignment(spark, sf):
    """A full assignment pass: half of the classes are known people, the rest is clustered."""
    rows = _vectors(spark, sf)
    known = rows.select("label").distinct().where("label < 5").select(
        (F.col("label") + 1).alias("id"),
        F.when(F.col("label") < 3, F.concat(F.lit("P"), F.col("label").cast("string"))).alias("name"),
        F.lit(None).cast("date").alias("birth_date"),
        F.lit(False).alias("hidden"),
        F.lit(None).cast("bigint").alias("cover_face_id"),
    )
    faces = rows.select(
        "id",
        F.col("id").alias("media_id"),
        (F.col("id") * 37 % 101 / 100.0).alias("quality"),
        "embedding",
        F.when((F.col("label") < 5) & (F.col("id") < 100), F.col("label") + 1).alias("person_id"),
        F.lit("auto").alias("assigned_by"),
        F.array().cast("array<bigint>").alias("not_person_ids"),
    )
    moments = spark.createDataFrame([], "media_id long, group_id long")
    done, _, _ = entities.assign_entities(faces, known, moments, match=0.35, link=0.40)
    return done.select("id", "person_id", "assigned_by")


_ALIKE = """len(list_filter(p.kept, lambda x: bit_count(xor(x.sig, s.sig)) <= 10 OR coalesce(
      list_dot_product(x.vec, s.vec) >= 0.93 OR (list_dot_product(x.vec, s.vec) >= 0.88 AND abs(x.us - epoch_us(s.ts)) <= 90000000), false)))"""
GREEDY = f"""
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, ts, id) AS rn FROM cand),
pick(g, rn, kept, ids) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(sig UBIGINT, vec DOUBLE[], us BIGINT)[]), CAST([] AS BIGINT[]) FROM seq
  UNION ALL
  SELECT p.g, s.rn,
    CASE WHEN {_ALIKE} = 0 THEN list_append(p.kept, {{'sig': s.sig, 'vec': s.vec, 'us': epoch_us(s.ts)}}) ELSE p.kept END,
    CASE WHEN {_ALIKE} = 0 THEN list_append(p.ids, s.id) ELSE p.ids END
  FROM pick p JOIN seq s ON s.g = p.g AND s.rn = p.rn + 1 WHERE len(p.ids) < {{k}}),
final AS (SELECT g, unnest(ids) AS id FROM (SELECT g, arg_max(ids, rn) AS ids FROM pick GROUP BY g))"""

PEOPLE = """,
people AS MATERIALIZED (SELECT f.media_id, count(DISTINCT person_id) AS n FROM faces f JOIN persons p ON p.id = f.person_id AND NOT p.hidden GROUP BY 1),
cur AS MATERIALIZED (SELECT m.id, m.kind, taken_at AS ts, has_thumb, m.id IN (SELECT media_id FROM hidden) AS copy, sig, CAST(v.embedding AS DOUBLE[]) AS vec, width >= height AS wide, aesthetic,
    coalesce(q.total, 50.0) + 4 * least(coalesce(people.n, 0), 3) AS score
  FROM media m LEFT JOIN quality q ON q.media_id = m.id LEFT JOIN people ON people.media_id = m.id LEFT JOIN embeddings v ON v.vec_id = m.id WHERE NOT missing)"""
CUR_TABLES = ["media", "quality", "faces", "persons", "dup_groups", "dup_members", "hidden"]


@query(with_tables(CUR_TABLES, PEOPLE + """,
cand AS (SELECT id, sig, vec, score, ts, year(ts) AS g FROM cur WHERE kind='photo' AND has_thumb AND NOT copy),""" + GREEDY.replace("{k}", "24") + """
SELECT CAST(g AS BIGINT) AS year, id FROM final"""))
def best_of_year(spark, sf):
    """24 diverse picks of every year."""
    lib = library(spark, sf)
    return views.best_of_year(lib).select(big("year"), "id")


@query(with_tables([*CUR_TABLES, "event_media"], PEOPLE + """,
cand AS (SELECT id, sig, vec, score, ts, event_id AS g FROM cur JOIN event_media e ON e.media_id = id WHERE kind='photo' AND has_thumb AND NOT copy),""" + GREEDY.replace("{k}", "12") + """,
hero AS (SELECT g, arg_max(c.id, (score + CASE WHEN wide THEN 6 ELSE 0 END + 10*coalesce(aesthetic, 0), -rn)) AS h
  FROM final JOIN cur c USING (id) JOIN (SELECT g, id, rn FROM seq) s USING (g, id) GROUP BY g),
other AS (SELECT event_id AS g, arg_min(id, (ts, id)) AS h FROM cur JOIN event_media e ON e.media_id = id WHERE has_thumb GROUP BY 1)
SELECT other.g AS event_id, coalesce(hero.h, other.h) AS hero_id FROM other LEFT JOIN hero USING (g)"""))
def event_heroes(spark, sf):
    """Hero of every event: the best pick, or the earliest item where there is no photo."""
    lib = library(spark, sf)
    _, heroes = curation.curate(lib.live_members(), lib.curation_items(), "event_id")
    return heroes


def _unlike(kept: str, seen: str) -> str:
    """No kept vector looks like the seen one, or like it within 90 seconds."""
    cos = f"list_dot_product(x.v, {seen}.v)"
    return f"len(list_filter({kept}, lambda x: {cos} >= 0.45 OR ({cos} >= 0.3 AND abs(x.t - {seen}.t) <= 90))) = 0"


@query(f"""WITH RECURSIVE
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, t, id) AS rn FROM
  (SELECT vec_id AS id, CAST(label AS BIGINT) AS g, (vec_id * 37 % 101) / 100.0 AS score, vec_id * 20 AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
pick(g, rn, kept, ids) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(v DOUBLE[], t BIGINT)[]), CAST([] AS BIGINT[]) FROM seq
  UNION ALL
  SELECT p.g, s.rn,
    CASE WHEN {_unlike('p.kept', 's')} THEN list_append(p.kept, {{'v': s.v, 't': s.t}}) ELSE p.kept END,
    CASE WHEN {_unlike('p.kept', 's')} THEN list_append(p.ids, s.id) ELSE p.ids END
  FROM pick p JOIN seq s ON s.g = p.g AND s.rn = p.rn + 1 WHERE len(p.ids) < 12)
SELECT g AS label, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pick FROM (SELECT g, arg_max(ids, rn) AS ids FROM pick GROUP BY g)""")
def diverse_vectors(spark, sf):
    """Diverse picks of every class by vector similarity."""
    rows = _vectors(spark, sf).select(
        "label",
        "id",
        (F.col("id") * 37 % 101 / 100.0).alias("score"),
        F.timestamp_seconds(F.col("id") * 20).alias("ts"),
        F.lit(None).cast("bigint").alias("sig"),
        F.col("embedding").alias("vec"),
    )
    found = curation.diverse_top_k(rows, ["label"], 12, same_cos=0.45, burst_cos=0.3)
    return found.select("label", "id", big("pick"))


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id AS id, epoch_us(ts) AS us, value AS v, event_type <> 'error' AS marked,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk(user_id, rn, id, kept, pv, pus) AS (
  SELECT user_id, rn, id, true, CASE WHEN marked THEN v END, CASE WHEN marked THEN us END FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.id, NOT (marked AND pv IS NOT NULL AND us - pus <= 14400000000 AND abs(v - pv) < 30),
    CASE WHEN marked AND NOT (pv IS NOT NULL AND us - pus <= 14400000000 AND abs(v - pv) < 30) THEN v ELSE pv END,
    CASE WHEN marked AND NOT (pv IS NOT NULL AND us - pus <= 14400000000 AND abs(v - pv) < 30) THEN us ELSE pus END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, id FROM walk WHERE kept""")
def thinned_events(spark, sf):
    """Events that differ from the last kept one of their user, or come four hours later."""
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("taken_at"),
        F.when(F.col("event_type") != "error", F.array("value")).alias("print"),
    )
    kept = curation.thin_sequence(e, "print", ["user_id"], window_s=14400, max_diff=30.0)
    return kept.select("user_id", "id")
