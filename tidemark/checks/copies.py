"""Exact, near and burst duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.checks.registry import big, query
from tidemark.checks.standin import library, table, with_tables
from tidemark.functions.numeric import sign_signature
from tidemark.operators import duplicates
from tidemark.operators.similarity import hamming_join
from tidemark.params import Settings
from tidemark.session import cut

# 64 counters per text, over all of its words; the counters' signs form the signature.
DOC_SQL = """
words AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 64 AS b
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> ''),
counts AS (SELECT doc_id, b, count(*) AS n FROM words GROUP BY 1, 2),
full_counts AS (SELECT d.doc_id, r.i, coalesce(n, 0) AS n FROM documents d CROSS JOIN range(64) r(i) LEFT JOIN counts c ON c.doc_id=d.doc_id AND c.b=r.i),
med AS (SELECT doc_id, median(n) FILTER (i > 0) AS m FROM full_counts GROUP BY 1),
sigs AS (SELECT f.doc_id, CAST(sum(CASE WHEN n > m THEN 1::UBIGINT << (63 - i)::INTEGER ELSE 0 END) AS UBIGINT) AS sig
  FROM full_counts f JOIN med USING (doc_id) GROUP BY 1),
items AS (SELECT doc_id AS id, sha256(text) AS sha, sig, coalesce(quality, 0) AS total, n_chars AS pixels FROM documents JOIN sigs USING (doc_id) LEFT JOIN labels USING (doc_id))"""


def document_items(spark, sf):
    d = table(spark, sf, "documents")
    words = d.select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''")
    bucket = (F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int") % 64).alias("b")
    counts = words.groupBy("doc_id", bucket).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    sigs = filled.select("doc_id", sign_signature(vector).alias("sig"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    empty = F.lit(0).cast("bigint")
    return (
        d.select("doc_id", "text", "n_chars")
        .join(sigs, "doc_id", "left")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.lit("photo").alias("kind"),
            F.sha2("text", 256).alias("sha256"),
            F.coalesce("sig", empty).alias("sig"),
            F.lit(None).cast("timestamp_ntz").alias("minute"),
            F.lit(False).alias("pinned"),
            F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("total"),
            F.col("n_chars").alias("pixels"),
            F.lit(None).cast("timestamp_ntz").alias("taken_at"),
        )
    )


@query("""
SELECT g AS src, doc_id AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS g FROM documents) WHERE g <> doc_id""")
def exact_copies(spark, sf):
    none = F.lit(None).cast("bigint")
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("video").alias("kind"), F.sha2("text", 256).alias("sha256"), none.alias("sig"), none.alias("minute")
    )
    return duplicates.exact_edges(duplicates.mark_copies(d))


@query(f"""WITH {DOC_SQL}, u AS (SELECT sig, min(id) AS id FROM items GROUP BY sig)
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.sig, y.sig)) AS BIGINT) AS distance FROM u x JOIN u y ON x.id < y.id AND bit_count(xor(x.sig, y.sig)) <= 8""")
def near_documents(spark, sf):
    """Similar texts by signature: one row per pair of distinct signatures within 8 bits."""
    rows = document_items(spark, sf).groupBy("sig").agg(F.min("id").alias("id"))
    return hamming_join(rows, 8).select("a", "b", big("distance"))


VEC_SQL = """
med AS (SELECT vec_id, embedding, list_sort(embedding[2:])[32] AS m FROM embeddings),
sigs AS (SELECT vec_id AS id, CAST(list_sum([CASE WHEN embedding[i] > m THEN 1::UBIGINT << (64 - i)::INTEGER ELSE 0 END FOR i IN range(1, 65)]) AS UBIGINT) AS sig FROM med)"""


@query(f"""WITH {VEC_SQL}
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.sig, y.sig)) AS BIGINT) AS distance FROM sigs x JOIN sigs y ON x.id < y.id AND bit_count(xor(x.sig, y.sig)) <= 20""")
def near_vectors(spark, sf):
    """Similar vectors by the signs of their components, at the loose distance of 20."""
    e = table(spark, sf, "embeddings")
    sigs = e.select(F.col("vec_id").alias("id"), sign_signature(F.col("embedding")).alias("sig"))
    return hamming_join(sigs, 20).select("a", "b", big("distance"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderdate AS minute, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)),1,16) AS UBIGINT) AS sig FROM orders)
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.sig, y.sig)) AS BIGINT) AS distance FROM s x JOIN s y
ON x.minute = y.minute AND x.id < y.id AND bit_count(xor(x.sig, y.sig)) BETWEEN 9 AND 20""")
def burst_pairs(spark, sf):
    """Orders of one instant whose signatures differ by 9 to 20 bits."""
    o = table(spark, sf, "orders")
    sig = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16), 16, -10).cast("bigint")
    rows = o.select(F.col("o_orderkey").alias("id"), sig.alias("sig"), F.col("o_orderdate").alias("minute"))
    return hamming_join(rows, 20, above=8, by=["minute"]).select("a", "b", big("distance"))


# Labels travel along edges between distinct signatures and contents until they settle.
DOC_GROUPS = f"""WITH RECURSIVE {DOC_SQL},
star AS (SELECT id, min(id) OVER (PARTITION BY sha) AS centre FROM items),
pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, CASE WHEN x.sha = y.sha AND x.id = sx.centre THEN 0 ELSE 1 END AS reason
  FROM items x JOIN items y ON x.id < y.id AND bit_count(xor(x.sig, y.sig)) <= 8 JOIN star sx ON sx.id = x.id
  UNION SELECT centre, id, 0 FROM star WHERE centre <> id),
sym AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, root) AS (SELECT DISTINCT a, a FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.id WHERE r.root < s.b),
comp AS MATERIALIZED (SELECT id, min(root) AS g FROM reach GROUP BY id)"""


@query(DOC_GROUPS + """
SELECT c.g AS id, arg_max(c.id, (i.total, i.pixels, -c.id)) AS best_media_id, count(*) AS size,
  (SELECT CASE WHEN max(reason) = 0 THEN 'exact' ELSE 'near' END FROM pairs p JOIN comp x ON x.id = p.a WHERE x.g = c.g) AS kind
FROM comp c JOIN items i ON i.id = c.id GROUP BY c.g""")
def document_groups(spark, sf):
    """Duplicate groups of all texts, with kind and best copy."""
    items = cut(document_items(spark, sf))
    groups, _ = duplicates.duplicate_groups(items, Settings(burst_enabled=False))
    return groups.select("id", "best_media_id", "size", "kind")


@query(DOC_GROUPS + """,
best AS (SELECT c.g, arg_max(c.id, (i.total, i.pixels, -c.id)) AS b FROM comp c JOIN items i ON i.id = c.id GROUP BY c.g)
SELECT c.id AS media_id, c.g AS group_id, CAST(bit_count(xor(x.sig, y.sig)) AS BIGINT) AS distance, c.id <> b AS hidden
FROM comp c JOIN best ON best.g = c.g JOIN items x ON x.id = c.id JOIN items y ON y.id = b""")
def document_members(spark, sf):
    """Members of all groups with their distance to the best copy."""
    items = cut(document_items(spark, sf))
    groups, members = duplicates.duplicate_groups(items, Settings(burst_enabled=False))
    hidden = duplicates.hidden_copies(groups, members).withColumn("hidden", F.lit(True))
    return members.join(hidden, "media_id", "left").select(
        "media_id", "group_id", big("distance"), F.coalesce("hidden", F.lit(False)).alias("hidden")
    )


LIB_COMPONENTS = with_tables(["media", "quality"], """,
items AS MATERIALIZED (SELECT m.id, m.kind, sha256 AS sha, sig, CASE WHEN date_source IN ('exif','video_meta') THEN date_trunc('minute', taken_at) END AS minute,
    pinned_best AS pinned, coalesce(q.total, 0) AS total, width*height AS pixels
  FROM media m LEFT JOIN quality q ON q.media_id = m.id WHERE NOT missing),
star AS MATERIALIZED (SELECT id, centre FROM (SELECT id, min(id) OVER (PARTITION BY sha) AS centre, count(*) OVER (PARTITION BY sha) AS n FROM items) WHERE n > 1),
raw AS (
  SELECT centre AS a, id AS b, 0 AS reason FROM star WHERE centre <> id
  UNION ALL SELECT x.id, y.id, 1 FROM items x JOIN items y ON x.sig = y.sig AND x.id < y.id WHERE x.kind='photo' AND y.kind='photo'
  UNION ALL SELECT x.id, y.id, 1 FROM items x JOIN items y ON x.id < y.id AND x.sig <> y.sig AND bit_count(xor(x.sig, y.sig)) <= 8 WHERE x.kind='photo' AND y.kind='photo'
  UNION ALL SELECT x.id, y.id, 2 FROM items x JOIN items y ON x.minute = y.minute AND x.id < y.id AND bit_count(xor(x.sig, y.sig)) <= 26 WHERE x.kind='photo' AND y.kind='photo'),
pairs AS MATERIALIZED (SELECT a, b, min(reason) AS reason FROM raw GROUP BY a, b),
sym AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, root) AS (SELECT DISTINCT a, a FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.id WHERE r.root < s.b),
comp AS MATERIALIZED (SELECT id, min(root) AS g FROM reach GROUP BY id)""")
LIB_GROUPS = LIB_COMPONENTS + """
SELECT c.g AS id, arg_max(c.id, (i.pinned, i.total, i.pixels, -c.id)) AS best_media_id, count(*) AS size,
  (SELECT CASE max(reason) WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'burst' END FROM pairs p JOIN comp x ON x.id = p.a WHERE x.g = c.g) AS kind
FROM comp c JOIN items i ON i.id = c.id GROUP BY c.g"""


@query(LIB_GROUPS)
def library_groups(spark, sf):
    """Exact, near and burst groups of the collection."""
    lib = library(spark, sf)
    items = cut(duplicates.duplicate_items(lib["media"], lib["quality"]))
    groups, _ = duplicates.duplicate_groups(items, Settings(burst_threshold=26))
    return groups.select("id", "best_media_id", "size", "kind")


@query(LIB_GROUPS.replace("SELECT c.g AS id, arg_max", "SELECT count(*) AS groups, CAST(sum(size - 1) AS BIGINT) AS hidden FROM (SELECT c.g AS id, arg_max") + ")")
def regroup_counts(spark, sf):
    lib = library(spark, sf)
    items = cut(duplicates.duplicate_items(lib["media"], lib["quality"]))
    groups, _ = duplicates.duplicate_groups(items, Settings(burst_threshold=26))
    return duplicates.regroup_summary(groups)
