"""Document fingerprints by winnowing, with DataFrame functions only.

A text is cut into units: its words, those of over ``UNIT`` characters into pieces of that many. Every run of ``k`` units has a hash,
rolled on from the hash of the run without its last unit. Of every ``w`` hashes in a row the smallest is kept, the rightmost of equal
ones, with its place. Any passage of ``k + w - 1`` units (6 by default) that two texts share gives both the same hash. A text below
``k`` units has one hash of all of it; one below ``w`` hashes keeps their smallest.

A kept hash is one number: 31 bits of hash above 32 bits of ``2^32 - 1 - place``, so the minimum of a window is its rightmost
smallest hash. Window minima come from log2(w) passes that combine neighbours, not from a scan of each window. (Runs of bytes were
measured too: 570 ns a byte on one core, against 130 with units.)

Neighbours. Documents are grouped by ``bucket_ids`` consecutive ids and read in order within a group, which bounds a group whatever
the ids; the first document of each group also goes to the group before. So each text is shuffled once.

Defined cases. A null text is empty; empty and blank texts have the hash of nothing, alike for all. Rows without an id have no
neighbour: they get a fingerprint, and null for edited and next. Rows that share an id follow each other by text. The only document
is its own next. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, under own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_index

K, W = 3, 4
UNIT = 12
BUCKET_IDS = 1024
_LOW = (1 << 32) - 1


def window_minima(df: DataFrame, text: Column, name: str, k: int = K, w: int = W) -> DataFrame:
    """Add the smallest hash of every window of ``text`` as an array."""
    if w & (w - 1):
        raise ValueError("the window is a power of two")
    own = F.col(name)
    units = F.regexp_extract_all(text, F.lit(rf"([^\x20\x09-\x0D]{{1,{UNIT}}})"))
    df = df.withColumn(name, F.transform(units, lambda x: F.xxhash64(x)))
    one = f"{name}_unit"
    df = df.withColumn(one, F.when(F.size(name) == 0, F.array(F.xxhash64(F.lit("")))).otherwise(own)).withColumn(name, F.col(one))
    for step in range(1, k):
        # hashing passes over a missing neighbour; runs that end early are cut off below, but for a text without a whole run
        df = df.withColumn(name, F.zip_with(own, F.slice(one, step + 1, F.size(one)), lambda a, b: F.xxhash64(a, b)))
    grams = F.greatest(F.size(one) - (k - 1), F.lit(1))
    df = df.withColumn(
        name,
        F.transform(
            F.slice(own, F.lit(1), grams), lambda x, i: x.bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(F.lit(_LOW) - i)
        ),
    )
    step = 1
    while step < w:
        df = df.withColumn(name, F.zip_with(own, F.slice(own, step + 1, F.size(own)), lambda a, b: F.least(a, b)))
        step *= 2
    return df.withColumn(name, F.slice(own, F.lit(1), F.greatest(F.size(own) - (w - 1), F.lit(1)))).drop(one)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints by their hashes, places aside."""
    x = F.array_distinct(F.transform(a, lambda v: F.shiftright(v, 32)))
    y = F.array_distinct(F.transform(b, lambda v: F.shiftright(v, 32)))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, 32)


def place_of(entry: Column) -> Column:
    """0-based unit at which the run of a kept hash starts."""
    return F.lit(_LOW) - entry.bitwiseAND(F.lit(_LOW))


def digest(entries: Column) -> Column:
    """A short name of a whole fingerprint."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(entries)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), entries)), 16, "0")))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, entries) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return window_minima(rows, F.col("_text"), "_w", k, w).select("doc_id", F.array_distinct("_w").alias("entries"))


def _edges(rows: DataFrame) -> DataFrame:
    """(bucket, edge): for each group of ids, the text of the first document of the next group (of the first, after the last)."""
    firsts = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_bucket").orderBy("_id", "_text"))).where("_turn = 1")
    firsts = firsts.select(F.col("_bucket").alias("_at"), F.col("_text").alias("_edge"))
    order = dense_index(rows.select("_bucket").distinct(), [F.col("_bucket")], "_seat")
    n = order.count()
    before = order.select(F.col("_bucket").alias("_at"), F.pmod(F.col("_seat") - 1, F.lit(max(1, n))).alias("_seat"))
    pairs = before.join(order.withColumnRenamed("_bucket", "_edge_bucket"), "_seat").select("_at", "_edge_bucket")
    return firsts.join(pairs, "_at").select("_edge_bucket", "_edge")


def edited_and_next(docs: DataFrame, k: int = K, w: int = W, bucket_ids: int = BUCKET_IDS) -> DataFrame:
    """(doc_id, n_chars, edited, entries, edited_entries, near_edited, near_next) of every row.

    The edited text has the last half of the characters replaced by as many first characters of the next document (or all of it).
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    ).withColumn("_bucket", F.floor(F.col("_id") / bucket_ids))
    placed = rows.where("_id is not null")
    order = Window.partitionBy("_bucket").orderBy("_id", "_text")
    seen = placed.withColumn("_next", F.lead("_text").over(order)).withColumn("_last", F.col("_next").isNull())
    seen = seen.join(_edges(placed), (F.col("_bucket") == F.col("_edge_bucket")) & F.col("_last"), "left").drop("_edge_bucket")
    seen = seen.withColumn("_next", F.coalesce("_next", "_edge"))

    seen = seen.withColumn("n_chars", F.length("_text").cast("bigint")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    head = F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - F.col("_half"))
    seen = seen.withColumn("edited", F.concat(head, F.substring("_next", F.lit(1), F.col("_half")))).drop("_next", "_half")
    seen = window_minima(seen, F.col("_text"), "_own", k, w)
    seen = window_minima(seen, F.col("edited"), "_new", k, w)
    seen = seen.withColumn("entries", F.array_distinct("_own")).withColumn("edited_entries", F.array_distinct("_new"))
    seen = seen.withColumn("near_edited", likeness(F.col("entries"), F.col("edited_entries")))
    # a group's last document meets the text it got from the next group
    seen = window_minima(seen, F.coalesce(F.when(F.col("_last"), F.col("_edge")), F.lit("")), "_edge_w", k, w)
    seen = seen.select(
        "_bucket", "_id", "_text", "_last", "n_chars", "edited", "entries", "edited_entries", "near_edited",
        F.when(F.col("_last"), F.array_distinct("_edge_w")).alias("_edge_entries"),
    )
    after = F.coalesce(F.lead("entries").over(order), "_edge_entries")
    seen = seen.withColumn("_after", after).withColumn("near_next", likeness(F.col("entries"), F.col("_after")))

    loose_texts = docs.where("doc_id is null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    loose = window_minima(loose_texts, F.col("_text"), "_w", k, w).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.length("_text").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("edited"),
        F.array_distinct("_w").alias("entries"), F.lit(None).cast("array<bigint>").alias("edited_entries"),
        F.lit(None).cast("double").alias("near_edited"), F.lit(None).cast("double").alias("near_next"),
    )
    columns = ["doc_id", "n_chars", "edited", "entries", "edited_entries", "near_edited", "near_next"]
    return seen.withColumnRenamed("_id", "doc_id").select(*columns).unionByName(loose)
