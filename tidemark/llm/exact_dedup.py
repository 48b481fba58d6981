"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Texts are equal when identical after replacing each run of blanks (0x20, 0x09-0x0D) by one space.

1. A first pass keeps two small numbers of each text: its length and the hash of its first ``prefix`` characters. Rows are counted
   by length and, within a length, by prefix. A row alone in its group is settled: no other text can equal it.
2. The groups with more than one row go into a bitmap of fixed size (``bits``), which every task gets; its size does not follow the
   data. A second pass tests each row's group and reads on to the end only of rows whose group survived: these get the SHA-256 of
   their whole text. A group that shares its bit with a surviving one is hashed in vain, and nothing else happens to it.
3. Equal hashes are a group; the row with the smallest id stays. What is grouped is written once to the shared folder, without texts.

Scale. No text is shuffled. Groups are counted with partial aggregates, so a third of all rows in one group arrives as a row per task.
Sizes and kept rows are joined back in two parts: groups with over a ``HOT``-th of all rows, of which there are fewer than ``HOT``,
are sent to every task; the others are shuffled.

Defined cases. Null counts as empty; empty texts equal each other, and a blank one equals a single space. Rows without an id come after
all others, so that one of them stays only where no row of its group has an id (``keep_id`` is then null). Of rows with the same id
and equal texts one stays. An empty table gives no row. Only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

PREFIX = 64
BITS = 1 << 26
HOT = 1024
# fixed by bitmap_construct_agg
BITS_PER_BITMAP = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def _texts(docs: DataFrame, prefix: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text"))
    return rows.withColumns({"n": F.length("text"), "prefix": F.xxhash64(F.substring("text", 1, prefix))})


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("n", "prefix"), F.lit(bits))


def _survivors(texts: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): one bit for each (length, prefix) with several rows; at most bits / 32768 rows of 4 KB."""
    groups = texts.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    at = groups.select(_bit(bits).alias("bit"))
    return at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _marked(texts: DataFrame, bits: int) -> DataFrame:
    """``texts`` with ``survives``: whether the row's group may have several rows."""
    maps = F.broadcast(_survivors(texts, bits))
    rows = texts.withColumn("_bit", _bit(bits)).withColumn("bucket", F.bitmap_bucket_number("_bit"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(maps, "bucket", "left").withColumn("survives", F.coalesce(hit, F.lit(False))).drop("_bit", "bucket", "bitmap")


def groups(docs: DataFrame, carry: dict[str, Column] | None = None, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, settled) of every row; ``settled`` names the level that decided it: prefix or hash.

    ``carry``: further columns, expressions over the normalised ``text``; they are worked out while a text is at hand.
    """
    if bits % BITS_PER_BITMAP:
        raise ValueError(f"bits must be a multiple of {BITS_PER_BITMAP}")
    carry = carry or {}
    rows = stored(
        _marked(_texts(docs, prefix), bits).select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.when(F.col("survives"), digest(F.col("text"))).alias("hash"), *[x.alias(name) for name, x in carry.items()],
        ),
        "exact-rows",
    )
    alone = rows.where("hash is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lit("prefix").alias("settled"), *carry
    )
    same = rows.where("hash is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    sizes = stored(same.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")), "exact-groups")
    total = F.lit(same.count())
    # fewer than HOT groups can hold more than a HOT-th of the rows each
    hot = F.broadcast(sizes.where(F.col("group_size") * HOT > total))
    cold = sizes.where(F.col("group_size") * HOT <= total)
    spread = same.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash").unionByName(same.join(hot, "hash"))
    return alone.unionByName(
        spread.select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lit("hash").alias("settled"), *carry
        )
    )


def keep_first(docs: DataFrame, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, as they are; only texts of surviving groups are hashed, and only kept ones are shuffled.

    Of rows with the same id whose texts differ in blanks alone, the one with the smallest hash stays.
    """
    plain = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = normalised(F.col("_row.text"))
    marked = _marked(
        whole.withColumns({"n": F.length(text), "prefix": F.xxhash64(F.substring(text, 1, prefix))}), bits
    ).withColumns({"hash": F.when(F.col("survives"), digest(text)), "as_is": F.xxhash64(plain), "id": F.col("_row.doc_id").cast("bigint")})
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "as_is"))
    winners = marked.where("hash is not null").groupBy("hash").agg(first.alias("first")).select(
        F.col("hash").alias("_hash"), F.col("first.id").alias("_id"), F.col("first.as_is").alias("_as_is")
    )
    stay = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("as_is") == F.col("_as_is"))
    kept = marked.where("hash is not null").join(winners, stay, "left_semi").dropDuplicates(["hash"])
    return marked.where("hash is null").select("_row.*").unionByName(kept.select("_row.*"))
