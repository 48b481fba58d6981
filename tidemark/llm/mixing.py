"""Mixing sources to target weights: fixed-length blocks, multinomial shards, pseudorandom index permutations, a join by index.

1. Each source's documents, in order of id, are one stream of words; every ``block`` words of it are a block (the last one may be
   shorter). A document lies in one or more blocks, each with a piece of it.
2. Targets: sources by code point, null last, have the weights ``weights`` by turns and share ``total`` times all words. A target
   stops at ``most`` times its source; the excess is reshared by weight until none is above (sorted by cap over weight, the capped
   sources are a prefix, found with running sums). A target in words becomes a whole number of blocks.
3. The output has as many slots as all sources have blocks to give, ``shard_slots`` to a shard. Each slot draws a source with the
   probability of its blocks, so the counts of a shard are multinomial. Draws beyond a source's blocks are taken back evenly from
   all shards and go to the sources that fell short, so the totals are the targets.
4. The slots of a source are numbered along the shards. Number j is in epoch j div n of the n blocks and takes the block at the
   permuted index of j mod n. The permutation is a swap-or-not network keyed by source and epoch: exact for any n, without tables.
   No block is used more than ceil(``most``) times.
5. Blocks are joined by (source, index), a fine key: a source with a third of all rows spreads over its blocks.

Only DataFrame functions are used. Running numbers come from a range shuffle, never from a window over a whole source. What is
windowed by source is a count per shard.

Defined cases. Null, empty and blank texts have size 0, are in no block and are taken 0 times. Null ids and repeated rows are
documents of their own (rows with equal id, source and text are interchangeable). A source without words has target 0. An empty
table gives an empty result. Only ``doc_id``, ``source`` and ``text`` are read, under own names; ``mixed`` returns all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.operators.ordering import dense_index, running

SLOTS_PER_TASK = 50_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    total: float = 1.5
    most: float = 2.0
    block: int = 64
    shard_slots: int = 4096
    rounds: int = 16
    seed: int = 11


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for every row: its id, source and text, and a number among rows that have all of them equal."""
    key = ["_id", "_source", "_hash"]
    named = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_source": F.col("source").cast("string"), "_hash": F.xxhash64("text")})
    return named.withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy("_hash")))


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(_source, rank, source_size, target, blocks, quota) of each source, given ``_source`` and ``_size`` of the documents."""
    w = settings.weights
    per = dense_index(
        sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")),
        [F.col("_source").isNull(), F.col("_source")], "rank",
    ).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in w]), (F.col("rank") % len(w) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(settings.most)
    # as few rows as sources
    order = dense_index(per.withColumn("cap", cap), [F.col("cap") / F.col("weight"), F.col("rank")], "_turn")
    order = running(order, F.col("cap"), "_caps", inclusive=False, index="_turn")
    order = running(order, F.col("weight"), "_weights", inclusive=False, index="_turn")
    sums = order.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_every"))
    order = order.crossJoin(F.broadcast(sums))  # one row
    level = (F.col("_all") * F.lit(settings.total) - F.col("_caps")) / (F.col("_every") - F.col("_weights"))
    order = order.withColumn("_level", level).withColumn("_capped", F.col("cap") <= F.col("_level") * F.col("weight"))
    open_level = order.agg(F.min_by("_level", F.when(~F.col("_capped"), F.col("_turn"))).alias("_final"))
    target = F.when(F.col("_capped") | F.col("_final").isNull(), F.col("cap")).otherwise(F.col("_final") * F.col("weight"))
    n = F.ceil(F.col("source_size") / F.lit(settings.block))
    return (
        order.crossJoin(F.broadcast(open_level))
        .select("_source", "rank", "source_size", target.alias("target"), n.alias("blocks"))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("bigint"))
    )


def permuted(index: Column, n: Column, rounds: int, *key: Column) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of 0..n-1 (swap-or-not)."""

    def step(x, r):
        other = F.pmod(F.xxhash64(*key, r) % n - x, n)
        swap = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("bigint"), step)


def _shard_counts(plan: DataFrame, settings: Settings) -> DataFrame:
    """(rank, shard, n, before): slots of each source in each shard, and its slots in earlier shards."""
    spark, cells = plan.sparkSession, 4096
    plan = running(plan, F.col("quota"), "low", inclusive=False, index="rank").withColumn("high", F.col("low") + F.col("quota"))
    slots = plan.agg(F.sum("quota")).first()[0] or 0
    width = max(1, -(-slots // cells))
    spans = plan.where("quota > 0").select(
        "rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")
    )
    draws = spark.range(slots).select(
        F.floor(F.col("id") / settings.shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(settings.seed), "id"), F.lit(max(1, slots))).alias("x"),
    ).withColumn("cell", F.floor(F.col("x") / width))
    drawn = draws.join(spans, "cell").where("x >= low and x < high").groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("rank").orderBy("shard")
    drawn = drawn.withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "drawn", F.sum("n").over(Window.partitionBy("rank"))
    )
    drawn = stored(drawn.join(plan.select("rank", "quota"), "rank"), "mix-draws")
    over = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))

    def share(upto):
        return F.floor(over.cast("decimal(19,0)") * upto / F.col("drawn")).cast("bigint")

    kept = drawn.withColumn("back", share(F.col("upto")) - share(F.col("upto") - F.col("n")))
    # slots taken back, numbered along the shards, against the places that sources lack
    free = dense_index(kept.where("back > 0").select("shard", "rank", F.explode(F.sequence(F.lit(1), F.col("back").cast("int"))).alias("k")), [F.col("shard"), F.col("rank"), F.col("k")], "place")
    totals = plan.join(drawn.select("rank", "drawn").distinct(), "rank", "left")
    short = totals.select("rank", (F.col("quota") - F.coalesce("drawn", F.lit(0))).cast("int").alias("short")).where("short > 0")
    n_free = free.count()
    lacking = dense_index(short.select("rank", F.explode(F.sequence(F.lit(1), "short")).alias("k")), [F.col("rank"), F.col("k")], "turn")
    lacking = lacking.select("rank", permuted(F.col("turn"), F.lit(max(1, n_free)).cast("bigint"), settings.rounds, F.lit(settings.seed)).alias("place"))
    added = free.select("shard", "place").join(lacking, "place").groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    final = kept.select("rank", "shard", (F.col("n") - F.col("back")).alias("n")).unionByName(added).groupBy("rank", "shard").agg(F.sum("n").alias("n"))
    return final.withColumn("before", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).where("n > 0")


def slots_of(plan: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(shard, rank, number, epoch, block): the block of each slot of the output."""
    counts = _shard_counts(plan, settings).join(plan.select("rank", "blocks"), "rank")
    # a row here becomes many: dealt out by the slots to come, as the counts themselves would fit one task
    slots = plan.agg(F.sum("quota")).first()[0] or 0
    counts = counts.repartition(1 + slots // SLOTS_PER_TASK, "rank", "shard")
    each = counts.select("shard", "rank", "blocks", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("number"))
    epoch = F.floor(F.col("number") / F.col("blocks"))
    return each.select(
        "shard", "rank", "number", epoch.alias("epoch"),
        permuted(F.col("number") % F.col("blocks"), F.col("blocks"), settings.rounds, F.lit(settings.seed), F.col("rank"), epoch).alias("block"),
    )


def pieces_of(placed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(rank, block, row, first, words): the words of each document in each block; ``placed`` has rank, row, at and _size."""
    b = settings.block
    last = F.col("at") + F.col("_size")
    each = placed.where("_size > 0").select(
        "rank", "row", "at", last.alias("last"), F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((last - 1) / b))).alias("block")
    )
    low, high = F.greatest("at", F.col("block") * b), F.least("last", (F.col("block") + 1) * b)
    return each.select("rank", "block", "row", (low - F.col("at")).alias("first"), (high - low).alias("words"))


def plan(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place in the source, sources with targets, slots), cut to the shared folder."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    narrow = _keyed(docs.select("doc_id", "source", "text")).select("_id", "_source", "_hash", "_copy", size.alias("_size"))
    narrow = stored(narrow, "mix-sizes")
    sources = stored(targets(narrow, settings), "mix-sources")
    order = [F.col("_source").isNull(), F.col("_source"), F.col("_id"), F.col("_hash"), F.col("_copy")]
    placed = running(dense_index(narrow, order, "row"), F.col("_size"), "upto", inclusive=False, index="row")
    # the first word of a source in the order of all
    starts = running(sources.select("_source", "rank", "source_size", "target"), F.col("source_size"), "start", inclusive=False, index="rank")
    starts = starts.withColumnRenamed("_source", "_named")
    placed = placed.join(F.broadcast(starts) if _few(starts) else starts, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named")
    placed = stored(placed.withColumn("at", F.col("upto") - F.col("start")).drop("upto", "start"), "mix-placed")
    return placed, sources, slots_of(sources, settings)


def _few(df: DataFrame, rows: int = 10_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    placed, _, slots = plan(docs, settings)
    used = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces_of(placed, settings).join(used, ["rank", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix as documents: rows of ``docs`` with the words that the mix takes of them, all columns as they were but ``text`` (and ``n_chars``).

    The k-th row of a document has, in order, the pieces whose block fills k slots or more: one row for what is taken once, another
    for what is taken twice, and so on, at most ceil(``most``) rows. Words are joined by a blank. The pieces of a document travel to
    its text, not the text to every slot, and its words are cut out once per row.
    """
    placed, _, slots = plan(docs, settings)
    used = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = (
        pieces_of(placed, settings).join(used, ["rank", "block"])
        # as many as the document has blocks
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("_parts"))
    )
    wanted = placed.join(parts, "row").select(*[F.col(c).alias(f"_w{c}") for c in ("_id", "_source", "_hash", "_copy")], "_parts")
    rows = _keyed(docs)
    same = F.col("_hash") == F.col("_w_hash")
    for c in ("_id", "_source", "_copy"):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{c}"))
    each = rows.join(wanted, same).withColumn("_again", F.explode(F.sequence(F.lit(1), F.array_max("_parts.times").cast("int"))))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    own = F.filter("_parts", lambda p: p["times"] >= F.col("_again"))
    # the words are worked out once and handed to the pieces
    text = F.element_at(
        F.transform(
            F.array(F.struct(words.alias("words"), own.alias("own"))),
            lambda x: F.array_join(F.flatten(F.transform(x["own"], lambda p: F.slice(x["words"], (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "),
        ),
        1,
    )
    out = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
