"""Duplicate groups: exact copies, near copies and same-minute bursts, and the best of each.

Items are first collapsed to distinct signatures, so that many copies of one file cost one
row in the similarity join, and are linked to their group by a star instead of by pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import minute_bucket
from tidemark.functions.numeric import hamming, hex_to_signature
from tidemark.operators.components import connected_components
from tidemark.operators.similarity import hamming_join
from tidemark.params import Settings
from tidemark.session import cut

# Order matters: a group takes the loosest reason found in it.
EXACT, NEAR, BURST = 0, 1, 2


def duplicate_items(media: DataFrame, quality: DataFrame) -> DataFrame:
    """Live items with what grouping needs: signature, reliable minute, rank columns."""
    pixels = F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0))
    return (
        media.where(~F.col("missing"))
        .join(quality.select(F.col("media_id").alias("id"), "total"), "id", "left")
        .select(
            "id",
            "kind",
            "sha256",
            hex_to_signature(F.col("phash")).alias("sig"),
            minute_bucket(F.col("taken_at"), F.col("date_source")).alias("minute"),
            F.col("pinned_best").alias("pinned"),
            F.coalesce(F.col("total"), F.lit(0.0)).alias("total"),
            pixels.alias("pixels"),
            "taken_at",
        )
    )


def content_key(sha256: Column) -> Column:
    """Equal exactly where ``sha256`` is; 64 lower-case hex digits, as a rule, take half the room. Others are longer than 32 bytes."""
    other = F.concat(F.encode(sha256, "utf-8"), F.lit(bytes(33)))
    return F.when(sha256.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(sha256)).otherwise(other)


def mark_copies(items: DataFrame) -> DataFrame:
    """Items with the lowest id of their content (``centre``), null where it is unique. The centre stands for the content from here on."""
    photo_sig = F.when(F.col("kind") == "photo", F.col("sig"))
    keyed = items.select("id", "kind", content_key(F.col("sha256")).alias("content"), "sig", "minute")
    centres = (
        keyed.where(F.col("content").isNotNull())
        .groupBy("content")
        .agg(F.min("id").alias("centre"), F.min_by(photo_sig, "id").alias("centre_sig"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    return keyed.join(centres, "content", "left").drop("content")


def exact_edges(marked: DataFrame) -> DataFrame:
    """Star edges (lowest id, other) of byte-identical items."""
    return marked.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("src"), F.col("id").alias("dst"))


def _collapsed(photos: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct ``keys``: its lowest item and what tells copies apart.

    ``sole`` is the centre of the only content in the row, if there is just one and it has
    copies; ``lone`` marks a row that is nothing but such a centre. Two rows of one content,
    one of them lone, consist of exact pairs only.
    """
    one = F.min("centre") == F.max("centre")
    return photos.groupBy(*keys).agg(
        F.min("id").alias("id"),
        F.count(F.lit(1)).alias("size"),
        F.when(one & (F.count("centre") == F.count(F.lit(1))), F.min("centre")).alias("sole"),
        ((F.count(F.lit(1)) == 1) & F.max(F.coalesce(F.col("id") == F.col("centre"), F.lit(False)))).alias("lone"),
        F.count_if((F.col("id") != F.col("centre")) & (F.col("sig") == F.col("centre_sig"))).alias("star"),
    )


def _photos(marked: DataFrame) -> DataFrame:
    return marked.where((F.col("kind") == "photo") & F.col("sig").isNotNull())


def near_edges(marked: DataFrame, threshold: int) -> DataFrame:
    """Links between similar items that are not already exact pairs."""
    photos = _photos(marked)
    rows = _collapsed(photos, ["sig"])
    across = hamming_join(rows.select("id", "sig", "sole", "lone"), threshold, above=0, links_only=True)
    # equal signatures: near unless every pair is an exact star edge already
    mixed = rows.where(F.col("size") * (F.col("size") - 1) / 2 > F.col("star")).select(
        "sig", F.col("id").alias("src")
    )
    equal = photos.select("id", "sig").join(mixed, "sig").where(F.col("id") != F.col("src"))
    return across.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        equal.select("src", F.col("id").alias("dst"))
    )


def burst_edges(marked: DataFrame, near: int, burst: int) -> DataFrame:
    """Links between less similar items of the same calendar minute."""
    rows = _collapsed(_photos(marked).where(F.col("minute").isNotNull()), ["minute", "sig"])
    found = hamming_join(
        rows.select("id", "sig", "sole", "lone", "minute"), burst, above=near, by=["minute"], links_only=True
    )
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def duplicate_edges(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(src, dst, reason) with reason 0 exact, 1 near, 2 burst."""
    marked = cut(mark_copies(items))
    edges = exact_edges(marked).withColumn("reason", F.lit(EXACT)).unionByName(
        near_edges(marked, settings.near_dup_threshold).withColumn("reason", F.lit(NEAR))
    )
    if settings.burst_enabled and settings.burst_threshold > settings.near_dup_threshold:
        found = burst_edges(marked, settings.near_dup_threshold, settings.burst_threshold)
        edges = edges.unionByName(found.withColumn("reason", F.lit(BURST)))
    return edges


def grouped(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, group_id) and (kinds: group_id, kind) of an edge table with reasons.

    An edge of a looser reason stands for at least one pair that has no closer one, so the
    loosest reason of a group is its kind.
    """
    first = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "reason")
    first = cut(first.groupBy("src", "dst").agg(F.max("reason").alias("reason")))
    members = connected_components(first).select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    kinds = (
        first.join(members.withColumnRenamed("id", "src"), "src")
        .groupBy("group_id")
        .agg(F.max("reason").alias("worst"))
        .select("group_id", F.element_at(F.array(*map(F.lit, ("exact", "near", "burst"))), F.col("worst") + 1).alias("kind"))
    )
    return members, kinds


def best_members(members: DataFrame, items: DataFrame) -> DataFrame:
    """Best item per group: pinned first, then score, then pixels, then the lowest id."""
    rank = F.struct("pinned", "total", "pixels", -F.col("id"))
    return (
        members.join(items.select("id", "pinned", "total", "pixels", "taken_at"), "id")
        .groupBy("group_id")
        .agg(
            F.max_by("id", rank).alias("best_media_id"),
            F.max_by("taken_at", rank).alias("taken_at"),
            F.count(F.lit(1)).alias("size"),
        )
    )


def duplicate_groups(items: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(dup_groups, dup_members) rebuilt from all live items. A group's id is its lowest member."""
    members, kinds = grouped(duplicate_edges(items, settings))
    groups = best_members(members, items).join(kinds, "group_id")
    groups = groups.select(F.col("group_id").alias("id"), "kind", "best_media_id", "size", "taken_at")
    return groups, with_distance(members, groups, items)


def with_distance(members: DataFrame, groups: DataFrame, items: DataFrame) -> DataFrame:
    """dup_members: distance of each member to the best one, 0 without a signature."""
    best = groups.select(F.col("id").alias("group_id"), F.col("best_media_id").alias("best"))
    best = best.join(items.select(F.col("id").alias("best"), F.col("sig").alias("best_sig")), "best")
    return (
        members.join(items.select("id", "sig"), "id")
        .join(best, "group_id")
        .select(
            F.col("id").alias("media_id"),
            "group_id",
            F.coalesce(hamming(F.col("sig"), F.col("best_sig")), F.lit(0)).alias("distance"),
        )
    )


def hidden_copies(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Ids of group members that are not the best of their group."""
    return (
        members.join(groups.select(F.col("id").alias("group_id"), "best_media_id"), "group_id")
        .where(F.col("media_id") != F.col("best_media_id"))
        .select("media_id")
    )


def regroup_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("hidden")
    )
