"""Look-alikes, diverse top-k, heroes and sequential thinning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import dot, hamming, hex_to_signature, is_landscape
from tidemark.operators.ordering import dense_index
from tidemark.params import BURST_COS, BURST_SECONDS, CURATED_MAX, SAME_SCENE_COS, SAME_SIGNATURE
from tidemark.session import cut


def item_score(quality: Column, people: Column) -> Column:
    return F.coalesce(quality, F.lit(50.0)) + 4 * F.least(F.coalesce(people, F.lit(0)), F.lit(3))


def hero_score(score: Column, landscape: Column, aesthetic: Column) -> Column:
    return score + F.when(landscape, 6).otherwise(0) + 10 * F.coalesce(aesthetic, F.lit(0.0))


def look_alike(
    a: dict[str, Column],
    b: dict[str, Column],
    same_signature: int = SAME_SIGNATURE,
    same_cos: float = SAME_SCENE_COS,
    burst_cos: float = BURST_COS,
    burst_seconds: int = BURST_SECONDS,
) -> Column:
    """Do two items (``sig``, ``vec``, ``ts``) show practically the same thing?"""
    near = F.coalesce(hamming(a["sig"], b["sig"]) <= same_signature, F.lit(False))
    cos = dot(a["vec"], b["vec"])
    apart = F.abs(F.unix_micros(a["ts"].cast("timestamp")) - F.unix_micros(b["ts"].cast("timestamp")))
    close = (cos >= same_cos) | ((cos >= burst_cos) & (apart <= burst_seconds * 1_000_000))
    return near | F.coalesce(close, F.lit(False))


def _greedy(group: list[str], k: int, pool: int, same_signature: int, same_cos: float, burst_cos: float, burst_seconds: int):
    columns = [*group, "id", "pick", "_kept", "more"]
    burst_us = burst_seconds * 1_000_000

    def alike(a, b) -> bool:
        if a[0] is not None and b[0] is not None and (a[0] ^ b[0]).bit_count() <= same_signature:
            return True
        if a[1] is None or b[1] is None:
            return False
        cos = float(a[1] @ b[1])
        return cos >= same_cos or (cos >= burst_cos and abs(a[2] - b[2]) <= burst_us)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come clustered by group and best first; a group may span batches."""
        current, kept, out, done = None, [], [], []
        for batch in batches:
            keys = zip(*[batch[c] for c in group])
            for key, item, sig, vec, at, rank, have, extra in zip(
                keys, batch["id"], batch["sig"], batch["vec"], batch["_us"], batch["_rank"], batch["_have"], batch["_kept"]
            ):
                if key != current:
                    done += out
                    current, kept, out = key, [], []
                if rank > pool:
                    # one row beyond the pool only says that the group goes on
                    out = [(*row[:-1], True) for row in out]
                    continue
                if have + len(kept) >= k:
                    continue
                me = (
                    None if pd.isna(sig) else int(sig) & (1 << 64) - 1,
                    None if vec is None else np.asarray(vec, dtype=np.float64),
                    int(at),
                )
                if not any(alike(me, other) for other in kept):
                    kept.append(me)
                    out.append((*key, item, have + len(kept), extra, False))
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def diverse_top_k(
    items: DataFrame,
    group: list[str],
    k: int = CURATED_MAX,
    pool: int | None = None,
    same_signature: int = SAME_SIGNATURE,
    same_cos: float = SAME_SCENE_COS,
    burst_cos: float = BURST_COS,
    burst_seconds: int = BURST_SECONDS,
    keep: str | None = None,
) -> DataFrame:
    """(group, id, pick): the k best items of each group that look alike to no better pick.

    ``items``: group columns, id, score, ts, sig, vec; the picks have the column ``keep`` of theirs too. Each round looks only at the ``pool``
    best remaining items of a group (the window group limit drops the others before the
    shuffle). Groups that are neither full nor exhausted go on with the items that resemble
    none of their picks, so every further round adds a pick.
    """
    pool = pool or 8 * k
    rules = (same_signature, same_cos, burst_cos, burst_seconds)
    by_group = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name in group)
    schema = f"{by_group}, id bigint, pick int, _kept string, more boolean"
    # as text, in which no null becomes another value on its way through pandas
    kept = (F.col(keep) if keep else F.lit(None)).cast("string").alias("_kept")
    shape = [*group, "id", "pick", *([F.col("_kept").cast(dict(items.dtypes)[keep]).alias(keep)] if keep else [])]
    rank = Window.partitionBy(*group).orderBy(F.col("score").desc(), "ts", "id")
    remaining = items.select(*group, "id", "score", "ts", "sig", "vec", kept).withColumn("_have", F.lit(0))
    picks = None
    while True:
        top = remaining.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= pool + 1)
        ordered = top.select(
            *group, "id", "sig", "vec", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), "_rank", "_have", "_kept"
        )
        # the window leaves the rows clustered by group and sorted by rank
        new = cut(ordered.mapInPandas(_greedy(group, k, pool, *rules), schema).select(*shape, "more"))
        picks = new if picks is None else picks.unionByName(new)
        latest = new.groupBy(*group).agg(F.max("pick").alias("_have"), F.max("more").alias("_more"))
        waiting = latest.where(F.col("_more") & (F.col("_have") < k))
        if waiting.isEmpty():
            return picks.drop("more")
        details = items.select("id", "sig", "vec", "ts").join(new.select(*group, "id").join(waiting, group, "left_semi"), "id")
        shown = details.groupBy(*group).agg(F.collect_list(F.struct("sig", "vec", "ts")).alias("_shown"))
        me = {"sig": F.col("sig"), "vec": F.col("vec"), "ts": F.col("ts")}
        repeats = F.exists("_shown", lambda p: look_alike(me, {"sig": p["sig"], "vec": p["vec"], "ts": p["ts"]}, *rules))
        seen = top.where(F.col("_rank") <= pool).select("id")
        remaining = cut(
            remaining.drop("_have")
            .join(waiting.select(*group, "_have"), group)
            .join(seen, "id", "left_anti")
            .join(shown, group)
            .where(~repeats)
            .drop("_shown")
        )


def curation_items(
    media: DataFrame, quality: DataFrame, embeddings: DataFrame, faces: DataFrame, persons: DataFrame, hidden: DataFrame
) -> DataFrame:
    """Live items with everything curation needs: scores, signature, vector, visibility."""
    visible = faces.join(persons.where(~F.col("hidden")).select(F.col("id").alias("person_id")), "person_id")
    people = visible.groupBy(F.col("media_id").alias("id")).agg(F.count_distinct("person_id").alias("people"))
    return (
        media.where(~F.col("missing"))
        .join(quality.select(F.col("media_id").alias("id"), "total", "aesthetic"), "id", "left")
        .join(embeddings.select(F.col("media_id").alias("id"), F.col("vector").alias("vec")), "id", "left")
        .join(people, "id", "left")
        .join(hidden.select(F.col("media_id").alias("id"), F.lit(True).alias("copy")), "id", "left")
        .select(
            "id",
            "kind",
            F.col("taken_at").alias("ts"),
            "has_thumb",
            F.coalesce("copy", F.lit(False)).alias("hidden_copy"),
            hex_to_signature(F.col("phash")).alias("sig"),
            "vec",
            item_score(F.col("total"), F.col("people")).alias("score"),
            hero_score(
                item_score(F.col("total"), F.col("people")),
                is_landscape(F.col("width"), F.col("height")),
                F.col("aesthetic"),
            ).alias("hero_score"),
        )
    )


def curate(members: DataFrame, items: DataFrame, group: str, k: int = CURATED_MAX) -> tuple[DataFrame, DataFrame]:
    """(picks: group, id, pick; heroes: group, hero_id) for a membership table (group, id).

    The hero is the best pick; a group without any visible photo takes its earliest item.
    """
    inside = members.select(group, "id").join(items, "id")
    photos = inside.where((F.col("kind") == "photo") & F.col("has_thumb") & ~F.col("hidden_copy"))
    picks = diverse_top_k(photos, [group], k, keep="hero_score")
    best = picks.groupBy(group).agg(F.max_by("id", F.struct("hero_score", -F.col("pick"))).alias("hero_id"))
    fallback = (
        inside.where("has_thumb")
        .groupBy(group)
        .agg(F.min_by("id", F.struct("ts", "id")).alias("first_id"))
        .join(best, group, "left")
    )
    return picks.drop("hero_score"), fallback.select(group, F.coalesce("hero_id", "first_id").alias("hero_id"))


# ---------- sequential thinning ----------

def _thin(owner: list[str], key: str, window_s: float, max_diff: float):
    """One chunk from its entry on; ``_kept`` is what the run before has kept (null in the first).

    As soon as both runs keep the same fingerprint they agree to the end, so the rest is taken over.
    """

    def run(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_chunk": [], key: [], "kept": [], "state": []})
        rows = rows.sort_values("_idx", ignore_index=True)
        marked = rows["_print"].notna().to_numpy()
        at = rows["_us"].to_numpy(np.int64)
        marks = dict(zip(np.flatnonzero(marked).tolist(), (np.asarray(m, dtype=np.float64) for m in rows["_print"][marked]), strict=True))
        owners = list(zip(*[rows[o] for o in owner])) if owner else [()] * len(rows)
        was = rows["_kept"].to_numpy() if rows["_kept"].notna().all() else None
        state = None
        if len(entry):
            first = entry.iloc[0]
            state = (tuple(first[o] for o in owner), int(first["_us"]), np.asarray(first["_print"], dtype=np.float64))
        kept = np.ones(len(rows), dtype=bool)
        for i, mark in marks.items():
            if state is not None and state[0] == owners[i] and at[i] - state[1] <= window_s * 1_000_000 and np.abs(mark - state[2]).mean() < max_diff:
                kept[i] = False
                continue
            if was is not None and was[i]:
                kept[i:] = was[i:]
                break
            state = (owners[i], at[i], mark)
        last = np.flatnonzero(kept & marked)
        end = rows[key].iloc[last[-1]] if len(last) else entry.iloc[0][key] if len(entry) else None
        return pd.DataFrame({"_chunk": rows["_chunk"], key: rows[key], "kept": kept, "state": pd.array([end] * len(rows), dtype="Int64")})

    return run


def thin_sequence(
    items: DataFrame,
    fingerprint: str,
    by: list[str] | None = None,
    ts: str = "taken_at",
    key: str = "id",
    window_s: float = 120,
    max_diff: float = 12.0,
    chunk_rows: int = 20_000,
    rounds: list[int] | None = None,
) -> DataFrame:
    """Drop items that repeat the last kept fingerprint within ``window_s`` seconds.

    Items without a fingerprint stay and do not change what later ones are compared with.
    The sequence is cut into chunks of fixed size that run side by side, as if nothing came before.
    Then a chunk runs again if its predecessor ends with another item than it started from, and only up
    to the place where it agrees with its run before; rounds repeat until no chunk is handed another
    item, which is then the sequential result. ``rounds`` receives the number of chunks of each round.
    """
    by = by or []
    narrow = items.select(
        *by, key, ts, F.col(fingerprint).cast("array<double>").alias("_print"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")
    )
    rows = dense_index(narrow, [*map(F.col, by), F.col(ts), F.col(key)])
    rows = cut(rows.withColumn("_chunk", F.floor(F.col("_idx") / chunk_rows)).drop(ts))
    # aliases keep the two sides of the cogroup apart
    columns = ["_chunk", *by, "_us", "_print", key]
    states = rows.select(*[F.col(c).alias(c) for c in columns])
    run, schema = _thin(by, key, window_s, max_diff), f"_chunk bigint, {key} bigint, kept boolean, state bigint"

    def ran(part: DataFrame, entry: DataFrame) -> DataFrame:
        return part.groupBy("_chunk").cogroup(entry.groupBy("_chunk")).applyInPandas(run, schema)

    done = cut(ran(rows.withColumn("_kept", F.lit(None).cast("boolean")), states.limit(0)))
    used = done.select("_chunk", "state").limit(0)
    while True:
        ends = cut(done.groupBy("_chunk").agg(F.max("state").alias("state")))
        handed = ends.where("state is not null").select((F.col("_chunk") + 1).alias("_chunk"), "state").join(ends.select("_chunk"), "_chunk", "left_semi")
        before = used.select("_chunk", F.col("state").alias("was"))
        changed = cut(handed.join(before, "_chunk", "left").where(~F.col("state").eqNullSafe(F.col("was"))).select("_chunk", "state"))
        n = changed.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        again = rows.join(changed.select("_chunk"), "_chunk", "left_semi").join(done.select(key, F.col("kept").alias("_kept")), key)
        entry = changed.withColumnRenamed("state", key).join(states.drop("_chunk"), key).select(*[F.col(c).alias(c) for c in columns])
        done = cut(done.join(changed.select("_chunk"), "_chunk", "left_anti").unionByName(ran(again, entry)))
        used = cut(handed)
    return items.join(done.where("kept").select(key), key, "left_semi")
