"""Order-dependent operators against their sequential definitions."""

import random
import re
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import curation, leaders as leading, sessions, vectors
from tidemark.operators.ordering import carried_last, dense_index, running
from tidemark.session import cut


def test_index_and_running(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = dense_index(spark.createDataFrame(rows, "id long, t long"), [F.col("t"), F.col("id")])
    df = running(df, F.col("id"), "total", rows=37)
    df = running(df, F.col("t"), "before", how="max", inclusive=False, rows=37)
    df = carried_last(df, F.when(F.col("id") % 7 == 0, F.col("id")), "last", rows=37)
    got = {r["_idx"]: (r["id"], r["total"], r["before"], r["last"]) for r in df.collect()}
    total, top, last = 0, None, None
    for i, (id, t) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        total += id
        assert got[i] == (id, total, top, last)
        top = t if top is None else max(top, t)
        last = id if id % 7 == 0 else last


def test_clusters(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        place = rng.choice([(None, None), (0.0, 0.0), (17.0, 78.0), (17.1, 78.0), (15.3, 74.1)])
        rows.append((i, i % 3, start + timedelta(minutes=30 * rng.randrange(2000)), *place))
    df = spark.createDataFrame(rows, "id long, who int, taken_at timestamp_ntz, gps_lat double, gps_lon double")
    out = sessions.split_clusters(df, 6, 30, ["who"])
    got = {}
    for r in out.collect():
        got.setdefault((r["who"], r["session"], r["place"]), set()).add(r["id"])
    want, last_place = [], None
    for who in range(3):
        current, at = [], None
        for id, _, t, la, lo in sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0])):
            geo = (la, lo) if la else None
            new = bool(current) and (t - at > timedelta(hours=6) or (geo and last_place and geo != last_place and {geo, last_place} != {(17.0, 78.0), (17.1, 78.0)}))
            if new or not current:
                current, last_place = [], None
                want.append(current)
            current.append(id)
            at, last_place = t, geo or last_place
        last_place = None
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_reuse(spark):
    rng = random.Random(3)
    old = [(i, rng.randrange(12), rng.choice(["auto", "moments"])) for i in range(150)]
    kinds = {e: random.Random(e).choice(["auto", "moments"]) for e in range(12)}
    old = [(i, e, kinds[e]) for i, e, _ in old]
    new = [(i, rng.randrange(10)) for i in range(150)]
    new_kind = {g: random.Random(100 + g).choice(["auto", "moments"]) for g in range(10)}
    got = {
        r["group_id"]: r["event_id"]
        for r in sessions.reuse_ids(
            spark.createDataFrame([(g, k, g) for g, k in new_kind.items()], "group_id long, kind string, position long"),
            spark.createDataFrame(new, "id long, group_id long"),
            spark.createDataFrame(old, "id long, event_id long, kind string"),
        ).collect()
    }
    used, want, order = set(), {}, list(dict.fromkeys(e for _, e, _ in old))
    for g in range(10):
        ids, best, overlap = {i for i, x in new if x == g}, None, 0
        for e in order:
            if e not in used and kinds[e] == new_kind[g]:
                n = len(ids & {i for i, x, _ in old if x == e})
                if n > overlap:
                    best, overlap = e, n
        if best is not None:
            used.add(best)
            want[g] = best
    assert got == want


def test_reuse_along_a_chain(spark, monkeypatch):
    """A thousand groups, each over its old event and a part of the next, settle at once."""
    rounds = []
    monkeypatch.setattr(sessions, "cut", lambda df: rounds.append(1) or cut(df))
    old = [(10 * g + i, g, "auto") for g in range(1001) for i in range(10)]
    new = [(10 * g + i, 5000 + g) for g in range(1000) for i in range(2, 12)]
    got = sessions.reuse_ids(
        spark.createDataFrame([(5000 + g, "auto", g) for g in range(1000)], "group_id long, kind string, position long"),
        spark.createDataFrame(new, "id long, group_id long"), spark.createDataFrame(old, "id long, event_id long, kind string"),
    )
    assert {(r["group_id"], r["event_id"]) for r in got.collect()} == {(5000 + g, g) for g in range(1000)} and len(rounds) <= 2


def test_diverse_in_rounds(spark):
    """Crowds of look-alikes force several rounds; the result is the sequential one."""
    rng = random.Random(2)
    start, rows = datetime(2024, 1, 1), []
    scenes = [rng.getrandbits(64) for _ in range(9)]
    for i in range(240):
        bits = scenes[0] if i % 3 else rng.choice(scenes)
        bits ^= 1 << rng.randrange(64)
        rows.append((i % 2, i, float(rng.randrange(100)) + (500 if i % 3 else 0), start + timedelta(seconds=i), bits - (1 << 64) if bits >> 63 else bits))
    df = spark.createDataFrame(rows, "g int, id long, score double, ts timestamp_ntz, sig long")
    df = df.withColumn("vec", F.lit(None).cast("array<float>"))
    got = {}
    for r in curation.diverse_top_k(df, ["g"], 5, pool=6).collect():
        got.setdefault(r["g"], {})[r["pick"]] = r["id"]
    for g in (0, 1):
        kept = []
        for _, id, _, _, sig in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3], r[1])):
            if len(kept) < 5 and all(((sig ^ k[1]) & (1 << 64) - 1).bit_count() > 10 for k in kept):
                kept.append((id, sig))
        assert got[g] == {i + 1: id for i, (id, _) in enumerate(kept)}


def test_thinning_in_chunks(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(i, i % 2, start + timedelta(seconds=20 * i), None if rng.random() < 0.2 else [float(rng.randrange(3) * 10)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, who int, taken_at timestamp_ntz, mark array<double>")
    rounds: list[int] = []
    got = {r["id"] for r in curation.thin_sequence(df, "mark", ["who"], window_s=120, max_diff=12.0, chunk_rows=23, rounds=rounds).collect()}
    want = set()
    for who in (0, 1):
        mark = at = None
        for id, _, t, m in (r for r in rows if r[1] == who):
            if m is not None and mark is not None and (t - at).total_seconds() <= 120 and abs(m[0] - mark[0]) < 12:
                continue
            want.add(id)
            if m is not None:
                mark, at = m, t
    assert got == want
    # 14 chunks: all but the first are handed an item, and few end otherwise for it
    assert rounds[0] <= 13 and sum(rounds[1:]) <= 6 and rounds[-1] == 0


def test_thinning_agrees_early(spark):
    """What a chunk's first run has kept is taken over from where both runs agree; one endless repeat hands the first item on."""
    start = datetime(2024, 5, 1)
    rows = [(i, start + timedelta(seconds=i), [float(i // 40)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, taken_at timestamp_ntz, mark array<double>")
    rounds: list[int] = []
    got = curation.thin_sequence(df, "mark", window_s=1000, max_diff=0.5, chunk_rows=10, rounds=rounds)
    assert sorted(r["id"] for r in got.collect()) == [0, 40, 80, 120, 160]
    assert rounds[0] == 19 and rounds[-1] == 0 and len(rounds) <= 6


def test_vector_shards(spark):
    """A class table beyond the bound is cut into shards and gives the same answers."""
    rng = np.random.default_rng(1)
    items = rng.normal(size=(60, 8))
    classes = rng.normal(size=(11, 8))
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    classes /= np.linalg.norm(classes, axis=1, keepdims=True)
    a = spark.createDataFrame([(i, v.tolist(), [int(i % 11)]) for i, v in enumerate(items)], "id long, embedding array<double>, no array<long>")
    b = spark.createDataFrame(
        [(i, v.tolist(), i % 4 != 0, f"t{i}", i > 8) for i, v in enumerate(classes)],
        "class_id long, class_vector array<double>, named boolean, tag string, background boolean",
    )
    sims = items @ classes.T
    for i in range(60):
        sims[i, [j for j in range(11) if j % 4 == 0 or j == i % 11]] = -9
    want = {i: int(sims[i].argmax()) for i in range(60) if sims[i].max() >= 0.3}
    for bound in (100, 4):
        got = vectors.nearest_class(a, b, 0.3, forbidden="no", max_classes=bound)
        assert {r["id"]: r["class_id"] for r in got.collect()} == want
    logits = np.exp(5 * items @ classes.T)
    p = logits / logits.sum(axis=1, keepdims=True)
    tags = {(i, f"t{j}") for i in range(60) for j in range(9) if p[i, j] >= 0.25}
    for bound in (100, 4):
        got = vectors.zero_shot_tags(a, b, 0.25, scale=5.0, key="id", vector="embedding", max_classes=bound)
        assert {(r["id"], r["tag"]) for r in got.collect()} == tags


@pytest.mark.parametrize("partitions, block_bytes", [(1, 1 << 20), (4, 1 << 20), (64, 8 * 12 * 7), (4, 8 * 12 * 3)])
def test_leader_clusters(spark, partitions, block_bytes):
    """One rule, whatever the partitions and the size of a block: compared with a loop over the seeds."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(90):
        v = np.repeat(np.eye(6), 2, axis=1)[i % 6] + rng.normal(size=12) * rng.choice([0.2, 0.5, 1.0])
        rows.append((i, float(rng.integers(0, 20)) if i % 9 else None, (v / np.linalg.norm(v)).tolist()))
    rows += [(200, 5.0, None), (201, 30.0, [0.0] * 12)]
    leaders, want = [], {}
    order = sorted((r for r in rows if r[2]), key=lambda r: (-(r[1] or 0.0), r[0]))
    for id, _, v in order:
        if all(np.dot(v, w) < 0.6 for _, w in leaders):
            leaders.append((id, v))
    for id, _, v in order:
        want[id] = id if any(id == x for x, _ in leaders) else max(leaders, key=lambda x: np.dot(v, x[1]))[0]
    df = spark.createDataFrame(rows, "id long, quality double, embedding array<double>").repartition(partitions)
    got = {r["id"]: r["cluster"] for r in leading.leader_clusters(df, 0.6, block_bytes=block_bytes).collect()}
    assert got == want and len(leaders) > 7
    assert leading.leader_clusters(df.limit(0), 0.6).count() == 0


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_first_independent_set(spark, few):
    """Rounds of joins choose what a loop over the nodes chooses, in few rounds on links without order."""
    rng = random.Random(3)
    nodes = list(range(300))
    links = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(900)} | {(7, n) for n in range(8, 200)}
    taken: set[int] = set()
    for n in nodes:
        if not any(b == n and a in taken for a, b in links):
            taken.add(n)
    df = spark.createDataFrame([(n,) for n in nodes], "at long")
    found, rounds = leading.first_independent(df, spark.createDataFrame([*links, (7, 8)], "better long, worse long"), few)
    assert {r["at"] for r in found.collect()} == taken
    assert rounds <= 12 and (few < 10_000 or rounds == 0)


def test_first_independent_chain(spark):
    """A chain is followed by one task once it is short enough."""
    df = spark.range(500).withColumnRenamed("id", "at")
    links = df.where("at < 499").select(F.col("at").alias("better"), (F.col("at") + 1).alias("worse"))
    found, rounds = leading.first_independent(df, links, 490)
    assert sorted(r["at"] for r in found.collect()) == list(range(0, 500, 2)) and rounds <= 5


def test_dense_cluster_is_not_compared_with_itself(spark, monkeypatch):
    """A cluster of most rows is closed by its leaders: the links between its members are not all made."""
    made = []
    pairs = leading.similar_pairs

    def counted(rows, link, blocks):
        out = cut(pairs(rows, link, blocks))
        made.append(out.count())
        return out

    monkeypatch.setattr(leading, "similar_pairs", counted)
    rng = np.random.default_rng(2)
    vectors_ = np.eye(16)[0] + rng.normal(size=(600, 16)) * 0.05
    rows = [(i, float(i % 13), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(vectors_)]
    df = spark.createDataFrame(rows, "id long, quality double, embedding array<double>")
    got = leading.leader_clusters(df, 0.6, block_rows=32).collect()
    assert {r["cluster"] for r in got} == {12} and len(got) == 600
    assert made[0] == 32 * 31 // 2 and sum(made) == made[0]


@pytest.mark.parametrize("held", [vectors.SUM_BYTES, 200])
def test_centroids_in_parts(spark, monkeypatch, held):
    """Partial sums of tasks that may hold few classes only."""
    monkeypatch.setattr(vectors, "SUM_BYTES", held)
    rng = np.random.default_rng(5)
    rows = [(i, f"c{i % 7}" if i % 10 else None, rng.normal(size=6).tolist() if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>").repartition(5)
    got = {r["c"]: (r["members"], r["centroid"]) for r in vectors.centroids(df, "c", "v", 6).collect()}
    assert set(got) == {f"c{k}" for k in range(7)}
    for name, (members, centroid) in got.items():
        own = np.array([v for _, c, v in rows if c == name and v])
        mean = own.sum(axis=0)
        assert members == len(own) and np.allclose(centroid, mean / (np.linalg.norm(mean) + 1e-8))
    assert vectors.centroids(df.limit(0), "c", "v", 6).collect() == []


def test_windows_of_two_owners(spark):
    """A window takes items of its own owner only; a null owner is an owner too."""
    day = datetime(2021, 7, 9)
    items = [(i, ["north", "south", None][i % 3], day + timedelta(hours=i)) for i in range(40)]
    windows = [(1, "north", day, day + timedelta(hours=20)), (2, "south", day + timedelta(hours=5), day + timedelta(hours=30)), (3, None, day, day + timedelta(hours=9)), (4, "north", day, day + timedelta(hours=25))]
    got = sessions.absorb(
        spark.createDataFrame(items, "id long, owner string, taken_at timestamp_ntz"),
        spark.createDataFrame(windows, "event_id long, owner string, start_at timestamp_ntz, end_at timestamp_ntz"),
        by=["owner"],
    )
    want = {}
    for id, owner, at in items:
        fits = sorted((s, e, w) for w, o, s, e in windows if o == owner and s <= at <= e)
        if fits:
            want[id] = fits[0][2]
    assert {r["id"]: r["event_id"] for r in got.collect()} == want


def test_chunks_of_one_step_serve_the_next(spark):
    """Steps over the same chunks deal the rows out once, and a rebuild does not join the items again."""
    df = dense_index(spark.range(1000).withColumn("t", F.col("id") % 13), [F.col("t"), F.col("id")])
    last = F.when(F.col("id") % 7 == 0, F.col("id"))
    one = running(carried_last(df, last, "last", rows=37, chunks=True), F.col("last") % 5, "total", rows=37)
    two = running(carried_last(df, last, "last", rows=37), F.col("last") % 5, "total", rows=37)
    assert one.columns == two.columns and sorted(one.collect()) == sorted(two.collect())
    dealt = lambda x: len(re.findall(r"Exchange hashpartitioning\(_chunk", x._jdf.queryExecution().executedPlan().toString()))
    assert dealt(one) < dealt(two)
    items = spark.createDataFrame([(i, f"2024-01-{1 + i % 9:02d} 0{i % 7}:00:00", 10.0 + i % 5, 70.0) for i in range(60)], "id long, at string, gps_lat double, gps_lon double")
    items = items.select("id", F.to_timestamp("at").cast("timestamp_ntz").alias("taken_at"), "gps_lat", "gps_lon")
    narrow = sessions.split_clusters(items, 6, 30, whole=False)
    assert set(narrow.columns) == {"id", "taken_at", "session", "place"}
    assert sorted(narrow.select("id", "session", "place").collect()) == sorted(sessions.split_clusters(items, 6, 30).select("id", "session", "place").collect())


def test_picks_keep_a_column(spark):
    rows = [(i % 3, i, float(i % 10), None if i == 5 else i / 7, i * 997) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, score double, hero double, sig long").withColumn("vec", F.lit(None).cast("array<double>"))
    df = df.withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))
    plain, kept = curation.diverse_top_k(df, ["g"], 5, pool=6), curation.diverse_top_k(df, ["g"], 5, pool=6, keep="hero")
    assert kept.columns == [*plain.columns, "hero"] and sorted(kept.drop("hero").collect()) == sorted(plain.collect())
    of = {r[1]: r[3] for r in rows}
    assert all(r["hero"] == of[r["id"]] for r in kept.collect())


def test_similarities_of_a_batch_are_held_in_slices(monkeypatch):
    """A batch against many classes holds some of its similarities at once, whatever their number."""
    taken = []
    monkeypatch.setattr(vectors, "_against_classes", lambda items, classes, key, vector, cols, kernel, *rest: taken.append(kernel) or (items, False))
    vectors.nearest_class(None, None, 0.1, forbidden="banned")
    rng = np.random.default_rng(5)
    rows, known = rng.normal(size=(3000, 16)), rng.normal(size=(6000, 16))
    ids, named = rng.permutation(6000), rng.random(6000) < 0.5
    banned = [[int(x) for x in rng.integers(0, 6000, 3)] if i % 10 == 0 else [] for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(rows.tolist()), pa.array(banned, pa.list_(pa.int64()))], ["id", "_v", "banned"])
    tracemalloc.start()
    got = taken[0](batch, known, {"class_id": ids.tolist(), "named": named.tolist()})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = rows @ known.T
    for i, out in enumerate(banned):
        if out:
            sims[i, ~named | np.isin(ids, out)] = -np.inf
    assert got["class_id"].to_pylist() == ids[sims.argmax(axis=1)].tolist()
    assert np.allclose(got["similarity"].to_numpy(), sims.max(axis=1)) and peak < 3 * 8 * vectors.BLOCK_CELLS < rows.shape[0] * known.shape[0] * 8
