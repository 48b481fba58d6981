import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates, similarity
from tidemark.operators.components import connected_components
from tidemark.params import Settings
from tidemark.plans.library import Library

ITEM = "id long, kind string, sha256 string, phash string, minute string, pinned boolean, total double, pixels long"


def found_groups(spark, items, near, burst, with_bursts=True):
    """{members: (kind, best)} of the operator."""
    rows = spark.createDataFrame(items, ITEM).withColumn("sig", F.conv("phash", 16, -10).cast("bigint"))
    rows = rows.withColumn("taken_at", F.lit(None).cast("timestamp_ntz"))
    groups, members = duplicates.duplicate_groups(rows, Settings(near_dup_threshold=near, burst_threshold=burst, burst_enabled=with_bursts))
    sets = {}
    for m in members.collect():
        sets.setdefault(m["group_id"], set()).add(m["media_id"])
    out = {frozenset(sets[g["id"]]): (g["kind"], g["best_media_id"]) for g in groups.collect()}
    assert all(g["size"] == len(sets[g["id"]]) for g in groups.collect()) and len(out) == len(sets)
    return out


def pairwise_groups(items, near, burst, with_bursts=True):
    """The definition: a pair's reason is its strictest, a group's kind its loosest, its best the first by pin, score, size, id."""
    reason, parent = {}, {i[0]: i[0] for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = {}
    for id, _, sha, *_ in items:
        # copies hang on their first one
        head = same.setdefault(sha, id) if sha else id
        if head != id:
            reason[(head, id)] = 0
    shown = [i for i in items if i[1] == "photo" and i[3]]
    for n, a in enumerate(shown):
        for b in shown[n + 1 :]:
            bits = (int(a[3], 16) ^ int(b[3], 16)).bit_count()
            if bits <= near:
                reason.setdefault((a[0], b[0]), 1)
            elif with_bursts and bits <= burst and a[4] and a[4] == b[4]:
                reason.setdefault((a[0], b[0]), 2)
    for a, b in reason:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    loosest, sets = {}, {}
    for (a, _), why in reason.items():
        loosest[root(a)] = max(why, loosest.get(root(a), 0))
    for item in items:
        sets.setdefault(root(item[0]), []).append(item)
    first = lambda i: (not i[5], -i[6], -i[7], i[0])
    return {frozenset(i[0] for i in s): (("exact", "near", "burst")[loosest[g]], min(s, key=first)[0]) for g, s in sets.items() if len(s) > 1}


@pytest.mark.parametrize("seed, near, burst, with_bursts", [(31, 6, 18, True), (32, 3, 14, True), (33, 9, 20, False)])
def test_groups_against_pairs(spark, seed, near, burst, with_bursts):
    rng = random.Random(seed)
    scenes, items = [rng.getrandbits(64) for _ in range(14)], []
    for id in range(1, 101):
        bits = rng.choice(scenes)
        for place in rng.sample(range(64), rng.choice([0, 0, 1, 4, 7, 11, 16])):
            bits ^= 1 << place
        film = rng.random() < 0.15
        items.append((
            id, "video" if film else "photo", rng.choice([f"one{id}", f"one{id}", f"copy{rng.randrange(9)}"]), None if film or rng.random() < 0.05 else f"{bits:016x}",
            rng.choice([None, "09:14", "17:40"]), rng.random() < 0.1, float(rng.randrange(4)), rng.randrange(3) * 1000,
        ))
    assert found_groups(spark, items, near, burst, with_bursts) == pairwise_groups(items, near, burst, with_bursts)


@pytest.mark.parametrize("threshold, small", [(2, 256), (8, 256), (8, 4), (20, 4)])
def test_hamming_join(spark, monkeypatch, threshold, small):
    """Quiet and crowded keys give the same pairs as comparing everything."""
    monkeypatch.setattr(similarity, "SMALL_KEY", small)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = set(base)
    while len(values) < 120:
        v = rng.choice(base)
        for _ in range(rng.randrange(1, 9)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    sigs = spark.createDataFrame(rows, "id long, sig long")
    want = {
        (i, j, (a ^ b).bit_count())
        for i, a in enumerate(sorted(values))
        for j, b in enumerate(sorted(values))
        if i < j and (a ^ b).bit_count() <= threshold
    }
    got = [tuple(r) for r in similarity.hamming_join(sigs, threshold).select("a", "b", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = similarity.hamming_join(sigs, threshold, links_only=True)
    as_components = {tuple(r) for r in connected_components(links, "a", "b").collect()}
    full = spark.createDataFrame(list(want) or [(0, 0, 0)], "a long, b long, d int")
    assert as_components == {tuple(r) for r in connected_components(full, "a", "b").collect()}


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def test_pins(spark):
    from tidemark.operators.edits import pin_best

    media = spark.createDataFrame([(1, False), (2, True), (3, True)], "id long, pinned_best boolean")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "media_id long, group_id long")
    pins = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 9, 1)], "ts long, group_id long, media_id long")
    out, bad = pin_best(media, members, pins)
    assert {r["id"]: r["pinned_best"] for r in out.collect()} == {1: True, 2: False, 3: True}
    assert [r["group_id"] for r in bad.collect()] == [9]


def test_content_keys(spark):
    """Keys are equal exactly where the digests are, also for what is no digest."""
    texts = ["ab" * 32, "AB" * 32, "ab" * 31, "x", "", "x\0", "ab" * 32 + "\n", None, "ab" * 32]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, sha256 string")
    keys = dict(rows.select("id", duplicates.content_key(F.col("sha256")).alias("k")).collect())
    for i, a in enumerate(texts):
        assert (keys[i] is None) == (a is None)
        assert all((keys[i] == keys[j]) == (a == b) for j, b in enumerate(texts))


def test_hidden_copies_are_worked_out_once(spark):
    lib = Library(spark).having(
        dup_groups=spark.createDataFrame([(1, "near", 2)], "id long, kind string, best_media_id long"),
        dup_members=spark.createDataFrame([(1, 1), (2, 1)], "media_id long, group_id long"),
    )
    hidden = lib.hidden()
    assert "Join" not in hidden._jdf.queryExecution().optimizedPlan().toString()
    assert [r["media_id"] for r in hidden.collect()] == [1]
    assert lib.having(media=hidden).hidden() is hidden
    other = lib.having(dup_members=spark.createDataFrame([(3, 1)], "media_id long, group_id long"))
    assert [r["media_id"] for r in other.hidden().collect()] == [3]
