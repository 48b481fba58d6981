"""The similarity join deals its work by comparisons, and crowded keys keep their links."""

import random

import pytest
from test_duplicates import found_groups, pairwise_groups

from tidemark.operators import similarity
from tidemark.operators.components import connected_components


def test_tasks_follow_comparisons(spark, monkeypatch):
    """Few bytes with many comparisons are not merged into few tasks."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64, raising=False)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 3000, raising=False)
    rng = random.Random(5)
    rows = [(i, rng.getrandbits(63), i % 2) for i in range(700)]
    found = similarity.hamming_join(spark.createDataFrame(rows, "id long, sig long, minute int"), 24, above=8, by=["minute"])
    got = {tuple(r) for r in found.collect()}
    bits = {(a, b): (x ^ y).bit_count() for a, x, m in rows for b, y, n in rows if a < b and m == n}
    assert got == {(*k, d) for k, d in bits.items() if 8 < d <= 24}
    assert found.rdd.getNumPartitions() >= 40


@pytest.mark.parametrize("seed", [41, 42])
def test_groups_of_crowded_keys(spark, monkeypatch, seed):
    monkeypatch.setattr(similarity, "SMALL_KEY", 4)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 5, raising=False)
    rng = random.Random(seed)
    scenes, items = [rng.getrandbits(64) for _ in range(6)], []
    for id in range(1, 141):
        bits = rng.choice(scenes)
        for place in rng.sample(range(64), rng.choice([0, 0, 1, 4, 7, 11])):
            bits ^= 1 << place
        items.append((id, "photo", rng.choice([f"one{id}", f"copy{rng.randrange(20)}"]), f"{bits:016x}", rng.choice([None, "09:14", "17:40"]), False, float(id % 4), 1000))
    assert found_groups(spark, items, 6, 18) == pairwise_groups(items, 6, 18)


def _shuffled_rows(spark, run):
    """Rows that the stages of ``run`` wrote for other stages."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()

    def written():
        none = sc._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none).iterator()
        rows = {}
        while stages.hasNext():
            stage = stages.next()
            rows[stage.stageId(), stage.attemptId()] = stage.shuffleWriteRecords()
        return rows

    before = written()
    run()
    return sum(n for key, n in written().items() if key not in before)


def test_copies_of_a_row_stay_few(spark):
    """A row travels to a few cells, not under every value one bit away."""
    rng = random.Random(8)
    sigs = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(3000)], "id long, sig long")
    assert _shuffled_rows(spark, lambda: similarity.hamming_join(sigs, 8).collect()) < 20 * 3000


@pytest.mark.parametrize("threshold, above, grouped", [(2, -1, False), (5, 0, False), (8, -1, False), (11, 3, False), (8, -1, True)])
def test_cells_and_their_blocks(spark, monkeypatch, threshold, above, grouped):
    """Pairs across cells and blocks are found, each once; links connect the same rows."""
    monkeypatch.setattr(similarity, "CELL_ROWS", 32, raising=False)
    monkeypatch.setattr(similarity, "CELL_BLOCK", 40, raising=False)
    monkeypatch.setattr(similarity, "SLICE", 50, raising=False)
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(400):
        v = rng.choice(base)
        for place in rng.sample(range(64), rng.randrange(0, 9)):
            v ^= 1 << place
        rows.append((i, v - (1 << 64) if v >> 63 else v, rng.choice([0, 1, None]) if grouped else 0))
    by = ["minute"] if grouped else None
    sigs = spark.createDataFrame(rows, "id long, sig long, minute int")
    bits = {(a, b): ((x ^ y) & (1 << 64) - 1).bit_count() for a, x, m in rows for b, y, n in rows if a < b and m == n and m is not None}
    want = {(*k, d) for k, d in bits.items() if above < d <= threshold}
    got = [tuple(r) for r in similarity.hamming_join(sigs, threshold, above=above, by=by).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = similarity.hamming_join(sigs, threshold, above=above, by=by, links_only=True)
    parts = {tuple(r) for r in connected_components(links, "a", "b").collect()}
    pairs = spark.createDataFrame([(a, b) for a, b, _ in want], "a long, b long")
    assert parts == {tuple(r) for r in connected_components(pairs, "a", "b").collect()}
