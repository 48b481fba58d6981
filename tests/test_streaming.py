from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs


def run(stream, name, mode="append"):
    """Process what is there and return the rows."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def source(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t), (1, t + timedelta(hours=6)), (1, t + timedelta(hours=12, seconds=1)), (2, t), (2, t + timedelta(days=9))]
    stream = source(spark, tmp_path, rows, "who int, ts timestamp")
    got = run(jobs.stream_sessions(stream, 6, "1 hour", ["who"]), "sessions")
    assert sorted((r["who"], r["n"]) for r in got if r["start_at"] < t + timedelta(days=8)) == [(1, 1), (1, 2), (2, 1)]


def test_copies_and_windows(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [(1, t, "a"), (2, t, "a"), (3, t + timedelta(hours=5), "b")]
    stream = source(spark, tmp_path, rows, "id long, ts timestamp, sha256 string")
    assert sorted(r["sha256"] for r in run(jobs.stream_first_copies(stream, "1 day"), "copies")) == ["a", "b"]
    windows = spark.createDataFrame([(8, t, t + timedelta(hours=1)), (7, t, t + timedelta(hours=9))], "event_id long, start_at timestamp, end_at timestamp")
    got = run(jobs.stream_absorb(stream, windows), "absorbed")
    assert sorted((r["id"], r["event_id"]) for r in got) == [(1, 8), (2, 8), (3, 7)]


def test_entities(spark, tmp_path):
    """Every batch meets the newest finished class table."""
    schema, classes, found = "id long, embedding array<float>", str(tmp_path / "classes"), str(tmp_path / "found")
    arrivals = [(1, [0.6, 0.8]), (2, [0.0, -2.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.5, 0.5])]
    stream = source(spark, tmp_path / "in", arrivals, schema)
    known = spark.createDataFrame([(30, [0.0, 1.0]), (10, [1.0, 0.0]), (20, [0.0, -1.0]), (40, [1.0, 0.0])], "class_id long, class_vector array<double>")
    assert jobs.publish_classes(known, classes) == 0
    job = jobs.stream_entities(stream, classes, found, str(tmp_path / "cp"), 0.4)
    job.trigger(availableNow=True).start().awaitTermination()

    def matches():
        return sorted((r["id"], r["class_id"], round(r["similarity"], 5), r["version"]) for r in spark.read.parquet(found).collect())

    first = [(1, 30, 0.8, 0), (2, 20, 2.0, 0), (5, 10, 0.5, 0)]
    assert matches() == first
    newer = known.unionByName(spark.createDataFrame([(50, [-1.0, 0.0])], known.schema))
    assert jobs.publish_classes(newer, classes) == 1
    (tmp_path / "classes" / "v=2").mkdir()  # not finished
    source(spark, tmp_path / "in", [(6, [-0.9, 0.1])], schema)
    job.trigger(availableNow=True).start().awaitTermination()
    assert matches() == [*first, (6, 50, 0.9, 1)]


def test_entities_without_classes(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [(1, [0.6, 0.8])], "id long, embedding array<float>")
    empty = spark.createDataFrame([], "class_id long, class_vector array<double>")
    jobs.publish_classes(empty, str(tmp_path / "classes"))
    job = jobs.stream_entities(stream, str(tmp_path / "classes"), str(tmp_path / "found"), str(tmp_path / "cp"), 0.4)
    job.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("id long").parquet(str(tmp_path / "found")).count() == 0


def test_late_rows_do_not_turn_back_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    t = datetime(2021, 6, 1)
    schema = "id long, who string, ts timestamp, mark array<double>"
    stream = source(spark, tmp_path / "in", [(1, "k", t, [0.0]), (2, "k", t + timedelta(seconds=200), [50.0])], schema)
    job = jobs.stream_thin(stream, "who", "mark", late="2 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
    job.trigger(availableNow=True).start().awaitTermination()
    # an hour late and unlike the last one: kept; then one like the last one: dropped
    source(spark, tmp_path / "in", [(3, "k", t - timedelta(hours=1), [90.0]), (4, "k", t + timedelta(seconds=260), [51.0])], schema)
    job.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_thinning(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    t = datetime(2024, 1, 1)
    marks = [0.0, 5.0, 40.0, 42.0, None, 41.0, 41.0]
    rows = [(i, "o", t + timedelta(seconds=60 * i), None if m is None else [m]) for i, m in enumerate(marks)]
    stream = source(spark, tmp_path, rows, "id long, who string, ts timestamp, mark array<double>")
    got = run(jobs.stream_thin(stream, "who", "mark"), "thin")
    assert sorted(r["id"] for r in got) == [0, 2, 4, 5]


def test_thinning_state_expires(spark, tmp_path):
    """An owner's state goes once the watermark is past its window; a row behind the watermark is left out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    t = datetime(2022, 3, 1)
    schema = "id long, who string, ts timestamp, mark array<double>"
    stream = source(spark, tmp_path / "in", [(1, "k", t, [0.0]), (2, "m", t + timedelta(seconds=10), [0.0])], schema)
    job = jobs.stream_thin(stream, "who", "mark", late="10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))

    def after(rows):
        source(spark, tmp_path / "in", rows, schema)
        job.trigger(availableNow=True).start().awaitTermination()
        kept = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp"))
        return kept, sorted(r[0] for r in state.select("key.owner").collect())

    job.trigger(availableNow=True).start().awaitTermination()
    # m goes on and stays; the clock passes 120 s after k's row
    kept, state = after([(3, "m", t + timedelta(seconds=100), [90.0]), (4, "n", t + timedelta(seconds=160), [0.0])])
    assert kept == [1, 2, 3, 4] and state == ["m", "n"]
    # behind the watermark: left out, and no state comes back; like its last one: dropped
    kept, state = after([(5, "k", t + timedelta(seconds=30), [0.0]), (6, "m", t + timedelta(seconds=155), [91.0])])
    assert kept == [1, 2, 3, 4] and state == ["m", "n"]


def _ingest(spark, tmp_path, stream, **layout):
    job = jobs.incremental_ingest(stream, str(tmp_path / "snap"), str(tmp_path / "ch"), str(tmp_path / "cp"), ["path"], ["size"], **layout)
    job.trigger(availableNow=True).start().awaitTermination()


def test_incremental_ingest(spark, tmp_path):
    schema = "path string, size long, seen_at long"
    stream = source(spark, tmp_path / "in", [("x", 1, 1), ("y", 2, 1), ("z", 1, 1), ("n", 5, 1), ("n", 4, 0)], schema)
    store = jobs.ingest_snapshot(spark, stream, str(tmp_path / "snap"), ["path"], ["size"])
    store.start(spark.createDataFrame([("x", 1, False), ("y", 1, False), ("z", 1, True)], "path string, size long, missing boolean"))
    _ingest(spark, tmp_path, stream)
    got = spark.read.parquet(f"{tmp_path}/ch").collect()
    assert {r["path"]: r["status"] for r in got} == {"x": "unchanged", "y": "updated", "z": "revived", "n": "added"}
    assert {tuple(r) for r in store.read(1).collect()} == {("x", 1, False), ("y", 2, False), ("z", 1, False), ("n", 5, False)}
    # a repeated batch sees what was there before it
    assert {tuple(r) for r in store.read(0).collect()} == {("x", 1, False), ("y", 1, False), ("z", 1, True)}


def test_ingest_writes_touched_buckets_only(spark, tmp_path):
    """Deltas of the buckets that change, compaction of those with many, and old files go."""
    schema = "path string, size long, seen_at long"
    names = [f"f{i}" for i in range(40)]
    stream = source(spark, tmp_path / "in", [(n, 1, 0) for n in names], schema)
    layout = {"buckets": 8, "max_deltas": 3}
    store = jobs.ingest_snapshot(spark, stream, str(tmp_path / "snap"), ["path"], ["size"], **layout)
    _ingest(spark, tmp_path, stream, **layout)
    want = dict.fromkeys(names, 1)

    def files():
        return {str(p.relative_to(tmp_path / "snap")): p.stat().st_mtime_ns for p in (tmp_path / "snap").rglob("*.parquet")}

    bucket = store.bucket()
    where = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "path string").select("path", bucket).collect()}
    for k in range(1, 6):
        before = files()
        source(spark, tmp_path / "in", [("f0", k + 1, k), ("f1", 1, k)], schema)
        _ingest(spark, tmp_path, stream, **layout)
        want["f0"] = k + 1
        assert {r["path"]: r["size"] for r in store.read(100).collect()} == want
        now = files()
        assert all(f"bucket={where['f0']}/" in f for f in now.keys() - before.keys())
        assert all(now[f] == before[f] for f in now.keys() & before.keys())
    # three deltas of the one bucket were merged, twice; what the first merge replaced is gone
    assert store._layout(100)[0] == {where["f0"]: 5} and where["f0"] not in {b for _, b in store._layout(100)[1]}
    gone = [f for f in files() if f"bucket={where['f0']}/" in f and ("batch=0/" in f or "batch=1/" in f or "batch=2/" in f)]
    assert gone == []
