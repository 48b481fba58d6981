"""Derived tables are rebuilt when, and only when, something they read has changed."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_library import FEAST, collection, frame, members, outings

from tidemark.operators import changes
from tidemark.params import Settings
from tidemark.plans import analysis, rebuild, refresh, views
from tidemark.plans.library import Library
from tidemark.session import cut
from tidemark.sources import tables


def ran(report):
    return [name for name, did in report if did]


def rows(df):
    return sorted(map(repr, df.collect()))


def boxes(spark, n, person=None):
    """Faces on the first items, of two people who look unlike each other."""
    out = []
    for i in range(1, n + 1):
        vector = [1.0, 0.02 * i, 0.0] if i % 2 else [0.0, 0.02 * i, 1.0]
        length = sum(x * x for x in vector) ** 0.5
        out.append(dict(id=i, media_id=i, x=0.1, y=0.1, w=0.2, h=0.2, size_px=100, quality=0.9 - i / 100, embedding=[x / length for x in vector], person_id=person, assigned_by="auto", not_person_ids=[]))
    return frame(spark, "faces", out)


@pytest.fixture(scope="module")
def fresh(spark):
    feast = dict(id=1, festival="diwali", year=2017, date=FEAST.date(), start=FEAST.date(), end=FEAST.date(), user_edited=False)
    given = {**collection(spark, outings()[0]), "festivals": frame(spark, "festivals", [feast]), "faces": boxes(spark, 8)}
    return refresh.refresh(Library(spark, given))


def test_the_first_run_derives_everything(fresh):
    lib, report = fresh
    assert ran(report) == ["duplicates", "people", "events"]
    assert sorted(members(lib).values()) == sorted(outings()[1])
    assert lib["persons"].count() == 2 and lib["faces"].where("person_id is null").isEmpty()


def test_nothing_runs_when_nothing_changed(fresh):
    lib, _ = fresh
    again, report = refresh.refresh(lib)
    assert ran(report) == [] and rows(again["derivations"]) == rows(lib["derivations"])
    # neither the order of rows, nor the moment of the last scan, is a change
    shuffled = lib["media"].orderBy(F.rand(3)).repartition(5).withColumn("scanned_at", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    assert ran(refresh.refresh(lib.having(media=cut(shuffled)))[1]) == []


def test_a_change_reaches_what_depends_on_it(fresh):
    lib, _ = fresh
    spark = lib.spark
    birthday = frame(spark, "occasions", [dict(id=1, kind="other", name="Fair", month=11, day=17)])
    after, report = refresh.refresh(lib.having(occasions=birthday))
    assert ran(report) == ["events"]
    assert [21] in members(after).values() and [20, 22] in members(after).values()
    better = lib["quality"].withColumn("total", F.when(F.col("media_id") == 2, 99.0).otherwise(F.col("total")))
    after, report = refresh.refresh(lib.having(quality=cut(better)))
    assert ran(report) == ["duplicates", "heroes"]
    assert after["events"].where("hero_media_id = 2").count() == 1
    later = Library(spark, lib.tables, Settings(event_gap_hours=1))
    after, report = refresh.refresh(later)
    # five photos 95 minutes apart are five short outings now, which share their month
    assert ran(report) == ["events"] and after["events"].where("kind = 'moments'").count() == 2
    full, _ = rebuild.rebuild_events(later)
    assert members(full) == members(after) and rows(full["events"].drop("created_at")) == rows(after["events"].drop("created_at"))


def test_new_items_equal_a_rebuild_from_scratch(fresh):
    lib, _ = fresh
    spark, (times, groups) = lib.spark, outings()
    more = collection(spark, [*times, *[times[0] + timedelta(days=40, minutes=5 * i) for i in range(4)]])
    grown = lib.having(**{name: more[name] for name in ("media", "quality", "embeddings")})
    after, report = refresh.refresh(grown)
    assert ran(report) == ["duplicates", "events"]
    assert sorted(members(after).values()) == sorted([*groups, list(range(len(times) + 1, len(times) + 5))])
    assert ran(refresh.refresh(after)[1]) == []


def test_tags_follow_classes_and_threshold(fresh):
    lib, _ = fresh
    axis = [1.0 if i == 1 else 0.0 for i in range(32)]
    other = [1.0 if i == 2 else 0.0 for i in range(32)]
    classes = lib.spark.createDataFrame([(1, axis, "one", False), (2, other, "two", False)], "class_id long, class_vector array<double>, tag string, background boolean")
    tagged, report = refresh.refresh(lib, classes)
    assert ran(report) == ["tags"] and {r["tag"] for r in tagged["media_tags"].where("media_id in (1, 2)").collect()} == {"one", "two"}
    assert ran(refresh.refresh(tagged, classes)[1]) == []
    assert ran(refresh.refresh(Library(lib.spark, tagged.tables, Settings(tag_threshold=0.6)), classes)[1]) == ["tags"]


def test_fingerprints(spark):
    def of(data, schema="a long, b string, c array<float>"):
        return changes.fingerprint(spark.createDataFrame(data, schema)).first()["fingerprint"]

    base = [(1, "x", [1.0]), (None, "y", None), (1, "x", [1.0])]
    assert of(base) == of(base[::-1]) and of(base) != of(base[:2])
    assert of([(None, "1", None)]) != of([(1, None, None)]) and of([(1, None, [])]) != of([(1, None, None)])
    assert of([]) == of([]) and of([]) != of([(None, None, None)]) and of([], "a long") != of([], "b long")
    assert changes.fingerprint(spark.range(1 << 16)).count() == 1
    assert set(tables.SCHEMAS["derivations"].split(", ")) == {"step string", "fingerprint string"}


def test_stored_and_loaded_libraries_are_current(fresh, tmp_path):
    lib, _ = fresh
    lib.store(str(tmp_path), *tables.SCHEMAS)
    loaded = Library.load(lib.spark, str(tmp_path))
    assert ran(refresh.refresh(loaded)[1]) == []


def test_recompute_does_what_the_map_says(fresh):
    lib, _ = fresh
    again = rebuild.recompute(Library(lib.spark, lib.tables, Settings(event_min_photos=6)), ["event_min_photos"])
    assert again["dup_groups"].count() == 0 and members(again) != members(lib)
    same = rebuild.recompute(lib, ["pins"])
    assert rows(same["events"]) == rows(lib["events"]) and same["event_media"] is lib["event_media"]


def test_a_batch_from_stale_rows_to_the_summary(spark, fresh):
    """Stale items are found, their results attached with people following the boxes, then all is derived once more."""
    lib, _ = fresh
    stale = analysis.to_analyse(lib.having(quality=cut(lib["quality"].where("media_id <> 3").withColumn("version", F.lit(2)).withColumn("models_used", F.lit("m")))), "m")
    assert [r["id"] for r in stale.collect()] == [3]
    known = lib["faces"].where("media_id = 3").first()
    quality = frame(spark, "quality", [dict(media_id=3, version=2, media_mtime_ns=3, sharpness=0.9, exposure=0.7, resolution=0.5, total=100.0, models_used="m")])
    signatures = spark.createDataFrame([(3, "00ff00ff00ff00ff")], "media_id long, phash string")
    vectors = frame(spark, "embeddings", [dict(media_id=3, model="axes", vector=[0.0] * 31 + [1.0])])
    seen = frame(spark, "faces", [dict(id=900, media_id=3, x=0.11, y=0.1, w=0.2, h=0.2, size_px=100, quality=0.8, embedding=list(known["embedding"]), assigned_by="auto", not_person_ids=[])])
    attached = analysis.attach_results(lib, quality, signatures, vectors, seen)
    assert attached["media"].where("id = 3").first()["phash"] == "00ff00ff00ff00ff" and attached["media"].count() == lib["media"].count()
    assert attached["faces"].where("id = 900").first()["person_id"] == known["person_id"] and attached["faces"].where("media_id = 3").count() == 1
    done, summary = analysis.run_analysis(attached)
    got = summary.first().asDict()
    assert got == {"events": 5, "created": 0, "removed": 0, "kept_edited": 0, "groups": 0, "hidden": 0, "assigned": 0, "new_people": 0, "unassigned": 0, "tagged": 0} | {"events": got["events"]}
    assert members(done) == members(lib) and done["events"].where("hero_media_id = 3").count() == 1


def test_details_and_span(fresh):
    lib, _ = fresh
    everything = views.item_detail(lib)
    assert everything.count() == lib["media"].count() == everything.select("media_id").distinct().count()
    one = views.item_detail(lib, [2]).first()
    assert one["media_id"] == 2 and [f["id"] for f in one["faces"]] == [2] and one["group_size"] == 1 and one["title"] == "12 Aug 2017"
    span = views.story(lib)["span"].first()
    assert span["event_count"] == 5 and span["photo_count"] == lib["media"].count() and span["owner_name"] is None
