"""The collection end to end: events, people, story, edits."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import edits, entities, rollups
from tidemark.params import Settings
from tidemark.plans import rebuild, views
from tidemark.plans.library import Library
from tidemark.session import cut
from tidemark.sources import tables


def frame(spark, name, rows):
    """Rows given as dicts; columns that are not named are null."""
    names = [c.split()[0] for c in tables.SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], tables.SCHEMAS[name])


def collection(spark, times, first_score=40.0, seed=77):
    """A photo for each instant, the later the better, each unlike the others."""
    rng = np.random.default_rng(seed)
    media, quality, vectors = [], [], []
    for id, when in enumerate(times, 1):
        axis = np.zeros(32)
        axis[id % 32] = 1.0
        media.append(dict(
            id=id, folder_id=9, rel_path=f"in/{id}.png", filename=f"{id}.png", ext=".png", kind="photo", size=id, mtime_ns=id, taken_at=when, date_source="filename",
            date_confidence="medium", width=900, height=600, has_thumb=True, missing=False, pinned_best=False, user_rotation=0, phash=rng.bytes(8).hex(),
        ))
        quality.append(dict(media_id=id, version=1, media_mtime_ns=id, sharpness=0.6, exposure=0.7, resolution=0.5, total=first_score + 2 * id))
        vectors.append(dict(media_id=id, model="axes", vector=axis.tolist()))
    return {"media": frame(spark, "media", media), "quality": frame(spark, "quality", quality), "embeddings": frame(spark, "embeddings", vectors)}


# outings: first instant, photos, minutes between them
OUTINGS = [(datetime(2017, 8, 12, 7), 6, 40), (datetime(2017, 8, 14, 6, 30), 5, 95), (datetime(2017, 9, 2, 13), 7, 10)]
STRAYS = [datetime(2017, 11, 4, 9), datetime(2017, 11, 17, 22), datetime(2017, 11, 29, 5)]
FEAST = datetime(2017, 10, 19, 20)


def outings():
    """The instants in order, and the members of each event by the rule: a gap of six hours ends an outing, few strays share a month."""
    times, groups = [], []
    for start, n, gap in OUTINGS:
        groups.append(list(range(len(times) + 1, len(times) + n + 1)))
        times += [start + timedelta(minutes=gap * i) for i in range(n)]
    groups.append([len(times) + 1])
    times.append(FEAST)
    groups.append(list(range(len(times) + 1, len(times) + len(STRAYS) + 1)))
    return times + STRAYS, groups


@pytest.fixture(scope="module")
def library(spark):
    times, groups = outings()
    feast = dict(id=1, festival="diwali", year=2017, date=FEAST.date(), start=FEAST.date(), end=FEAST.date(), user_edited=False)
    lib = Library(spark, {**collection(spark, times), "festivals": frame(spark, "festivals", [feast])})
    built, summary = rebuild.rebuild_events(lib)
    assert summary.first().asDict() == {"events": len(groups), "created": len(groups), "removed": 0, "kept_edited": 0}
    return built


def members(lib):
    out = {}
    for r in lib["event_media"].collect():
        out.setdefault(r["event_id"], []).append(r["media_id"])
    return {k: sorted(v) for k, v in out.items()}


def named(lib):
    """Ids of the three outings, the feast and the strays."""
    by_first = {m[0]: id for id, m in members(lib).items()}
    return [by_first[g[0]] for g in outings()[1]]


def test_rebuild_and_titles(library):
    rows = views.event_list(library, newest_first=False).collect()
    assert [members(library)[r["id"]] for r in rows] == outings()[1]
    assert [(r["kind"], r["title"]) for r in rows] == [
        ("auto", "12 Aug 2017"), ("auto", "14 Aug 2017"), ("auto", "2 Sep 2017"), ("auto", "Deepavali 2017"), ("moments", "Moments · November 2017"),
    ]
    # the best photo leads, and later ones are better here
    assert [r["hero_media_id"] for r in rows] == [max(members(library)[r["id"]]) for r in rows]


def test_a_rebuild_respects_what_people_did(library):
    """A named outing keeps its id, text and hand-placed items, and takes in what falls between; the others follow their times."""
    spark, (one, two, three, _, strays) = library.spark, named(library)
    texts = spark.createDataFrame([(5, three, "title", "Orchard")], "ts long, id long, field string, value string")
    events, refused = edits.edit_event_texts(library["events"], library["event_media"], texts)
    assert refused.isEmpty()
    by_hand = spark.createDataFrame([(6, 2, three), (7, 21, three)], "ts long, media_id long, event_id long")
    held = edits.move_items(library["event_media"], library["media"], by_hand)
    inside = (OUTINGS[2][0] + timedelta(minutes=33)).isoformat(" ")
    extra = library["media"].where("id = 12").withColumn("id", F.lit(500).cast("long")).withColumn("taken_at", F.lit(inside).cast("timestamp_ntz"))
    again, _ = rebuild.rebuild_events(library.having(events=cut(events), event_media=cut(held), media=cut(library["media"].unionByName(extra))))
    after, before = members(again), members(library)
    assert after[three] == sorted([*before[three], 2, 21, 500])
    assert after[one] == [x for x in before[one] if x != 2] and after[two] == before[two] and after[strays] == [x for x in before[strays] if x != 21]
    assert again["events"].where(F.col("id") == three).first()["title"] == "Orchard"


def test_two_owners_are_never_mixed(library):
    """A locked outing of one owner does not take the other's items of the same hours."""
    spark, (one, *_) = library.spark, named(library)
    texts = spark.createDataFrame([(5, one, "title", "Ours")], "ts long, id long, field string, value string")
    events, _ = edits.edit_event_texts(library["events"], library["event_media"], texts)
    media = library["media"].withColumn("owner", F.lit("first"))
    start = OUTINGS[0][0]
    more = media.where("id <= 3").withColumn("id", F.col("id") + 600).withColumn("taken_at", F.lit((start + timedelta(minutes=50)).isoformat(" ")).cast("timestamp_ntz"))
    others = more.withColumn("id", F.col("id") + 100).withColumn("owner", F.lit("second"))
    lib = library.having(events=cut(events), media=cut(media.unionByName(more).unionByName(others)))
    _, absorbed, placed = rebuild.place_items(lib, by=["owner"])
    assert {(r["id"], r["event_id"]) for r in absorbed.collect()} == {(601 + i, one) for i in range(3)}
    assert {701, 702, 703} <= {r["id"] for r in placed.collect()}


def test_event_edits(library):
    spark, (one, two, three, feast, strays) = library.spark, named(library)
    before = members(library)
    pair = spark.createDataFrame([(3, two), (3, three)], "batch long, event_id long")
    events, held = map(cut, edits.merge_events(library["events"], library["event_media"], pair))
    lib = library.having(events=events, event_media=held)
    whole = next(id for id, m in members(lib).items() if set(before[two]) < set(m))
    assert members(lib)[whole] == before[two] + before[three] and events.where(F.col("id") == whole).first()["locked"]
    # cut where the third outing began; an event cannot be cut before its first item
    cuts = spark.createDataFrame([(whole, before[three][0]), (feast, before[feast][0])], "event_id long, media_id long")
    events, held, refused = edits.split_events(events, held, library["media"], cuts)
    assert [r["event_id"] for r in refused.collect()] == [feast]
    lib = library.having(events=cut(events), event_media=cut(held))
    assert sorted(members(lib).values()) == sorted(before.values())
    # all strays leave for events of their own: two by hand, one by its date
    moves = spark.createDataFrame([(1, 1, "Harbour", before[strays][0]), (2, 1, "Harbour", before[strays][2])], "ts long, request long, title string, media_id long")
    events, held = edits.move_to_new_events(lib["events"], lib["event_media"], lib["media"], moves)
    wish = spark.createDataFrame([(1, "Mid November", None, date(2017, 11, 10), date(2017, 11, 20))], "request long, title string, description string, start date, end date")
    events, held = edits.create_events(cut(events), cut(held), lib["media"], wish)
    done = rebuild.refresh_events(lib.having(events=cut(events), event_media=cut(held)))
    titles = {r["title"]: members(done)[r["id"]] for r in done["events"].where("title is not null").collect()}
    assert titles["Harbour"] == [before[strays][0], before[strays][2]] and titles["Mid November"] == [before[strays][1]]
    assert done["events"].where("kind = 'moments'").isEmpty()


def test_story_views(spark):
    """A life of one owner and a child over scattered years; counts, ages and covers follow from the plan."""
    plan = {2006: [(5, 20, 2)], 2013: [(5, 22, 1), (9, 1, 2)], 2020: [(1, 3, 4)]}
    times = [datetime(y, m, d, 8) + timedelta(minutes=20 * i) for y, days in plan.items() for m, d, n in days for i in range(n)]
    birth, child = date(1977, 2, 11), date(2009, 12, 24)
    persons = [dict(id=1, name="Ines", birth_date=birth, hidden=False), dict(id=2, name="Tomo", birth_date=child, hidden=False)]
    lib = Library(spark, {**collection(spark, times, 20.0), "persons": frame(spark, "persons", persons)}, Settings(story_person_id=1))
    lib, _ = rebuild.rebuild_events(lib)
    years = views.story(lib)["years"].collect()
    assert [r["year"] for r in years] == sorted([birth.year, child.year, *plan])
    counted = {y: sum(n for *_, n in days) for y, days in plan.items()}
    for r in years:
        assert r["photo_count"] == counted.get(r["year"], 0)
    last = {y: sum(counted[x] for x in plan if x <= y) for y in plan}
    assert {r["year"]: r["cover_media_id"] for r in years if r["year"] in plan} == last
    assert next(r for r in years if r["year"] == 2020)["age"] == f"Ines turns {2020 - birth.year}"
    from tidemark.operators.occasions import suggest_stages

    nothing = spark.createDataFrame([], "person_id long, kind string")
    stages = suggest_stages(lib["persons"].where("id = 1"), lib["persons"], lib["occasions"], nothing, F.lit("2030-01-01").cast("date")).orderBy("position").collect()
    assert stages[0]["kind"] == "childhood" and stages[-1]["kind"] == "kids" and stages[-1]["start"] == child
    assert all(a["start"] <= b["start"] for a, b in zip(stages, stages[1:], strict=False))
    told = views.story(lib.having(stages=frame(spark, "stages", [dict(id=i, name=r["name"], start=r["start"], kind=r["kind"], suggested=True) for i, r in enumerate(stages)])))
    late = told["years"].collect()[-1]
    assert late["chapter_name"] == stages[-1]["name"] and late["chapter_age"] == f"From age {child.year - birth.year}"
    best = rollups.best_years(lib["media"], lib["quality"], lib.hidden()).collect()
    assert sorted((r["year"], r["photo_count"]) for r in best) == sorted(counted.items())
    shown, picks = views.on_this_day(lib, date(2031, 5, 22))
    assert [(r["year"], r["label"], r["span"], r["total"]) for r in shown.collect()] == [(2013, "18 years ago", "day", 1)] and picks.count() == 1
    shown, _ = views.on_this_day(lib, date(2031, 5, 21))
    assert [(r["year"], r["span"]) for r in shown.collect()] == [(2013, "week"), (2006, "week")]


# members of each person, by the axis that the person's faces lie along; 90 and 91 are like no one
CROWD = {0: range(1, 8), 1: range(8, 13), 2: range(13, 16)}


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(15)
    faces = []

    def add(id, axis, tilt):
        v = [0.0] * 24
        v[axis] = 1.0
        v[10 + rng.randrange(6)] = tilt
        faces.append(dict(id=id, media_id=id, quality=0.5 + id / 1000, size_px=80, embedding=[x / math.hypot(*v) for x in v], assigned_by="auto", not_person_ids=[]))

    for axis, ids in CROWD.items():
        for id in ids:
            add(id, axis, 0.3)
    add(90, 20, 0.0)
    add(91, 22, 0.0)
    done, persons, summary = entities.assign_entities(frame(spark, "faces", faces), frame(spark, "persons", []), frame(spark, "dup_members", []))
    assert summary.first().asDict() == {"assigned": 15, "unassigned": 2, "new_people": 3}
    return cut(done), cut(persons)


def by_person(faces):
    out = {}
    for r in faces.where("person_id is not null").collect():
        out.setdefault(r["person_id"], set()).add(r["id"])
    return out


def who_is(faces):
    """The person of each axis."""
    found = by_person(faces)
    return {axis: next(p for p, m in found.items() if ids[0] in m) for axis, ids in CROWD.items()}


def test_people_match_identities(people):
    found = by_person(people[0])
    assert sorted(map(sorted, found.values())) == sorted(map(list, CROWD.values()))
    assert {r["id"]: r["cover_face_id"] for r in people[1].collect()} == {p: max(m) for p, m in found.items()}


def test_people_do_not_depend_on_blocks(people, monkeypatch):
    """The same clusters when a round settles a few faces only."""
    from tidemark.operators import leaders

    faces, persons = people
    free = faces.withColumn("person_id", F.lit(None).cast("long"))
    whole = leaders.leader_clusters(free, 0.4).collect()
    assert sorted(whole) == sorted(leaders.leader_clusters(free.repartition(7), 0.4, block_bytes=8 * 24 * 4).collect())


def test_corrections_survive(spark, people):
    """A refused face stays out, a given one stays in, a named person keeps the id, a dissolved one gets a new one."""
    faces, persons = people
    who = who_is(faces)
    log = spark.createDataFrame([(1, 3, None), (2, 90, who[1])], "ts long, id long, person_id long")
    fixed = cut(edits.reassign_members(faces, log))
    known = cut(persons.withColumn("name", F.when(F.col("id") == who[1], "Tomo").otherwise(F.col("name"))))
    again, _, _ = entities.recluster_unnamed(fixed, known, frame(spark, "dup_members", []))
    after = by_person(again)
    assert after[who[1]] == {*CROWD[1], 90} and all(3 not in m for m in after.values())
    others = {frozenset(m): p for p, m in after.items() if p != who[1]}
    assert set(others) == {frozenset(CROWD[0]) - {3}, frozenset(CROWD[2])} and min(others.values()) > max(who.values())


def test_merge(spark, people):
    faces, persons = people
    who = who_is(faces)
    known = persons.withColumn("name", F.when(F.col("id") == who[0], "Ines").otherwise(F.col("name")))
    moved, left = edits.merge_entities(faces, known, spark.createDataFrame([(1, who[0], who[2])], "ts long, source long, target long"))
    assert by_person(moved) == {who[2]: {*CROWD[0], *CROWD[2]}, who[1]: set(CROWD[1])}
    assert {r["id"]: r["name"] for r in left.collect()} == {who[2]: "Ines", who[1]: None}


def test_storage_and_settings(spark, tmp_path):
    lib = Library(spark, collection(spark, [datetime(2019, 4, 9)]))
    lib.store(str(tmp_path), "media")
    assert Library.load(spark, str(tmp_path))["media"].count() == 1
    grown = tables.add_columns(lib["media"].drop("pinned_best"), {"pinned_best": ("boolean", False)})
    assert grown.first()["pinned_best"] is False
    with pytest.raises(ValueError):
        Settings().changed(near_dup_threshold=33)
    stored = spark.createDataFrame([("tag_threshold", "0.5"), ("other", "1")], "key string, value string")
    defaults = spark.createDataFrame([("tag_threshold", "0.35"), ("burst_enabled", "true")], "key string, value string")
    got = edits.overlay_settings(defaults, stored)
    assert {r["key"]: r["value"] for r in got.collect()} == {"tag_threshold": "0.5", "burst_enabled": "true"}
