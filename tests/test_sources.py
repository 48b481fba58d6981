import json
from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.plans import rebuild
from tidemark.plans.library import Library
from tidemark.sources import manifest, reference, tables


def test_manifest_of_real_files(spark, tmp_path):
    for name in ["a/IMG_1.JPG", "a/b/clip.mp4", "a/note.txt", "node_modules/x.jpg", "songs/my_song.mp3", "s p/é.png"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    files = manifest.list_files(spark, str(tmp_path), with_content=True)
    rows = manifest.with_sha256(manifest.media_files(files)).collect()
    assert {(r["rel_path"], r["ext"], r["kind"]) for r in rows} == {
        ("a/IMG_1.JPG", ".jpg", "photo"), ("a/b/clip.mp4", ".mp4", "video"), ("s p/é.png", ".png", "photo"),
    }
    assert {r["sha256"] for r in rows} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"} and rows[0]["size"] == 3
    assert [(r["title"], len(r["id"])) for r in manifest.audio_files(files).collect()] == [("my song", 16)]


def test_hidden_files_are_listed(spark, tmp_path):
    """Names that start with '_' or '.' are files like others; only resource forks and hidden folders are left out later."""
    names = ["_a.jpg", ".b.jpg", "._c.jpg", "d/_e/f.png", "d/.g/h.png", "_SUCCESS", "d/plain.mp4", "#odd?name%20.jpg"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * i)
    (tmp_path / "nothing").mkdir()
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        files = manifest.list_files(spark, root)
        found = {r["rel_path"]: (r["size"], r["mtime_ns"]) for r in files.collect()}
        assert found == {n: (i, (tmp_path / n).stat().st_mtime_ns) for i, n in enumerate(names)}
        kept = {r["rel_path"] for r in manifest.media_files(files).collect()}
        assert kept == {"_a.jpg", ".b.jpg", "d/_e/f.png", "d/plain.mp4", "#odd?name%20.jpg"}


def test_festival_table(spark, tmp_path):
    data = {"festivals": {"ugadi": {"2024": {"date": "2024-04-09"}}, "sankranti": {"2025": {"date": "2025-01-14", "start": "2025-01-13", "end": "2025-01-15"}}}}
    (tmp_path / "f.json").write_text(json.dumps(data))
    table = reference.festival_table(spark, str(tmp_path / "f.json"))
    have = spark.createDataFrame(
        [(5, "ugadi", 2024, date(2024, 4, 8), date(2024, 4, 8), date(2024, 4, 8), True)], tables.SCHEMAS["festivals"]
    )
    out, added = reference.seed_missing(have, table)
    assert [tuple(r) for r in added.collect()] == [(6, "sankranti", 2025, date(2025, 1, 14), date(2025, 1, 13), date(2025, 1, 15), False)]
    assert out.where("festival = 'ugadi'").first()["date"] == date(2024, 4, 8)


def test_scan_cycle(spark):
    """Added, updated, vanished and returned files; rows are flagged, never deleted."""
    schema = "folder_id long, rel_path string, size long, mtime_ns long"
    roots = spark.createDataFrame([(1, "/a", True, True), (2, "/b", True, False)], "id long, path string, enabled boolean, available boolean")
    media = spark.createDataFrame(
        [(1, 1, "x", 1, 1, False), (2, 1, "y", 1, 1, False), (3, 1, "z", 1, 1, True), (4, 2, "w", 1, 1, False), (5, 1, "q", 1, 1, False)],
        "id long, folder_id long, rel_path string, size long, mtime_ns long, missing boolean",
    )
    found = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 2, 1), (1, "z", 1, 1), (1, "new", 1, 1)], schema)
    status = changes.scan_changes(found, media, roots)
    assert {r["rel_path"]: r["status"] for r in status.collect()} == {"x": "unchanged", "y": "updated", "z": "revived", "new": "added", "q": "missing"}
    assert changes.change_counters(status).first().asDict() == {"total": 4, "added": 1, "updated": 1, "unchanged": 2, "missing": 1, "errors": 0}
    after = changes.apply_scan(media, found.withColumn("missing", F.lit(False)), status)
    assert {(r["id"], r["rel_path"], r["size"], r["missing"]) for r in after.collect()} == {
        (1, "x", 1, False), (2, "y", 2, False), (3, "z", 1, False), (4, "w", 1, False), (5, "q", 1, True), (6, "new", 1, False),
    }
    watched, seen = changes.observed(status)
    watched.count()
    assert seen.get["added"] == 1 and seen.get["revived"] == 1
    assert [r["note"] for r in changes.unreachable_notes(roots).collect()] == ["Folder not found, skipped: /b"]


def test_recompute_map():
    assert rebuild.DEPENDENTS["tag_threshold"] == ("duplicates", "tags", "events")
    assert rebuild.DEPENDENTS["pins"] == ("heroes",)
