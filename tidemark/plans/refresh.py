"""Derived tables kept up to date: a derivation runs when something that it reads has changed, and only then.

Each step names the tables and settings that it reads. Their fingerprints (one aggregate over a table, see ``changes.fingerprint``)
are kept in the table ``derivations``; a step whose fingerprint is the stored one is skipped. Steps run in order, so what one writes
counts as changed for the next. A step that rewrites what it reads (events keep their ids, people their members) is recorded after it
ran, which is right because each of them leaves its own result as it is when run again.

Only one short text per table comes to the driver. A table's rows are read once for all steps unless a step replaces the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changes, entities
from tidemark.plans.library import Library
from tidemark.plans.rebuild import rebuild_events, refresh_heroes, regroup, retag
from tidemark.session import cut
from tidemark.sources import tables


@dataclass(frozen=True)
class Step:
    """``covers`` names later steps whose work this one does as well."""

    name: str
    reads: tuple[str, ...]
    settings: tuple[str, ...]
    run: Callable[[Library, DataFrame | None], Library]
    covers: tuple[str, ...] = ()


def _people(lib: Library, classes: DataFrame | None) -> Library:
    faces, persons, _ = entities.assign_entities(lib["faces"], lib["persons"], lib["dup_members"], last_id=lib.top_id("persons"))
    lib = lib.having(faces=cut(faces), persons=cut(persons))
    return lib.marked("persons", lib.top_id("persons"))


def _tags(lib: Library, classes: DataFrame) -> Library:
    lib = retag(lib, classes)
    return lib.having(media_tags=cut(lib["media_tags"]))


STEPS = (
    Step("duplicates", ("media", "quality"), ("near_dup_threshold", "burst_threshold", "burst_enabled"), lambda lib, _: regroup(lib)),
    Step("people", ("faces", "persons", "dup_members"), (), _people),
    Step("tags", ("embeddings", "classes"), ("tag_threshold",), _tags),
    Step(
        "events", ("media", "events", "event_media", "occasions", "festivals", "persons"), ("event_gap_hours", "event_gps_km", "event_min_photos"),
        lambda lib, _: rebuild_events(lib)[0], covers=("heroes",),
    ),
    Step(
        "heroes", ("events", "event_media", "media", "quality", "embeddings", "faces", "persons", "dup_groups", "dup_members"), (),
        lambda lib, _: (done := refresh_heroes(lib)).having(events=cut(done["events"])),
    ),
)


class _Fingerprints:
    """Digests of tables as they are now; a table is read again only after it was replaced."""

    def __init__(self, classes: DataFrame | None):
        self.classes, self.known = classes, {}

    def of(self, lib: Library, step: Step) -> str:
        parts = [f"{name}={getattr(lib.settings, name)!r}" for name in step.settings]
        for name in step.reads:
            rows = self.classes if name == "classes" else lib[name]
            if name not in self.known or self.known[name][0] is not rows:
                self.known[name] = (rows, changes.fingerprint(rows).first()["fingerprint"])
            parts.append(f"{name}:{self.known[name][1]}")
        return hashlib.sha256("\n".join([step.name, *parts]).encode()).hexdigest()


def refresh(lib: Library, classes: DataFrame | None = None, steps: tuple[Step, ...] = STEPS) -> tuple[Library, list[tuple[str, bool]]]:
    """(library with current derived tables, whether each step ran). Store ``derivations`` along with the tables.

    Without ``classes`` tags stay as they are. A library without a record runs every step.
    """
    before = {r["step"]: r["fingerprint"] for r in lib["derivations"].collect()}
    prints, report, covered = _Fingerprints(classes), [], set()
    after = dict(before)
    for step in steps:
        if "classes" in step.reads and classes is None:
            report.append((step.name, False))
            continue
        wanted = step.name not in covered and prints.of(lib, step) != before.get(step.name)
        if wanted:
            lib = step.run(lib, classes)
            covered |= set(step.covers)
        if wanted or step.name in covered:
            after[step.name] = prints.of(lib, step)
        report.append((step.name, wanted))
    record = lib.spark.createDataFrame(sorted(after.items()), tables.SCHEMAS["derivations"])
    return lib.having(derivations=record), report
