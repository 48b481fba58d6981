"""Tunable settings and fixed constants."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Fixed values that must equal the published behaviour.
MIN_YEAR = 1980
CONTAINER_EPOCH_OFFSET = 2_082_844_800
EARTH_RADIUS_KM = 6371.0
MATCH_THRESHOLD = 0.42
LINK_THRESHOLD = 0.50
SEED_QUALITY = 0.30
MIN_MOMENTS = 2
CURATED_MAX = 12
SAME_SCENE_COS = 0.93
BURST_COS = 0.88
BURST_SECONDS = 90
SAME_SIGNATURE = 10
CARRY_OVER_IOU = 0.5
JUDGE_PIXELS = 80
RESULT_VERSION = 2
LOGIT_SCALE = 100.0

# Allowed range of each numeric setting.
RANGES = {
    "near_dup_threshold": (0, 32),
    "burst_threshold": (0, 40),
    "event_gap_hours": (0.5, 72),
    "event_gps_km": (1, 1000),
    "event_min_photos": (1, 20),
    "tag_threshold": (0.1, 0.9),
}


@dataclass(frozen=True)
class Settings:
    near_dup_threshold: int = 8
    burst_threshold: int = 20
    burst_enabled: bool = True
    event_gap_hours: float = 6
    event_gps_km: float = 30
    event_min_photos: int = 3
    tag_threshold: float = 0.35
    story_person_id: int | None = None
    music_folder: str | None = None

    def changed(self, **changes) -> "Settings":
        known = {f.name for f in fields(self)}
        for key, value in changes.items():
            if key not in known:
                raise KeyError(key)
            if key in RANGES and not RANGES[key][0] <= value <= RANGES[key][1]:
                raise ValueError(f"{key}={value} is outside {RANGES[key]}")
        return replace(self, **changes)
