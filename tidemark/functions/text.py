"""Text, names and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types of each kind.
PHOTO_TYPES = [".jpg", ".jpeg", ".png", ".heic", ".webp"]
VIDEO_TYPES = [".mp4", ".mov"]
AUDIO_TYPES = [".mp3", ".m4a", ".aac", ".ogg", ".oga", ".opus", ".wav", ".flac"]

# Tag titles and labels.
TAG_TITLES = {
    "birthday": "Birthday celebration",
    "wedding": "Wedding",
    "temple": "Temple visit",
    "school": "School day",
    "travel": "Trip",
    "beach": "Beach day",
}
TAG_LABELS = {
    "birthday": "Birthday",
    "wedding": "Wedding",
    "temple": "Temple",
    "school": "School",
    "travel": "Travel",
    "beach": "Beach",
}

# Display names and range notes of the festival keys.
FESTIVAL_NAMES = {
    "sankranti": "Sankranti",
    "ugadi": "Ugadi",
    "holi": "Holi",
    "raksha_bandhan": "Raksha Bandhan",
    "ganesh_chaturthi": "Ganesh Chaturthi",
    "dussehra": "Dussehra",
    "diwali": "Deepavali",
}
FESTIVAL_NOTES = {
    "sankranti": "Bhogi, Sankranti & Kanuma",
    "holi": "Holika Dahan & Holi",
    "diwali": "Naraka Chaturdashi & Deepavali",
}


def lookup(code: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Label of a code; ``default`` (or null) for unknown codes."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.try_element_at(pairs, code)
    return found if default is None else F.coalesce(found, default)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for none, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def media_kind(path: Column) -> Column:
    return F.when(extension(path).isin(PHOTO_TYPES), "photo").when(extension(path).isin(VIDEO_TYPES), "video")


def clean_text(value: Column) -> Column:
    """Strip NULs and blanks at both ends; empty becomes null."""
    bare = F.regexp_replace(value, r"^[\x00 ]+|[\x00 ]+$", "")
    return F.nullif(F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit(""))


def make_and_model(make: Column, model: Column) -> Column:
    """'Make Model', without repeating a make that the model already starts with."""
    maker, name = clean_text(make), clean_text(model)
    return F.when(F.startswith(F.lower(name), F.lower(maker)), name).otherwise(
        F.nullif(F.concat_ws(" ", maker, name), F.lit(""))
    )


def short_id(path: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the lower-case path."""
    return F.substring(F.sha1(F.lower(path)), 1, 16)


def nice_title(name: Column) -> Column:
    spaced = F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" - "))
    return F.regexp_replace(F.trim(spaced), " {2,}", " ")


def ordinal(n: Column) -> Column:
    suffix = (
        F.when((n % 100).between(10, 20), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def occasion_label(kind: Column, name: Column, year: Column, first_year: Column) -> Column:
    """Label of a recurring date in one year; a null or zero first year is never counted."""
    n = year - F.nullif(first_year, F.lit(0))
    nth = ordinal(n)
    birthday = (
        F.when(n == 0, F.concat(name, F.lit(" is born")))
        .when(n > 0, F.concat(name, F.lit("'s "), nth, F.lit(" birthday")))
        .otherwise(F.concat(name, F.lit("'s birthday")))
    )
    anniversary = (
        F.when(n == 0, F.concat(name, F.lit(": wedding day")))
        .when(n > 0, F.concat(name, F.lit(": "), nth, F.lit(" anniversary")))
        .otherwise(F.concat(name, F.lit(": anniversary")))
    )
    return F.when(kind == "birthday", birthday).when(kind == "anniversary", anniversary).otherwise(name)


# ---------- JSON lists of ids ----------

def ids_from_json(text: Column) -> Column:
    return F.array_sort(F.coalesce(F.from_json(text, "array<bigint>"), F.array().cast("array<bigint>")))


def ids_to_json(ids: Column) -> Column:
    return F.to_json(F.array_sort(ids))


def add_id(ids: Column, value: Column) -> Column:
    return F.array_sort(F.array_union(ids, F.array(value.cast("bigint"))))


def drop_id(ids: Column, value: Column) -> Column:
    return F.array_sort(F.array_remove(F.array_distinct(ids), value.cast("bigint")))
