"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, slot long, _id long, _text string"
SYLLABLES = ["ka", "lo", "mi", "ru", "sen", "tar", "vo", "xi", "zum", "pel", "dra", "fo"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def row(doc_id, text, source="a"):
    """A document with extra columns whose names the operators use themselves."""
    return (doc_id, text, "en", source, None if text is None else len(text), 0.5, "x", 1, 7, "y")


def messy(spark, seed=1):
    """Nulls, empty, blank, one-word, unspaced and very long texts, ties, repeated rows and shared ids."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows = [
        row(1, base), row(2, base), row(3, base + " " + word(rng)), row(3, base + " " + word(rng)), row(4, None), row(5, ""), row(6, " \n\t "),
        row(7, "solo"), row(8, "x" * 5000), row(9, prose(rng, 30_000), "b"), row(None, "text without an id " + prose(rng, 40)),
        row(None, None), row(None, "text without an id twice " * 9), row(None, "text without an id twice " * 9), row(10, prose(rng, 60), None),
        row(11, "Ünïcode tèxt ñ 漢字 " * 12, "ü"), row(12, prose(rng, 50) + "\n\n" + prose(rng, 50)), row(12, prose(rng, 50)), row(13, "a\rb\u0000c"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
