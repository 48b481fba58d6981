"""Spelling variants: words one edit apart, joined by asymmetric q-chunks, each pointing to its commoner form.

Words are maximal runs of letters (A-Z, a-z, U+00C0-U+00FF), A-Z lower-cased; a run is misread on purpose where ``slips`` divides the
CRC-32 of ``<doc_id>:<run>`` (one code point is left out), which gives a corpus variants that are known. Runs are counted in whole
texts, slice by slice, and summed per task before they are shuffled.

Join. Of two words one edit apart the shorter (or either, at equal lengths) contributes two disjoint chunks, its halves; the other
contributes its positional grams. An edit spoils one chunk at most, so the other one is found as a gram: the first half at its own
place, the second shifted by the difference of the lengths, 0 or 1. Only the grams that lie so are written, as no others can meet.

Crowded chunks. Halves of short words are shared by very many words. Where a chunk would join over ``PAIRS`` pairs, its entries are
refined instead: what is left of the words beside the chunk is again one edit apart, so its halves are chunks in turn. This goes on
until a chunk is rare or a single letter is left open, which only an alphabet's worth of words can share. No key joins more than
that, nothing is capped and no pair is lost. Pairs that met are verified by their edit distance.

Forms. A word's form is its commonest near word (the smallest in code-point order among equals) if that is ``ratio`` times as common.
Counts grow along the way, so forms lead to a last word without circles; they are followed by pointer doubling, in as many rounds as
the logarithm of the longest way.

Defined cases. Null and empty texts have no runs. A null id is written as nothing before the colon. Repeated rows count again. Very
long runs are words like others. An empty table gives no row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SLIPS = 97
SHORTEST = 5
RAREST = 3
RATIO = 2
# entries that a worker sums up before it passes them on
HELD = 1 << 17
SLICE = 1 << 20
# most pairs that one chunk may join
PAIRS = 1 << 14

# Latin-1: A-Z in lower case, letters as they are, all else a blank
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256)
)


def runs(text: str):
    """Lists of a text's runs as Latin-1 bytes, a slice of the text at a time."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(letters):
        end = letters.find(b" ", at + SLICE)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def slipped(run: bytes, start: int, slips: int = SLIPS) -> bytes:
    """The run, without one of its code points where ``slips`` divides the checksum that ``start`` begins."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, slips: int = SLIPS, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): words of ``shortest`` code points or more that occur ``rarest`` times or more."""

    def run(batches):
        found: Counter = Counter()

        def out():
            names = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for some in runs(text.as_py() or ""):
                    for word, n in Counter(w for w in some if len(w) >= shortest).items():
                        word = slipped(word, start, slips)
                        if len(word) >= shortest:
                            found[word] += n
                    if len(found) > HELD:
                        yield out()
                        found.clear()
        if found:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _halves(entries: DataFrame) -> DataFrame:
    """Entries refined by one level: each keeps one half of what was open, and leaves the other open.

    An entry's open part has ``size`` code points on the side of the chunks, and ``more`` (0 or 1) further ones on that of the grams.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    longer = F.when(F.col("side") == 1, F.col("more")).otherwise(0)
    cut = half + longer

    def part(option: int, kept: Column, open_: Column, size: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(option), kept).alias("key"), open_.alias("open"), size.alias("size"))

    far = F.length("open") + 1  # beyond the end
    first = part(1, F.substring(F.col("open"), F.lit(1), half), F.substring(F.col("open"), half + 1, far), F.col("size") - half)
    second = part(2, F.substring(F.col("open"), cut + 1, far), F.substring(F.col("open"), F.lit(1), cut), half)
    # an empty part cannot hold an edit, unless a letter was put in there
    options = F.filter(F.array(first, second), lambda x: (x["size"] > 0) | (F.col("more") > 0))
    return entries.select("word", "n", "side", "more", F.explode(options).alias("_x")).select("word", "n", "side", "more", "_x.*")


def _entries(vocabulary: DataFrame) -> DataFrame:
    """Every word once as chunks, for a partner of its own length and for one that is longer, and twice as grams."""
    size = F.length("word")
    kinds = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.lit(more).alias("more"), (size - more if side else size).cast("int").alias("size"))
            for side in (0, 1) for more in (0, 1)
        ]
    )
    rows = vocabulary.select("word", "n", F.explode(kinds).alias("_k")).select("word", "n", "_k.*")
    return rows.select("word", "n", "side", "more", F.xxhash64("size", "more").alias("key"), F.col("word").alias("open"), "size")


def near(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n) of all words of ``vocabulary`` (word, n) that are exactly one edit apart; each pair once."""
    found = []
    entries = _entries(vocabulary)
    while True:
        entries = stored(_halves(entries), "chunks")
        counts = entries.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("chunks"), F.count_if(F.col("side") == 1).alias("grams"), F.max("size").alias("widest"))
        use = counts.where((F.col("chunks") > 0) & (F.col("grams") > 0)).select(
            "key", ((F.col("chunks") * F.col("grams") > pairs) & (F.col("widest") > 1)).alias("crowded")
        )
        rows = stored(entries.join(use, "key"), "chunk-rows")
        rare = rows.where("not crowded")
        a = rare.where("side = 0").select("key", "more", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = rare.where("side = 1").select("key", "more", F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = a.join(b, ["key", "more"]).where((F.col("more") == 1) | (F.col("a") < F.col("b")))
        found.append(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"))
        entries = rows.where("crowded").drop("crowded")
        if entries.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way of every word with a form."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(at.join(ahead, "root", "left"), "roots")
        at = step.select("word", F.coalesce("_next", "root").alias("root"))
        if step.where("_next is not null").isEmpty():
            return at


def variants(docs: DataFrame, slips: int = SLIPS, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    vocabulary = stored(words(docs, slips, shortest, rarest), "words")
    links = stored(near(vocabulary, pairs), "near")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    # the smallest of (-n, word) is the commonest, then the first in code-point order
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    ends = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = stored(vocabulary.join(ends, "word", "left"), "forms")
    common = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
