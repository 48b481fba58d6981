"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where over half of the XXH64 values (seed 42) of its word shingles have it, repeats included.
Two fingerprints are linked at ``distance`` (4) or fewer differing bits. Those bits lie in at most 4 of the 8 bytes, so linked
fingerprints share at least ``MATCHES`` = 4 positional bytes.

Index. A posting list for each single (position, byte) would hold a 256th of the corpus. The lists are therefore kept for sets of
three positions, chosen so that any four positions contain one of them (20 of the 56 sets): whatever four bytes a linked pair
shares, the pair meets in a list. Pairs that meet are tallied on all eight positional bytes, those below the guaranteed 4 matches
are dropped, and the rest are verified by their bits. A pair that meets in several lists is reported by each and counted once.

Scale. Only distinct fingerprints are indexed, so copies cost nothing. A list is a stream of sorted rows in a task; one with more
than ``block`` fingerprints is cut into blocks by hash, and each pair of blocks is a group of its own. Within a list, only links
that join different parts of it are passed on (at most one per fingerprint and block pair), because groups need no more; their
connected components are those of all links. Nothing but key counts goes through a single group.

Defined cases. Null, empty and blank texts have fingerprint 0, and are linked like any other. Fewer words than a shingle make one
shingle of all. Rows are fingerprinted one by one; repeated rows are copies of each other. A row without an id belongs to its
group and has the group's smallest id, or null where no member has one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, raw_texts, stored
from tidemark.operators.components import connected_components

SHINGLE = 4
DISTANCE = 4
MATCHES = 8 - DISTANCE
BLOCK = 4096
SEED = 42


def position_sets() -> list[tuple[int, int, int]]:
    """Sets of three positions such that any four of the eight contain one.

    The positions stand on three circles-in-a-row groups; a set lies within a group, or has two of a group and one of the next.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = [c for g in groups for c in combinations(g, 3)]
    for k, g in enumerate(groups):
        sets += [(*pair, one) for pair in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return [tuple(sorted(s)) for s in sets]


SETS = position_sets()


def _bits(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority of each bit over the segments of ``values``."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE, block: int = 200_000) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    digest, found = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    rows, starts = [], []

    def flush():
        if rows:
            values, at = np.array(hashes, np.uint64), np.array(starts)
            found[rows] = _bits(values, at, np.diff(np.append(at, len(values))))
            hashes.clear(), rows.clear(), starts.clear()

    for i, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII only: A-Z, and the blanks 09-0D and 20
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) < shingle:
            own = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            own = [digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        rows.append(i)
        starts.append(len(hashes))
        hashes.extend(own)
        if len(hashes) > block:
            flush()
    flush()
    return found


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, on request with the text's ``hash``; the 64 bits as a signed number."""
    names = ["doc_id", "fp", *(["hash"] if hashed else [])]

    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in chunks(texts):
                found = fingerprints_of(texts[a:b], shingle).view(np.int64)
                more = [batch.column(2).slice(a, b - a)] if hashed else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), *more], names)

    text = F.col("text").cast("string")
    needed = [F.col("doc_id").cast("bigint"), text, *([F.xxhash64(text)] if hashed else [])]
    return docs.select(*needed).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest member of the part of each of ``n`` nodes, given edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _close(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then the bits: which pairs share enough positional bytes and differ in few bits."""
    differs = left ^ right
    if distance >= 8:
        return np.bitwise_count(differs) <= distance
    shared = (differs.view(np.uint8).reshape(len(differs), 8) == 0).sum(1)
    keep = shared >= 8 - distance
    keep[keep] = np.bitwise_count(differs[keep]) <= distance
    return keep


def _links_within(values: np.ndarray, distance: int, rows: int = 1 << 20):
    """Indices of linked pairs among one list, joined parts only once."""
    n = len(values)
    a_all, b_all = [], []
    step = max(1, rows // n)
    for i in range(0, n - 1, step):
        a = np.arange(i, min(n - 1, i + step))
        x, y = np.meshgrid(a, np.arange(i + 1, n), indexing="ij")
        pick = y > x
        x, y = x[pick], y[pick]
        keep = np.bitwise_count(values[x] ^ values[y]) <= distance
        a_all.append(x[keep])
        b_all.append(y[keep])
    if not a_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _roots(n, np.concatenate(a_all), np.concatenate(b_all))
    # a link from every node to the lowest of its part stands for a path of links within the list
    own = np.flatnonzero(root != np.arange(n))
    return root[own], own


def _list_links(keys: np.ndarray, values: np.ndarray, distance: int, small: int = 64):
    """Links of all lists of a sorted run: short lists pair by pair at once, longer ones one by one."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.append(starts, len(keys)))
    lefts, rights = [], []
    # short lists: each row with the row d places on
    for d in range(1, small):
        head = starts[(sizes > d) & (sizes <= small)]
        if not len(head):
            continue
        width = sizes[(sizes > d) & (sizes <= small)] - d
        at = np.repeat(head - (np.cumsum(width) - width), width) + np.arange(width.sum())
        keep = _close(values[at], values[at + d], distance)
        lefts.append(values[at[keep]])
        rights.append(values[at[keep] + d])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        own = values[s : s + n]
        a, b = _links_within(own, distance)
        lefts.append(own[a])
        rights.append(own[b])
    if not lefts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(lefts), np.concatenate(rights)


def _index_links(entries: DataFrame, distance: int) -> DataFrame:
    """(src, dst) of the lists of (key, fp), which hold at most two blocks each."""

    def run(batches):
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys, values):
            a, b = _list_links(keys, values, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        for batch in batches:
            keys = np.concatenate((held_k, batch.column(0).to_numpy()))
            values = np.concatenate((held_v, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the list at the end may go on in the next batch
            if last:
                yield out(keys[:last], values[:last])
            held_k, held_v = keys[last:], values[last:]
        if len(held_k):
            yield out(held_k, held_v)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "src bigint, dst bigint")


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links between distinct fingerprints ``fp``: enough of them that their components are those of all links."""
    if distance > 4:
        raise ValueError("the index guarantees pairs up to 4 differing bits")
    byte = [F.shiftright("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = [
        (F.lit(n << 24).cast("bigint") + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c])
        for n, (a, b, c) in enumerate(SETS)
    ]
    entries = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    parts = F.ceil(F.col("n") / F.lit(block // 2)).cast("int")
    # an entry of a crowded list goes to every pair of blocks that its own block is in
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    spread = entries.join(crowded.select("key", parts.alias("parts")), "key", "left").select(
        "fp", "key", "parts", own.alias("own")
    )
    group = F.when(F.col("parts").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda other: F.xxhash64("key", F.least("own", other), F.greatest("own", other)),
        )
    )
    return _index_links(spread.select(F.explode(group).alias("key"), "fp"), distance)


def _members(prints: DataFrame, distance: int, block: int) -> DataFrame:
    """(fp, first, component) of every distinct fingerprint: its smallest id, and the smallest fingerprint it is connected with."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = links(distinct.select("fp"), distance, block)
    members = connected_components(stored(found.distinct(), "simhash-links"))
    return distinct.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id that linked fingerprints reach."""
    prints = stored(fingerprints(docs, shingle), "simhash")
    # only fingerprints with a link need their class's smallest id
    linked = _members(prints, distance, block).where("component is not null")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    resolved = linked.join(lowest, "component").select("fp", "component_id")
    return prints.join(resolved, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one with the smallest id (none comes last), fingerprint and text hash.

    An id that stands for unlike texts is several documents. Rows with equal id and text are one document and the first of them stays.
    """
    prints = stored(fingerprints(docs, shingle, hashed=True), "simhash")
    # of each fingerprint one row competes for its class, so that a class of copies is not gathered
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "hash"))
    first = prints.groupBy("fp").agg(best.alias("best"))
    kept = first.join(_members(prints, distance, block).select("fp", "component"), "fp").groupBy("component").agg(F.min("best").alias("best"))
    named = kept.select(F.col("best.doc_id").alias("_kept_id"), F.col("best.hash").alias("_kept_hash"))
    rows = docs.withColumn("_kept_hash", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (rows["_kept_hash"] == named["_kept_hash"])
    return rows.join(named, same, "left_semi").dropDuplicates(["doc_id", "_kept_hash"]).drop("_kept_hash")
