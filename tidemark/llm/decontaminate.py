"""Benchmark decontamination: greedy string tiling of documents with benchmark items.

Words are lower-cased and stripped of ASCII punctuation. Every run of ``match`` words of an item is a seed; documents are joined
with seeds by a rolling hash (Karp-Rabin) over the whole text. Neighbouring seed hits on a diagonal make maximal matches. Tiling
then takes the longest match whose words are unmarked on both sides, marks it, cuts what is left of overlapping ones, and goes on
until none of ``match`` words is left: each word of the item and of the document is used once, in any order, so that passages whose
parts were moved are still covered. The coverage of an item is the share of its words inside tiles; ``threshold`` makes a leak.

The item side is a stated query set against all rows: it is cut into blocks of about ``block_bytes`` of text, each block is sent
to the tasks, and the documents pass over each block. Documents are never shuffled and never collected.

Defined cases. Null, empty or blank texts and items match nothing. An item of fewer than ``match`` words must occur as a whole.
Equal matches go by place in the item, then in the document. Repeated items are separate rows of the result, repeated documents
too. Items without an id are reported with a null id. Only ``doc_id``, ``text``, ``item_id`` and the item's ``text`` are read;
``keep_clean`` returns all columns of the documents untouched.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, map_batches, raw_texts

MATCH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
# punctuation and control characters separate words
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id bigint, item_id bigint, coverage double, tiles int, words int"


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_TABLE).split()


def _rolling(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and whether all of them are known words."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        key = key * _PRIME + part.astype(np.uint64) + np.uint64(1)
        known &= part >= 0
    return key, known


def tile(item: np.ndarray, text: np.ndarray, matches: list[tuple[int, int, int]], least: int) -> tuple[int, int]:
    """(words covered, tiles) of greedy tiling, given maximal matches (place in item, place in text, words)."""
    heap = [(-n, p, t) for p, t, n in matches]
    heapq.heapify(heap)
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    covered = tiles = 0
    while heap:
        n, p, t = heapq.heappop(heap)
        n = -n
        taken = used_item[p : p + n] | used_text[t : t + n]
        if not taken.any():
            used_item[p : p + n] = used_text[t : t + n] = True
            covered += n
            tiles += 1
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, t + a))
    return covered, tiles


@dataclass
class Items:
    """A block of items: numbered words, and the sorted seeds of each length."""

    ids: list
    words: list[np.ndarray]
    least: list[int]
    number: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], match: int) -> Items:
        number: dict[bytes, int] = {}
        found = cls([], [], [], number, {})
        parts: dict[int, list] = defaultdict(list)
        for item_id, text in rows:
            words = np.array([number.setdefault(w, len(number)) for w in words_of((text or "").encode())], np.int64)
            if not len(words):
                continue
            size = min(match, len(words))
            keys, _ = _rolling(words, size)
            parts[size].append((keys, np.full(len(keys), len(found.ids)), np.arange(len(keys))))
            found.ids.append(item_id)
            found.words.append(words)
            found.least.append(size)
        for size, own in parts.items():
            keys, item, place = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(keys, kind="stable")
            found.seeds[size] = (keys[order], item[order], place[order])
        return found

    def _hits(self, ids: np.ndarray):
        """(item, place in item, place in text) of all seeds found."""
        out = []
        for size, (keys, item, place) in self.seeds.items():
            rolled, known = _rolling(ids, size)
            at = np.flatnonzero(known)
            low = np.searchsorted(keys, rolled[at], "left")
            count = np.searchsorted(keys, rolled[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            if len(at):
                seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                out.append(np.stack((item[seed], place[seed], np.repeat(at, count))))
        return np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)

    def matched(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, coverage, tiles, words) of every pair that reaches the threshold."""
        get = self.number.get
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split)) + 1
        # texts in a row, each with an unknown word behind it
        ids = np.fromiter((get(w, -1) for words in split for w in (*words, b" ")), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        item, place, at = self._hits(ids)
        if not len(item):
            return []
        text = np.searchsorted(ends, at, "right")
        order = np.lexsort((place, at - place, item, text))
        item, place, at, text = item[order], place[order], at[order], text[order]
        pair = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(text) != 0)])
        found = []
        for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(item)], strict=True):
            own, least = self.words[item[a]], self.least[item[a]]
            reach = np.zeros(len(own) + 1, np.int64)
            np.add.at(reach, place[a:b], 1)
            np.add.at(reach, place[a:b] + least, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < threshold * len(own):
                continue  # not even with overlaps
            start = ends[text[a]] - counts[text[a]]
            body = ids[start : ends[text[a]]]
            p, t = place[a:b], at[a:b] - start
            new = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(t) != 1)])
            runs = np.diff(np.append(new, b - a)) + least - 1
            matches = [
                (x, y, n)
                for x, y, n in zip(p[new].tolist(), t[new].tolist(), runs.tolist(), strict=True)
                if (own[x : x + n] == body[y : y + n]).all()  # equal hashes are not yet equal words
            ]
            covered, tiles = tile(own, body, matches, least)
            if covered >= threshold * len(own):
                found.append((int(text[a]), int(item[a]), covered / len(own), tiles, len(own)))
        return found


def blocks(items: DataFrame, match: int = MATCH, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes``."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // block_bytes)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Items.of(sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), match)


def leaks(docs: DataFrame, items: DataFrame, match: int = MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, words) of every document and item whose coverage reaches ``threshold``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = spark.createDataFrame([], _SCHEMA)
    for block in blocks(items, match, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts, ids, found = raw_texts(batch.column(1)), batch.column(0).to_pylist(), []
            for a, b in chunks(texts):
                found += [(ids[a + t], shared.value.ids[i], c, n, w) for t, i, c, n, w in shared.value.matched(texts[a:b], threshold)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "coverage", "tiles", "words"])

        out = out.unionByName(map_batches(rows, run, _SCHEMA))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, match: int = MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    at = docs.columns.index("text")
    for block in blocks(items, match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts, clean = raw_texts(batch.column(at)), np.ones(batch.num_rows, bool)
            for a, b in chunks(texts):
                clean[[a + m[0] for m in shared.value.matched(texts[a:b], threshold)]] = False
            return batch.filter(pa.array(clean))

        docs = map_batches(docs, run, docs.schema)
    return docs
