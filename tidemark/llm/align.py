"""Cross-tokenizer alignment: which tokens of two public vocabularies cover the same bytes of a text.

A is a byte-level vocabulary (a rank file), B a piece vocabulary with byte fallback; both see a blank and the text, A literally, B by
its own rule. A token's bytes are known from its id, so its byte range is a running sum. A text whose joined token bytes differ from
blank and text on either side (B rewrites some characters) is not aligned and has no tokens.

1. Per batch of texts, laid end to end, ``pandas.merge_asof`` keyed by document finds for each token start of A the token of B that
   covers it, and for each token start of B the covering token of A. The union of both directions is the set of overlaps.
2. An overlap whose tokens end at the same byte closes a group: such ends cut both sides into the smallest runs of tokens that cover
   the same bytes. All tokens A and B of a group are linked with each other.
3. The count of a pair of ids is the number of documents that hold it linked. Workers gather ``CHUNK`` bytes of text into one row:
   its documents, their linked pairs as places in the row's list of distinct pairs, and how many documents hold each. The rows are
   written once. The lists are summed up over the corpus, and every row gets back the counts of its own list only: nothing is
   broadcast and what is shuffled is at most one entry per row and distinct pair.

Long texts are cut before a single blank between words, where neither vocabulary has tokens that go on (checked for B when it is
loaded); the parts are tokenised one by one and make one sequence. Memory follows a batch, and the linked pairs of a document.

Defined cases. Null and empty texts have no tokens. Repeated rows are documents of their own, ids may be null. An empty table gives no
row. Special tokens in a text are plain text. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, stored
from tidemark.llm.materialise import VOCABULARY, encoder, parts_of

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# bytes of text that are aligned at once, and that share one list of pairs
BATCH = 1 << 19
CHUNK = 1 << 24
# links of a group that are written out one by one; larger groups are counted per id first
SMALL_GROUP = 64
# pairs of a large group that are made at once
BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    vocabulary: str = VOCABULARY
    pieces: str = PIECES
    batch: int = BATCH
    chunk: int = CHUNK


class Sides:
    """Both tokenizers with the bytes and the digits of every id."""

    def __init__(self, settings: Settings):
        import sentencepiece

        self.a = encoder(settings.vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=settings.pieces)
        self.bytes_a = {i: x for x, i in self.a._mergeable_ranks.items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        one = [re.fullmatch(r"<0x([0-9A-F]{2})>", x) for x in names]
        self.bytes_b = {i: bytes([int(m[1], 16)]) if m else x.replace("▁", " ").encode() for i, (x, m) in enumerate(zip(names, one, strict=True))}
        # parts may only be cut before a blank if no piece goes on from a letter to a blank
        self.cuts = not any("▁" in x.lstrip("▁") for x in names)
        self.size_a, self.size_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (self.bytes_a, self.bytes_b))
        if max(len(self.size_a), len(self.size_b)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if one of them does not spell blank and text."""
        if not text:
            return [], []
        whole = " " + text
        raw = whole.encode()
        a, b = [], []
        for part in parts_of(whole) if self.cuts else [whole]:
            a += self.a.encode_ordinary(part)
            b += self.b.encode(part[1:])  # which puts a blank in front
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        return a, b


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.empty(sizes.sum(), np.int64)
    at = 0
    for x in lists:
        out[at : at + len(x)] = x
        at += len(x)
    return out, np.repeat(np.arange(len(lists)), sizes)


@dataclass
class Aligned:
    """Tokens of a batch of documents: their ids, document, group, and the overlaps as places."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray
    overlaps: pd.DataFrame | None


def aligned(encoded: list[tuple[list[int], list[int]]], sides: Sides, overlaps: bool = False) -> Aligned:
    ids_a, doc_a = _flat([a for a, _ in encoded])
    ids_b, doc_b = _flat([b for _, b in encoded])
    # both sides have the same bytes, so the running sums are places in all texts laid end to end
    end_a, end_b = np.cumsum(sides.size_a[ids_a]), np.cumsum(sides.size_b[ids_b])
    left = pd.DataFrame({"at": end_a - sides.size_a[ids_a], "doc": doc_a, "a": np.arange(len(ids_a))})
    right = pd.DataFrame({"at": end_b - sides.size_b[ids_b], "doc": doc_b, "b": np.arange(len(ids_b))})
    over_a = pd.merge_asof(left, right, on="at", by="doc")
    over_b = pd.merge_asof(right, left, on="at", by="doc")
    a, b = (np.concatenate((over_a[c].to_numpy(), over_b[c].to_numpy())) for c in "ab")
    # a pair found in both directions stands twice; for the ends that does not matter
    closing = a[end_a[a] == end_b[b]]
    is_end = np.zeros(len(ids_a), bool)
    is_end[closing] = True
    ends = end_a[is_end]
    both = pd.DataFrame({"a": a, "b": b}).drop_duplicates().sort_values(["a", "b"], ignore_index=True) if overlaps else None
    return Aligned(ids_a, ids_b, doc_a, doc_b, np.searchsorted(ends, end_a), np.searchsorted(ends, end_b), doc_a[is_end], both)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _products(group_a, value_a, n_a, group_b, value_b, n_b, groups: int):
    """Blocks of (group, a, b, links): each value of A with each of B within a group. Both sides are in order of groups."""
    per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start_b = _starts(per_b)
    width = per_b[group_a]
    bounds = np.cumsum(width)
    at = 0
    while at < len(group_a):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + BLOCK, "right")))
        own = np.arange(at, to)
        rows = np.repeat(own, width[own])
        cols = np.arange(len(rows)) - np.repeat(_starts(width[own]), width[own]) + start_b[group_a[rows]]
        yield group_a[rows], value_a[rows], value_b[cols], n_a[rows] * n_b[cols]
        at = to


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(weight, first)


def pair_links(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Keys doc << 32 | a << 16 | b of all linked ids of the batch, in order, and their links."""
    groups = len(x.group_doc)
    per = np.bincount(x.group_a, minlength=groups) * np.bincount(x.group_b, minlength=groups)
    few = per <= SMALL_GROUP
    parts = []
    for small in (True, False):
        mine = few if small else ~few
        if not mine.any():
            continue
        sides = []
        for group, ids in ((x.group_a, x.ids_a), (x.group_b, x.ids_b)):
            keep = mine[group]
            group, ids, n = group[keep], ids[keep], np.ones(keep.sum(), np.int64)
            if not small:
                key, n = _summed(group << 16 | ids, n)
                group, ids = key >> 16, key & 0xFFFF
            sides += [group, ids, n]
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for group, a, b, n in _products(*sides, groups):
            key, n = _summed(x.group_doc[group] << 32 | a << 16 | b, n)
            held = _summed(np.concatenate((held[0], key)), np.concatenate((held[1], n)))
        parts.append(held)
    return _summed(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Digits:
    """The text of groups: ids of A, then of B, of each group in turn."""

    def __init__(self, sides: Sides):
        n_a, n_b = len(sides.size_a), len(sides.size_b)
        self.table = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)]
        self.n_a, self.n_b = n_a, n_b

    def of(self, x: Aligned, docs: int) -> list[str]:
        groups = len(x.group_doc)
        last_a = np.r_[x.group_a[1:] != x.group_a[:-1], True][: len(x.group_a)]
        last_b = np.r_[x.group_b[1:] != x.group_b[:-1], True][: len(x.group_b)]
        per_a, per_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
        codes = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
        codes[np.arange(len(x.ids_a)) + _starts(per_b)[x.group_a]] = x.ids_a + self.n_a * last_a
        codes[np.arange(len(x.ids_b)) + np.cumsum(per_a)[x.group_b]] = x.ids_b + self.n_b * last_b + 2 * self.n_a
        sizes = np.bincount(x.doc_a, minlength=docs) + np.bincount(x.doc_b, minlength=docs)
        ends = np.cumsum(sizes)
        # the mark after the last group of a text is left out
        return ["".join(map(self.table.__getitem__, codes[e - n : e].tolist()))[:-1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


_ROW = pa.schema(
    [("chunk", pa.int64())]
    + [(name, pa.list_(kind)) for name, kind in (
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("entries", pa.int64()),
    )]
    + [("at", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
_ROW_DDL = (
    "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, entries array<bigint>, at binary, links binary, pairs array<bigint>, docs array<bigint>"
)


def _batches(batches, settings: Settings):
    """(ids, encoded texts, bytes) of about ``settings.batch`` bytes of text."""
    sides = Sides(settings)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        # characters are what is cheap to count here; a batch of other scripts has up to four times the bytes
        for low, high in chunks([x or "" for x in texts], settings.batch):
            yield sides, batch.column(0).slice(low, high - low), [sides.encode(x or "") for x in texts[low:high]], sum(len(x or "") for x in texts[low:high])


def _gathered(docs: DataFrame, settings: Settings) -> DataFrame:
    """A row for each ``settings.chunk`` bytes of text, see the module's third step."""

    def run(batches):
        # first the partition, then the row within it
        chunk = TaskContext.get().partitionId() << 32
        digits, held, size = None, [], 0

        def out():
            nonlocal chunk
            columns = {name: np.concatenate([h[name] for h in held]) for name in ("n_a", "n_b", "n_groups", "n_links", "entries", "pair", "links")}
            pairs, at = np.unique(columns.pop("pair"), return_inverse=True)
            links = columns.pop("links")
            if len(links) and links.max() >> 32:
                raise ValueError("a pair is linked 2**32 times in one document")
            row = {"chunk": chunk, "at": at.astype("<u4").tobytes(), "links": links.astype("<u4").tobytes(), "pairs": pairs, "docs": np.bincount(at, minlength=len(pairs))}
            row |= {name: x for name, x in columns.items()}
            row |= {name: [y for h in held for y in h[name]] for name in ("doc_id", "groups_sha256")}
            chunk += 1
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ROW], schema=_ROW)

        for sides, ids, encoded, n in _batches(batches, settings):
            digits = digits or Digits(sides)
            x, many = aligned(encoded, sides), len(encoded)
            key, links = pair_links(x)
            doc = key >> 32
            texts = digits.of(x, many)
            held.append({
                "doc_id": ids.to_pylist(), "n_a": np.bincount(x.doc_a, minlength=many), "n_b": np.bincount(x.doc_b, minlength=many),
                "n_groups": np.bincount(x.group_doc, minlength=many), "entries": np.bincount(doc, minlength=many),
                "n_links": _totals(links, np.bincount(doc, minlength=many)), "pair": key & 0xFFFFFFFF, "links": links,
                "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts],
            })
            size += n
            if size >= settings.chunk:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _ROW_DDL)


def _totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs of the given sizes; whole numbers throughout."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair a << 16 | b linked, and whether no pair of the same a is in more."""
    lists = rows.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = lists.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("count"))
    a = F.shiftright("pair", 16)
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best``: links whose count is the highest of their A id; ``count_sum``: the counts of all links, summed.
    """
    rows = stored(_gathered(docs, settings), "aligned")
    asked = rows.select("chunk", F.explode("pairs").alias("pair"))
    known = asked.join(stored(pair_counts(rows), "pair-counts"), "pair")
    # at most one entry per distinct pair of a chunk
    lists = known.groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("known"))
    heavy = rows.drop("pairs", "docs").join(lists, "chunk", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries")}
                at, links = (np.frombuffer(batch.column(name)[i].as_py(), "<u4").astype(np.int64) for name in ("at", "links"))
                entries = row.pop("entries").to_numpy()
                best = count = np.zeros(0, np.int64)
                if len(at):
                    known = batch.column("known")[i].values
                    order = np.argsort(known.field("pair").to_numpy())
                    count = known.field("count").to_numpy()[order][at] * links
                    best = known.field("best").to_numpy(zero_copy_only=False)[order][at] * links
                row |= {"n_best": pa.array(_totals(best, entries)), "count_sum": pa.array(_totals(count, entries))}
                yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    return heavy.mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    )


def overlaps(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, a_ids, b_ids, overlaps, ends) of every row: both token sequences, the overlapping places of them, and the groups.

    ``overlaps``: (a, b) places; ``ends``: (a, b) places of the last tokens of each group.
    """
    place = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("overlaps", place), ("ends", place)])

    def run(batches):
        for sides, ids, encoded, _ in _batches(batches, settings):
            x = aligned(encoded, sides, overlaps=True)
            own = x.doc_a[x.overlaps["a"].to_numpy()]
            first_a, first_b = (_starts(np.bincount(d, minlength=len(encoded))) for d in (x.doc_a, x.doc_b))
            last_a, last_b = (np.flatnonzero(np.r_[g[1:] != g[:-1], True][: len(g)]) for g in (x.group_a, x.group_b))

            def places(a, b, doc):
                ends = np.cumsum(np.bincount(doc, minlength=len(encoded)))
                flat = pa.StructArray.from_arrays([pa.array(a - first_a[doc]), pa.array(b - first_b[doc])], ["a", "b"])
                return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat)

            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([a for a, _ in encoded], pa.list_(pa.int64())), pa.array([b for _, b in encoded], pa.list_(pa.int64())),
                 places(x.overlaps["a"].to_numpy(), x.overlaps["b"].to_numpy(), own), places(last_a, last_b, x.group_doc)], schema=schema,
            )

    pair = "array<struct<a:bigint,b:bigint>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id bigint, a_ids array<bigint>, b_ids array<bigint>, overlaps {pair}, ends {pair}"
    )
