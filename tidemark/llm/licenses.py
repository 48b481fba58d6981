"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased (A-Z), ASCII punctuation separates them. A text's shingles are its runs of ``SHINGLE`` (5) words, a template's
likewise. Templates are grouped by size, up to 1, 2, 4, 8 ... shingles. For the group of up to s shingles, the text is cut into
blocks of s, and every two neighbouring blocks are a window, so that windows overlap by half and any run of s shingles lies in one.
The minima of a window are those of its blocks; blocks of 2s shingles are pairs of blocks of s, so all sizes cost as much as two.

Guarantee. A window of 2s shingles that holds 0.8 of a template of over s/2 shingles has a Jaccard similarity of at least 0.19 with
it. With ``BANDS`` = 64 bands of one row it meets the template in a band with a probability of at least 1 - 0.81 ** 64 = 0.999998.
(Two rows to a band would need 300 bands for that; the check that follows makes long bands needless.) A passage that insertions
stretch, up to 2s shingles, lies in three neighbouring blocks; one of their two windows holds half of it: similarity 0.087 at least
(0.15 for a template of s shingles), met with a probability of 0.997 (0.99998).

A retrieved template is verified exactly, in the window and a block on either side of it, which hold such a passage whole: the share
of the template's distinct shingles found there (all words' hashes are compared) must reach ``CONTAINMENT``. A row of the result is a
document and a template, with the best share and the shortest stretch that has it, the earliest of equal ones.

Templates are a stated query set of bounded size: ``MAX_TEMPLATE_BYTES`` in all, else an error. Documents are never shuffled.

Defined cases. Null, empty and blank texts and those of fewer than five words match nothing. A template of fewer than five words is
an error. Repeated rows are reported each, rows without an id with a null id. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, map_batches, raw_texts
from tidemark.llm.license_texts import TEMPLATES

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
MAX_TEMPLATE_BYTES = 8 << 20
_FILTER_BITS = 16
_TABLE = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32) for c in range(256)), np.uint8)
_PRIME = np.uint64(0x100000001B3)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text's bytes, and where each word starts."""
    text = _TABLE[data]
    inside = text != 32
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
    length = ends - starts
    at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
    power = _powers(int(length.max()))
    place = at - np.repeat(starts, length)
    total = np.add.reduceat((text[at].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(length) - length)
    return _mix(total + length.astype(np.uint64)), starts


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every run of five words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = _mix(out * _PRIME + words[k : k + n])
    return out


def _coefficients(bands: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, bands, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands, np.uint32)


def shortest(places: list[int], kinds: list[int], n: int) -> tuple[int, int]:
    """First and last place of the shortest stretch in which all ``n`` kinds occur, the earliest of equal ones."""
    count, missing, left, best = [0] * n, n, 0, (places[0], places[-1])
    for right, kind in enumerate(kinds):
        missing -= count[kind] == 0
        count[kind] += 1
        while not missing:
            if places[right] - places[left] < best[1] - best[0]:
                best = (places[left], places[right])
            count[kinds[left]] -= 1
            missing += count[kinds[left]] == 0
            left += 1
    return best


class Index:
    """Templates by size, with the minima that each band is looked up by."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError("the templates are larger than a query set may be")
        self.bands, self.a, self.b = bands, *_coefficients(bands)
        self.names, self.shingles, self.blocks = [], [], []
        sizes = defaultdict(list)
        for name, text in templates.items():
            own = shingle_hashes(word_hashes(np.frombuffer(text.encode(), np.uint8))[0])
            if not len(own):
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            sizes[(len(own) - 1).bit_length()].append(len(self.names))
            self.blocks.append(1 << (len(own) - 1).bit_length())
            self.names.append(name)
            self.shingles.append(np.unique(own))
        self.levels = {}
        for level, members in sizes.items():
            minima = np.stack([self.minhash(self.shingles[t]).min(0) for t in members])
            quick = np.zeros((bands, 1 << _FILTER_BITS), bool)
            for row in minima:
                quick[np.arange(bands), row >> np.uint32(32 - _FILTER_BITS)] = True
            self.levels[level] = (np.array(members), minima, quick)

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        """(shingles, bands) values; the minimum over rows is the signature."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        return x[:, None] * self.a + self.b

    def candidates(self, shingles: np.ndarray, text: np.ndarray):
        """(first shingle, one after the last, template) of windows that meet a template in a band.

        ``text`` numbers the text of each shingle; windows end with their text.
        """
        # blocks start anew with each text
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        begin, minima, owner = np.arange(len(shingles)), self.minhash(shingles), text
        end = begin + 1
        for level in range(max(self.levels) + 1):
            if level:
                # pairs of blocks; an odd one at the end of a text stays alone
                place = np.arange(len(begin)) - np.repeat(first, np.diff(np.r_[first, len(begin)]))
                head = np.flatnonzero(place % 2 == 0)
                mate = np.minimum(head + 1, len(begin) - 1)
                paired = (head + 1 < len(begin)) & (owner[mate] == owner[head])
                minima = np.where(paired[:, None], np.minimum(minima[head], minima[mate]), minima[head])
                end = np.where(paired, end[mate], end[head])
                begin, owner = begin[head], owner[head]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if level not in self.levels:
                continue
            members, wanted, quick = self.levels[level]
            after = np.minimum(np.arange(len(begin)) + 1, len(begin) - 1)
            same = owner[after] == owner
            window = np.where(same[:, None], np.minimum(minima, minima[after]), minima)
            near = quick[np.arange(self.bands)[None, :], window >> np.uint32(32 - _FILTER_BITS)].any(1)
            at = np.flatnonzero(near)
            if len(at):
                hit = (window[at][:, None, :] == wanted[None, :, :]).any(2)
                w, t = np.nonzero(hit)
                yield from zip(begin[at[w]].tolist(), np.where(same, end[after], end)[at[w]].tolist(), members[t].tolist(), strict=True)

    def matches(self, texts: list[bytes], containment: float = CONTAINMENT) -> list[tuple]:
        """(text, template, containment, first word, words) of the best window of each text and template."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        words, starts = word_hashes(data)
        shingles = shingle_hashes(words)
        if not len(shingles):
            return []
        owner = np.searchsorted(ends, starts, "right")
        whole = np.flatnonzero(owner[: len(shingles)] == owner[SHINGLE - 1 :])
        if not len(whole):
            return []
        shingles, text = shingles[whole], owner[whole]
        first_word = np.searchsorted(owner, np.arange(len(texts)))
        best: dict[tuple, tuple] = {}
        for a, b, t in self.candidates(shingles, text):
            low, high = np.searchsorted(text, text[a], "left"), np.searchsorted(text, text[a], "right")
            begin = max(int(low), a - self.blocks[t])
            own = shingles[begin : min(int(high), b + self.blocks[t])]
            held = np.flatnonzero(np.isin(own, self.shingles[t]))
            kinds, kind = np.unique(own[held], return_inverse=True)
            share = len(kinds) / len(self.shingles[t])
            if share >= containment:
                one, last = shortest(held.tolist(), kind.tolist(), len(kinds))
                start = int(whole[begin + one] - first_word[text[a]])
                length = last - one + SHINGLE
                key = (int(text[a]), t)
                if key not in best or (-share, start) < best[key][:2]:
                    best[key] = (-share, start, length)
        return [(i, self.names[t], -s, start, length) for (i, t), (s, start, length) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, containment, first_word, words) of every document and template that it contains."""
    templates = TEMPLATES if templates is None else templates
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, bands))
    schema = "doc_id bigint, license string, containment double, first_word int, words int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids, found = raw_texts(batch.column(1)), batch.column(0).to_pylist(), []
        for a, b in chunks(texts, 1 << 18):
            found += [(ids[a + i], *rest) for i, *rest in shared.value.matches(texts[a:b], containment)]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "containment", "first_word", "words"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, schema)
