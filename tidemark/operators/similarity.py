"""Exact Hamming-distance joins of 64-bit signatures.

Up to distance 11 the 64 bits are cut into bands, few enough that two signatures within the
threshold differ in some band by two bits at most. Then some value of the band is at most one
bit away from both (pigeonhole; nothing is missed). A cell is all values of a band with the
same upper bits. A row travels to its own cell and to those that one upper bit leads to; what
the lower bits lead to stays inside the cell and is worked out in its task, so the copies of a
row grow with the logarithm of the rows. Crowded cells are cut into blocks and compared two
blocks at a time. A pair belongs to one value of one band and is found once.

Larger thresholds have no useful index: the rows of a group are compared block by block
instead. Groups of few rows are joined in the JVM.

The number of tasks follows the number of rows and of comparisons, not that of bytes: a few
bytes can stand for much work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import hamming
from tidemark.session import cut, maybe_broadcast

SMALL_KEY = 256
BLOCK_ROWS = 4096
CHUNK_ROWS = 128
# Work of one task: rows that it joins, and signatures that it compares.
TASK_ROWS = 2_000_000
TASK_PAIRS = 500_000_000
BANDED_UP_TO = 11
NO_CENTRE = -(1 << 63)
# Rows of a cell on average, and at most in one block of it.
CELL_ROWS = 1 << 17
CELL_BLOCK = 1 << 18
# Squared rows of a cell's parts that one block may hold, and bits that tell its parts apart.
CELL_WORK = 1_000_000_000
PART_BITS = 6
# Comparisons, or pairs, that a task holds at once.
SLICE = 1 << 21


def _bands(threshold: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each band: bands * 3 > threshold, as two bits may differ in one."""
    count = threshold // 3 + 1
    edges = [round(i * 64 / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _band_value(low: int, width: int) -> Column:
    return F.shiftrightunsigned("sig", low).bitwiseAND(F.lit(_signed((1 << width) - 1)).cast("bigint"))


def _upper_bits(rows: int, width: int) -> int:
    """How many upper bits of a band name its cells."""
    bits = 0
    while bits < width and rows * (bits + 1) > CELL_ROWS << bits:
        bits += 1
    return bits


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each connected set, after the links (a, b) were added."""
    while True:
        open_links = root[a] != root[b]
        if not open_links.any():
            return root
        a, b = root[a[open_links]], root[b[open_links]]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _compare_blocks(above: int, threshold: int, links_only: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        sig = rows["sig"].to_numpy(np.int64).view(np.uint64)
        ids = rows["id"].to_numpy(np.int64)
        marked = "sole" in rows
        if marked:
            sole, lone = rows["sole"].to_numpy(np.int64), rows["lone"].to_numpy(bool)
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        root, found = np.arange(len(rows)), []
        for start in range(0, len(left), CHUNK_ROWS):
            part = left[start : start + CHUNK_ROWS]
            # within one block, each pair once
            others = right[start:] if lo == hi else right
            dist = np.bitwise_count(sig[part][:, None] ^ sig[others][None, :])
            x, y = np.nonzero((dist > above) & (dist <= threshold) if above >= 0 else dist <= threshold)
            a, b = part[x], others[y]
            keep = a < b if lo == hi else np.ones(len(a), bool)
            if marked:
                keep &= ~((sole[a] == sole[b]) & (sole[a] != NO_CENTRE) & (lone[a] | lone[b]))
            a, b = a[keep], b[keep]
            if links_only:
                root = _merged(root, a, b)
            else:
                found.append((np.minimum(a, b).astype(np.int32), np.maximum(a, b).astype(np.int32)))
        if links_only:
            b = np.flatnonzero(root != np.arange(len(rows)))
            a = root[b]
        else:
            a, b = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int32)]) for i in (0, 1))
        return pd.DataFrame({"a": ids[a], "b": ids[b], "distance": np.bitwise_count(sig[a] ^ sig[b]).astype(np.int32)})

    return run


def _dealt(df: DataFrame, tasks: float, on: list[str]) -> DataFrame:
    """``df`` hashed to as many partitions as its work asks for, which are not merged by their bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(int(tasks), cores), *on)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of every range, one range after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Runs of ranges that hold about ``SLICE`` elements (a longer range is a run by itself)."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield slice(at, upto)
        at = upto


def _near_values(value: np.ndarray, code: np.ndarray, lower: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p, q) of different values of one code that meet in this cell, each in one cell only.

    They differ by one or two bits. The smallest value at most one bit away from both decides.
    """
    one = np.uint64(1)
    mask = np.uint64((1 << lower) - 1)
    here = np.flatnonzero((value >> np.uint64(lower) if lower < 64 else value * np.uint64(0)) == np.uint64(cell))
    owner = np.concatenate([np.arange(len(value), dtype=np.int32)] + [here.astype(np.int32)] * lower)
    key = np.concatenate([value & mask] + [(value[here] & mask) ^ (one << np.uint64(i)) for i in range(lower)])
    order = np.lexsort((code[owner], key))
    key, owner = key[order], owner[order]
    base = np.uint64((cell << lower) & ((1 << 64) - 1))
    left, step, found = np.arange(len(key)), 0, []
    while len(left):
        step += 1
        left = left[left + step < len(key)]
        right = left + step
        left = left[(key[left] == key[right]) & (code[owner[left]] == code[owner[right]])]
        p, q = owner[left], owner[left + step]
        x = value[p] ^ value[q]
        low = x & (~x + one)
        meets = np.where(x == low, value[p] & value[q], np.minimum(value[p] ^ low, value[q] ^ low))
        mine = (x != 0) & (meets == (key[left] | base))
        found.append((p[mine], q[mine]))
    return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int32)]) for i in (0, 1))


def _compare_cell(above: int, threshold: int, links_only: bool, uppers: list[int], by: list[str]):
    bands = _bands(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        cell, lo, hi = (int(rows[c].iloc[0]) for c in ("cell", "lo", "hi"))
        number, upper = cell >> 40, cell & ((1 << 40) - 1)
        first, width = bands[number]
        lower = width - uppers[number]
        if by:
            # a cell is then a bucket of groups, with all values of the band
            upper = 0
        code = rows.groupby(by, sort=False).ngroup().to_numpy(np.int64) if by else np.zeros(len(rows), np.int64)
        sig = rows["sig"].to_numpy(np.int64).view(np.uint64)
        of_band = np.uint64((1 << width) - 1)
        value = (sig >> np.uint64(first)) & of_band
        second = (rows["block"].to_numpy() == hi) & (lo != hi)
        order = np.lexsort((second, value, code))
        sig, value, code, second = sig[order], value[order], code[order], second[order]
        ids = rows["id"].to_numpy(np.int64)[order]
        marked = "sole" in rows
        if marked:
            sole, lone = rows["sole"].to_numpy(np.int64)[order], rows["lone"].to_numpy(bool)[order]
        del rows
        new = np.ones(len(sig), bool)
        new[1:] = (value[1:] != value[:-1]) | (code[1:] != code[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(sig))
        middle = start + np.add.reduceat(~second, start)
        at = value[start]
        p, q = _near_values(at, code[start], lower, upper)
        own = np.flatnonzero((at >> np.uint64(lower) if lower < 64 else at * np.uint64(0)) == np.uint64(upper))
        # (rows of the left side, rows of the right side); one block: each pair of rows once
        if lo == hi:
            sides = [(start[p], end[p], start[q], end[q])]
        else:
            sides = [(start[p], middle[p], middle[q], end[q]), (middle[p], end[p], start[q], middle[q]), (start[own], middle[own], middle[own], end[own])]
        root, held, size = np.arange(len(ids)), [], 0

        def frame(a, b):
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            return pd.DataFrame({"a": ids[a], "b": ids[b], "distance": np.bitwise_count(sig[a] ^ sig[b]).astype(np.int32)})

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            def against(a, low, high):
                counts = high - low
                for part in _slices(counts):
                    yield np.repeat(a[part], counts[part]), _ranges(low[part], counts[part])

            if lo == hi:
                for part in _slices((end - start)[own]):
                    a = _ranges(start[own[part]], (end - start)[own[part]])
                    yield from against(a, a + 1, np.repeat(end[own[part]], (end - start)[own[part]]))
            for a_from, a_to, b_from, b_to in sides:
                for part in _slices(a_to - a_from):
                    counts = a_to[part] - a_from[part]
                    a = _ranges(a_from[part], counts)
                    yield from against(a, np.repeat(b_from[part], counts), np.repeat(b_to[part], counts))

        for a, b in found():
            differ = sig[a] ^ sig[b]
            distance = np.bitwise_count(differ)
            keep = np.flatnonzero((distance <= threshold) & (distance > above) if above >= 0 else distance <= threshold)
            a, b, differ = a[keep], b[keep], differ[keep]
            keep = ids[a] != ids[b]
            for earlier, bits in bands[:number]:
                keep &= np.bitwise_count((differ >> np.uint64(earlier)) & np.uint64((1 << bits) - 1)) > 2
            if marked:
                keep &= ~((sole[a] == sole[b]) & (sole[a] != NO_CENTRE) & (lone[a] | lone[b]))
            a, b = a[keep], b[keep]
            if not links_only:
                for from_ in range(0, len(a), SLICE):
                    yield frame(a[from_ : from_ + SLICE], b[from_ : from_ + SLICE])
                continue
            held, size = [*held, (a, b)], size + len(a)
            if size >= SLICE:
                root, held, size = _merged(root, *(np.concatenate([h[i] for h in held]) for i in (0, 1))), [], 0
        if links_only:
            if size:
                root = _merged(root, *(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            b = np.flatnonzero(root != np.arange(len(ids)))
            yield frame(root[b], b)

    return run


def _banded_join(sigs: DataFrame, threshold: int, above: int, by: list[str], links_only: bool) -> DataFrame:
    """The pairs by cells. Rows with a null in ``by`` are in no group."""
    if by:
        sigs = sigs.dropna(subset=by)
    rows, bands = sigs.count(), _bands(threshold)
    buckets = max(1, rows // CELL_ROWS)
    uppers = [0 if by else _upper_bits(rows, width) for _, width in bands]
    parts = [0 if by else min(width, bits + PART_BITS) for (_, width), bits in zip(bands, uppers)]

    def cells(number: int, upper: Column) -> Column:
        return upper.bitwiseOR(F.lit(number << 40).cast("bigint"))

    def reached(number: int, upper: Column) -> list[Column]:
        return [cells(number, upper.bitwiseXOR(F.lit(1 << i).cast("bigint"))) for i in range(uppers[number])] + [cells(number, upper)]

    if by:
        uppermost = [F.pmod(F.xxhash64(*by), F.lit(buckets).cast("bigint"))] * len(bands)
        part = [F.struct(F.lit(n).alias("band"), u.alias("upper"), F.xxhash64(*by, F.shiftrightunsigned(_band_value(lo, width), max(0, width - PART_BITS))).alias("rest"))
                for n, ((lo, width), u) in enumerate(zip(bands, uppermost))]
    else:
        uppermost = [F.shiftrightunsigned(_band_value(lo, width), width - bits) if bits else F.lit(0).cast("bigint") for (lo, width), bits in zip(bands, uppers)]
        part = []
        for n, ((lo, width), bits) in enumerate(zip(bands, parts)):
            fine = F.shiftrightunsigned(_band_value(lo, width), width - bits) if bits else F.lit(0).cast("bigint")
            rest = fine.bitwiseAND(F.lit((1 << bits - uppers[n]) - 1).cast("bigint"))
            part.append(F.struct(F.lit(n).alias("band"), uppermost[n].alias("upper"), rest.alias("rest")))
    # as many rows as parts; a part of a cell also has what other cells send to it
    counts = sigs.select(F.explode(F.array(*part)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    around = F.array().cast("array<bigint>")
    for n in range(len(bands)):
        around = F.when(F.col("x.band") == n, F.array(*reached(n, F.col("x.upper")))).otherwise(around)
    in_part = counts.select(F.explode(around).alias("cell"), "x.rest", "n").groupBy("cell", "rest").agg(F.sum("n").alias("n"))
    sizes = in_part.groupBy("cell").agg(F.sum("n").alias("size"), F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
    blocks = F.greatest(F.ceil(F.col("size") / CELL_BLOCK), F.ceil(F.sqrt(F.col("work") / CELL_WORK))).cast("int")
    crowded = cut(sizes.select("cell", "size", blocks.alias("blocks")))
    total = crowded.agg(
        F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0)).alias("groups"),
        F.coalesce(F.sum(F.col("blocks").cast("double") * F.col("size")), F.lit(0.0)).alias("rows"),
    ).first()
    crowded = crowded.where("blocks > 1").drop("size")
    quiet = crowded.isEmpty()

    keyed = sigs.select("*", F.explode(F.array(*[c for n, u in enumerate(uppermost) for c in reached(n, u)])).alias("cell"))
    none = F.lit(0)
    if quiet:
        dealt = keyed.select("*", none.alias("block"), none.alias("lo"), none.alias("hi"))
    else:
        dealt = keyed.join(maybe_broadcast(crowded), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = (
            dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
            .withColumn("lo", F.least("block", "other"))
            .withColumn("hi", F.greatest("block", "other"))
            .drop("blocks", "other")
        )
    tasks = min(2 * int(total["groups"]), 1 + int(total["rows"]) // CELL_BLOCK + int(total["groups"]) // 8)
    on = ["cell", "lo", "hi"]
    return _dealt(dealt, tasks, on).groupBy(*on).applyInPandas(
        _compare_cell(above, threshold, links_only, uppers, by), "a bigint, b bigint, distance int"
    )


def hamming_join(
    sigs: DataFrame,
    threshold: int,
    *,
    above: int = -1,
    by: list[str] | None = None,
    links_only: bool = False,
) -> DataFrame:
    """Pairs (a, b, distance) with a < b and above < distance <= threshold.

    ``sigs`` has a unique ``id`` and a bigint ``sig``; pairs are formed within equal ``by``
    columns. Optional ``sole`` and ``lone`` columns mark copies that are linked already (see
    duplicates.py). With ``links_only`` a cell or a crowded group yields links that connect the
    same rows instead of all of its pairs, so that its output stays linear.
    """
    by = by or []
    marked = "sole" in sigs.columns
    marks = [F.coalesce("sole", F.lit(NO_CENTRE)).alias("sole"), "lone"] if marked else []
    # read several times below, and far narrower than what it was computed from
    sigs = cut(sigs.select("id", "sig", *marks, *by))
    if threshold <= BANDED_UP_TO:
        return _banded_join(sigs, threshold, above, by, links_only)
    on = [*by, "key"]
    keyed = sigs.withColumn("key", F.lit(0).cast("bigint"))
    sizes = cut(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("size")))
    crowded = sizes.where(F.col("size") > SMALL_KEY)
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    big = F.col("size") > SMALL_KEY
    work = sizes.agg(
        F.coalesce(F.sum(F.when(big, F.col("size").cast("double") * F.col("size"))), F.lit(0.0)).alias("compared"),
        F.coalesce(F.sum(F.when(~big, F.col("size").cast("double") * F.col("size"))), F.lit(0.0)).alias("joined"),
    ).first()
    quiet = work["compared"] == 0

    # only what a comparison needs travels; marks are met by the pairs that were found
    few = keyed.select(*on, "id", "sig")
    tasks = max(sigs.count() / TASK_ROWS, work["joined"] / (TASK_PAIRS / 10))
    few = _dealt(few, 1 + tasks, on)
    if not quiet:
        few = few.join(crowded.select(*on), on, "left_anti")
    left = few.select(*on, F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = few.select(*on, F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    distance = hamming(F.col("sig_a"), F.col("sig_b"))
    pairs = (
        left.join(right, on)
        .where((F.col("a") < F.col("b")) & (distance > above) & (distance <= threshold))
        .select("a", "b", distance.alias("distance"))
    )
    if marked:
        known = sigs.where(F.col("sole") != NO_CENTRE)
        for side in ("a", "b"):
            side_marks = known.select(F.col("id").alias(side), F.col("sole").alias(f"sole_{side}"), F.col("lone").alias(f"lone_{side}"))
            pairs = pairs.join(side_marks, side, "left")
        linked = (F.col("sole_a") == F.col("sole_b")) & (F.col("lone_a") | F.col("lone_b"))
        pairs = pairs.where(~F.coalesce(linked, F.lit(False))).select("a", "b", "distance")
    if quiet:
        return pairs

    many = (
        keyed.join(crowded, on)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    dealt = _dealt(many, 1 + work["compared"] / 2 / TASK_PAIRS, [*on, "lo", "hi"])
    compared = dealt.groupBy(*on, "lo", "hi").applyInPandas(
        _compare_blocks(above, threshold, links_only), "a bigint, b bigint, distance int"
    )
    return pairs.unionByName(compared)
