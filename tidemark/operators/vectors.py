"""Centroids and nearest-class joins of embedding vectors.

Vectors travel to Python as Arrow lists and are multiplied as matrices. A class table of
checked size is sent to every task; a larger one is cut into shards that meet item blocks by
key, and the partial results are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.numeric import dot, norm
from tidemark.session import cut

# most bytes of class vectors that are sent to every task, and most rows of them
CLASS_BYTES = 32 << 20
CLASS_ROWS = 20_000
# rows and bytes of vectors that a task holds of either side when two tables meet block by block
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
# similarities that a task holds at once
BLOCK_CELLS = 1 << 21
# bytes of partial sums that a task holds before it passes them on
SUM_BYTES = 32 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length Arrow lists as one matrix."""
    flat = pa.compute.list_flatten(column)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists, without a Python object for each number."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel(), pa.float64()))


def slices(rows: int, columns: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose similarities with so many columns a task may hold at once."""
    step = max(1, BLOCK_CELLS // max(1, columns))
    return ((low, min(rows, low + step)) for low in range(0, rows, step))


def _summed(rows: DataFrame, schema: str) -> DataFrame:
    """(by, members, sum) with one row per class and task, from rows (by, members, sum).

    A task with more classes than fit passes some on early, but never the one it read last: where
    equal classes follow each other, each gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def out() -> pa.RecordBatch:
            counts, sums = zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), kind), pa.array(counts, pa.int64()), _lists(np.stack(sums))], ["by", "members", "sum"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            sums = np.add.reduceat(matrix(batch.column(2))[order], starts, axis=0)
            counts = np.add.reduceat(batch.column(1).to_numpy()[order], starts)
            for name, count, total in zip(coded.dictionary.to_pylist(), counts.tolist(), sums, strict=True):
                if name in held:
                    held[name] = (held[name][0] + count, held[name][1] + total)
                else:
                    held[name] = (count, total)
                    size += total.nbytes
            if size > SUM_BYTES:
                last = batch.column(0)[batch.num_rows - 1].as_py()
                kept = held.pop(last)
                if held:
                    yield out()
                held, size = {last: kept}, kept[1].nbytes
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def centroids(rows: DataFrame, by: str, vector: str, dim: int, mean: bool = False) -> DataFrame:
    """(by, centroid, members): normalised sum (or mean) of the members' vectors of ``dim`` components.

    Each task adds its vectors up as matrices, class by class; what is shuffled is one partial sum
    per class and task, so a large class arrives as at most one row from each task.
    """
    kind = dict(rows.dtypes)[by]
    schema = f"by {kind}, members bigint, sum array<double>"
    first = rows.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(by).alias("by"), F.lit(1).cast("bigint").alias("members"), F.col(vector).cast("array<double>").alias("sum")
    )
    partial = _summed(first.where(F.size("sum") == dim), schema)
    totals = _summed(partial.repartition("by").sortWithinPartitions("by"), schema)
    scale = F.col("members").cast("double") if mean else F.lit(1.0)
    parts = totals.select(F.col("by").alias(by), "members", F.transform("sum", lambda x: x / scale).alias("_sum"))
    return parts.withColumn("_n", norm(F.col("_sum")) + 1e-8).select(
        by, "members", F.transform("_sum", lambda x: x / F.col("_n")).alias("centroid")
    )


def similarity_to_own(rows: DataFrame, cents: DataFrame, by: str, vector: str) -> DataFrame:
    """Each member with its similarity to its own centroid; sort ascending for outliers."""
    return rows.join(cents.select(by, "centroid"), by).withColumn(
        "similarity", dot(F.col(vector), F.col("centroid"))
    ).drop("centroid")


Kernel = Callable[[pa.RecordBatch, np.ndarray, list], pa.RecordBatch]


def blocks_of(n: int, dim: int, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> int:
    """How many blocks ``n`` vectors are dealt out to, so that a block has few enough rows and bytes."""
    return max(1, -(-n // max(1, min(rows, size // (8 * max(1, dim))))))


def block_join(left: DataFrame, right: DataFrame, key: str, right_key: str, n_left: int, n_right: int, kernel: Callable, schema: str, triangle: bool = False) -> DataFrame:
    """``kernel(left table, right table)``, a batch or a table, for each of the ``n_left`` x ``n_right`` pairs of blocks.

    Rows are dealt out to blocks by hash, so neither a class nor a quality gathers in one. Each
    pair of blocks is a group of its own: a task holds two blocks, whatever the sizes of the sides.
    With ``triangle`` both sides are the same rows and each pair of blocks meets once.
    """

    def dealt(rows: DataFrame, by: str, own: str, n: int, other: str, others: int, low: bool) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
        first, last = F.lit(0), F.lit(others - 1)
        if triangle:
            first, last = (F.col(own), last) if low else (first, F.col(own))
        return rows.withColumn(other, F.explode(F.sequence(first, last)))

    a = dealt(left, key, "_lb", n_left, "_rb", n_right, True)
    # with names of its own, as both sides may be the same table
    b = dealt(right.toDF(*right.columns), right_key, "_rb", n_right, "_lb", n_left, False)
    target = to_arrow_schema(left.sparkSession.createDataFrame([], schema).schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return target.empty_table()
        found = kernel(x, y)
        return (found if isinstance(found, pa.Table) else pa.Table.from_batches([found])).cast(target)

    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInArrow(run, schema)


def _against_classes(
    items: DataFrame, classes: DataFrame, key: str, vector: str, extra: list[str], kernel: Kernel, schema: str, max_classes: int
) -> tuple[DataFrame, bool]:
    """Run ``kernel(batch, class matrix, class rows)`` for every item and class shard; whether there are several shards.

    The classes are worked out once. Up to ``CLASS_BYTES`` and ``max_classes`` rows of them go to every
    task; beyond that (always, with 0 rows) items and classes meet block by block.
    """
    table = cut(classes.select("class_id", F.col("class_vector").cast("array<double>"), *[c for c in classes.columns if c not in ("class_id", "class_vector")]))
    needed = items.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"), *extra)
    found = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("class_vector")).alias("dim")).first()
    count, dim = found["n"], found["dim"] or 1
    if count == 0:
        return items.sparkSession.createDataFrame([], schema), False
    if count <= max_classes and count * dim * 8 <= CLASS_BYTES:
        known = table.toPandas()
        cols = known.drop(columns="class_vector").to_dict("list")
        mat = np.stack([np.asarray(v, dtype=np.float64) for v in known["class_vector"]])

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield kernel(batch, mat, cols)

        return needed.mapInArrow(one_pass, schema), False

    def block(part: pa.Table, known: pa.Table) -> pa.RecordBatch:
        cols = {c: known[c].to_pylist() for c in known.column_names if c not in ("class_vector", "_lb", "_rb")}
        return kernel(part.combine_chunks().to_batches()[0], matrix(known["class_vector"]), cols)

    shards = blocks_of(count, dim, rows=min(max_classes or BLOCK_ROWS, BLOCK_ROWS))
    parts = blocks_of(needed.count(), dim)
    return block_join(needed, table, key, "class_id", parts, shards, block, schema), True


def nearest_class(
    items: DataFrame,
    classes: DataFrame,
    threshold: float,
    key: str = "id",
    vector: str = "embedding",
    forbidden: str | None = None,
    max_classes: int = CLASS_ROWS,
) -> DataFrame:
    """(key, class_id, similarity): most similar allowed class at or above ``threshold``.

    ``classes``: class_id, class_vector and, with ``forbidden``, ``named``. Items whose
    ``forbidden`` array is not empty may only match named classes that are not in it. Equal
    similarities go to the lowest class id.
    """

    def kernel(batch: pa.RecordBatch, mat: np.ndarray, cols: list) -> pa.RecordBatch:
        order = np.argsort(np.asarray(cols["class_id"], dtype=np.int64), kind="stable")
        ids = np.asarray(cols["class_id"], dtype=np.int64)[order]
        rows, known = matrix(batch.column("_v")), mat[order].T
        named = np.asarray(cols["named"], dtype=bool)[order] if forbidden else None
        best, score = np.empty(len(rows), np.int64), np.empty(len(rows))
        for low, high in slices(len(rows), len(ids)):
            sims = rows[low:high] @ known
            if forbidden:
                for i, banned in enumerate(batch.column(forbidden)[low:high].to_pylist()):
                    if banned:
                        sims[i, ~named | np.isin(ids, banned)] = -np.inf
            top = sims.argmax(axis=1)
            best[low:high], score[low:high] = top, sims[np.arange(high - low), top]
        keep = score >= threshold
        return pa.RecordBatch.from_arrays(
            [batch.column(key).filter(pa.array(keep)), pa.array(ids[best][keep]), pa.array(score[keep])],
            names=[key, "class_id", "similarity"],
        )

    cols = [forbidden] if forbidden else []
    found, several = _against_classes(
        items, classes, key, vector, cols, kernel, f"{key} bigint, class_id bigint, similarity double", max_classes
    )
    if not several:
        return found
    best = F.max_by("class_id", F.struct("similarity", -F.col("class_id")))
    return found.groupBy(key).agg(best.alias("class_id"), F.max("similarity").alias("similarity"))


def zero_shot_tags(
    items: DataFrame,
    classes: DataFrame,
    threshold: float,
    scale: float = 100.0,
    key: str = "media_id",
    vector: str = "vector",
    max_classes: int = CLASS_ROWS,
) -> DataFrame:
    """(key, tag, score): softmax over all classes, keeping non-background ones at ``threshold``.

    ``classes``: class_id, class_vector, tag, background. A class that does not reach the
    threshold within its own shard cannot reach it overall, so shards only pass on the few
    that might.
    """

    def kernel(batch: pa.RecordBatch, mat: np.ndarray, cols: list) -> pa.RecordBatch:
        logits = scale * (matrix(batch.column("_v")) @ mat.T)
        top = logits.max(axis=1)
        weight = np.exp(logits - top[:, None])
        total = weight.sum(axis=1)
        may = (weight / total[:, None] >= threshold) & ~np.asarray(cols["background"], dtype=bool)[None, :]
        tags = np.asarray(cols["tag"], dtype=object)
        found = [
            [{"tag": tags[j], "logit": float(logits[i, j])} for j in np.flatnonzero(may[i])] for i in range(len(logits))
        ]
        kind = pa.list_(pa.struct([("tag", pa.string()), ("logit", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(top), pa.array(total), pa.array(found, kind)],
            names=[key, "top", "total", "found"],
        )

    schema = f"{key} bigint, top double, total double, found array<struct<tag:string,logit:double>>"
    parts, several = _against_classes(items, classes, key, vector, [], kernel, schema, max_classes)
    if several:
        tops = parts.groupBy(key).agg(F.max("top").alias("_top"))
        parts = parts.join(tops, key)
        parts = parts.groupBy(key).agg(
            F.max("_top").alias("top"),
            F.sum(F.col("total") * F.exp(F.col("top") - F.col("_top"))).alias("total"),
            F.flatten(F.collect_list("found")).alias("found"),
        )
    return (
        parts.select(key, "top", "total", F.explode("found").alias("hit"))
        .select(key, F.col("hit.tag").alias("tag"), (F.exp(F.col("hit.logit") - F.col("top")) / F.col("total")).alias("p"))
        .where(F.col("p") >= threshold)
        .select(key, "tag", F.round("p", 3).alias("score"))
    )
