"""Leader clustering: a lexicographic-first independent set of a similarity graph, then nearest leaders.

A seed leads if no better seed that leads is similar to it. The seeds are ranked once, best first,
and taken in prefixes that double in length. Within a prefix the seeds that are still open are
compared block against block, which gives the links between them; rounds of equi joins over the
links decide who leads. The leaders of a prefix then close all seeds behind it that are similar to
one of them, so that a cluster that holds a third of all rows is closed by its first few leaders
and never compared with itself as a whole. No vector passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_index
from tidemark.operators.vectors import BLOCK_BYTES, BLOCK_ROWS, block_join, blocks_of, matrix, slices
from tidemark.session import cut

# links that are few enough to be followed one after the other in one task
FEW_LINKS = 200_000


def similar_pairs(rows: DataFrame, link: float, blocks: int) -> DataFrame:
    """(better, worse): places ``at`` of all rows whose vectors ``_v`` have a similarity of ``link``."""

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        left, right = x["at"].to_numpy(), y["at"].to_numpy()
        a, b = matrix(x["_v"]), matrix(y["_v"])
        same = x["_lb"][0].as_py() == y["_rb"][0].as_py()
        found = []
        for low, high in slices(len(a), len(b)):
            i, j = np.nonzero(a[low:high] @ b.T >= link)
            i, j = left[low + i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            # a batch for each slice: the pairs of all are not put together once more
            found.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["better", "worse"]))
        return pa.Table.from_batches(found)

    return block_join(rows, rows, "at", "at", blocks, blocks, kernel, "better bigint, worse bigint", triangle=True)


def _follow(links: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a few links that are out: linked with a better one that is not."""
    out: set[int] = set()
    for better, worse in links.sort_values(["worse", "better"])[["better", "worse"]].itertuples(index=False):
        # all links of the better node come before those of the worse
        if better not in out:
            out.add(worse)
    return pd.DataFrame({"at": sorted(out)}, dtype=np.int64)


def first_independent(nodes: DataFrame, links: DataFrame, few: int = FEW_LINKS) -> tuple[DataFrame, int]:
    """Nodes ``at`` that no better node of the set is linked to (``links``: better, worse), and the number of rounds.

    In a round every open node without an open better neighbour joins the set, and its neighbours
    are out. Nodes in no order of their own need rounds like the logarithm of their number; a chain
    in which each node is linked to the next needs one for each two nodes. Therefore, as soon as at most
    ``few`` links are left, one task follows them in order.
    """
    links, chosen, rounds = cut(links.select("better", "worse").distinct()), [], 0
    nodes = cut(nodes.select("at"))
    while True:
        left = links.limit(few + 1).count()
        if left <= few:
            out = links.groupBy(F.lit(0).alias("_all")).applyInPandas(_follow, "at bigint") if left else links.select(F.col("worse").alias("at"))
            chosen.append(cut(nodes.join(out, "at", "left_anti")))
            break
        rounds += 1
        first = cut(nodes.join(links.select(F.col("worse").alias("at")).distinct(), "at", "left_anti"))
        chosen.append(first)
        out = links.join(first, links["better"] == first["at"], "left_semi").select(F.col("worse").alias("at")).distinct()
        settled = cut(first.unionByName(out))
        nodes = cut(nodes.join(settled, "at", "left_anti"))
        for end in ("better", "worse"):
            links = links.join(settled.withColumnRenamed("at", end), end, "left_anti")
        links = cut(links)
    members = chosen[0]
    for more in chosen[1:]:
        members = members.unionByName(more)
    return members, rounds


def _similar_to(rows: DataFrame, leaders: DataFrame, link: float, blocks: tuple[int, int], best: bool = False) -> DataFrame:
    """(at) of the rows with a similarity of ``link`` to a leader; with ``best`` also (similarity, leader) per block of leaders."""

    def kernel(x: pa.Table, y: pa.Table) -> pa.RecordBatch:
        a, b = matrix(x["_v"]), matrix(y["_v"])
        names = y["id"].to_numpy()
        order = np.argsort(names, kind="stable")
        b, names = b[order], names[order]
        score, who = np.empty(len(a)), np.empty(len(a), np.int64)
        for low, high in slices(len(a), len(b)):
            sims = a[low:high] @ b.T
            top = sims.argmax(axis=1)
            score[low:high], who[low:high] = sims[np.arange(high - low), top], names[top]
        keep = score >= link
        columns = [pa.array(x["at"].to_numpy()[keep])]
        if best:
            columns += [pa.array(score[keep]), pa.array(who[keep])]
        return pa.RecordBatch.from_arrays(columns, ["at", "similarity", "leader"][: len(columns)])

    schema = "at bigint, similarity double, leader bigint" if best else "at bigint"
    return block_join(rows, leaders, "at", "at", *blocks, kernel, schema)


def leader_clusters(
    seeds: DataFrame,
    link: float,
    key: str = "id",
    vector: str = "embedding",
    quality: str = "quality",
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
    few: int = FEW_LINKS,
) -> DataFrame:
    """(key, cluster): clusters of the seeds that have a vector, named after their leaders.

    One rule at every size: a seed leads if no better seed that leads has a similarity of ``link``
    with it (better: quality, then the lower key); every other seed joins its most similar leader
    (the lowest key among equals). Sizes of blocks and partitions do not change the result.

    The comparisons are those of the sequential rule: open seeds with leaders, and open seeds of a
    prefix among themselves. Prefixes double, so there are as many as the logarithm of the rows.
    """
    rows = dense_index(
        seeds.where(F.col(vector).isNotNull()).select(
            F.col(key).alias("id"), F.coalesce(F.col(quality).cast("double"), F.lit(0.0)).alias("quality"), F.col(vector).cast("array<double>").alias("_v")
        ),
        [F.col("quality").desc(), F.col("id")],
        "at",
    )
    rows = cut(rows.select("at", "id", "_v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
    if not size["n"]:
        return rows.select(F.col("id").alias(key), F.col("id").alias("cluster"))

    def blocks(n: int) -> int:
        return blocks_of(n, size["dim"], block_rows, block_bytes)

    still_open, n_open, leaders = rows, size["n"], None
    upto = max(1, min(block_rows, block_bytes // (8 * max(1, size["dim"]))))
    while True:
        prefix = cut(still_open.where(F.col("at") < upto))
        pairs = similar_pairs(prefix, link, blocks(prefix.count()))
        found, _ = first_independent(prefix, pairs, few)
        new = cut(prefix.join(found, "at"))
        leaders = new if leaders is None else leaders.unionByName(new)
        if upto >= size["n"]:
            break
        behind = still_open.where(F.col("at") >= upto)
        closed = _similar_to(behind, new, link, (blocks(n_open), blocks(new.count()))).distinct()
        still_open = cut(behind.join(closed, "at", "left_anti"))
        n_open = still_open.count()
        if not n_open:
            break
        upto *= 2
    leaders = cut(leaders)
    # a leader is most similar to itself, whatever the length of its vector
    others = rows.join(leaders.select("at"), "at", "left_anti")
    near = _similar_to(others, leaders, link - 1e-9, (blocks(size["n"]), blocks(leaders.count())), best=True)
    best = near.groupBy("at").agg(F.max(F.struct("similarity", (-F.col("leader")).alias("last"))).alias("best"))
    joined = others.join(best, "at").select("id", (-F.col("best.last")).alias("cluster"))
    return joined.unionByName(leaders.select("id", F.col("id").alias("cluster"))).withColumnRenamed("id", key)
