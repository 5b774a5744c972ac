"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors at cosine c or more are at distance sqrt(2 - 2c) at most, so their projections onto a Gaussian direction
differ by a normal amount of that deviation. Vectors are sorted by a first projection; those in the window round a
vector are its partners so far, and a partner collides on a further projection if it is in the window there. The count
that a pair must reach is calibrated: a pair right at the threshold reaches it with the wanted recall. Pairs that can't
reach it any more are dropped after every few projections; those that do are verified by their exact cosine.

Windows alone leave a third of a large label to each vector. So large labels are dealt to cells first: some projections
are cut into steps, and vectors that share the steps of all of them are in a cell. There are several tables of cells, so
that a pair at the threshold shares a cell of one with the wanted recall; a pair counts in the first table where it does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import connected_components, parallelism, small_side, written
from tickspark.llm.simhash import _joined

#: Projections, deviations of the counting windows and of the first one, projections between two droppings.
PROJECTIONS, WIDE, WIDEST, TURN = 24, 2.0, 3.5, 4
STEP = 2_000_000
#: Steps of a cell's projections, in distances of a pair at the threshold; most projections of a cell.
CELL, MOST_CUTS = 5.0, 16
#: Cost of a copy of a vector in a table, in comparisons.
COPY = 500


def misses_allowed(recall: float, projections: int = PROJECTIONS, wide: float = WIDE) -> int:
    """The fewest misses that let a pair at the threshold pass with this recall."""
    p, total = erf(wide / sqrt(2)), 0.0
    for misses in range(projections + 1):
        total += comb(projections, misses) * (1 - p) ** misses * p ** (projections - misses)
        if total >= recall:
            return misses
    return projections


def shared_step(steps: float = CELL) -> float:
    """The chance that a pair at the threshold is in one step of a projection, a step being so many of its distances."""
    return erf(steps / sqrt(2)) - sqrt(2 / pi) / steps * (1 - exp(-steps * steps / 2))


def tables_needed(cuts: int, recall: float) -> int:
    """Tables of cells of that many projections so that a pair at the threshold shares a cell with this recall."""
    return ceil(log(1 - recall) / log(1 - shared_step() ** cuts)) if cuts else 1


def cuts_for(n: int, least: float, recall: float, block: int) -> int:
    """Projections of a cell for a label of n vectors, at least work: copies and comparisons with a random cell's vectors."""
    if n <= block:
        return 0
    # two unit vectors at random are in one step of width w with about this chance
    chance = min(1.0, CELL * sqrt(2 - 2 * least) / (2 * sqrt(pi)))
    return min(range(MOST_CUTS + 1), key=lambda k: tables_needed(k, recall) * (n * chance**k + COPY))


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, PROJECTIONS + 1))


@cache
def cell_directions(size: int, cuts: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, places of the steps) of all tables."""
    rng = np.random.default_rng([size, cuts])
    return rng.standard_normal((size, tables * cuts)), rng.random(tables * cuts)


def cells(unit: np.ndarray, cuts: int, recall: float, width: float) -> np.ndarray:
    """(vectors, tables): a number of the cell of each unit vector in each table."""
    tables = tables_needed(cuts, recall)
    if not cuts:
        return np.zeros((len(unit), 1), np.int64)
    to, shift = cell_directions(unit.shape[1], cuts, tables)
    # rounded, so that a vector's cells don't depend on the batch it is in
    steps = np.floor(np.round(unit @ to, 9) / width + shift).astype(np.int64).view(np.uint64).reshape(len(unit), tables, cuts)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(cuts):
        out = (out ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _placed(least: float, recall: float):
    width = CELL * sqrt(2 - 2 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cuts = pc.list_value_length(batch.column(1)).to_numpy(), batch.column(2).to_numpy()
            for size, k in {*zip(sizes.tolist(), cuts.tolist(), strict=True)}:
                own = batch.filter(pa.array((sizes == size) & (cuts == k)))
                v = _rows(own.column(1), size)
                found = cells(v / np.linalg.norm(v, axis=1, keepdims=True), k, recall, width)
                yield pa.record_batch([own.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], ["node", "cells"])

    return run


def _linked(least: float, recall: float):
    radius, allowed = sqrt(2 - 2 * least), misses_allowed(recall)
    width = CELL * radius

    def links(own: pa.Table) -> pa.RecordBatch:
        node, times, role = (own.column(n).to_numpy() for n in ("node", "times", "role"))
        table, cuts = own.column("nth")[0].as_py(), own.column("cuts")[0].as_py()
        size = len(own.column("vec")[0])
        v = _rows(own.column("vec").combine_chunks(), size)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        proj = (v / norm[:, None]) @ directions(size)
        order = np.argsort(proj[:, 0], kind="stable")
        node, times, role, v, norm, proj = (z[order] for z in (node, times, role, v, norm, proj))
        n = len(node)
        low = np.searchsorted(proj[:, 0], proj[:, 0] - WIDEST * radius)
        high = np.searchsorted(proj[:, 0], proj[:, 0] + WIDEST * radius, "right")
        found, label = np.zeros(n, np.int64), np.arange(n)
        queries = np.flatnonzero(role != 1)
        work, at = np.cumsum((high - low)[queries]), 0
        while at < len(queries):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + STEP, "right")))
            q = queries[at:to]
            todo = (high - low)[q]
            a = np.repeat(q, todo)
            b = np.repeat(low[q], todo) + np.arange(len(a)) - np.repeat(np.cumsum(todo) - todo, todo)
            keep = (a != b) & (role[b] != 0)
            a, b = a[keep], b[keep]
            missed = np.zeros(len(a), np.int8)
            for j in range(1, PROJECTIONS + 1):
                missed += np.abs(proj[a, j] - proj[b, j]) > WIDE * radius
                if j % TURN == 0:
                    keep = missed <= allowed
                    a, b, missed = a[keep], b[keep], missed[keep]
            for k in range(0, len(a), 100_000):
                x, y = a[k : k + 100_000], b[k : k + 100_000]
                near = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= least
                x, y = x[near], y[near]
                other = node[x] != node[y]  # blocks of one cell hold a vector twice
                x, y = x[other], y[other]
                if table and len(x):  # the pair counts in the first table where it shares a cell
                    own, at_own = np.unique(np.r_[x, y], return_inverse=True)
                    earlier = cells(v[own] / norm[own, None], cuts, recall, width)[:, :table]
                    new = ~(earlier[at_own[: len(x)]] == earlier[at_own[len(x) :]]).any(axis=1)
                    x, y = x[new], y[new]
                found += np.bincount(x, times[y], n).astype(np.int64)
                label = _joined(n, x, y, label)
            at = to
        got = np.flatnonzero((found > 0) | (label != np.arange(n)))
        return pa.record_batch([node[got], found[got], node[label[got]]], ["node", "links", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            one, two = (batch.column(k).to_numpy() for k in (0, 1))
            ends = [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist(), len(one)] if len(one) else [0]
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                part = batch.slice(start, end - start)
                if kept and any(kept[0].column(k)[0] != part.column(k)[0] for k in (0, 1)):
                    yield links(pa.Table.from_batches(kept))
                    kept = []
                kept.append(part)
        if kept:
            yield links(pa.Table.from_batches(kept))

    return run


def _cuts(n: Column, least: float, recall: float, block: int) -> Column:
    """cuts_for as an expression: it changes at a few sizes only."""
    out, last = F.lit(0), 0
    for size in (block + 1, *(block * 2**k // 4 for k in range(3, 160))):
        if (k := cuts_for(size, least, recall, block)) > last:
            out, last = F.when(n >= size, k).otherwise(out), k
    return out


def near_vectors(vectors: DataFrame, least: float = 0.98, recall: float = 0.999, block: int = 8000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Vectors link if their labels are equal, they have the same dimension and the cosine is least or more. Links to
    nothing: a null label, vec_id or vector, one of norm zero or with a null or non-finite component; its component is
    its vec_id. Equal vectors of a label are one class of so many, compared once; rows that share a vec_id share its
    links. An empty table gives an empty result; other columns are ignored.

    A label (of one dimension) of up to block vectors is one cell; a larger one has tables of cells whose number of
    projections grows with the logarithm of its size, so that work for a vector grows much slower than the label. Cells
    that hold more than block vectors are cut into blocks, and each pair of blocks is a task's, whose memory is bounded
    by two blocks. Links aren't listed: each task returns their number for a vector and one representative.
    """
    spark = vectors.sparkSession
    recall = 1 - (1 - recall) / 2  # half of what may be lost is for cells
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    keyed = rows.where("good").select(
        "vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding")
    ).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = written(
        keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("embedding").alias("vec")),
        "vectors",
    )
    dim = F.size("vec").alias("dim")
    of_label = classes.groupBy("label", dim).agg(F.count("*").alias("n"))
    of_label = of_label.select("label", "dim", _cuts(F.col("n"), least, recall, block).alias("cuts"))
    rated = classes.select("node", "label", dim, "times", "vec").join(small_side(written(of_label, "labels")), ["label", "dim"])
    rated = written(rated, "rated")
    found = rated.select("node", F.col("vec").cast("array<double>").alias("vec"), "cuts").mapInArrow(_placed(least, recall), "node long, cells array<long>")
    cell = written(found, "cells").select("node", F.posexplode("cells").alias("nth", "cell"))
    placed = rated.join(cell, "node")
    group = ["label", "dim", "nth", "cell"]
    sizes = rated.select("node", "label", "dim").join(cell, "node").groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(sizes.select(*group, F.ceil(F.col("n") / block).cast("int").alias("blocks")), group)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # role 0: compared with the others, 1: one of the others, 2: both
    spread = F.sequence(F.lit(0), F.col("blocks") - 1)
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role")))
    as_other = F.transform(spread, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("role")))
    as_home = F.transform(spread, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("role")))
    tasks = F.when(F.col("blocks") == 1, alone).otherwise(F.concat(as_other, as_home))
    task = [*group, "t.i", "t.j"]
    dealt = placed.withColumn("t", F.explode(tasks)).select(
        F.xxhash64(*task).alias("task"), F.xxhash64(F.lit(1), *task).alias("task2"), "node", "times", "nth", "cuts", F.col("t.role").alias("role"), "vec"
    )
    dealt = dealt.repartition(parallelism(spark), "task", "task2").sortWithinPartitions("task", "task2")
    found = written(dealt.mapInArrow(_linked(least, recall), "node long, links long, near long"), "links")
    roots = connected_components(found.where("node <> near"), "node", "near")
    of_class = (
        classes.select("h1", "h2", "node", "times")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(roots, "node", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    linked = keyed.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
