"""SimHash near-duplicates, found by a generalised pigeonhole search over fingerprints.

A fingerprint has 64 bits. Bits are grouped into partitions, correlated bits together, and partition i gets its own
threshold t_i with sum(t_i) = radius - partitions + 1 (t_i = -1: not probed). Two fingerprints within the radius then
agree up to t_i bits in some partition i, so probing each partition within its threshold loses no pair. Thresholds and
the number of partitions come from a dynamic program over estimated costs of probes and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import connected_components, free_name, parallelism, slices, small_side, tidy, written

BITS = 64
CHUNK = 1 << 16
#: Cost of one probe row in comparisons; of one in two bands, which compare few of the pairs, with a sketch.
ROW_COST, BANDED_ROW_COST = 100.0, 10_000.0


def simhash(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text: bit j is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = simhash(text, width)
                out.append(known[text])
            yield pa.record_batch([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty, whose fingerprint is 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.indices((BITS, BITS), np.int32)
    yield pa.record_batch([i.ravel(), j.ravel(), total.ravel()], ["i", "j", "n"])


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them: 4096 sums, whatever the input."""
    rows = fps.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for r in rows.collect():
        out[r.i, r.j] = r.n
    return out


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Greedily fills partitions of nearly equal width with the bits that correlate most with those already in it."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: corr[b, own].sum()))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def near_chance(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0..most of the bits with these frequencies."""
    dist = np.array([1.0])
    for d in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - d, d])
    return np.cumsum(dist)[: most + 1]


def sampled_chance(sample: np.ndarray, own: list[int], most: int, step: int = 256) -> np.ndarray:
    """Share of the pairs of sampled fingerprints that differ in at most 0..most of the bits own, which may correlate."""
    mask, counts, n = np.uint64(sum(1 << b for b in own)), np.zeros(BITS + 1, np.int64), len(sample)
    part = sample & mask
    for at in range(0, n, step):
        differ = np.bitwise_count(part[at : at + step, None] ^ part[None, :])
        later = np.arange(n)[None, :] > np.arange(at, min(n, at + step))[:, None]
        counts += np.bincount(differ[later], minlength=BITS + 1)
    return (np.cumsum(counts) / max(1, n * (n - 1) // 2))[: most + 1]


def allocation(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with the given sum; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, start=-1):
                if s + t not in new or c + extra < new[s + t][0]:
                    new[s + t] = (c + extra, [*ts, t])
        best = new
    return best[total]


def plan_probes(together: np.ndarray, n: int, radius: int, row_cost: float = ROW_COST, sample: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """(bit masks, thresholds) of least estimated cost over all partition counts from 2 to radius + 1.

    How many pairs a probe meets is estimated from pairs of a sample, which sees the correlation within a partition; and
    from the bits' frequencies as if they were independent, where the sample is too small to have such pairs. The plan
    decides the cost only: any plan finds all pairs.
    """
    n = max(n, 1)
    p, best = together.diagonal() / n, None
    for parts in range(2, radius + 2):
        groups = grouped_bits(together, n, parts)
        costs = []
        for own in groups:
            chance, row = near_chance(p[own], radius), [0.0]
            if sample is not None:
                chance = np.maximum(chance, sampled_chance(sample, own, radius))
            for t in range(radius - parts + 2):
                variants = sum(comb(len(own), d) for d in range(t + 1))
                row.append(n * row_cost * variants + n * n / (2 if t == 0 else 1) * chance[t])
            costs.append(row)
        cost, ts = allocation(costs, radius - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, [sum(1 << b for b in own) for own in groups], ts)
    return best[1], best[2]


def _probes(masks: list[int], thresholds: list[int]):
    plan = []
    for i, (mask, most) in enumerate(zip(masks, thresholds, strict=True)):
        own = [b for b in range(BITS) if mask >> b & 1]
        flips = [sum(1 << b for b in c) for d in range(most + 1) for c in combinations(own, d)]
        plan += [(i, mask, np.uint64(f)) for f in flips]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, mask, flip in plan:
                key = (fp & np.uint64(mask)) ^ flip
                yield pa.record_batch(
                    [np.full(len(fp), i, np.int32), key.view(np.int64), np.full(len(fp), bool(flip)), fp.view(np.int64)],
                    ["part", "key", "guest", "fp"],
                )

    return run


def _joined(size: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of size vertices with these links, and those of label."""
    label = np.arange(size) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(jump := label[label], label):
            label = jump
    return label


def _pairs(group: np.ndarray, guest: np.ndarray, fp: np.ndarray, radius: int, step: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of rows of a group within radius, of which a is at home; rows are sorted by group, then guest.

    Small groups are compared together, large ones as blocks of a matrix, about step comparisons at a time.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    homes = np.add.reduceat(~guest, starts)
    for k in np.flatnonzero((sizes > 100) & (homes > 0)):
        start, end = int(starts[k]), int(starts[k] + sizes[k])
        each = max(1, step // int(sizes[k]))
        for at in range(start, start + int(homes[k]), each):
            to = min(at + each, start + int(homes[k]))
            x, y = np.nonzero(np.bitwise_count(fp[at:to, None] ^ fp[None, at:end]) <= radius)
            keep = y > x
            yield x[keep] + at, y[keep] + at
    ends = np.repeat(starts + sizes, sizes)
    home = np.flatnonzero(~guest & (np.repeat(sizes, sizes) <= 100))
    home = home[ends[home] - home > 1]
    work, at = np.cumsum(ends[home] - home - 1), 0
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + step, "right")))
        own, todo = home[at:to], ends[home[at:to]] - home[at:to] - 1
        a = np.repeat(own, todo)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(todo) - todo, todo)
        hit = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        yield a[hit], b[hit]
        at = to


def _near(group: np.ndarray, guest: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Labels of rows: linked rows of a group share the smallest index."""
    label = np.arange(len(fp))
    for a, b in _pairs(group, guest, fp, radius):
        label = _joined(len(fp), a, b, label)
    return label


def _by_group(links, columns: int):
    """Gives links(part, key, ...) whole groups of rows that are sorted by part and key, many small ones at once."""

    def arrays(kept: list[pa.RecordBatch]) -> list[np.ndarray]:
        return [c.to_numpy() for c in pa.Table.from_batches(kept).columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = kept[0]
            if (part[-1], key[-1]) == (first.column(0)[0].as_py(), first.column(1)[0].as_py()):
                continue  # one group so far
            cols = arrays(kept)
            whole = int(np.flatnonzero((cols[0] == part[-1]) & (cols[1] == key[-1]))[0])
            yield links(*(c[:whole] for c in cols[:columns]))
            kept = [pa.Table.from_batches(kept).slice(whole).combine_chunks().to_batches()[0]]
        if kept:
            yield links(*arrays(kept)[:columns])

    return run


def _groups(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])


def _links(radius: int):
    def links(part: np.ndarray, key: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = _near(_groups(part, key), guest, fp.view(np.uint64), radius)
        far = np.flatnonzero(fp[label] != fp)
        return pa.record_batch([fp[far], fp[label[far]]], ["a", "b"])

    return _by_group(links, 4)


#: Fingerprints whose pairs estimate how many a probe meets.
PAIRED = 1024


def probe_plan(fps: DataFrame, n: int, radius: int, row_cost: float = ROW_COST) -> tuple[list[int], list[int]]:
    """plan_probes for n rows fps(fp): frequencies and correlations of all of them, pairs of PAIRED in hash order."""
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) * F.lit(n / (1 << 40))
    some = fps.where(share < 4 * PAIRED).select("fp").orderBy(F.xxhash64("fp")).limit(PAIRED).collect()
    return plan_probes(co_occurrence(fps), n, radius, row_cost, np.array([r.fp for r in some], np.int64).view(np.uint64))


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints fps(fp) such that the links' components are those of all pairs within radius.

    Each bucket gives at most one row per member, so a large group of near copies doesn't become all of its pairs.
    """
    n = fps.count()
    masks, thresholds = probe_plan(fps, n, radius)
    probes = fps.select("fp").mapInArrow(_probes(masks, thresholds), "part int, key long, guest boolean, fp long")
    probes = probes.repartition(parallelism(fps.sparkSession), "part", "key")
    return probes.sortWithinPartitions("part", "key", "guest").mapInArrow(_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text).

    Lower-cases A-Z, splits at ASCII white space and hashes width-word shingles (a shorter text: all its words; none:
    fingerprint 0, linked like any other; null: as empty). Fingerprints link at radius or fewer differing bits;
    component_id is the smallest doc_id reachable. Rows with equal texts share a fingerprint and so a component; a row
    with null doc_id keeps its row and takes its component's smallest doc_id (null if there is none). An empty table
    gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, width), "simhash")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = connected_components(near_links(groups, radius))
    labelled = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = labelled.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# near duplicates by shingles, for which fingerprints and rare shingles give candidates

#: Bins of a node's sketch; contents of fewer shingles than SMALL are judged by a bound that loses no pair.
BINS, SMALL = 32, 24
#: Nodes in which frequent shingles are counted, and how many of them are known; both only decide an order.
SAMPLE, FREQUENT = 8_000, 30_000
#: Nodes and shingles of a block that is compared in one task.
BLOCK, BLOCK_SHINGLES = 256, 60_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles (a shorter text: all its words), in order; none of a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    shingles = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64, n))


def described(text: str | None, width: int) -> tuple[int, int, bytes]:
    """(fingerprint, distinct shingles, sketch) of the set of shingles, however often each of them comes.

    The sketch has a byte of the least hash of each bin, 0 where it has none.
    """
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0, 0, bytes(BINS)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    least = np.full(BINS, (1 << 64) - 1, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(BINS - 1)).astype(np.int64), hashes)
    marks = np.where(least == (1 << 64) - 1, 0, (least >> np.uint64(5)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little"), n, marks.tobytes()


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, tuple[int, int, bytes]] = {}
            rows = [known[t] if t in known else known.setdefault(t, described(t, width)) for part in slices(batch) for t in part.column(3).to_pylist()]
            fp, n, marks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(marks, pa.binary())],
                ["doc_id", "h1", "h2", "fp", "n", "marks"],
            )

    return run


def _banded_probes(masks: list[int], thresholds: list[int], similarity: float):
    """Probes of _probes in bands of shingle counts: as similar contents are in one band or neighbouring ones."""
    probes = _probes(masks, thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, n, marks = batch.columns
            band = np.floor(np.log(np.maximum(n.to_numpy(), 1)) / -np.log(similarity) + 1e-9).astype(np.int32)
            for probe in probes([pa.record_batch([fp], ["fp"])]):
                part, key, guest, _ = probe.columns
                for more in (0, 1):
                    at = pa.array(part.to_numpy() * 1000 + band + more, pa.int32())
                    yield pa.record_batch([at, key, guest if not more else pa.array(np.ones(len(fp), bool)), fp, node, n, marks], ["part", "key", "guest", "fp", "node", "n", "marks"])

    return run


def _hashes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t, width) for part in slices(batch) for t in part.column(0).to_pylist()]
            yield pa.record_batch([np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)], ["key"])

    return run


def rare_shingles(hashes: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles one of which any set of that similarity has among its own: the first ones in an order that all share.

    Rare ones come first. At least similarity * n of n shingles are in both sets, so that the first n minus that many,
    and one more, hold the first common one.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    weight = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        weight = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _rare(width: int, similarity: float, frequent: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = (batch.column(1)[k].as_py() for k in first.tolist())
            own = [rare_shingles(shingle_hashes(t, width), similarity, frequent, counts) for t in texts]
            node = np.repeat(nodes, [len(x) for x in own])
            yield pa.record_batch([np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64), node], ["key", "node"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) that are sorted, each of those once whose key another node has too."""
    last = None
    for batch in batches:
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key, node = (c.to_numpy() for c in batch.columns)
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        batch, key = batch.filter(pa.array(once)), key[once]
        same = key[1:] == key[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        first = int(np.searchsorted(key, key[-1]))
        yield batch.slice(0, first).filter(pa.array(keep[:first]))
        last = batch.slice(first)
    if last is not None and last.num_rows > 1:
        yield last


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows may have that similarity by their sizes and sketches."""
    out = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
    at = np.flatnonzero(out)
    for k in range(0, len(at), 200_000):
        own = at[k : k + 200_000]
        p, q = sketch[x[own]], sketch[y[own]]
        differ, either = (p != q).sum(axis=1), ((p > 0) | (q > 0)).sum(axis=1)
        # a shingle that only one set has changes one bin at most
        few = differ <= (n[x[own]] + n[y[own]]) * (1 - similarity) / (1 + similarity) + 1e-9
        out[own] = np.where(np.minimum(n[x[own]], n[y[own]]) < SMALL, few, either - differ >= (similarity - 0.3) * either)
    return out


def _hanging(group: np.ndarray, guest: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Labels of rows: all candidate pairs of a group have one label, directly or over others.

    In large groups a row is compared to those that aren't reached yet, so a group of copies isn't all of its pairs.
    """
    label = np.arange(len(fp))
    sizes = np.bincount(group - group[0])[group - group[0]] if len(group) else group
    small = np.flatnonzero(sizes <= 100)
    for a, b in _pairs(group[small], guest[small], fp[small], radius) if len(small) else ():
        a, b = small[a], small[b]
        keep = _alike(a, b, n, sketch, similarity)
        label = _joined(len(fp), a[keep], b[keep], label)
    large = np.flatnonzero(sizes > 100)
    for left in np.split(large, np.flatnonzero(np.diff(group[large])) + 1) if len(large) else ():
        while len(left):
            first, left = left[0], left[1:]
            todo = [first]
            while todo and len(left):
                x = todo.pop()
                hit = np.bitwise_count(fp[left] ^ fp[x]) <= radius
                at = np.flatnonzero(hit)
                hit[at] = _alike(np.full(len(at), x), left[at], n, sketch, similarity)
                label[left[hit]] = first
                todo += left[hit].tolist()
                left = left[~hit]
    return label


def _candidates(radius: int, similarity: float):
    def links(part, key, guest, fp, node, n, marks) -> pa.RecordBatch:
        sketch = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, BINS)
        label = _hanging(_groups(part, key), guest, fp.view(np.uint64), node, n, sketch, radius, similarity)
        least = node.copy()
        np.minimum.at(least, label, node)
        far = np.flatnonzero(least[label] != node)
        return pa.record_batch([node[far], least[label[far]]], ["a", "b"])

    return _by_group(links, 7)


def _shingle_set(text: str, width: int) -> set:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def _similar(a: set, b: set, similarity: float) -> bool:
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (both := len(a & b)) >= similarity * (len(a) + len(b) - both)


def _hub(root: np.ndarray, key: np.ndarray, node: np.ndarray, n: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """(a, b) of each member a of a cluster and its hub b, whose sketch has most of what most members' have."""
    sketch = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, BINS)
    hub = np.empty(len(node), np.int64)
    for own in np.split(np.arange(len(node)), np.flatnonzero(np.diff(root)) + 1):
        x = sketch[own]
        usual = np.array([np.bincount(x[:, k]).argmax() for k in range(BINS)])
        hub[own] = node[own[(x == usual).sum(axis=1).argmax()]]
    return pa.record_batch([node, hub], ["a", "b"])


def _against_hub(width: int, similarity: float):
    """Gives (a, b) those that are similar; rows are (a, b, text of a, text of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, set()
        for batch in batches:
            out = []
            for part in slices(batch):
                for a, b, text, other in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if last != b:
                        last, of = b, _shingle_set(other, width)
                    if _similar(_shingle_set(text, width), of, similarity):
                        out.append((a, b))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _cut(n: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of blocks of at most BLOCK rows and BLOCK_SHINGLES shingles, or one row."""
    out, start, total = [], 0, 0
    for k, size in enumerate(n.tolist()):
        if k > start and (k - start >= BLOCK or total + size > BLOCK_SHINGLES):
            out.append((start, k))
            start, total = k, 0
        total += size
    return [*out, (start, len(n))] if len(n) else out


def _dealt(similarity: float):
    """Pairs of blocks of each cluster that isn't settled: all rows that aren't with the hub meet all others of like size."""

    def links(root, key, node, n, joined) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64),) * 5]
        for own in np.split(np.arange(len(node)), np.flatnonzero(np.diff(root)) + 1):
            if joined[own].all():
                continue
            own = own[np.lexsort((node[own], n[own], ~joined[own]))]
            most = int(joined[own].sum())
            blocks = [own[a:b] for a, b in _cut(n[own[:most]])]
            hubs = len(blocks)
            blocks += [own[most + a : most + b] for a, b in _cut(n[own[most:]])]
            for j in range(hubs, len(blocks)):
                for i in range(j + 1):
                    x, y = n[blocks[i]], n[blocks[j]]
                    if min(x[-1], y[-1]) < similarity * max(x[0], y[0]):
                        continue
                    for side, rows in enumerate((blocks[i], blocks[j]) if i < j else (blocks[i],)):
                        found.append((root[rows], np.full(len(rows), j * (1 << 31) + i), np.full(len(rows), side), node[rows], joined[rows].astype(np.int64)))
        return pa.record_batch([np.concatenate(c) for c in zip(*found, strict=True)], ["root", "pair", "side", "node", "joined"])

    return _by_group(links, 5)


def _in_blocks(width: int, similarity: float):
    """Gives links whose components are those of all similar pairs in a pair of blocks; rows are sorted by root, pair, side."""

    def spanning(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [_shingle_set(r[4], width) for r in rows]
        two = any(r[2] for r in rows)
        up = list(range(len(rows)))

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        with_hub = [k for k, r in enumerate(rows) if r[5]]
        for k in with_hub:
            up[k] = with_hub[0]
        for y in range(len(rows)):
            for x in range(y):
                if (not two or rows[x][2] != rows[y][2]) and find(x) != find(y) and _similar(sets[x], sets[y], similarity):
                    up[find(y)] = find(x)
                    yield rows[x][3], rows[y][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in (r for part in slices(batch) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                if kept and kept[0][:2] != row[:2]:
                    out += spanning(kept)
                    kept = []
                kept.append(row)
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out = []
        out += spanning(kept)
        yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verified_links(clusters: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) whose components are those of all pairs of that similarity within clusters(node, root, n, marks).

    Every member is compared to its cluster's hub. Members that aren't similar to it then meet all others of their
    cluster in pairs of blocks, each a row in a task; members that hang together already aren't compared again.
    """
    spark = clusters.sparkSession
    rows = clusters.select("root", F.lit(0).cast("long").alias("key"), "node", "n", "marks")
    rows = rows.repartition(parallelism(spark), "root").sortWithinPartitions("root", "node")
    stars = written(rows.mapInArrow(tidy(_by_group(_hub, 5)), "a long, b long"), "stars")
    pairs = stars.where("a <> b").join(texts.select(F.col("node").alias("a"), "text"), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")
    first = written(pairs.mapInArrow(tidy(_against_hub(width, similarity)), "a long, b long"), "with-hub")
    settled = first.select(F.col("a").alias("node")).unionByName(stars.where("a = b").select(F.col("a").alias("node"))).withColumn("joined", F.lit(True))
    left = clusters.select("node", "root", "n").join(settled, "node", "left").select("root", F.lit(0).cast("long").alias("key"), "node", "n", F.coalesce("joined", F.lit(False)).alias("joined"))
    left = left.repartition(parallelism(spark), "root").sortWithinPartitions("root", "node")
    blocks = written(left.mapInArrow(tidy(_dealt(similarity)), "root long, pair long, side long, node long, joined long"), "blocks")
    meet = blocks.join(texts, "node").select("root", "pair", "side", "node", "text", "joined")
    meet = meet.repartition(parallelism(spark), "root", "pair").sortWithinPartitions("root", "pair", "side", "node")
    return first.unionByName(meet.mapInArrow(tidy(_in_blocks(width, similarity)), "a long, b long"))


def identity(text: Column) -> tuple[Column, Column]:
    """A text's identity: 128 bits of hashes."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _one_of_each(found: DataFrame, key: str) -> DataFrame:
    first = (F.first(c).alias(c) for c in ("fp", "n", "marks"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    return found.groupBy(key).agg(least, F.min("h2").alias("low"), F.max("h2").alias("high"), *first)


def _as_nodes(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows(h1, h2, ...) with node: h1, which is one text's but for those in clashes; these get another number."""
    if clashes is None:
        return rows.withColumn("node", F.col("h1"))
    told = rows.join(small_side(clashes), "h1", "left")
    return told.withColumn("node", F.when(F.col("clash"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("clash")


def _similar_components(docs: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """(doc_id, h1, h2, component_id, kept) of every row; kept: of the row's component, the first by doc_id (null last), then text."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    h1, h2 = identity(text)
    rows = docs.select(F.col("doc_id").cast("long"), h1.alias("h1"), h2.alias("h2"), text.alias("text"))
    found = written(rows.mapInArrow(tidy(_described(width)), "doc_id long, h1 long, h2 long, fp long, n long, marks binary"), "described")
    nodes, clashes = written(_one_of_each(found, "h1").withColumnRenamed("h1", "node"), "nodes"), None
    if not (two := nodes.where("low <> high").select(F.col("node").alias("h1"), F.lit(True).alias("clash"))).isEmpty():
        clashes = written(two, "clashes")
        nodes = written(_one_of_each(_as_nodes(found, clashes), "node"), "nodes")
    rows, found = _as_nodes(rows, clashes).select("doc_id", "node", "text"), _as_nodes(found, clashes)
    n = nodes.count()
    masks, thresholds = probe_plan(nodes, n, radius, BANDED_ROW_COST)
    schema = "part int, key long, guest boolean, fp long, node long, n long, marks binary"
    probes = nodes.select("node", "fp", "n", "marks").mapInArrow(tidy(_banded_probes(masks, thresholds, similarity)), schema)
    probes = probes.repartition(parallelism(spark), "part", "key").sortWithinPartitions("part", "key", "guest", "fp", "node")
    near = written(probes.mapInArrow(tidy(_candidates(radius, similarity)), "a long, b long").distinct(), "candidates")
    sample = rows.where(F.pmod("node", F.lit(max(1, n // SAMPLE))) == 0).select("text").mapInArrow(tidy(_hashes(width)), "key long")
    often = sample.groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    frequent, counts = often["key"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(frequent)
    rare = rows.select("node", "text").mapInArrow(tidy(_rare(width, similarity, frequent[order], counts[order])), "key long, node long")
    rare = rare.repartition(parallelism(spark), "key").sortWithinPartitions("key", "node").mapInArrow(tidy(_shared), "key long, node long")
    rare = written(rare, "rare").join(nodes.select("node", "fp", "n", "marks"), "node")
    rare = rare.select(F.lit(0).alias("part"), "key", F.lit(False).alias("guest"), "fp", "node", "n", "marks")
    rare = rare.repartition(parallelism(spark), "part", "key").sortWithinPartitions("part", "key", "node")
    more = written(rare.mapInArrow(tidy(_candidates(BITS, similarity)), "a long, b long").distinct(), "candidates")
    clusters = connected_components(near.unionByName(more)).join(nodes.select("node", F.col("least.doc_id").alias("doc_id"), "n", "marks"), "node")
    clusters = written(clusters, "clusters")
    one = F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.node") == F.col("e.node"))
    texts = rows.alias("d").join(small_side(clusters.select("node", "doc_id")).alias("e"), one).select("d.node", "d.text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    roots = connected_components(verified_links(clusters, texts, width, similarity))
    labelled = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = labelled.groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "node")).alias("first"))
    of_node = labelled.join(first, "root").select("node", "first.doc_id", F.col("first.node").alias("of")).withColumnRenamed("doc_id", "component_id")
    kept = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "h1", "h2", "node").join(of_node, "node").select("doc_id", "h1", "h2", "component_id", kept.alias("kept"))


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row: documents whose width-word shingle sets have that Jaccard similarity or more.

    Equal texts, by 128 bits of hashes, are one node. Nodes within radius bits of their fingerprints are candidates, and
    so are nodes that share one of their rarest shingles, which all nodes of that similarity do, whatever their
    fingerprints; sizes and a sketch drop those that are far off. A bucket gives one link for each node, and what hangs
    together by these links is a cluster, within which whole shingle sets decide. component_id is the smallest doc_id;
    null texts count as empty, and empty texts are alike. A null doc_id takes its component's smallest doc_id (null if
    there is none). An empty table gives an empty result.
    """
    return _similar_components(docs, width, similarity, radius).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One row of docs of each component: the first by doc_id (null last), then by its text's hash; all columns are kept.

    Rows are told apart by doc_id and text, so rows that share a doc_id with other texts are judged by themselves. Of
    rows that repeat both, one stays, whichever its other columns. An empty table gives an empty result.
    """
    judged = written(_similar_components(docs, width, similarity, radius), "judged")
    names = id_, h1, h2 = [free_name(docs, c) for c in ("id", "h1", "h2")]
    own = F.col("doc_id").cast("long"), *identity(F.coalesce("text", F.lit("")))
    rows = docs.withColumns(dict(zip(names, own, strict=True)))

    def same(d: DataFrame) -> Column:
        return rows[id_].eqNullSafe(d["doc_id"]) & (rows[h1] == d["h1"]) & (rows[h2] == d["h2"])

    lost = written(judged.where("NOT kept").select("doc_id", "h1", "h2").distinct(), "lost")
    out = rows.join(small_side(lost, 2_000_000), same(lost), "left_anti")
    more = written(judged.where("kept").groupBy("doc_id", "h1", "h2").count().where("count > 1").drop("count"), "repeated")
    if not more.isEmpty():
        own = rows.join(small_side(more), same(more), "left_semi").dropDuplicates(names)
        out = out.join(small_side(more), same(more), "left_anti").unionByName(own)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
