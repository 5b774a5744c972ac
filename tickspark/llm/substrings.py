"""Removal of every byte in a string of given length that also starts elsewhere in the corpus.

Every window of that length picks one g-gram in it, the leftmost of least hash, so equal windows pick equal grams. The
consecutive windows with one gram are a region; only regions whose gram also occurs in another one can hold a repeat,
and only their positions and digests are shuffled. Regions that occur as a whole elsewhere are repeats by their digests.
Of the others, one of each content is cut from its text and gathered by gram. There a suffix array's Burrows-Wheeler
permutation, held for steps of eight bytes, gives the common prefixes of neighbouring suffixes: breadth first, by
increasing length, intervals of suffixes that share a prefix are extended to the left, until the length is reached; what
is never separated shares that many bytes. A gram with more contents than a task compares has its windows dealt by the
gram's place in them, first to an eighth of the places, then to each place, until few contents are together.

Texts get a number and are dealt by it once, into a table whose parts meet the regions wanted of them: however many
levels there are, texts are shuffled once, and rows that repeat a doc_id and its text are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import parallelism, written
from tickspark.sources import store

GRAM, CUT, AT_ONCE = 64, 1 << 19, 1_000_000
POSITION = np.uint64((1 << 20) - 1)
#: A byte that no UTF-8 text has: a match can't run over it.
END = b"\xff"
#: Contents that one task compares at once; a gram (or a part of its windows) with more is dealt further.
FEW = 512
ROWS = "part long, c1 long, c2 long, row long, start long, windows int, gram int, times int, covered long"
FACTOR = 0x9E3779B97F4A7C15 | 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = CUT + 4096
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, FACTOR, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)]))
    return np.random.default_rng(17).integers(0, 1 << 64, 256, np.uint64), power, inverse


def regions(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, windows, gram's distance from the first window) of the regions of a text."""
    code, power, inverse = _tables()
    most = len(data) - length + 1  # windows
    if most <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int32, np.int32))
    whole, width, out = np.frombuffer(data, np.uint8), length - GRAM + 1, []
    for cut in range(0, most, CUT):
        own = whole[cut : min(cut + CUT, most) + length - 1]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(code[own] * power[: len(own)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * inverse[: len(own) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = h & ~POSITION
        low |= np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        windows = np.diff(np.r_[first, len(at)])
        gram = at[first]
        out.append((h[gram], first + cut, windows.astype(np.int32), (gram - first).astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _grams(length: int):
    """(part, n): the gram of each region with how many regions of a batch have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text is not None:
                    made.append(regions(text.encode(), length)[0])
                    held += len(made[-1])
                if text is None or held > 200_000:
                    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *made]), return_counts=True)
                    yield pa.record_batch([h.view(np.int64), n.astype(np.int64)], ["part", "n"])
                    made, held = [], 0

    return run


def _regions(length: int):
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = []
            held = 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                h, start, windows, gram = regions(data, length)
                if not len(h):
                    continue
                ends = start + windows + (length - 1)
                digest = xxhash.xxh3_128_digest
                c = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                # equal regions one after another, as a text of one repeated word has, are one row
                again = (h[1:] == h[:-1]) & (c[1:] == c[:-1]).all(axis=1) & (start[1:] == start[:-1] + windows[:-1])
                first = np.flatnonzero(np.r_[True, ~again])
                last = np.r_[first[1:], len(h)] - 1
                covered = start[last] + windows[last] - start[first]
                kept = [x[first] for x in (h.view(np.int64), c[:, 0], c[:, 1], np.full(len(h), row), start, windows, gram)]
                made.append([*kept, (last - first + 1).astype(np.int32), covered])
                held += len(first)
                if held > 50_000:
                    yield pa.record_batch([np.concatenate(x) for x in zip(*made, strict=True)], names)
                    made, held = [], 0
            if made:
                yield pa.record_batch([np.concatenate(x) for x in zip(*made, strict=True)], names)

    return run


def _finer(length: int, each: int):
    """Deals the windows of regions by the gram's place in them, each places together, to rows as those of _regions.

    The windows of such a part have more than the gram in common: all bytes that are in every window, which name the part.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.int64()]
    width = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, text, needs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                for need in needs:
                    gram = need["start"] + need["gram"]
                    least, most = need["gram"] - need["windows"] + 1, need["gram"]
                    for q in range(least // each, most // each + 1):
                        a, b = max(least, q * each), min(most, q * each + each - 1)  # the gram's distance from the windows
                        core = data[gram - q * each : gram - min(width, q * each + each) + 1 + length]
                        c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(data[gram - b : gram - a + length]), np.int64).tolist()
                        rows.append((xxhash.xxh64_intdigest(core, q) - (1 << 63), c1, c2, row, gram - b, b - a + 1, b, 1, b - a + 1))
                    if len(rows) > 20_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _cut(length: int):
    """Cuts regions from their texts."""
    names = ["part", "row", "start", "wanted", "content"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, text, needs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                for need in needs:
                    start = need["start"]
                    rows.append((need["part"], row, start, need["same"] == 1, data[start : start + need["windows"] - 1 + length]))
                    if len(rows) > 20_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first depth bytes or more, first eight bytes of every suffix as a number)."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : n + k]
    key, size = eight, 8
    while True:
        order = np.argsort(key)
        own = key[order]
        new = np.r_[False, own[1:] != own[:-1]]
        if size >= depth or new[1:].all():
            return order, eight
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        behind = np.zeros(n, np.int64)
        behind[: n - size] = rank[size:] + 1 if size < n else 0
        key, size = rank * (n + 1) + behind, 2 * size


def shared_prefixes(text: np.ndarray, length: int) -> np.ndarray:
    """Which positions start length bytes that also start at another position of text.

    Suffixes j - 1 and j in suffix order share d + 8 bytes if they share eight and the suffixes behind these share d:
    if no suffix between the two was separated from its neighbour at d. Each turn extends all intervals that are still
    whole by eight bytes to the left, so common prefixes come out by increasing length; those of length stop.
    """
    n = len(text)
    order, eight = suffix_array(text, length + 8)
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n)
    behind = place[np.minimum(order + 8, n - 1)]
    first = eight[order]
    left = length % 8
    apart = np.r_[True, np.zeros(n - 1, bool)]
    if left:
        apart[1:] = first[1:] >> np.uint64(64 - 8 * left) != first[:-1] >> np.uint64(64 - 8 * left)
    same = np.r_[False, first[1:] == first[:-1]]
    open_ = np.flatnonzero(~apart)
    for _ in range(length // 8):
        count, open_ = np.cumsum(apart), open_[same[open_]]
        a, b = behind[open_ - 1], behind[open_]
        still = count[np.maximum(a, b)] == count[np.minimum(a, b)]
        open_ = open_[still]
        apart = np.ones(n, bool)
        apart[open_] = False
    out = np.zeros(n, bool)
    out[order[open_]] = True
    out[order[open_ - 1]] = True
    return out


def _expanded(length: int):
    names = ["row", "a", "b"]

    def repeats(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(END.join(r[3] for r in rows) + END, np.uint8)
        starts = shared_prefixes(text, length)
        out, at = [], 0
        for row, start, wanted, content in rows:
            if wanted:
                found = np.flatnonzero(starts[at : at + len(content) - length + 1])
                if len(found):
                    first = np.r_[True, np.diff(found) > 1]
                    a, b = found[first], found[np.r_[first[1:], True]]
                    out += [(row, start + x, start + y + length) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            at += len(content) + 1
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > AT_ONCE and part != last:
                    yield repeats(rows)
                    rows, held = [], 0
                rows.append(tuple(row))
                held, last = held + len(row[3]), part
        if rows:
            yield repeats(rows)

    return run


def _kept():
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, kept, removed, runs, at = (text or "").encode(), hashlib.sha256(), 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if a > end:
                        kept.update(data[at:a])
                        runs, removed, end, at = runs + 1, removed + b - a, b, b
                    elif b > end:
                        removed, end, at = removed + b - end, b, b
                kept.update(data[at:])
                rows.append((len(data), removed, runs, kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names)

    return run


def _settled(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of the rows whose content others have too, one row of each content whose part has others).

    Counts are aggregated before they are shuffled and joined back, so that no task has all rows of a part.
    """
    first = F.min(F.struct("row", "start", "windows", "gram")).alias("first")
    contents = written(rows.groupBy("part", "c1", "c2").agg(F.sum("times").alias("same"), first), "contents")
    several = contents.groupBy("part").agg(F.count("*").alias("contents")).where("contents > 1")
    open_ = written(contents.join(several, "part").select("part", "first.*", "same", "contents"), "open")
    whole = rows.join(contents.where("same > 1").select("part", "c1", "c2"), ["part", "c1", "c2"])
    whole = whole.select("row", F.col("start").alias("a"), (F.col("start") + F.col("covered") + (length - 1)).alias("b"))
    return whole, open_


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """(row, a, b): bytes a to b of a row's text, end exclusive, are in repeated strings; spans may overlap.

    texts(row, text) is a table that is dealt by row, which no two rows share, in as many parts as a shuffle has.
    """
    spark = texts.sparkSession
    texts = texts.select("row", F.coalesce("text", F.lit("")).alias("text"))
    grams = texts.select("text").mapInArrow(_grams(length), "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).where("n > 1")
    grams = written(grams.select("part"), "grams")
    rows = written(texts.mapInArrow(_regions(length), ROWS).join(grams, "part"), "regions")

    def with_texts(open_: DataFrame) -> DataFrame:
        need = F.struct("part", "start", "windows", "gram", "same")
        needs = open_.groupBy("row").agg(F.collect_list(need).alias("needs"))
        return texts.join(needs.hint("shuffle_hash"), "row").select("row", "text", "needs")

    whole, open_ = _settled(rows, length)
    spans, compared, places = [whole], [open_.where(F.col("contents") <= FEW)], length - GRAM + 1
    for each in (-(-places // 8), 1):
        many = open_.where(F.col("contents") > FEW)
        if many.isEmpty():
            break
        whole, open_ = _settled(written(with_texts(many).mapInArrow(_finer(length, each), ROWS), "regions"), length)
        spans.append(whole)
        compared.append(open_.where(F.col("contents") <= FEW) if each > 1 else open_)
    need = compared[0]
    for more in compared[1:]:
        need = need.unionByName(more)
    cut = with_texts(need).mapInArrow(_cut(length), "part long, row long, start long, wanted boolean, content binary")
    cut = cut.repartition(parallelism(spark), "part").sortWithinPartitions("part")
    out = cut.mapInArrow(_expanded(length), "row long, a long, b long")
    for whole in spans:
        out = out.unionByName(whole)
    return out


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text).

    Bytes in a length-byte string that also starts elsewhere, in the same text or another, are removed; all strings are
    judged on the input, so a repeated text loses all of its bytes if it is long enough. A null text counts as empty. A
    null doc_id stays null; rows with equal doc_id are texts of their own. An empty table gives an empty result; other
    columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    texts = store.written_dealt(rows, "texts", "row", parallelism(docs.sparkSession))
    spans = repeated_spans(texts, length).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = texts.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_kept(), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
