"""Best-fit packing of token pieces into sequences, certified by lower bounds and repacked where a bound isn't met.

Pieces are dealt to partitions of bounded size. Each is packed best-fit decreasing, and dual feasible functions bound
from below how few sequences its pieces need. A partition that meets its bound is optimal and stays. The others give
up the pieces of their sequences that aren't full; these are dealt anew, so that partitions exchange documents, and
packed again, while that saves sequences. At last the emptiest sequences of all partitions are packed together.
"""

from __future__ import annotations

import gc
import os
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import give_back, worker_kept, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, part long, bin long, offset long, load long, n_bins long, bound long"
#: Words whose ids a worker keeps in each of two generations: when the young one is full, it becomes the old one, whose
#: words come back when they are met. It bounds memory and doesn't change results.
CACHED_WORDS = 250_000
#: What may follow a letter run without changing how it is split (an apostrophe may).
TAIL = b'.,!%*&#$|:;?"()-'


def _lower(run: str) -> str:
    """Letters of the first scripts in lower case as the vocabulary's normaliser has them; empty where that isn't plain."""
    small = run.lower()
    return small if small.isalpha() and max(small) < "\u0530" and "Σ" not in run and is_normalized("NFC", small) else ""


class WordIds:
    """The ids of white-space separated words, lower-cased in ASCII, as little-endian unsigned 32-bit numbers.

    The vocabulary lower-cases texts and no token crosses white space, so a text's ids are its words' ids. A new word
    that is letters with punctuation behind it is two pre-tokens; letter runs are encoded together, a space apart.
    Added tokens are matched before lower-casing: a word that may hold one keeps its case and is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        # for runs of lower-case letters, which need no normalising and no splitting but at spaces
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        for token, k in vocab.items():
            self.last[k] = token.endswith("</w>")
        self.added = sorted({t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()})

    def ids(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()  # what follows makes many objects and no cycles
        try:
            words = [self.split((t or "").encode()) for t in texts]
            if len(self.known) > CACHED_WORDS:
                self.known, self.old = {}, self.known
            missing = set().union(*words).difference(self.known)
            if met := self.old.keys() & missing:  # intersection() would go through all of old
                self.known.update(zip(met, map(self.old.__getitem__, met), strict=True))
                missing -= met
            self.learn(missing)
            of = self.known.__getitem__
            return [b"".join(map(of, ws)) for ws in words]
        finally:
            gc.enable()

    def split(self, raw: bytes) -> list[bytes]:
        low = raw.lower()
        if not any(t in low for t in self.added):
            return low.split()
        return [w if any(t in w.lower() for t in self.added) else w.lower() for w in raw.split()]

    def learn(self, words: set[bytes]) -> None:
        known, runs, parts, whole = self.known, {}, [], []
        for w in words:
            run = w.rstrip(TAIL)
            letters = run.decode()
            if run.isalpha() or (letters := _lower(letters)):
                if len(run) < len(w):
                    parts.append((w, run, w[len(run) :]))
                if run not in known:
                    runs[run] = letters
            else:
                whole.append(w)
        ids = np.array(self.plain.encode_batch_fast([" ".join(runs.values())], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) == len(runs):
            data, at = ids.tobytes(), 0
            for run, to in zip(runs, ends, strict=True):
                known[run], at = data[at:to], to
            self.encode({tail for _, _, tail in parts if tail not in known})
            for w, run, tail in parts:
                known[w] = known[run] + known[tail]
        else:  # a letter run that this vocabulary's pattern splits
            whole = words
        self.encode(whole)

    def encode(self, words: Iterable[bytes]) -> None:
        words = list(words)
        for w, x in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = np.array(x.ids, "<u4").tobytes()


def word_ids(path: str) -> WordIds:
    return worker_kept((WordIds, path), lambda: WordIds(path))


def some(batch: pa.RecordBatch, most: int = 64, size: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most most rows and, but for a longer text, about size bytes of the second column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + most)
        yield batch.slice(at, to - at)
        at = to


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_ids(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for part in some(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), known.ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        to = min(total, start + capacity)
                        rows.append((doc_id, piece, start, to - start, crc32(ids[4 * start : 4 * to])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most capacity ids of every document: its tokenizer ids, then end_id. Only longer ones are cut."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, capacity, end_id), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, into the fullest bin that still has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # those that some bin has, ascending
    n = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, b, n = capacity, n, n + 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[k], offsets[k] = b, capacity - room
        if left := room - size:
            own = by_room.setdefault(left, [])
            if not own:
                insort(rooms, left)
            own.append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 64) -> int:
    """The largest bound of two families of dual feasible functions on how many bins these lengths need."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int(count @ size) // capacity)
    for k in range(1, most_k + 1):  # x if (k + 1) x is whole, else floor((k + 1) x) / k, for x = size / capacity
        whole = (k + 1) * size % capacity == 0
        best = max(best, -(-int(count @ np.where(whole, size * k, (k + 1) * size // capacity * capacity)) // (k * capacity)))
    below, mass = np.cumsum(count), np.cumsum(count * size)
    for low in range(1, capacity // 2 + 1):  # 1 above capacity - low, 0 below low, x between
        top = below[-1] - below[capacity - low]
        best = max(best, int(top) - int(-(mass[capacity - low] - mass[low - 1]) // capacity))
    return best


def _pack(capacity: int):
    def run(own: pa.Table) -> pa.Table:
        lengths = own.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n, load = int(bins.max()) + 1, np.bincount(bins, weights=lengths).astype(np.int64)
        made = {"bin": bins, "offset": offsets, "load": load[bins], "n_bins": np.full(len(bins), n), "bound": np.full(len(bins), lower_bound(lengths, capacity))}
        for name, values in made.items():
            own = own.append_column(name, pa.array(values, pa.int64()))
        return own

    return run


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.max("n_bins").alias("n")).agg(F.sum("n")).first()[0] or 0


def pack(pieces: DataFrame, capacity: int = 2048, each: int = 100_000) -> DataFrame:
    """pieces with sequence_id and offset, gapless from 0 in every sequence; pieces must be a written table.

    A full piece is a sequence by itself. each bounds what one task packs. Partitions with a gap exchange what isn't in
    full sequences until a round saves none.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]
    out = [pieces.where(F.col("length") >= capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    dealt = 0  # partitions so far: each has a number of its own

    def packed(rows: DataFrame) -> DataFrame:
        nonlocal dealt
        parts = max(1, -(-rows.count() // each))
        part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)) + F.lit(dealt)
        dealt += parts
        return written(rows.select(*names).withColumn("part", part).groupBy("part").applyInArrow(_pack(capacity), PACKED), "packed")

    def keep(rows: DataFrame) -> None:
        out.append(rows.select(*names, (F.col("part") * F.lit(1 << 28) + F.col("bin")).alias("sequence_id"), "offset"))

    now, open_ = packed(pieces.where(F.col("length") < capacity)), F.col("n_bins") > F.col("bound")
    pooled = F.col("load") < capacity
    while (parts := now.where(open_).agg(F.count_distinct("part")).first()[0]) > 1:
        pool = written(now.where(open_ & pooled), "pool")
        before = pool.agg(F.count_distinct("part", "bin")).first()[0]
        after = packed(pool)
        if _bins(after) >= before:
            break
        keep(now.where(~(open_ & pooled)))
        now = after
    # the emptiest sequence of each partition, which its bound may round up
    least = now.groupBy("part").agg(F.min("load").alias("least"))
    now = now.join(F.broadcast(least) if parts < 10_000 else least, "part")
    last = written(now.where((F.col("load") == F.col("least")) & (F.col("least") < capacity)), "last")
    before = last.agg(F.count_distinct("part", "bin")).first()[0]
    if before > 1:
        after = packed(last)
        if _bins(after) < before:
            keep(now.where(~((F.col("load") == F.col("least")) & (F.col("least") < capacity))))
            now = after
    keep(now)
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048, each: int = 100_000) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence.

    A document is its ids by the tokenizer file at path, then id 0; a null or empty text is that id alone. Rows with
    equal or null doc_id are documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    return pack(written(token_pieces(docs, path, capacity), "pieces"), capacity, each)
