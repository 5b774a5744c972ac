"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps the hash of every shingle that is below a fixed fraction of the hash range, whatever the document's
size, so that sketches of very unequal documents can be merged and compared: these are the scaled_ figures. So that
short texts are told apart as well, the smallest hashes are kept in any case; near_ figures compare two sketches below
the bound up to which both are whole, which for texts of some hundred words and more is that fraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import parallelism, small_side, written

TOP = (1 << 64) - 1


@dataclass(frozen=True)
class Sketch:
    """n: distinct shingles; kept: ascending hashes; below: up to here every hash is kept; scaled: of these, those under the threshold."""

    n: int
    kept: np.ndarray
    below: int
    scaled: int

    def __str__(self) -> str:
        """n, the hashes under the threshold, and the spare ones that a short text keeps."""
        under, spare = (x.astype(">u8").tobytes().hex() for x in (self.kept[: self.scaled], self.kept[self.scaled :]))
        return f"{self.n:x}:{under}:{spare}"

    def under(self) -> np.ndarray:
        return self.kept[: self.scaled]


def sketch(text: str, width: int = 5, scale: int = 8, least: int = 32) -> Sketch:
    """The hashes under 2^64 / scale, and the least smallest, of the text's width-word shingles (fewer words: all as one)."""
    words = text.encode().lower().split()
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] * bool(words)
    found = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(0)), np.uint64))
    return _cut(found, len(found), (1 << 64) // scale, least)


def _cut(found: np.ndarray, n: int, limit: int, least: int) -> Sketch:
    scaled = int(np.searchsorted(found, np.uint64(limit)))
    kept = found[: max(scaled, min(least, len(found)))]
    return Sketch(n, kept, TOP if len(kept) == n else max(limit, int(kept[-1]) + 1), scaled)


def parsed(printed: str, scale: int = 8) -> Sketch:
    n, under, spare = printed.split(":")
    kept = np.frombuffer(bytes.fromhex(under + spare), ">u8").astype(np.uint64)
    return Sketch(int(n, 16), kept, TOP if len(kept) == int(n, 16) else max((1 << 64) // scale, int(kept[-1]) + 1), len(under) // 16)


def _shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    below = np.uint64(min(a.below, b.below))
    x, y = (s.kept[: np.searchsorted(s.kept, below, "right" if below == TOP else "left")] for s in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1; exact where both sketches are whole."""
    both, x, y = _shared(a, b)
    return both / (x + y - both) if x + y else float(a.n == b.n)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    both, x, _ = _shared(a, b)
    return both / x if x else float(a.n == 0)


def scaled_likeness(a: Sketch, b: Sketch) -> float | None:
    """Estimated Jaccard similarity by the hashes under the threshold alone; None if neither has any."""
    both = len(np.intersect1d(a.under(), b.under(), assume_unique=True))
    return both / n if (n := a.scaled + b.scaled - both) else None


def scaled_containment(a: Sketch, b: Sketch) -> float | None:
    """Estimated share of a's shingles that b has, by the hashes under the threshold alone; None if a has none."""
    return len(np.intersect1d(a.under(), b.under(), assume_unique=True)) / a.scaled if a.scaled else None


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents' shingles together; n is estimated where it isn't known."""
    below = min(a.below, b.below)
    kept = np.union1d(a.kept, b.kept)
    kept = kept[: np.searchsorted(kept, np.uint64(below), "right" if below == TOP else "left")]
    scaled = np.union1d(a.under(), b.under())
    return Sketch(len(kept) if below == TOP else round(len(kept) * 2.0**64 / below), kept, below, len(scaled))


COLUMNS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_in_edited double, contained_in_next double, scaled_near_edited double, scaled_near_next double, "
    "scaled_in_edited double, scaled_in_next double"
)


def _compared(make):
    types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 8, pa.int64()]
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), "times"]

    def row(doc_id, text: str, own: Sketch, other: str, next_: Sketch) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        changed = make(edited)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(changed),
            likeness(own, changed), likeness(own, next_), containment(own, changed), containment(own, next_),
            scaled_likeness(own, changed), scaled_likeness(own, next_), scaled_containment(own, changed), scaled_containment(own, next_),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose next one is to come: (bucket, doc_id, text, sketch)
        for batch in batches:
            rows: list[tuple] = []
            for bucket, edge, doc_id, text, times in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if edge and (held is None or held[0] != bucket):
                    continue  # a later row of the same border
                own = make(text)
                if held is not None:
                    rows.append((*row(*held[1:], text, own), 1))
                if times > 1:  # all but the last are followed by an equal row
                    rows.append((*row(doc_id, text, own, text, own), times - 1))
                held = None if edge else (bucket, doc_id, text, own)
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(2).type, *types], strict=True)], names)

    return run


#: Buckets that all rows are dealt to at most, beside those of hot keys; rows of a key that make it hot, at least.
BUCKETS, HOT = 16_384, 1_000
#: Equal rows of the result that one row becomes at a time.
CHUNK = 10_000


def ordered_buckets(keys: DataFrame, each: int):
    """A function (key, h) -> bucket for the rows of keys(key, h), in the order of key, then h, about each rows to a bucket.

    Quantiles of key are the borders. A key that so many rows have that one bucket wouldn't do has borders round it and
    buckets of its own, by h, a hash. The driver holds the borders and the hot keys: BUCKETS of either at most, and each
    grows so that they are enough. Sums of all rows decide, whatever their number.
    """
    n = keys.count()
    each = max(each, -(-n // BUCKETS))
    parts = max(1, n // each)
    at = keys.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 4 * parts + 10_000)).first()[0] or []
    hot = {r.key: -(-r["count"] // each) for r in keys.groupBy("key").count().where(F.col("count") > max(each, HOT)).collect()}
    beyond = [k + 1 for k in hot if k < (1 << 63) - 1]
    borders = np.unique(np.array([*at, *hot, *beyond], np.int64))
    cuts = np.ones(len(borders) + 1, np.int64)
    for k, m in hot.items():
        cuts[np.searchsorted(borders, k, "right")] = m
    first = np.cumsum(cuts) - cuts

    @F.pandas_udf("long")
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        nth = np.searchsorted(borders, key.to_numpy(), "right")
        share = (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series(first[nth] + np.minimum((share * cuts[nth]).astype(np.int64), cuts[nth] - 1))

    return bucket


def compare_neighbours(docs: DataFrame, width: int = 5, scale: int = 8, least: int = 32, each: int = 500) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see COLUMNS.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; the first follows the last. A null text counts as empty. Null doc_ids come first; rows with
    equal doc_id are in an order that their texts decide. Two texts without words are alike (1), a text with words and
    one without aren't (0); scaled_ figures are null where no hash is under the threshold. An empty table gives an empty
    result; other columns are ignored.

    Texts are shuffled once, to buckets in doc_id order. The first document of each bucket is added to the one before.
    Buckets of equal rows are the only ones that can't be cut; rows that repeat a doc_id and its text are counted before
    the shuffle if the doc_id is hot, and each gets its row.
    """
    kind, spark = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(key.alias("key"), F.xxhash64(text).alias("h"))
    bucket = ordered_buckets(keys, each)
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("h"), "doc_id", text.alias("text"), F.lit(1).cast("long").alias("times"))
    # of hot keys, equal rows become one before they are shuffled
    often = written(keys.groupBy("key", "h").count().where(F.col("count") > HOT).select("key", "h"), "often")
    if not often.isEmpty():
        one = [rows["key"] == often["key"], rows["h"] == often["h"]]
        many = rows.join(small_side(often), one, "left_semi").groupBy("key", "h", "doc_id", "text").agg(F.count("*").alias("times"))
        rows = rows.join(small_side(often), one, "left_anti").unionByName(many)
    starts = keys.select("*", bucket("key", "h").alias("bucket")).groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("r")).collect()
    starts = sorted((r.bucket, r.r.key, r.r.h) for r in starts)  # one row for each bucket, of which there are so many at most
    borders = [(*starts[(k + 1) % len(starts)][1:], b) for k, (b, _, _) in enumerate(starts)]
    borders = spark.createDataFrame(borders, "key long, h long, target long")
    edges = rows.join(F.broadcast(borders), ["key", "h"]).groupBy("target").agg(F.min(F.struct("key", "h", "text", "doc_id")).alias("r"))
    both = rows.select(bucket("key", "h").alias("bucket"), F.lit(False).alias("edge"), "key", "h", "doc_id", "text", "times").unionByName(
        edges.select(F.col("target").alias("bucket"), F.lit(True).alias("edge"), "r.key", "r.h", "r.doc_id", "r.text", F.lit(1).cast("long").alias("times"))
    )
    both = both.repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket", "edge", "key", "h", "text")

    def make(text: str) -> Sketch:
        return sketch(text, width, scale, least)

    out = both.select("bucket", "edge", "doc_id", "text", "times").mapInArrow(_compared(make), f"doc_id {kind}, {COLUMNS}, times long")
    if often.isEmpty():
        return out.drop("times")
    out = written(out, "compared")
    chunks = out.where("times > 1").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(CHUNK)))).repartition(parallelism(spark))
    many = chunks.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, F.col("times")) - 1)))
    return out.where("times = 1").drop("times").unionByName(many.drop("times", "at"))
