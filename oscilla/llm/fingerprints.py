"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed, left to right, into phrases, each the longest one seen before and one more
character. The set of its phrases is what a dictionary compressor learns from it, so the overlap of
two such sets measures how much knowing one text helps to compress the other. The fingerprint is a
minimum-hash signature of the set: the ``SIZE`` least of its hashes. Two signatures give the likeness
by the share of the least hashes of their union that both have, an estimate of the sets' Jaccard
similarity with an error of about 1 / sqrt(SIZE), exact for sets of up to ``SIZE`` phrases.

``with_next`` pairs each document with the next one by id in one range shuffle: Spark deals ids and hashes
of texts to even ranges, the first of each range is its bound, and the first document of a range also goes
to the range before as a look-ahead row. Each task streams its range in order. The driver sees one bound a
range, and there are no more than ``MAX_RANGES`` of them at any size: a task then has a range of more bytes,
which takes longer but no more memory.

Edge cases: a null text is empty; an empty text has no phrases and the empty fingerprint, like only
another empty one (1.0). Null ids come first; rows of one id follow one another in order of their
texts' hashes, each the next of the one before, and may lie in several ranges. A single document is its own next. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import mixed

SIZE = 64
#: The most ranges that documents are dealt to.
MAX_RANGES = 1 << 16


def phrases(text: str, known: set[str] | None = None, pending: str = "") -> tuple[set[str], str]:
    """The phrases of a text and the unfinished one at its end; goes on from ``known`` and ``pending`` in place."""
    known = set() if known is None else known
    add, word = known.add, pending
    for char in text:
        word += char
        if word not in known:
            add(word)
            word = ""
    return known, word


def signature(known: set[str], pending: str = "") -> np.ndarray:
    """The least hashes of the phrases, the unfinished one too if there is no other, sorted."""
    if not known and not pending:
        return np.zeros(0, np.uint32)
    whole = known or {pending}
    raw = "\n".join(whole)
    # phrase hashes by prefix sums over the code points
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths + 1)[: len(codes)].astype(np.uint64)
    terms = mixed((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = (mixed(sums[ends] - sums[starts]) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * SIZE:
        hashes = np.partition(hashes, 4 * SIZE)[: 4 * SIZE]
    return np.unique(hashes)[:SIZE]


def fingerprint(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the least hashes of the union, the share that both signatures have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def _range_of(ids: np.ndarray, hashes: np.ndarray, cut_ids: np.ndarray, cut_hashes: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (id, hash) are at or before each row, less one."""
    low, high = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    for first in np.unique(low[low < high]):  # ids on which a bound lies: their hashes decide
        at = np.flatnonzero((low == first) & (high > first))
        low[at] = first + np.searchsorted(cut_hashes[first : high[at[0]]], hashes[at], "right")
    return np.maximum(low - 1, 0)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """Rows (part, ahead, id, text) in ranges of ids: ahead is 1 for the look-ahead row of a range, its last.

    The number of ranges follows the total size of the texts, ``part_bytes`` each, but is no less than
    the session's parallelism and no more than ``MAX_RANGES``.
    """
    spark = docs.sparkSession
    ident = F.col(id_col).cast("long")
    # null ids are placed below all others, so that no function in Python sees a null
    rows = docs.select(ident.alias("id"), F.coalesce(ident, F.lit(-(1 << 63))).alias("place"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MAX_RANGES, max(2 * spark.sparkContext.defaultParallelism, -(-total // part_bytes)))
    dealt = rows.select("place", "hash").repartitionByRange(parts, "place", "hash")
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("place", "hash")).alias("least")).select("least.*")
    bounds = sorted((r.place, r.hash) for r in firsts.collect())  # MAX_RANGES rows at most
    shared = spark.sparkContext.broadcast(tuple(np.array([b[k] for b in bounds], np.int64) for k in range(2)))

    @F.pandas_udf("array<int>")
    def parts_of(place: pd.Series, hash_: pd.Series) -> pd.Series:
        ids, hashes = place.to_numpy(np.int64), hash_.to_numpy(np.int64)
        cut_ids, cut_hashes = shared.value
        own = _range_of(ids, hashes, cut_ids, cut_hashes)
        first = (cut_ids[own] == ids) & (cut_hashes[own] == hashes)
        # a range's first document goes to the range before it, too, the very first one to the last
        return pd.Series([[p, (p - 1) % len(cut_ids)] if f else [p] for p, f in zip(own.tolist(), first.tolist())])

    placed = rows.select("id", "hash", "text", F.posexplode(parts_of("place", "hash")).alias("ahead", "part"))
    placed = placed.repartitionById(max(1, len(bounds)), F.col("part"))
    return placed.sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), "hash").select("part", "ahead", "id", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, str]]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            piece = batch.slice(low, 256)
            yield from zip(*(piece.column(k).to_pylist() for k in range(4)))


class _Doc:
    """A document with its phrases up to the middle and in full."""

    def __init__(self, ident: int, text: str) -> None:
        self.ident, self.text = ident, text
        self.kept = text[: len(text) - len(text) // 2]
        known, pending = phrases(self.kept)
        self.half = (set(known), pending)
        self.sign = signature(*phrases(text[len(self.kept) :], known, pending))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in range(7)]

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)
        for x in out:
            x.clear()
        return batch

    last: _Doc | None = None
    closed = False
    part_of_last = None
    for part, ahead, ident, text in _streamed(batches):
        if part != part_of_last:
            last, closed, part_of_last = None, False, part
        if closed:  # copies of the look-ahead row
            continue
        doc = _Doc(ident, text)
        if last is not None:
            n = len(last.text)
            tail = text[: n // 2]
            known, pending = last.half
            sign = signature(*phrases(tail, known, pending))
            row = (last.ident, n, hashlib.sha256((last.kept + tail).encode()).hexdigest(), fingerprint(last.sign), fingerprint(sign), likeness(last.sign, sign), likeness(last.sign, doc.sign))
            for x, value in zip(out, row):
                x.append(value)
            if len(out[0]) >= 512:
                yield emit()
        last, closed = doc, bool(ahead)
    yield emit()


def op10_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents).mapInArrow(_edited, schema)
