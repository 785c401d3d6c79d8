"""Suffix-array dedup: removal of every byte covered by a long string that starts anywhere else, too.

1. Routing. Any ``length`` bytes hold one anchor, the least of their grams of ``GRAM`` bytes by hash
   (the leftmost of equal ones), so equal windows have equal anchors at equal places. A text falls
   into segments, runs of windows with one anchor; only segments whose anchor's gram occurs again
   anywhere can hold a repeat. A segment's context is all bytes of its windows.
2. Collapsing. Equal contexts around one gram are one string with a multiplicity; they are told apart by a
   cryptographic digest of 128 bits of all their bytes. Every window of a context that occurs twice is
   repeated. Wherever its gram stands in a window, the window covers one of ``SLOTS`` stretches around it, which
   reach from k to SLOTS - 1 - k parts of what a window has beside the gram, to the left and to the right; so a
   context that occurs once can hold a repeat only if one of its stretches is that of another context, too.
3. Sorting. Such contexts and those that they may repeat go to shards, all of one gram to one shard. A
   shard is spooled to disk as it arrives and its suffixes are sorted by external recursive induction
   (``suffixes``), whose queues carry common prefixes along; neighbours that share ``length`` bytes are repeats.
4. Hot grams. Contexts of one gram beyond ``hot`` are split by the place of the window around the
   anchor; either half is keyed by the bytes that all its windows share, which are more than the gram,
   and equal halves collapse again. The last split leaves single windows, which are equal or apart, so
   a passage in a third of all documents never meets in one task.
5. The repeated windows' bytes are gathered by document and cut out of the input's texts.

Shards, tables and rounds are Spark tables in the shared folder, so lost executors cost only their tasks.

Edge cases: null and empty texts have no bytes; texts below ``length`` bytes lose nothing. Rows of one
doc_id and text are two documents, each a repeat of the other; their ranges are the same and are gathered
once. A text of any length is taken in overlapping parts. A null doc_id is a document like any other. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .suffixes import Shard
from .wordscan import Rolling, blocks, buffers

GRAM = 32
#: Stretches around a gram by which contexts that can share a window are found.
SLOTS = 4
#: Windows of a long text that are taken at a time, and bits of a place among them; the rest of a packed value is hash.
CHUNK = 1 << 22
PLACE = np.uint64(24)
#: Bytes of contexts that are sorted together: the most, and the least as long as there are few shards for a core.
SHARD_BYTES, LEAST_SHARD_BYTES = 8 << 20, 2 << 20
HOT = 2048
PIECES = "gram long, piece binary, n long, anchor int, near int, far int, first int, body binary"
RUNS = "gram long, piece binary, a int, b int"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    pad = -n % width
    grid = np.append(values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray | list[bytes]]:
    """The segments of a block of texts: row, gram, digest of the context, first and last window in the text, anchor in the context.

    ``stretches`` packs hashes of 16 bits, by slot; 0 where the context does not reach so far.
    """
    offsets = offsets - offsets[0]
    none = {k: np.zeros(0, np.int64) for k in ("row", "gram", "context", "low", "high", "anchor", "stretches")}
    windows = len(raw) - length + 1
    if windows < 1:
        return none
    rolling = Rolling(raw)
    grams = rolling.grams(GRAM)
    if len(grams) > 1 << int(PLACE):
        raise ValueError(f"a block of {len(raw)} bytes has more places than {PLACE} bits tell apart")
    packed = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(packed, length - GRAM + 1) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[1:][row]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    low, high = np.flatnonzero(new), np.flatnonzero(stop)
    if not len(low):
        return none
    own, at = row[low], anchor[low]
    body = memoryview(raw)
    context = [hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), (high + length).tolist())]
    part = (length - GRAM) // SLOTS
    stretches = np.zeros(len(low), np.uint64)
    for slot in range(SLOTS):
        first, end = at - slot * part, at + GRAM + (SLOTS - 1 - slot) * part
        there = (first >= low) & (end <= high + length)
        hashes = rolling.hash(np.maximum(first, 0), np.minimum(end, len(raw)), 13) >> np.uint64(48) | np.uint64(1)
        stretches |= np.where(there, hashes, np.uint64(0)) << np.uint64(16 * slot)
    begin = offsets[:-1][own]
    return {"stretches": stretches.view(np.int64), "row": own, "gram": grams[at].view(np.int64), "context": context, "low": low - begin, "high": high - begin, "anchor": at - low}


def _parts(raw: np.ndarray, offsets: np.ndarray, length: int, chunk: int) -> Iterator[tuple[int, dict]]:
    """(first row, segments) of blocks of texts; a text of more than ``chunk`` windows comes in parts that overlap.

    A run of windows with one anchor that reaches into the next part is two segments; each window is in one.
    """
    for low, high in blocks(offsets):
        windows = int(offsets[high] - offsets[low]) - length + 1
        if high - low > 1 or windows <= chunk:
            yield low, segments(raw[offsets[low] : offsets[high]], offsets[low : high + 1], length)
            continue
        for first in range(0, windows, chunk):
            part = raw[offsets[low] + first : min(offsets[high], offsets[low] + first + chunk + length - 1)]
            own = segments(part, np.array([0, len(part)]), length)
            yield low, own | {"low": own["low"] + first, "high": own["high"] + first}


def _segment_rows(length: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = buffers(batch.column(2))
            for low, s in _parts(raw, offsets, length, chunk):
                rows = s["row"] + low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["gram"]), pa.array(s["context"], pa.binary()), pa.array(doc[rows]), pa.array(mark[rows]), *(pa.array(s[k].astype(np.int32)) for k in ("low", "high", "anchor")), pa.array(s["stretches"])],
                    names=["gram", "context", "doc", "mark", "low", "high", "anchor", "stretches"],
                )

    return run


def _context_bodies(length: int):
    """(doc text, its segments) to pieces with the bytes of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            lists = batch.column(1).to_pylist()
            for low in range(0, len(lists), 64):
                out: list[list] = [[] for _ in range(8)]
                for r in range(low, min(low + 64, len(lists))):
                    text = raw[offsets[r] : offsets[r + 1]]
                    for s in lists[r]:
                        body = text[s["low"] : s["high"] + length].tobytes()
                        for x, v in zip(out, (s["gram"], s["context"], s["n"], s["anchor"], 0, length - GRAM, 0, body)):
                            x.append(v)
                kinds = [pa.int64(), pa.binary(), pa.int64()] + [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["gram", "piece", "n", "anchor", "near", "far", "first", "body"])

    return run


def _halves(length: int):
    """Split pieces by the distance of the window from the anchor; parents' names and places ride along.

    ``first`` is the index in the context of a piece's first window; window j starts anchor - j bytes
    before the anchor, and a piece's windows lie ``near`` to ``far`` before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(11)]
            for p in batch.to_pylist():
                middle = (p["near"] + p["far"]) // 2
                last = p["first"] + len(p["body"]) - length
                for near, far in ((p["near"], middle), (middle + 1, p["far"])):
                    low, high = max(p["first"], p["anchor"] - far), min(last, p["anchor"] - near)
                    if low > high:
                        continue
                    body = p["body"][low - p["first"] : high - p["first"] + length]
                    shared = p["body"][p["anchor"] - near - p["first"] : p["anchor"] - far - p["first"] + length]
                    name = hashlib.blake2b(shared, digest_size=8, salt=near.to_bytes(8, "little"), person=far.to_bytes(8, "little")).digest()
                    own = hashlib.blake2b(body, digest_size=16, salt=(p["anchor"] - low).to_bytes(8, "little")).digest()
                    row = (p["gram"], p["piece"], low - p["first"], int.from_bytes(name, "little", signed=True), own, p["n"], p["anchor"], near, far, low, body)
                    for x, v in zip(out, row):
                        x.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64()] + [pa.int32()] * 4 + [pa.binary()]
            names = ["parent", "part", "shift", "gram", "piece", "n", "anchor", "near", "far", "first", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return run


def _sorter(length: int):
    """The runs of repeated windows of a shard's pieces, which arrive as (gram, piece, n, body)."""
    names = ["gram", "piece", "a", "b"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, grams, pieces = Shard(length), [], []
        for batch in batches:
            shard.add(*buffers(batch.column(3)), batch.column(2).to_numpy())
            grams.append(batch.column(0))
            pieces.append(batch.column(1))
        if not grams:
            return
        gram, piece = pa.chunked_array(grams).combine_chunks(), pa.chunked_array(pieces).combine_chunks()
        row, a, b = [], [], []

        def emit() -> pa.RecordBatch:
            at = pa.array(row, pa.int64())
            out = pa.RecordBatch.from_arrays([gram.take(at), piece.take(at), pa.array(a, kinds[2]), pa.array(b, kinds[3])], names=names)
            for x in (row, a, b):
                x.clear()
            return out

        for k, hit in shard.repeats():
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            starts = np.flatnonzero(edge == 1)
            row += [k] * len(starts)
            a += starts.tolist()
            b += (np.flatnonzero(edge == -1) - 1).tolist()
            if len(row) >= 10_000:
                yield emit()
        yield emit()

    return run


def _sorted_runs(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (from, to) of each piece, by suffix sorting in shards, each a task."""
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    few = 4 * pieces.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total // SHARD_BYTES), min(few, -(-total // LEAST_SHARD_BYTES)))
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int").alias("shard")
    keyed = pieces.select("gram", "piece", "n", "body", shard).repartitionById(shards, F.col("shard")).drop("shard")
    return keyed.mapInArrow(_sorter(length), RUNS)


def repeated_runs(pieces: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """Runs of repeated windows of distinct pieces; grams with more than ``hot`` of them are split first."""
    rounds = []
    while True:
        sizes = pieces.groupBy("gram").agg(F.count("*").alias("k"))
        large = sizes.where((F.col("k") > hot)).select("gram")
        if not large.take(1):
            break
        cool = pieces.join(large, "gram", "left_anti")
        halves = "parent long, part binary, shift int, " + PIECES
        split = written(pieces.join(large, "gram").select("gram", "piece", "n", "anchor", "near", "far", "first", "body").mapInArrow(_halves(length), halves), "halves")
        merged = split.groupBy("gram", "piece").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("anchor", "near", "far", "first")], F.min("body").alias("body"))
        rounds.append((split.select("parent", "part", "shift", "gram", "piece"), cool))
        pieces = written(merged, "pieces")
    runs = _runs_of(pieces, length)
    for names, cool in reversed(rounds):
        upper = names.join(runs, ["gram", "piece"]).select(F.col("parent").alias("gram"), F.col("part").alias("piece"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
        runs = written(upper.unionByName(_runs_of(cool, length)), "runs")
    return runs


def _runs_of(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces alone with their gram are repeated throughout or not at all; the others are sorted."""
    sizes = pieces.groupBy("gram").agg(F.count("*").alias("k"))
    sized = pieces.join(sizes, "gram")
    whole = sized.where("k = 1 and n > 1").select("gram", "piece", F.lit(0).alias("a"), (F.octet_length("body") - length).cast("int").alias("b"))
    return whole.unionByName(_sorted_runs(sized.where("k > 1").drop("k"), length))


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 200, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc, mark, text, spans) for every row: ``spans`` are byte ranges to remove, not yet merged; null where none."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), ident.alias("doc"), F.xxhash64(body).alias("mark"), body.alias("text"))
    found = written(rows.select("doc", "mark", "text").where(F.octet_length("text") >= length).mapInArrow(_segment_rows(length, chunk), "gram long, context binary, doc long, mark long, low int, high int, anchor int, stretches long"), "segments")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").drop("n")
    grams = written(grams, "grams")  # a table on both sides of the join lets Spark split the rows of a hot gram
    again = written(found.join(grams, "gram"), "repeats")

    place = F.struct("doc", "mark", "low", "high", "anchor")
    contexts = again.where("mixed").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.first("stretches").alias("stretches"))
    contexts = written(contexts, "contexts")
    keys = F.array(*[F.struct(F.lit(k).alias("slot"), F.shiftrightunsigned("stretches", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("key")) for k in range(SLOTS)])
    stretched = contexts.select("gram", "context", "n", "at", F.explode(keys).alias("s")).select("gram", "context", "n", "at", "s.slot", "s.key").where("key > 0")
    shared = stretched.groupBy("gram", "slot", "key").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").drop("k", "least")
    candidates = stretched.join(shared, ["gram", "slot", "key"]).groupBy("gram", "context").agg(F.first("n").alias("n"), F.first("at").alias("at"))
    wanted = candidates.select("at.doc", "at.mark", F.struct("gram", "context", "n", "at.low", "at.high", "at.anchor").alias("s")).groupBy("doc", "mark").agg(F.collect_list("s").alias("s"))
    bodies = rows.join(wanted.hint("shuffle_hash"), ["doc", "mark"]).select("text", "s").mapInArrow(_context_bodies(length), PIECES)
    pieces = written(bodies.dropDuplicates(["gram", "piece"]), "pieces")
    runs = repeated_runs(pieces, length, hot).withColumnRenamed("piece", "context")
    runs = runs.unionByName(contexts.where("n > 1").select("gram", "context", F.lit(0).alias("a"), (F.col("at.high") - F.col("at.low")).alias("b")))

    plain = again.where("not mixed").select("doc", "mark", F.col("low").alias("a"), (F.col("high") + length).alias("b"))
    by_runs = again.where("mixed").join(runs, ["gram", "context"]).select("doc", "mark", (F.col("low") + F.col("a")).alias("a"), (F.col("low") + F.col("b") + length).alias("b"))
    spans = plain.union(by_runs).groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows.join(spans.hint("shuffle_hash"), ["doc", "mark"], "left").select("id", "text", "spans")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        out: list[list] = [[] for _ in range(4)]
        for r, spans in enumerate(batch.column(2).to_pylist()):
            own = raw[offsets[r] : offsets[r + 1]]
            digest, last, removed, runs = hashlib.sha256(), 0, 0, _merged(spans or [])
            for a, b in runs:
                digest.update(own[last:a])
                removed, last = removed + b - a, b
            digest.update(own[last:])
            for x, v in zip(out, (len(own), removed, len(runs), digest.hexdigest())):
                x.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(id, text, removed): the remaining bytes as text, what is no whole character replaced, and the byte ranges cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            texts, removed = [], []
            for r, spans in enumerate(batch.column(2).to_pylist()):
                own, last, kept = raw[offsets[r] : offsets[r + 1]].tobytes(), 0, []
                runs = _merged(spans or [])
                for a, b in runs:
                    kept.append(own[last:a])
                    last = b
                texts.append(b"".join([*kept, own[last:]]).decode("utf-8", "replace"))
                removed.append([{"a": a, "b": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["id", "text", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return repeated_bytes(docs, id_col=id_col, text=text, length=length).mapInArrow(run, f"id {kind}, text string, removed array<struct<a:long,b:long>>").toDF(id_col, "text", "removed")


def op7_suffix_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return repeated_bytes(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
