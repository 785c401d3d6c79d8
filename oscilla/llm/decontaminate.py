"""Benchmark decontamination.

A broadcast hash set of the benchmark's normalised n-grams is held against every window of the
training texts; each hash hit is verified on the words themselves. Documents or spans then go.

Broadcast bound: one pass broadcasts the windows of at most ``block_bytes`` of benchmark text, some thirty
bytes a word. A larger benchmark is dealt to blocks, distinct items once each and long ones in overlapping
pieces, until no block is larger; the documents are scanned once a block, the state so far riding along in a
written table, so nothing that grows with the data is broadcast or collected at once.

Edge cases: a null or empty text has no words, no hits and the hash of the empty string. An item
without words never occurs; a null item_id counts as the empty string. Repeated items and repeated
documents are judged on their own, row by row. Empty tables give empty or hit-free results. Columns
of the caller are never overwritten: ``scan`` returns the id and its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .wordscan import ALNUM, Words, blocks, buffers

STATE = "n_words long, hits binary, items array<string>"


class Windows:
    """The n-grams of some items by length: sorted hashes, a word at which each stands, and its items.

    Windows of one hash and different words are entries of their own.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        self.ids = [i for i, _ in items]
        self.words = words = Words(*buffers(pa.array([t for _, t in items], pa.large_string())), ALNUM)
        length = np.minimum(words.count, n)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for size, hashes in words.runs(words.hash, n):
            at = np.flatnonzero(words.fits(size) & (length[words.row[: len(hashes)]] == size))
            if not len(at):
                continue
            at = at[np.argsort(hashes[at], kind="stable")]
            own = hashes[at]
            new = np.append(True, own[1:] != own[:-1])
            for first, end in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at))):
                if end - first > 1:  # the same words first to last, or a collision
                    texts = [words.text(int(w), size) for w in at[first:end]]
                    order = sorted(range(end - first), key=texts.__getitem__)
                    at[first:end] = at[first:end][order]
                    new[first:end] = [k == 0 or texts[order[k]] != texts[order[k - 1]] for k in range(end - first)]
            begin = np.flatnonzero(new)
            kept = own[begin]
            maybe = np.zeros(1 << 16, bool)
            maybe[kept >> np.uint64(48)] = True
            self.by_length[size] = (kept, maybe, at[begin].astype(np.int32), np.append(begin, len(at)), words.row[at].astype(np.int32))

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items that occur in each row."""
        cover = np.zeros(len(words.start) + 1, np.int32)
        found: dict[int, set[str]] = {}
        longest = max(self.by_length, default=0)
        if not longest or not len(words.start):
            return cover[:-1] > 0, found
        for size, hashes in words.runs(words.hash, longest):
            if size not in self.by_length:
                continue
            kept, maybe, stands, begin, owners = self.by_length[size]
            at = np.flatnonzero(maybe[hashes >> np.uint64(48)])
            at = at[words.fits(size)[at]]
            place = np.searchsorted(kept, hashes[at])
            same = place < len(kept)
            same[same] = kept[place[same]] == hashes[at[same]]
            for word, k in zip(at[same].tolist(), place[same].tolist()):
                text = words.text(word, size)
                while k < len(kept) and kept[k] == hashes[word]:
                    if text == self.words.text(int(stands[k]), size):
                        cover[word] += 1
                        cover[word + size] -= 1
                        found.setdefault(int(words.row[word]), set()).update(self.ids[r] for r in owners[begin[k] : begin[k + 1]])
                        break
                    k += 1
        return np.cumsum(cover)[:-1] > 0, found


def _pieces(n: int, limit: int):
    """(i, t) to (i, t) with texts of about ``limit`` bytes at most, n - 1 words in common with the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(t.encode(), np.uint8)
                if len(raw) <= limit:
                    ids.append(i)
                    texts.append(t)
                    continue
                words = Words(raw, np.array([0, len(raw)]), ALNUM)
                first = 0
                while first < len(words.start):
                    end = max(first + n, int(np.searchsorted(words.end, words.start[first] + limit, "right")))
                    ids.append(i)
                    texts.append(raw[words.start[first] : words.end[min(end, len(words.end)) - 1]].tobytes().decode())
                    first = end - n + 1 if end < len(words.start) else len(words.start)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["i", "t"])

    return run


def _scanner(shared, text_at: int, state_at: int | None, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column(text_at))
            n_words, hits, items = [], [], []
            before = batch.slice(0).to_pydict() if state_at is not None else None
            names = batch.schema.names
            for low, high in blocks(offsets):
                words = Words(raw[offsets[low] : offsets[high]], offsets[low : high + 1], ALNUM)
                hit, found = windows.scan(words)
                hot = np.zeros(high - low, bool)
                hot[np.unique(words.row[hit])] = True
                for r in range(high - low):
                    row = low + r
                    old = before[names[state_at + 1]][row] if before else None
                    n_words.append(int(words.count[r]))
                    if not hot[r] and old is None:
                        hits.append(None)
                    else:
                        bits = np.packbits(hit[words.first[r] : words.first[r + 1]])
                        hits.append((bits | np.frombuffer(old, np.uint8) if old is not None else bits).tobytes())
                    known = before[names[state_at + 2]][row] if before else None
                    items.append(sorted(found.get(r, set()) | set(known or [])))
            columns = [*batch.columns[:keep], pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def _prefixed(schema: T.StructType) -> T.StructType:
    """The same types under positional names, so that no name of the caller can clash."""
    return T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])


def _hit_rows(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, n: int, block_bytes: int) -> DataFrame:
    """All columns of ``docs`` as c0, c1, ..., then n_words, hits (bits of the words) and items."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    items = written(items.mapInArrow(_pieces(n, block_bytes // 8), "i string, t string").distinct(), "items")
    size = F.sum(F.octet_length("t"))
    passes = max(1, -(-(items.agg(size).first()[0] or 0) // block_bytes))

    def part(passes: int):
        return F.pmod(F.xxhash64("i", "t"), F.lit(passes))

    # a piece is a small part of a block (but for words that are longer), so more blocks come below the bound
    while (items.groupBy(part(passes).alias("p")).agg(size.alias("s"), F.count("*").alias("k")).where("k > 1").agg(F.max("s")).first()[0] or 0) > block_bytes:
        passes *= 2
    names, text_at = docs.columns, docs.columns.index(text)
    keep = len(names)
    state = T.StructType.fromDDL(STATE)
    out = T.StructType(_prefixed(docs.schema).fields + [T.StructField(f"c{keep + i}", f.dataType) for i, f in enumerate(state.fields)])
    rows = docs.toDF(*[f"c{i}" for i in range(keep)])
    for k in range(passes):
        block = items.where(part(passes) == k).collect()  # block_bytes of text at most
        shared = spark.sparkContext.broadcast(Windows([(r.i, r.t) for r in block], n))
        rows = rows.mapInArrow(_scanner(shared, text_at, keep if k else None, keep), out)
        if k + 1 < passes:
            rows = written(rows, "scan")
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, one_in: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """For each document: doc id, n_words, n_hit, items (sorted), contaminated.

    A word is hit if it lies in an occurrence of an item's window of ``n`` words (of the whole item,
    if it is shorter). A document is contaminated from one hit word in ``one_in`` on.
    """
    rows = _hit_rows(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), benchmark, "t", item, item_text, n, block_bytes)
    n_hit = F.coalesce(F.length(F.replace(_bits("c3"), F.lit("0"), F.lit(""))), F.lit(0)).cast("long")
    rows = rows.select(F.col("c0").alias(id_col), F.col("c2").alias("n_words"), n_hit.alias("n_hit"), F.col("c4").alias("items"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def _bits(column: str):
    """The ones and zeros of a binary column, as text: each hexadecimal digit spelled out."""
    text = F.hex(F.col(column))
    for digit in "23456789ABCDEF":
        text = F.replace(text, F.lit(digit), F.lit("1" * bin(int(digit, 16)).count("1") + "0"))
    return text


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, one_in: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the contaminated documents; every column and every other row stays as it is."""
    width = len(docs.columns)
    rows = _hit_rows(docs, benchmark, text, item, item_text, n, block_bytes)
    n_hit = F.coalesce(F.length(F.replace(_bits(f"c{width + 1}"), F.lit("0"), F.lit(""))), F.lit(0))
    clean = rows.where(~((n_hit > 0) & (one_in * n_hit >= F.col(f"c{width}"))))
    return clean.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with every run of hit words cut from its text, from the first word's start to the last one's end."""
    width, at = len(docs.columns), docs.columns.index(text)
    rows = _hit_rows(docs, benchmark, text, item, item_text, n, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(at))
            texts = batch.column(at).to_pylist()
            for row, bits in enumerate(batch.column(width + 1).to_pylist()):
                if bits is None:
                    continue
                own = raw[offsets[row] : offsets[row + 1]]
                words = Words(own, np.array([0, len(own)]), ALNUM)
                hit = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(words.start)].astype(np.int8)
                edge = np.diff(np.concatenate([[0], hit, [0]]))
                keep, last = [], 0
                for first, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    keep.append(own[last : words.start[first]].tobytes())
                    last = words.end[end - 1]
                texts[row] = b"".join([*keep, own[last:].tobytes()]).decode()
            columns = [*batch.columns[:width]]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(width)])

    return rows.mapInArrow(run, _prefixed(docs.schema)).toDF(*docs.columns)


def op1_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: The lower-casing and the words of the contract, for DuckDB.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with dw as (select doc_id, {_SQL_WORDS} as w from documents),
iw as (select coalesce(cast(item_id as varchar), '') as item, {_SQL_WORDS} as w from benchmark),
win as (select distinct item, least(13, len(w)) as l, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') as x
        from (select item, w, unnest(range(len(w) - least(13, len(w)) + 1)) as s from iw where len(w) > 0)),
sizes as (select distinct l from win),
dx as (select doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') as x
       from (select doc_id, w, l, unnest(range(len(w) - l + 1)) as s from dw, sizes where len(w) >= l)),
hits as (select dx.doc_id, dx.s, dx.l, win.item from dx join win on dx.l = win.l and dx.x = win.x),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + l)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct doc_id, item from hits) group by doc_id)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(h, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(dw.w) as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""
