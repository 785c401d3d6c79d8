"""MinHash near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Each whole text becomes its set of word shingles, a digest of that set and, from the set's fast
   similarity sketch, one key for each band of ``rows`` coordinates.
2. Texts with equal sets are one class; its least doc_id stands for it from here on.
3. Classes that share a band key are candidates. Each bucket is named after its least member, and
   that name after the least one the namesake meets itself, so one group of copies that fills dozens
   of buckets is compared once.
4. Groups are cut into blocks by the bytes of their members' sets, and the group's least member joins
   every block. Each block is verified on its own: intersections come from an inverted index over the full
   sets, whose shingles are told apart by 64 bits made of cryptographic digests of their words, members already joined are not compared again, and only links that join something are
   returned. A group of near copies is one component after this, at a cost in proportion to its size.
5. Components of the links, by least labels. Where a group of several blocks is not one component yet,
   the members outside its largest component meet the group's other blocks, a pair of blocks a unit, so
   every candidate pair is either compared or joined already. No task holds more than two blocks.

With 43 bands of 5 rows a pair at similarity 0.75 shares no band with a probability of 9e-6, at 0.8 of
4e-8; there is no other way to lose a link, and no cap on buckets, partners or candidates.

Edge cases: null or empty texts and texts of white space have an empty set and are linked with
nothing. Rows that share a doc_id are one document, so all its texts and what they are near to are one
component; a null doc_id is linked with its copies only through them and keeps ``kept`` true when it is
alone. Empty tables give empty results. Only the id
and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketching import band_keys, shingle_sets, sketch
from .store import written
from .wordscan import blocks, buffers

#: Bytes of the sets of a block on average, with what each member takes besides; a unit of verification holds two blocks at most.
BLOCK_BYTES = 4 << 20
MEMBER_BYTES = 1 << 10
#: Bits of the filter that keeps full sets from being made of texts without any candidate.
FILTER_BITS = 1 << 24


def _signatures(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            counts, digests, keys = [], [], []
            for low, high in blocks(offsets):
                for own in shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1], size):
                    counts.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    # sets of one or two shingles are near no other set
                    keys.append(band_keys(sketch(own, rows * bands), rows).view(np.int64) if len(own) > 2 else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"]
            )

    return run


def _full_sets(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            raw, offsets = buffers(batch.column(1))
            sets = [own.tobytes() for low, high in blocks(offsets) for own in shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1], size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "elements"])

    return run


def joining_links(sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions with ``den * intersection >= num * union`` that join all that such pairs join.

    Sets of one ``label`` count as joined already; those not in ``ask`` are not compared with one another. The
    comparisons end once those left to make are within one component.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting = owner[np.argsort(which, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(times)])
    ends = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    open_ = np.ones(n, bool) if ask is None else ask.copy()
    others, links = np.ones(n, bool) if ask is None else ~ask, []
    while open_.any():
        left = np.flatnonzero(open_)
        sizes = np.bincount(label[left], minlength=n)
        largest = int(sizes.argmax())
        outside = left[label[left] != largest]
        if not len(outside) and (ask is None and len(left) < n or (label[others] == largest).all()):
            break
        x = int(outside[0]) if len(outside) else int(left[0])
        open_[x] = False
        own = which[ends[x] : ends[x + 1]]
        lengths = times[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero((den * shared >= num * (size[x] + size - shared)) & (label != label[x]))
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            links += [(x, y) for y in near[first].tolist()]
            renamed = np.arange(n)
            renamed[joined] = label[x]
            label = renamed[label]
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100, rows: int = 5, bands: int = 43) -> DataFrame:
    """For each document: its id, n_shingles, component_id (least id reachable) and kept (it is that one)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    meta = written(source.mapInArrow(_signatures(size, rows, bands), "id long, n long, digest binary, keys array<long>"), "signatures")
    # a table on both sides of the joins below lets Spark split the rows of a large class
    classes = written(meta.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    owned = meta.join(classes, "digest").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys"))
    owned = written(owned, "owned")
    keyed = owned.where("keys is not null").select("id", "n", F.explode("keys").alias("key"))
    named = keyed.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = written(keyed.join(named, "key").select("center", "id", "n").distinct(), "buckets")
    first = met.groupBy(F.col("id").alias("center")).agg(F.min("center").alias("up"))
    members = written(met.join(first, "center").select(F.col("up").alias("center"), "id", "n").distinct(), "members")

    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")
    words = members.select(slot).groupBy(F.shiftright("slot", 5).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    for at, bits in words.collect():  # FILTER_BITS / 32 rows at most
        bitmap[at] = bits
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))
    sets = source.select("id", "text", slot).where("id is not null").mapInArrow(_full_sets(shared, size), "id long, elements binary")

    def verify(unit: pd.DataFrame) -> pd.DataFrame:
        ids, ask = unit["id"].to_numpy(), unit["ask"].to_numpy()
        found = joining_links([np.frombuffer(x, np.uint64) for x in unit["elements"]], num, den, unit["label"].to_numpy(), None if ask.all() else ask)
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    def verified(units: DataFrame) -> DataFrame:
        """Links found in ``units`` of (center, p, q, ask, id, label)."""
        return written(units.join(sets, "id").groupBy("center", "p", "q").applyInPandas(verify, "a long, b long"), "verified")

    weight = F.sum(8 * F.col("n") + MEMBER_BYTES)
    sized = members.groupBy("center").agg(F.ceil(weight / F.lit(BLOCK_BYTES)).cast("int").alias("parts"), F.min("id").alias("pivot"))
    dealt = members.join(sized, "center").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    dealt = written(dealt.select("center", "parts", "part", "id"), "blocks")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pivots = sized.where("parts > 1").select("center", each.alias("p"), F.col("pivot").alias("id"))
    own = dealt.select("center", F.col("part").alias("p"), "id").union(pivots).distinct()
    found = verified(own.select("center", "p", F.col("p").alias("q"), F.lit(True).alias("ask"), "id", F.col("id").alias("label")))
    # documents that share an id are one, so are the classes of one id
    pairs = owned.where("id is not null").select("id", "rep").distinct()
    shared_ids = pairs.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1")
    links = found.union(pairs.join(shared_ids, "id").select("a", F.col("rep").alias("b")))
    labels = components(links)

    # what groups of several blocks have left to compare: members apart from their largest component against all other blocks
    now = dealt.where("parts > 1").join(labels, F.col("id") == F.col("node"), "left").select("center", "parts", "part", "id", F.coalesce("label", "id").alias("label"))
    tally = now.groupBy("center", "label").agg(F.count("*").alias("k"))
    apart = tally.groupBy("center").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    left = written(now.join(apart, "center").withColumn("ask", F.col("label") != F.col("most")).drop("most", "labels"), "apart")
    if left.take(1):
        pairs = left.where("ask").select("center", "parts", "part").distinct().select("center", F.col("part").alias("p"), each.alias("q")).where("p <> q")
        asking = left.where("ask").withColumnRenamed("part", "p").join(pairs, ["center", "p"])
        asked = left.withColumn("ask", F.lit(False)).withColumnRenamed("part", "q").join(pairs, ["center", "q"])
        asking, asked = (x.select("center", "p", "q", "ask", "id", "label") for x in (asking, asked))
        labels = components(links.union(verified(asking.union(asked))))

    out = owned.join(labels, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("label", "rep", "id").alias("component"))
    out = out.union(meta.where("digest is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller id; all columns as they are. Rows without id stay."""
    gone = near_duplicates(docs, id_col=id_col, text=text).where("not kept").select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone.gone, "left_anti")


def op3_near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(documents)


#: Links of any two documents whose sets are near, by a join on shingles; components by recursion.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[s + 1 : s + least(5, len(w))], ' ') as x
       from (select doc_id, w, unnest(range(len(w) - least(5, len(w)) + 1)) as s from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on links.a = reach.other),
comp as (select doc_id, min(other) as c from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, comp.c as component_id, comp.c = w.doc_id as kept
from w left join n using (doc_id) join comp using (doc_id)
"""
