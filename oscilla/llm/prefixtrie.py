"""The prefix trie of conversations, from mergeable partial tries.

1. ``ordered`` deals turns to ranges of (conversation, turn) and numbers them: a row's number is its place in
   its range's share of the conversation and the sizes of the shares before it. A conversation of any
   length is spread over ranges; texts stay behind, only a digest of role and text and the bytes go on.
2. ``trie`` names each prefix after sums over its turns: four sums of 32 bits of a hash of place and
   digest. Sums add up over blocks of a conversation, so no task needs it whole.
3. Each range of conversations combines its nodes locally; rounds of merges, dealt by the hash of node and
   group of ranges, add up ``FAN`` partial tables each, until one row a node is left. No task gets more than
   ``FAN`` rows of a node, however many conversations share it. That one name is one prefix is checked: all its
   rows must have one parent and one last turn, down to the root; anything else is an error.
4. Lists of the conversations that end in a node are sorted within ranges, which follow one another in
   order of ids, so a digest of the whole list streams over them and holds one range's share at a time.
5. ``rolled_up`` sums over subtrees from the bottom by doubling: after k rounds a node has the sum of the 2^k levels
   under it and knows its ancestor 2^k levels up. Below a node of one member there is a single path, known
   without sums, so only nodes of several members take part, for as many rounds as the logarithm of their depth.

Edge cases: null roles and texts are empty; a null turn comes first; rows of one turn are ordered by the
digest of role and text, and repeated rows stay repeated. Rows without a conv_id belong to no conversation
and are left out. Conversations that have no turn when they are rebuilt are members of the root alone. Empty tables
give no node, as the root's members would be none. Only the four columns are read, so others can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Turns of a range, places of a block of a conversation, and partial tables that are merged at a time.
PART_ROWS = 1 << 16
BLOCK = 1 << 12
FAN = 16
#: Hash parts of a prefix.
_SUMS = ["k0", "k1", "k2", "k3"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def ordered(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(c, part, rank, digest, bytes) for every turn: ``rank`` from 0, ``part`` the range it lies in, written."""
    filled = turns.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    slim = filled.where("c is not null").select("c", "turn", digest_of(F.col("r"), F.col("x")).alias("digest"), F.octet_length("x").cast("long").alias("bytes"))
    parts = max(2 * turns.sparkSession.sparkContext.defaultParallelism, -(-turns.count() // part_rows))
    dealt = slim.repartitionByRange(parts, "c", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "turns")
    shares = dealt.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select("c", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return written(dealt.join(shares, ["c", "part"]).select("c", "part", (place - 1 + F.col("before")).alias("rank"), "digest", "bytes"), "ranks")


def digest_of(role: Column, text: Column) -> Column:
    """The digest of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def members_of(ranks: DataFrame) -> DataFrame:
    """(c, part, n) for every conversation: its first range and its number of turns."""
    return ranks.groupBy("c").agg(F.min("part").alias("part"), F.count("*").alias("n"))


def rebuilt(ranks: DataFrame, members: DataFrame, *, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos, digest, bytes) and members (c, part, n) of conversations that begin as the first of their group does.

    The first h turns are those of conversation c - c % ``group``, the others are conversation c's own after its
    first h, with h = crc32(c) % (``most`` + 1).
    """
    head = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    plan = members.select("c", "part", "n", head.cast("long").alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    sizes = members.select(F.col("c").alias("base"), F.col("n").alias("there"))
    plan = plan.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = written(plan.select("c", "part", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "plan")
    own = ranks.drop("part").join(plan, "c").where("rank >= h").select("c", (F.col("rank") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    heads = ranks.where(F.col("rank") < most).select(F.col("c").alias("base"), "rank", "digest", "bytes")
    first = heads.join(plan, "base").where("rank < taken").select("c", F.col("rank").alias("pos"), "digest", "bytes")
    return own.union(first), plan.select("c", "part", "n")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(".", depth, *sums))


def prefixes(turns: DataFrame, members: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(c, part, n, key, parent, depth, bytes, digest): the prefix that each turn ends, and the one before it."""
    placed = turns.join(members, "c").withColumn("block", F.floor(F.col("pos") / block))
    one, two = F.xxhash64("pos", "digest"), F.xxhash64("digest", F.lit("2"), "pos")
    low = F.lit((1 << 32) - 1)
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low)]
    placed = placed.select("*", *[p.alias(f"x{k[1:]}") for k, p in zip(_SUMS, parts)])
    # conversations of several blocks carry the sums of those before
    blocks = placed.where(F.col("n") > block).groupBy("c", "block").agg(*[F.sum(f"x{k[1:]}").alias(k) for k in _SUMS])
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("c", "block", *[F.sum(k).over(earlier).alias(f"carry_{k}") for k in _SUMS])
    so_far = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.join(carried, ["c", "block"], "left")
    summed = summed.select("*", *[(F.sum(f"x{k[1:]}").over(so_far) + F.coalesce(f"carry_{k}", F.lit(0))).alias(k) for k in _SUMS])
    key, parent = _name(F.col("pos") + 1, [F.col(k) for k in _SUMS]), _name(F.col("pos"), [F.col(k) - F.col(f"x{k[1:]}") for k in _SUMS])
    return summed.select("c", "part", "n", key.alias("key"), parent.alias("parent"), (F.col("pos") + 1).alias("depth"), "bytes", "digest")


@dataclass
class Trie:
    """Written tables: ``nodes`` (key, parent, depth, n_convs, conv_id, bytes, digest); ``ends`` (key, part, convs), lists in order of part."""

    nodes: DataFrame
    ends: DataFrame


def trie(turns: DataFrame, members: DataFrame, *, fan: int = FAN, block: int = BLOCK) -> Trie:
    """The trie of ``turns`` (c, pos, digest, bytes); ``members`` (c, part, n) has every conversation, those without turns too."""
    rows = written(prefixes(turns, members, block=block), "prefixes")
    root = _name(F.lit(0), [F.lit(0)] * len(_SUMS))
    tops = members.select("c", "part", "n", root.alias("key"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("digest"))
    every = rows.union(tops)
    seen = F.struct("parent", "digest")
    partial = every.groupBy("key", "part").agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    left = (members.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // fan)
        merged = partial.withColumn("part", F.floor(F.col("part") / fan)).groupBy("key", "part")
        partial = merged.agg(*[F.sum("n_convs").alias("n_convs")], *[F.min(x).alias(x) for x in ("conv_id", "depth", "bytes", "low")], F.max("high").alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("two prefixes have one name")).cast("struct<parent:string,digest:string>"))
    nodes = partial.withColumn("own", same).select("key", F.when(F.col("depth") > 0, F.col("own.parent")).alias("parent"), "depth", "n_convs", "conv_id", "bytes", "own.digest")
    ended = every.where("depth = n").groupBy("key", "part").agg(F.sort_array(F.collect_list("c")).alias("convs"))
    return Trie(written(nodes, "nodes"), written(ended, "ends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, n_ends, ends_sha256) for each run of rows (key, part, convs) with one key."""
    last, state, total = None, hashlib.sha256(), 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": keys, "n_ends": pa.array(totals, pa.int64()), "ends_sha256": digests})

    for batch in batches:
        keys, totals, digests = [], [], []
        lists = batch.column(2)
        for at, key in enumerate(batch.column(0).to_pylist()):
            if key != last:
                if last is not None:
                    keys.append(last), totals.append(total), digests.append(state.hexdigest())
                last, state, total = key, hashlib.sha256(), 0
            own = lists[at].as_py()
            state.update(("," * bool(total) + ",".join(map(str, own))).encode())
            total += len(own)
        if keys:
            yield row()
    if last is not None:
        keys, totals, digests = [last], [total], [state.hexdigest()]
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, n_ends, ends_sha256): how many conversations end in a node, and the digest of their ids in order."""
    dealt = ends.select("key", "part", "convs").repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_digests, "key string, n_ends long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved_tokens, the last two over whole subtrees."""
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("single"))
    counted = written(nodes.join(children, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "single")}), "counted")
    shared = counted.where("n_convs > 1")
    # paths of one member are a leaf of their topmost node's parent
    sums = shared.select("key", F.col("parent").alias("up"), "depth", (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    deepest, step = shared.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        sums = written(sums, "subtrees")
        below = sums.where(F.col("depth") >= step).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        over = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        # an ancestor twice as far up is there from twice the depth on
        far = sums.where(F.col("depth") >= 2 * step).join(over, "up").select("key", "next")
        sums = sums.drop("up").join(below, "key", "left").join(far, "key", "left").select(
            "key", F.col("next").alias("up"), "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        step *= 2
    done = counted.join(sums.select("key", "leaves", "saved"), "key", "left")
    return done.select(*nodes.columns, "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))


def with_turns(nodes: DataFrame, turns: DataFrame, *, role: str = "role", text: str = "text") -> DataFrame:
    """``nodes`` with the role and text of their last turn, from the turns that the trie was made of; null for the root."""
    filled = turns.select(F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = filled.select(digest_of(F.col("role"), F.col("text")).alias("digest"), "role", "text").dropDuplicates(["digest"])
    return nodes.join(said, "digest", "left")


def summary(found: Trie) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parents = found.nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = rolled_up(found.nodes).join(parents, "parent", "left").join(end_digests(found.ends), "key", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations, rebuilt in groups of five with up to eight turns of the group's first."""
    ranks = ordered(conversations)
    return summary(trie(*rebuilt(ranks, members_of(ranks), group=5, most=8)))


#: The CRC of decimal ids by its table, which follows from the polynomial; subtrees by the paths of nodes' smallest members.
ORACLE = r"""
with recursive crc as (select list(list_reduce(list_concat([i], range(8)), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as tab from range(256) r(i)),
t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k
      from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null) v),
s as (select conv_id, list({'r': role, 'x': text} order by k) as own from t group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 5 as base,
      xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda p: cast(ascii(substr(cast(conv_id as varchar), p, 1)) as bigint))),
        lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 9 as h from s, crc),
r as (select h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) as seq from h left join s b on b.conv_id = h.base),
p as (select conv_id, len(seq) as size, unnest(range(len(seq) + 1)) as depth, seq from r),
p2 as (select conv_id, size, depth, sha256(cast(seq[1:depth] as varchar)) as key, sha256(cast(seq[1:depth - 1] as varchar)) as up, case when depth > 0 then strlen(seq[depth].x) else 0 end as bytes from p),
n as (select depth, key, min(up) as up, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes,
      sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = depth), '')) as ends_sha256 from p2 group by depth, key),
kids as (select depth - 1 as depth, up as key, count(*) as n_children from n where depth > 0 group by all),
n2 as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (depth, key)),
sub as (select p2.depth, p2.key, count(*) filter (u.n_children = 0) as n_leaves, cast(sum((u.n_convs - 1) * u.bytes) as bigint) as saved_tokens
        from n2 u join p2 on p2.conv_id = u.conv_id and p2.depth <= u.depth group by p2.depth, p2.key)
select n2.conv_id, n2.depth, o.conv_id as parent_conv_id, n2.n_convs, n2.n_children, sub.n_leaves, sub.saved_tokens, n2.ends_sha256
from n2 join sub using (depth, key) left join n2 o on n2.depth > 0 and o.depth = n2.depth - 1 and o.key = n2.up
"""
