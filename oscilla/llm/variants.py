"""Spelling variants: words at distance one, by a trie self-join with active-node sets.

Two words are near if one inserted, deleted or replaced character makes them equal. With ``m`` the length of
the shorter one and ``i`` the length of their longest common prefix, the edit is at ``i`` and the words agree in all
``m - i`` characters behind it (``m - 1 - i`` for a replacement). So for any window [a, b) of places, all pairs with
an edit in it share their first ``a`` and their last ``m - b`` characters.

``cells`` deals the vocabulary by length ``m`` (words of ``m`` and of ``m + 1``), window, and those shared ends.
It begins with both halves of each length: the one is the trie cut by prefixes, the other holds the edits before
the cut. A cell of more than ``CELL_BYTES`` is cut again, into the halves of its window, until it fits or its
window is one place; then it holds no more than one word of each length for a character of the alphabet. So no
prefix or ending is too frequent, nothing is left out, and each pair belongs to one cell.

Each task builds the tries of many cells at once, level by level in numpy, and joins each trie with itself: a node's
active set has the nodes at distance one. Its seeds are the node's siblings (a replaced character) and its
children (an inserted one); an active pair goes on to the pairs of children with the same character. Terminal
pairs are emitted. A pair has one derivation, whose edit is at ``i``, and is emitted by the cell of ``i`` alone.

``grouped`` takes for each word the most frequent of the words near to it, if it is frequent enough, as its form, and
follows forms to the last one by pointer doubling: frequencies grow along a chain, so there are no cycles.

Edge cases: null texts have no words, a null id is spelled as the empty string; empty tables give empty results. Words
of any length are whole: one window of a long word is never cut by bytes, only by words. Only the id and text
columns are read, so other columns can have any name. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Bytes of a cell's words, with ``WORD_BYTES`` for each, above which it is cut; bytes that a task joins at a time.
CELL_BYTES = 1 << 20
WORD_BYTES = 48
TASK_BYTES = 4 << 20
#: A run of letters: ASCII and Latin-1 from U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least_chars: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): words of ``least_chars`` characters and ``least_n`` occurrences.

    One run in ``one_in``, by the CRC of id and run, loses a character; all others are words as they are.
    Counts are added up before they are shuffled.
    """
    # shorter runs can't become words, as a run only ever loses characters
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    run = rows.select("id", F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = run.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, m, a, b) with the ends that all pairs of the window share."""
    ending = F.when(F.col("m") > F.col("b"), F.expr("right(word, m - b)")).otherwise(F.lit(""))
    return rows.select("word", "n", "m", "a", "b", F.expr("left(word, a)").alias("head"), ending.alias("tail"))


_CELL = ["m", "a", "b", "head", "tail"]


def cells(vocab: DataFrame, *, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(word, n, m, a, b, head, tail): the vocabulary by cells of two words or more, none too large, written."""
    size = F.length("word")
    lengths = F.explode(F.array(size, size - 1))  # as the shorter or equal, and as the longer one of a pair
    half = ((F.col("m") + 1) / 2).cast("int")
    windows = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b"))))
    todo = vocab.select("word", "n", lengths.alias("m")).where("m > 0").withColumn("w", windows).select("word", "n", "m", "w.a", "w.b")
    done: DataFrame | None = None
    while True:
        rows = written(_keyed(todo), "cells")
        # a cell needs a word of the shorter length
        sizes = rows.groupBy(*_CELL).agg(F.count("*").alias("words"), F.min(F.length("word")).alias("least"), F.sum(F.octet_length("word") + WORD_BYTES).alias("weight"))
        sizes = sizes.where("words > 1 and least = m").withColumn("large", (F.col("weight") > cell_bytes) & (F.col("b") - F.col("a") > 1))
        sized = written(rows.join(sizes.select(*_CELL, "large"), _CELL), "sized")
        fit = sized.where("not large").drop("large")
        done = fit if done is None else done.union(fit)
        if not sized.where("large").take(1):
            return done
        middle = ((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))))
        todo = sized.where("large").select("word", "n", "m", parts.alias("w")).select("word", "n", "m", "w.a", "w.b")


class _Tries:
    """The tries of several cells: node ids in order of level, parent and character; the roots come first."""

    def __init__(self, cell: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Words in order of cell and characters; ``begin`` and ``size`` of each in ``data``."""
        roots = int(cell[-1]) + 1
        parents, chars, levels, self.end_of = [np.full(roots, -1)], [np.zeros(roots, np.int64)], [0, roots], np.full(len(cell), -1)
        node, live, depth, made = cell.copy(), np.arange(len(cell)), 0, roots
        self.end_of[size == 0] = cell[size == 0]
        live = live[size[live] > 0]
        while len(live):
            char, above = data[begin[live] + depth].astype(np.int64), node[live]
            new = np.ones(len(live), bool)
            new[1:] = (char[1:] != char[:-1]) | (above[1:] != above[:-1])
            parents.append(above[new])
            chars.append(char[new])
            node[live] = made + np.cumsum(new) - 1
            made += int(new.sum())
            levels.append(made)
            depth += 1
            ended = live[size[live] == depth]
            self.end_of[ended] = node[ended]
            live = live[size[live] > depth]
        self.parent, self.char, self.levels = np.concatenate(parents), np.concatenate(chars), np.array(levels)
        self.key = self.parent[roots:] * 256 + self.char[roots:]  # ascending
        self.roots = roots
        self.first = np.searchsorted(self.parent[roots:], np.arange(made), "left") + roots
        self.degree = np.searchsorted(self.parent[roots:], np.arange(made), "right") + roots - self.first
        self.word = np.full(made, -1)
        self.word[self.end_of[self.end_of >= 0]] = np.flatnonzero(self.end_of >= 0)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``nodes``, child) for all children."""
        degree = self.degree[nodes]
        which = np.repeat(np.arange(len(nodes)), degree)
        step = np.arange(len(which)) - np.repeat(np.cumsum(degree) - degree, degree)
        return which, self.first[nodes][which] + step

    def same_char(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node with that character, or -1."""
        key = nodes * 256 + chars
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at + self.roots, -1)

    def joined(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, word, place of the edit) of all terminal pairs at distance one; the longer word second."""
        none = np.zeros(0, np.int64)
        x, y, at = none, none, none
        for level in range(len(self.levels) - 1):
            # seeds: later siblings and children of this level's nodes
            low, high = self.levels[level], self.levels[level + 1]
            nodes = np.arange(low, high)
            which, child = self.children(nodes)
            if level:
                left = self.first[self.parent[nodes]] + self.degree[self.parent[nodes]] - nodes - 1
                other = np.repeat(nodes, left)
                sibling = other + 1 + np.arange(len(other)) - np.repeat(np.cumsum(left) - left, left)
                seeds = [(other, sibling, np.full(len(other), level - 1))]
            else:
                seeds = []
            seeds.append((nodes[which], child, np.full(len(child), level)))
            x, y, at = (np.concatenate([old, *(s[k] for s in seeds)]) for k, old in enumerate((x, y, at)))
            both = (self.word[x] >= 0) & (self.word[y] >= 0)
            if both.any():
                yield self.word[x[both]], self.word[y[both]], at[both]
            # active pairs go down by equal characters; a parent and its child are seeds of the next level themselves
            if not len(self.key):
                return
            which, child = self.children(x)
            match = self.same_char(y[which], self.char[child])
            keep = (match >= 0) & (self.parent[match] != child)
            x, y, at = child[keep], match[keep], at[which[keep]]


def near_pairs(cell: np.ndarray, words: list[bytes], m: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs at distance one whose edit lies in the window of their cell; words in Latin-1, in order of cell and word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    offset = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words), np.uint8)
    middle = size - a - np.maximum(m - b, 0)  # without the ends that the whole cell shares
    order = np.arange(len(words))
    tries = _Tries(cell, data, offset + a, middle)
    left, right = [order[:0]], [order[:0]]
    for x, y, at in tries.joined():
        place = at + a[x]
        ok = (np.minimum(size[x], size[y]) == m[x]) & (place >= a[x]) & (place < b[x])
        left.append(x[ok])
        right.append(y[ok])
    return np.concatenate(left), np.concatenate(right)


def _joined_cells(task_bytes: int):
    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
        one, two = rows["one"].to_numpy(), rows["two"].to_numpy()
        cell = np.concatenate([[0], np.cumsum((one[1:] != one[:-1]) | (two[1:] != two[:-1]))])
        m, a, b, n = (rows[c].to_numpy().astype(np.int64) for c in ("m", "a", "b", "n"))
        x, y = near_pairs(cell, words, m, a, b)
        own, other = np.concatenate([x, y]), np.concatenate([y, x])
        text = pa.array(rows["word"].to_pylist(), pa.string())
        return pa.RecordBatch.from_arrays([text.take(pa.array(own)), text.take(pa.array(other)), pa.array(n[other], pa.int64())], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += batch.nbytes
            if weight < task_bytes:
                continue
            rows = pa.Table.from_batches(held)
            one = rows["one"].to_numpy()
            cut = int(np.searchsorted(one, one[-1]))  # the last cell may go on
            if cut:
                yield pairs_of(rows.slice(0, cut))
            rest = rows.slice(cut)
            held, weight = rest.to_batches(), rest.nbytes if cut else weight
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return run


def near_words(vocab: DataFrame, *, cell_bytes: int = CELL_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(word, near, near_n): all pairs of words at distance one, in both orders, each once."""
    rows = cells(vocab, cell_bytes=cell_bytes)
    rows = rows.select("word", "n", "m", "a", "b", F.xxhash64(*_CELL).alias("one"), F.xxhash64(*_CELL[::-1], F.lit(2)).alias("two"))
    dealt = rows.repartition("one", "two").sortWithinPartitions("one", "two", "word")
    return dealt.mapInArrow(_joined_cells(task_bytes), "word string, near string, near_n long")


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms, by pointer doubling; chains have no cycles."""
    up = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(up.join(over, "root", "left"), "forms")
        if not step.where("next is not null").take(1):
            return up
        up = step.select("word", F.coalesce("next", "root").alias("root"))


def grouped(vocab: DataFrame, *, ratio: int = 5, cell_bytes: int = CELL_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """For each word of ``vocab`` (word, n): its form and its n, the root of its group, and how many words are near.

    The form is the near word of largest n, ties by code points, if that n is ``ratio`` times the word's or more.
    """
    vocab = written(vocab, "words")
    pairs = near_words(vocab, cell_bytes=cell_bytes, task_bytes=task_bytes)
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best"))
    joined = vocab.join(near, "word", "left").withColumn("form_n", -F.col("best.k"))
    joined = joined.withColumn("form_n", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n")))
    rows = written(joined.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "near")
    roots = last_forms(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents."""
    return grouped(vocabulary(documents))


#: The CRC of id and run byte by byte, with the table that follows from its polynomial; near words by a
#: place of one and the characters around it (replaced) or left out (inserted).
ORACLE = r"""
with recursive crc as (select list(list_reduce(list_concat([i], range(8)), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as tab from range(256) r(i)),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select doc_id, run, count(*) as k, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs group by doc_id, run),
h as (select run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda p: 16 * (instr('0123456789ABCDEF', x[2 * p + 1]) - 1) + instr('0123456789ABCDEF', x[2 * p + 2]) - 1)),
      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) as h from d, crc),
w as (select case when h % 199 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, k from h),
v as (select word, cast(sum(k) as bigint) as n from w where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, unnest(range(length(word))) as p from v),
gap as (select word, n, p, word[1:p] as l, word[p + 2:] as r from cut),
del as (select distinct word, n, l || r as less from gap),
near as (select a.word, b.word as near, b.n as near_n from gap a join gap b on a.p = b.p and a.l = b.l and a.r = b.r and a.word <> b.word
  union all select del.word, v.word, v.n from del join v on v.word = del.less union all select v.word, del.word, del.n from del join v on v.word = del.less),
best as (select word, count(*) as n_near, max(near_n) as top, arg_min(near, (-near_n, near)) as near from near group by word),
f as (select v.word, case when best.top >= 5 * v.n then best.near end as form, v.n, coalesce(n_near, 0) as n_near, case when best.top >= 5 * v.n then best.top end as form_n from v left join best using (word)),
chain(word, top_form) as (select word, form from f where form is not null union all select chain.word, f.form from chain join f on f.word = chain.top_form where f.form is not null)
select f.word, f.form, coalesce(ends.top_form, f.word) as root, f.n, f.n_near, f.form_n
from f left join (select chain.word, chain.top_form from chain join f on f.word = chain.top_form where f.form is null) ends on ends.word = f.word
"""
