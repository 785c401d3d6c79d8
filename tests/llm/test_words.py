"""Spelling variants, the prefix trie of conversations and token counts against brute force and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oscilla.llm import catalog, prefixtrie, tokens, variants

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 7) for i, t in rows], SCHEMA)


# --- token counts

PIECES = ["a", "bc", "Z", "é", "é", "̈", "'s", "'", "1", "<|endoftext|>", "<s>", "中", "Σ", "!", "İ", "▁", ".", ",", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "\x00"]


def loaded(name, cut=None):
    with open(public_tokenizers.path(name), "rb") as file:
        return tokens.counter(name, file.read(), cut or tokens.CUTS[name])


@pytest.mark.parametrize("window", [1 << 22, 16])
@pytest.mark.parametrize("name", sorted(tokens.CUTS))
@settings(deadline=None, max_examples=150)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.text(max_size=30)), max_size=8))
def test_cut_texts_have_as_many_tokens_as_whole_ones(name, window, texts):
    own = loaded(name)
    before, tokens.WINDOW = tokens.WINDOW, window
    try:
        got = own.lengths(pa.array(texts, pa.string())).tolist()
    finally:
        tokens.WINDOW = before
    assert got == [own.encoded([t])[0] if t else 0 for t in texts]


def test_no_entry_has_a_prefix_behind_other_characters():
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert not [p for p in map(own.id_to_piece, range(own.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_long_texts_with_and_without_boundaries(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 1000)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64)
    monkeypatch.setattr(tokens, "KNOWN", 3)
    own = tokens.Counter("word_bpe_49k.json", open(public_tokenizers.path("word_bpe_49k.json"), "rb").read(), "spaces")
    texts = ["x" * 20000, "one two, three. " * 2000, "", "é" * 5000 + " a" * 3000]
    assert own.lengths(pa.array(texts)).tolist() == [own.encoded([t])[0] for t in texts]
    assert len(own.known) <= 3 + 64


def test_token_counts_of_any_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "Hello world. " * 900), (3, "Hello world. " * 900), (None, "a<|endoftext|>b"), (5, " \n ")]
    own = loaded("word_bpe_49k.json")
    got = sorted(map(tuple, tokens.op13_token_counts(docs(spark, rows), path).collect()), key=str)
    want = [(i, len((t or "").encode()), n := own.encoded([t or ""])[0], n > 2048) for i, t in rows]
    assert got == sorted(want, key=str) and {r[3] for r in got} == {True, False}
    assert tokens.op13_token_counts(docs(spark, rows).limit(0), path).collect() == []
    with pytest.raises(ValueError):
        tokens.Counter("vocabulary.txt", b"", "whole")
    with pytest.raises(ValueError):
        tokens.Counter("x.json", b"", "words")


def test_query_equals_the_tokenizer_on_whole_texts(spark):
    own = loaded("word_bpe_49k.json")
    there = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.queries()["op13_token_counts"](spark, FOLDER).collect()}
    want = {r["doc_id"]: (len(r["text"].encode()), n := own.encoded([r["text"]])[0], n > 2048) for r in there}
    assert got == want


# --- spelling variants


def near(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain_vocabulary(rows, least_chars, least_n, one_in):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            found[run[:k] + run[k + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least_n}


def plain_groups(vocab, ratio):
    out, form = {}, {}
    for w, n in vocab.items():
        by = [(-vocab[u], u) for u in vocab if u != w and near(u, w)]
        best = min(by, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form[w], None, n, len(by), vocab[form[w]] if form[w] else None]
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


def some_words(seed, size=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(size // 4)] + ["prefix" + x + "suffix" for x in "abcdef"] + ["ab", "a", "aab", "aaab"]
    out = set(base)
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            out.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzÿ") + w[k:], w[:k] + rng.choice("abzÿ") + w[k + 1 :]]))
    return {w: 5 ** rng.randint(0, 6) for w in out if w}


@pytest.mark.parametrize("cell_bytes, task_bytes", [(1 << 20, 1 << 21), (400, 1000), (1, 1)])
def test_groups_equal_brute_force_however_cells_are_cut(spark, cell_bytes, task_bytes):
    vocab = some_words(cell_bytes)
    df = spark.createDataFrame(sorted(vocab.items()), "word string, n long")
    got = sorted(map(tuple, variants.grouped(df, cell_bytes=cell_bytes, task_bytes=task_bytes).collect()))
    assert got == plain_groups(vocab, 5)


@pytest.mark.parametrize("seed", range(12))
def test_each_pair_is_joined_in_one_cell(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab" if seed % 2 else "abcé") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    cells = {}
    for w in words:
        for m in (len(w), len(w) - 1):
            cuts = sorted({0, m + 1, *(random.Random(f"{m}{seed}").randint(0, m + 1) for _ in range(2))}) if m else []
            for a, b in zip(cuts, cuts[1:]):
                cells.setdefault((m, a, b, w[:a], w[len(w) - (m - b) :] if m > b else ""), []).append(w)
    rows = [(key, w) for key, own in sorted(cells.items()) for w in own]
    cell = np.cumsum([0] + [rows[i][0] != rows[i - 1][0] for i in range(1, len(rows))])
    x, y = variants.near_pairs(cell, [w.encode("latin-1") for _, w in rows], *(np.array([k[j] for k, _ in rows]) for j in range(3)))
    got = [tuple(sorted((rows[i][1], rows[j][1]))) for i, j in zip(x, y)]
    assert sorted(got) == [(u, w) for u in words for w in words if u < w and near(u, w)]


def test_no_cell_is_larger_than_its_limit_but_for_windows_of_one_place(spark):
    hot = [("stem" + a + b + c + "ending", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    found = variants.cells(spark.createDataFrame(hot, "word string, n long"), cell_bytes=2000).withColumn("weight", F.octet_length("word") + variants.WORD_BYTES)
    worst = found.groupBy("m", "a", "b", "head", "tail").agg(F.sum("weight").alias("weight")).where("b - a > 1").agg(F.max("weight")).first()[0]
    assert worst <= 2000
    pairs = variants.near_words(spark.createDataFrame(hot, "word string, n long"), cell_bytes=2000)
    assert pairs.count() == pairs.distinct().count() == 8**3 * 21


def test_very_long_words(spark):
    long = "ab" * 3000
    vocab = {long: 100, long + "c": 7, long[1:]: 7, "x" * 2500: 5, "x" * 2501: 30, long[:3000] + "z" + long[3001:]: 8}
    got = sorted(map(tuple, variants.grouped(spark.createDataFrame(sorted(vocab.items()), "word string, n long")).collect()))
    assert got == plain_groups(vocab, 5)


def test_vocabulary_and_edge_cases(spark):
    rng = random.Random(1)
    names = ["Straße", "STRASSE", "naïveté", "Àlpha", "àlpha", "x×y÷zab", "letters", "Letter"]
    rows = [(rng.choice([None, -3, k]), " ".join(rng.choices(names, k=30)) + "1" + "longword" * (k % 3)) for k in range(40)] + [(1, None), (2, ""), (3, "7 8"), (4, "letters"), (4, "letters")]
    for one_in in (199, 3):
        got = dict(map(tuple, variants.vocabulary(docs(spark, rows), one_in=one_in).collect()))
        assert got == plain_vocabulary(rows, 6, 5, one_in)
    assert variants.op11_spelling_variants(docs(spark, rows).limit(0)).collect() == []
    assert variants.op11_spelling_variants(docs(spark, [(1, None), (2, "a b c")])).collect() == []


# --- prefix trie


def plain_trie(sequences):
    """The nodes of conversations {c: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)

    def subtree(key):
        todo, out = [key], []
        while todo:
            out.append(todo.pop())
            todo += kids[out[-1]]
        return out

    rows = []
    for key, own in members.items():
        below = subtree(key)
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        parent = min(members[key[:-1]]) if key else None
        rows.append((min(own), len(key), parent, len(own), len(kids[key]), sum(not kids[k] for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def plain_order(rows):
    """{c: turns in order} of rows (c, turn, role, text)."""
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(own)] for c, own in out.items()}


def plain_rebuilt(own):
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + seq[h:]
    return out


def talks(seed, size=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), size):
        for t in range(rng.choice([1, 3, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "user", "assistant", None]), rng.choice(["", "é", "yes", None, "no"])))
    rows += [(7, 0, "user", "same")] * 3 + [(None, 1, "user", "lost")] + [(500 + k, t, "user", f"t{t}") for k in range(30) for t in range(3)]
    rng.shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_rows, fan, block", [(1 << 16, 16, 1 << 12), (7, 2, 2)])
def test_trie_equals_brute_force(spark, part_rows, fan, block):
    rows = talks(fan)
    df = spark.createDataFrame([(*r, 1) for r in rows], CONVERSATIONS + ", depth int")
    ranks = prefixtrie.ordered(df, part_rows=part_rows)
    members = prefixtrie.members_of(ranks)
    own = plain_order(rows)
    turns, kept = prefixtrie.rebuilt(ranks, members, group=5, most=8)
    found = prefixtrie.trie(turns, kept, fan=fan, block=block)
    assert sorted(map(tuple, prefixtrie.summary(found).collect()), key=str) == plain_trie(plain_rebuilt(own))
    # the trie of the conversations as they are, with its texts
    plain = prefixtrie.trie(ranks.select("c", F.col("rank").alias("pos"), "digest", "bytes"), members, fan=fan, block=block)
    assert sorted(map(tuple, prefixtrie.summary(plain).collect()), key=str) == plain_trie(own)
    said = {(r.conv_id, r.depth): (r.role, r.text) for r in prefixtrie.with_turns(plain.nodes, df).collect()}
    assert all(said[c, d] == (own[c][d - 1] if d else (None, None)) for c, d in said)


def test_one_conversation_with_most_turns_is_spread(spark):
    rows = [(1, t, "user", f"{t % 3}") for t in range(900)] + [(2, t, "user", f"{t % 3}") for t in range(850)] + [(3, 0, "user", "0"), (4, 0, "user", "x")]
    ranks = prefixtrie.ordered(spark.createDataFrame(rows, CONVERSATIONS), part_rows=50)
    assert ranks.where("c = 1").select("part").distinct().count() > 5
    own = plain_order(rows)
    found = prefixtrie.trie(ranks.select("c", F.col("rank").alias("pos"), "digest", "bytes"), prefixtrie.members_of(ranks), fan=3, block=64)
    assert sorted(map(tuple, prefixtrie.summary(found).collect()), key=str) == plain_trie(own)


def test_colliding_names_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], CONVERSATIONS)
    ranks = prefixtrie.ordered(df)
    monkeypatch.setattr(prefixtrie, "_name", lambda depth, sums: F.concat(depth.cast("string")))
    with pytest.raises(Exception, match="one name"):
        prefixtrie.trie(ranks.select("c", F.col("rank").alias("pos"), "digest", "bytes"), prefixtrie.members_of(ranks))


def test_trie_of_no_conversation(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefixtrie.op12_prefix_trie(empty).collect() == []
    lost = spark.createDataFrame([(None, 0, "user", "a")], CONVERSATIONS)
    assert prefixtrie.op12_prefix_trie(lost).collect() == []
