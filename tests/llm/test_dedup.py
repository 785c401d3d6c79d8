"""Near-duplicates, repeated substrings and fingerprints against brute force and edge cases."""

import collections
import hashlib
import re
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from oscilla.llm import fingerprints, minhash, sketching, substrings, suffixes
from oscilla.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = SPACE.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {k: k for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) or sets[a][0] == sets[b][0]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    least = collections.defaultdict(lambda: 1 << 60)
    for k, v in label.items():
        least[v] = min(least[v], sets[k][0])
    return sorted((sets[k][0], len(sets[k][1]), least[label[k]], sets[k][0] == least[label[k]]) for k in range(len(rows)))


def corpus(seed, copies=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, n)) for n in (3, 5, 6, 40, 80, 200)]
    rows = []
    for words in base:
        for _ in range(copies):
            edited = list(words)
            for _ in range(rng.integers(0, max(1, len(words) // 18) + 1)):
                edited[rng.integers(len(edited))] = str(rng.choice(vocabulary))
            rows.append(" ".join(edited))
    rows += ["", None, "  \t ", "One", "one", "ONE two", rows[-1].upper(), "z " * 60000]
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[k]) for i, k in enumerate(order)]


def test_words_on_which_sums_of_powers_collide_are_told_apart(spark):
    """Words of Thue-Morse letters and of their complements have one sum of powers modulo 2^64, whatever the base."""
    rows = []
    for k, size in enumerate((1 << 10, 1 << 12, 1 << 16)):
        bits = [bin(i).count("1") & 1 for i in range(size)]
        for j, letters in enumerate(("ab", "ba")):
            word = "".join(letters[b] for b in bits)
            rows += [(4 * k + 2 * j, word), (4 * k + 2 * j + 1, f"one two {word} three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.op3_near_duplicates(df).collect())
    assert got == near_groups(rows) and all(r[3] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    rows = corpus(seed)
    rows += [rows[5], rows[7]]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == near_groups(rows)
    left = minhash.keep_one(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, _, c, kept in got if kept}


def test_texts_that_share_an_id_are_one_document(spark):
    a, b = "a b c d e f g", "p q r s t u v w"
    rows = [(3, a), (5, a), (5, b), (7, b), (9, "x y"), (None, b), (8, ""), (8, "x y")]
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (9, 8), (None, 3), (8, 8), (8, 8)], key=str)


def test_links_across_blocks_are_found(spark, monkeypatch):
    """Two families that are near only through single members, in blocks of a few members each."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 6000)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for k in range(60):  # each is near its neighbours in the chain and far from the ends of it
        rows.append((k, " ".join([f"n{k + i}" if i < 20 else w for i, w in enumerate(base)])))
    for k in range(60):
        words = list(base)
        for i in range(k // 4):
            words[10 * i] = f"c{i}"
        rows.append((100 + k, " ".join(words + [f"own{k}"])))
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_groups(rows)


def test_work_on_one_group_grows_with_its_size():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 1 << 62, 300)).astype(np.uint64)
    seconds = []
    for n in (300, 3000):
        sets = [np.unique(np.where(rng.random(300) < 0.02, rng.integers(0, 1 << 62, 300).astype(np.uint64), base)) for _ in range(n)]
        start = time.perf_counter()
        assert len(minhash.joining_links(sets, 75, 100)) == n - 1
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 40 * seconds[0] + 0.5


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (None, "x")], "doc_id long, text string")
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(str, (r.component_id for r in minhash.near_duplicates(df).collect()))) == ["4", "4", "4", "None"]


def test_sketches_estimate_similarity_and_fill_for_tiny_sets():
    rng = np.random.default_rng(0)
    for similarity in (0.2, 0.5, 0.8):
        same = int(600 * similarity)
        all_ = rng.integers(0, 1 << 63, 600, dtype=np.int64).astype(np.uint64)
        a, b = all_[: same + (600 - same) // 2], np.concatenate([all_[:same], all_[same + (600 - same) // 2 :]])
        share = (sketching.sketch(a, 512) == sketching.sketch(b, 512)).mean()
        assert abs(share - similarity) < 0.08
    one = sketching.sketch(np.array([42], np.uint64), 200)
    assert (one != np.iinfo(np.uint64).max).all()


def test_components_of_chains_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (101, 100)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_suffix_order(values):
    text = np.array(values)
    assert suffixes.suffix_order(text).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def shared(a, b, cap):
    k = 0
    while k < min(len(a), len(b), cap) and a[k] == b[k]:
        k += 1
    return k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.sampled_from([3, 1000]), st.sampled_from([1, 5, 1000]), st.sampled_from([2, 7, 64]), st.integers(1, 4))
def test_suffixes_and_their_common_prefixes(values, cap, limit, batch, repeated):
    values = values * repeated
    old = suffixes.BATCH
    suffixes.BATCH = batch
    try:
        order, prefixes = suffixes.sorted_suffixes(np.array(values, np.int32), max(values) + 1, cap, limit)
    finally:
        suffixes.BATCH = old
    assert sorted(order.tolist()) == list(range(len(values)))
    assert [values[i:][:cap] for i in order] == sorted(values[i:][:cap] for i in range(len(values)))
    assert prefixes.tolist()[1:] == [shared(values[a:], values[b:], cap) for a, b in zip(order, order[1:])]


def test_suffixes_of_long_pieces():
    """Pieces longer than a packed key, some ending where others go on, and repeats of them."""
    rng = np.random.default_rng(7)
    falls = [[*range(k, 0, -1)] for k in (7, 8, 9, 15, 16, 30)]
    values = [v for k in rng.integers(0, 6, 150) for v in falls[k][: rng.integers(1, 31)]] * 2
    for cap in (5, 9, 40, 5000):
        order, prefixes = suffixes.sorted_suffixes(np.array(values, np.int32), 31, cap, 100)
        assert [values[i:][:cap] for i in order] == sorted(values[i:][:cap] for i in range(len(values)))
        assert prefixes.tolist()[1:] == [shared(values[a:], values[b:], cap) for a, b in zip(order, order[1:])]


def test_queues_go_to_disk_and_come_back_in_order():
    rng = np.random.default_rng(5)
    sent = {k: [] for k in range(700)}
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16))
    queue = suffixes.DiskQueue(np.append(np.arange(0, 600, 3), np.arange(600, 700)), 700, lambda low, high: none, 0, 500)
    for _ in range(40):
        keys = np.sort(2 * rng.integers(0, 700, 300)).astype(np.int32)
        values = rng.integers(0, 1 << 30, 300).astype(np.int32)
        queue.put(keys, values, (values % 100).astype(np.int16))
        for k, v in zip(keys.tolist(), values.tolist()):
            sent[k // 2].append(v)
    assert queue.file is not None and queue.held <= 500
    got = []
    while (entries := queue.next(64)) is not None:
        got += list(zip(*(x.tolist() for x in entries)))
        queue.drop(len(entries[0]))
    assert got == [(2 * k, v, v % 100) for k in range(700) for v in sent[k]]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 90))
@settings(deadline=None, max_examples=200)
def test_doubling_sorts_suffixes_and_finds_common_prefixes(values, cap):
    order, shared = suffixes.doubled_suffixes(np.array(values, np.int32), cap)
    cut = [values[i : i + cap] for i in order]
    assert sorted(order.tolist()) == list(range(len(values))) and cut == sorted(cut)
    for a, b, got in zip(cut, cut[1:], shared[1:].tolist()):
        assert got == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert shared[0] == 0


def test_a_shard_larger_than_the_memory_allowed(monkeypatch):
    """3 MB of strings, with arrays in memory kept below that, and every window of them as by counting."""
    monkeypatch.setattr(suffixes, "BATCH", 1 << 12)
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    strings = [" ".join(rng.choice(vocabulary, 60)) for _ in range(7500)]
    strings += [x[20:300] for x in strings[:300]] + [strings[5]]
    raw = [x.encode() for x in strings]
    size = sum(map(len, raw))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    body = np.frombuffer(b"".join(raw), np.uint8)
    shard = suffixes.Shard(200, limit=1 << 15, memory=0)
    tracemalloc.start()
    base = tracemalloc.get_traced_memory()[0]
    shard.add(body, offsets, np.ones(len(raw), np.int64))
    tracemalloc.reset_peak()
    got = {k: hit.copy() if hit.any() else None for k, hit in shard.repeats()}
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    seen = collections.Counter(hash(x[p : p + 200]) for x in raw for p in range(len(x) - 199))
    for k, x in enumerate(raw):
        want = [seen[hash(x[p : p + 200])] > 1 for p in range(len(x) - 199)]
        assert (got[k].tolist() if got[k] is not None else [False] * len(want)) == want
    assert size > 2.7e6 and peak < size, (size, peak)


def test_arrays_in_memory_give_their_bytes_back():
    disk = suffixes.Disk(100)
    one, two = disk.array(np.int32, 20), disk.array(np.int32, 20)
    assert disk.memory == 20
    view = one[3:]
    del one
    assert disk.memory == 20
    del view
    assert disk.memory == 100 and (two == 0).all()


def removed(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[p : p + length] for _, x in raw for p in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        cover = np.zeros(len(x) + 1, int)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((str(i), len(x), int(hit.sum()), spans, hashlib.sha256(bytes(b for b, h in zip(x, hit) if not h)).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = np.random.default_rng(seed)

    def prose(n):
        return "".join(rng.choice(list("abcdefghij é"), n))

    shared = [prose(n) for n in (150, 199, 200, 201, 420)]
    rows = [prose(300) + shared[k % 5] + prose(40 * k % 300) for k in range(40)]
    rows += [None] + [shared[4] + prose(30)] * 3 + ["a" * 900, "ab" * 300, None, "", "short", shared[4], rows[0], prose(20000) + shared[3], rows[1] * 3, "é" * 250]
    return [(k, t) for k, t in enumerate(rows)] + [(3, rows[3]), (None, rows[9])]


@pytest.mark.parametrize("hot, chunk", [(2048, substrings.CHUNK), (2, substrings.CHUNK), (2048, 37)])
def test_repeated_bytes_equal_brute_force(spark, hot, chunk):
    rows = passages(hot)
    if chunk < 1000:  # texts on their own in a block are taken in parts
        rows += [(90, "x" * 3_000_000), (91, rows[3][1] + "y" * 2_500_000)]
        chunk = 100_003
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    spans = substrings.repeated_bytes(df, hot=hot, chunk=chunk)
    got = spans.mapInArrow(substrings._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == removed(rows)


@pytest.mark.parametrize("chunk", [1, 61, 500])
def test_parts_of_a_long_text_have_the_windows_and_anchors_of_the_whole(chunk):
    rng = np.random.default_rng(chunk)
    raw = rng.integers(97, 100, 4000).astype(np.uint8)

    def windows(s):
        return sorted((w, int(g), int(low + a)) for g, low, high, a in zip(s["gram"], s["low"], s["high"], s["anchor"]) for w in range(low, high + 1))

    whole = substrings.segments(raw, np.array([0, 4000]), 200)
    found = [x for _, s in substrings._parts(raw, np.array([0, 4000]), 200, chunk) for x in windows(s)]
    assert sorted(found) == windows(whole) and len(found) == 3801


def test_places_beyond_the_bits_are_an_error(monkeypatch):
    monkeypatch.setattr(substrings, "PLACE", np.uint64(10))
    with pytest.raises(ValueError):
        substrings.segments(np.zeros(3000, np.uint8), np.array([0, 3000]), 200)


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert substrings.op7_suffix_dedup(df.limit(0)).count() == 0
    assert substrings.op7_suffix_dedup(df).first().n_removed == 0
    assert substrings.without_repeats(df).first().text == "only one"


def edited(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        changed = t[: len(t) - n] + following[:n]
        a, b, c = (fingerprints.signature(*fingerprints.phrases(x)) for x in (t, changed, following))
        out[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.fingerprint(a), fingerprints.fingerprint(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    return out


def test_fingerprints_equal_the_plain_way(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i) * 7 - 30, "".join(rng.choice(list("the cat sãt 🎉"), int(n)))) for i, n in enumerate(rng.integers(0, 400, 60))]
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, "xy" * 60000), (1004, "abc " * 50), (1005, "abc " * 50)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in fingerprints.op10_fingerprints(df).collect()}
    assert got == edited(rows)
    assert got[1004][2] == got[1005][2] and got[1004][5] == 1.0


def test_fingerprints_of_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "alone alone")], "doc_id long, text string")
    row = fingerprints.op10_fingerprints(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(("alone " + "alone").encode()).hexdigest()
    assert fingerprints.op10_fingerprints(one.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "aa"), (1, "aa"), (2, "bb"), (None, "cc")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fingerprints.op10_fingerprints(same).collect()) == ["1", "1", "2", "None"]


def test_ranges_cut_within_an_id(spark):
    rows = [(None if k % 3 else k, f"text {k * 7919 % 90} " * 20) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = fingerprints.with_next(df, part_bytes=500)
    null_parts = {r.part for r in dealt.where("id is null and ahead = 0").select("part").collect()}
    assert len(null_parts) > 3
    got = fingerprints.op10_fingerprints(df)
    assert got.count() == 90 and got.where("doc_id is null").count() == 60
    whole = [r for r in dealt.collect() if not r.ahead]
    assert sorted((str(r.id), r.text) for r in whole) == sorted((str(i), t) for i, t in rows)
    # each row is followed by the next in order, across ranges too
    order = df.select("doc_id", F.xxhash64("text").alias("h"), "text").orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()
    following = {hashlib.sha256(((a.text[: len(a.text) - len(a.text) // 2]) + b.text[: len(a.text) // 2]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1])}
    assert {r.edited_sha256 for r in got.collect()} == following
    cuts = np.array([-5, 3, 3, 3, 9]), np.array([0, -7, 2, 8, 1])
    got = fingerprints._range_of(np.array([-9, -5, 0, 3, 3, 3, 3, 9, 9, 10]), np.array([0, 0, 0, -9, -7, 1, 8, 0, 1, 0]), *cuts)
    assert got.tolist() == [0, 0, 0, 0, 1, 1, 3, 3, 4, 4]


def test_likeness_follows_shared_phrases():
    rng = np.random.default_rng(9)
    a, b = ("".join(rng.choice(list("abcdefgh "), 4000)) for _ in range(2))
    sign = lambda t: fingerprints.signature(*fingerprints.phrases(t))
    assert fingerprints.likeness(sign(a), sign(a)) == 1 > fingerprints.likeness(sign(a), sign(a[:2000] + b[:2000])) > fingerprints.likeness(sign(a), sign(b)) - 0.01
