"""Properties and edge cases of the library's operators."""

import os
import struct
import threading
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import bags, evaluation, labels, spectra, vectors, windows
from oscilla.sources import recordings, signals, tables


def samples(spark, *series):
    return spark.createDataFrame([(i, t, float(x)) for i, s in enumerate(series) for t, x in enumerate(s)], "subject long, t long, x double")


def test_tails_are_dropped_and_short_series_have_no_window(spark):
    rows = samples(spark, range(19), range(7))
    assert [(r.subject, r.win) for r in windows.tumbling(rows, 8).orderBy("subject", "win").collect()] == [(0, 0), (0, 1)]
    assert windows.sliding(rows, 8).count() == 12
    assert [r.seg for r in windows.half_overlapping(rows, 8).orderBy("seg").collect()] == [0, 1, 2]


def test_long_series_slide_in_pieces(spark):
    rows = samples(spark, range(50), range(3))
    whole = sorted(tuple(r) for r in windows.sliding(rows, 8).collect())
    assert whole == sorted(tuple(r) for r in windows.sliding(rows, 8, chunk=9).collect()) == [(0, k, float(sum(range(k, k + 8)))) for k in range(43)]


def test_random_and_scalable_starts_use_all_rows(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 10, (3, 6))
    rows = [(i, [float(x) for x in centers[i % 3] + rng.normal(0, 0.01, 6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    start = vectors.initial_centroids(df, 3, 6, init="k-means++", metric="euclidean", seed=4)
    assert {int(np.argmin(((centers - c) ** 2).sum(1))) for c in start} == {0, 1, 2}
    _, found, inertia = vectors.shift_kmeans(df, 3, 6, metric="euclidean", init="k-means++", max_iter=3)
    assert inertia < 1 and sorted(r["count"] for r in found.groupBy("centroid").count().collect()) == [30, 30, 30]
    for init in ("random", "random-energy"):
        assert vectors.initial_centroids(df, 3, 4, init=init, metric="cosine", seed=1).shape == (3, 4)
    with pytest.raises(ValueError):
        vectors.initial_centroids(df, 91, 6, init="random", metric="cosine", seed=1)
    with pytest.raises(ValueError):
        vectors.initial_centroids(df, 3, 6, init="k-means++", metric="cosine", seed=1)


def test_codebooks_in_blocks_and_spectra_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 5)]) for i in range(40)], "id long, v array<double>")
    book = spark.createDataFrame([(k % 2, k // 2, [float(x) for x in rng.normal(0, 1, 5)]) for k in range(12)], "class int, centroid int, c array<double>")
    one = sorted(map(tuple, vectors.nearest_centroid(df, book).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_VALUES", 13)
    assert sorted(map(tuple, vectors.nearest_centroid(df, book).collect())) == one and len(one) == 80
    rows = spark.createDataFrame([(s, b, float(rng.random())) for s in range(12) for b in range(4)], "subject long, bin int, p double")
    near = sorted(map(tuple, spectra.nearest(rows.where("subject < 6"), rows.where("subject >= 6")).collect()))
    monkeypatch.setattr(spectra, "BLOCK_VALUES", 9)
    assert sorted(map(tuple, spectra.nearest(rows.where("subject < 6"), rows.where("subject >= 6")).collect())) == near and len(near) == 6
    assert spectra.nearest(rows.where("subject < 6"), rows.limit(0)).count() == 0


def test_durations():
    assert windows.seconds_to_units([300, -1], per_second=1 / 1.5) == [200, None]
    assert windows.seconds_to_units(0.5, per_second=256) == 128
    with pytest.raises(ValueError):
        windows.seconds_to_units(10, per_second=1 / 1.5)
    with pytest.raises(TypeError):
        windows.seconds_to_units("10", per_second=1)


def test_rates_sum_to_one_in_each_book_and_segment(spark):
    codes = spark.createDataFrame([(0, t, b, (t * (b + 2)) % 5) for t in range(20) for b in range(2)], "subject long, t long, book int, code int")
    sums = bags.bag(codes, per_segment=8, k=8).groupBy("seg", F.floor(F.col("feature") / 8)).agg(F.sum("rate").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1) for r in sums)


def test_barycenter_of_equal_spectra_is_that_spectrum(spark):
    rows = spark.createDataFrame([(s, c, b, float(b + 1)) for s in range(3) for c in range(2) for b in range(4)], "subject long, channel int, bin int, p double")
    for kind in ("normed", "wasserstein"):
        assert np.allclose([r.p for r in spectra.barycenter(rows, kind).orderBy("bin").collect()], np.arange(1, 5) / 10)
    assert np.allclose([r.p for r in spectra.barycenter(rows, "unnormed").orderBy("bin").collect()], np.arange(1, 5))
    assert np.allclose([r.p for r in spectra.barycenter(rows, "joint").orderBy("bin").collect()], np.arange(1, 5) / 20)


def test_delta_filter_is_the_identity_and_causal(spark):
    rows = samples(spark, [1, 2, 3])
    delta = spark.createDataFrame([(0, 0, 1.0)], "subject long, k int, h double")
    assert [r.y for r in spectra.causal_fir(rows, delta).orderBy("t").collect()] == [1, 2, 3]
    late = spark.createDataFrame([(0, 1, 1.0)], "subject long, k int, h double")
    assert [(r.t, r.y) for r in spectra.causal_fir(rows, late).orderBy("t").collect()] == [(1, 1.0), (2, 2.0)]


def test_nearest_takes_the_lowest_source_on_ties(spark):
    t = spark.createDataFrame([(9, b, 1.0) for b in range(3)], "subject long, bin int, p double")
    s = spark.createDataFrame([(i, b, 1.0) for i in (5, 3) for b in range(3)], "subject long, bin int, p double")
    assert spectra.nearest(t, s).first().source == 3


def test_packing_round_trip(spark):
    rows = samples(spark, [3, 1, 2], [5])
    assert sorted(signals.unpacked(signals.packed(rows)).collect()) == sorted(rows.collect())


def test_shifted_copies_are_found_and_centroids_are_means(spark):
    rng = np.random.default_rng(1)
    shapes = rng.normal(size=(2, 8))
    rows = [(i, np.roll(np.pad(shapes[i % 2], (0, 4)), i % 5).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centers, found, inertia = vectors.shift_kmeans(df, 2, 8, metric="cosine", init=shapes, max_iter=5)
    assert inertia == pytest.approx(0, abs=1e-9) and found.count() == 40
    assert {(r.id % 2, r.centroid) for r in found.collect()} == {(0, 0), (1, 1)}
    for init, metric in (("random", "cosine"), ("random-energy", "euclidean"), ("k-means++", "euclidean")):
        assert vectors.shift_kmeans(df, 2, 8, metric=metric, init=init, max_iter=3)[0].shape == (2, 8)
    with pytest.raises(ValueError):
        vectors.shift_kmeans(df, 2, 8, init="k-means++")


def test_empty_clusters_are_zero_vectors(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0])], "centroid int, shift int, v array<double>")
    rows = vectors.centroid_update(df, 2, 2).orderBy("centroid").collect()
    assert rows[0].c == [1.0, 2.0] and rows[1].c == [0.0, 0.0] and rows[1].n == 0


def test_batched_and_declarative_assignments_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(20)], "id long, v array<double>")
    book = rng.normal(size=(3, 4))
    code = spark.createDataFrame([(0, i, c.tolist()) for i, c in enumerate(book)], "class int, centroid int, c array<double>")
    for metric in ("cosine", "euclidean"):
        a = {r.id: (r.centroid, r.shift) for r in vectors.shifted_nearest(df, code, metric).collect()}
        assert a == {r.id: (r.centroid, r.shift) for r in vectors.assigned(df, {0: book}, metric).collect()}


def test_f1_without_positives_is_zero_and_votes_take_the_smallest(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "g string, y int, pred int")
    assert {r.g: r.f1 for r in evaluation.f1(rows, ["g"]).collect()} == {"a": 0.0, "b": 1.0}
    votes = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (0, 1)], "subject long, pred int")
    assert evaluation.majority(votes, ["subject"]).first().pred == 1


def test_skip_rule():
    assert evaluation.skip_short(10, 5, True) and evaluation.skip_short(None, 5, True)
    assert not evaluation.skip_short(10, None, True) and not evaluation.skip_short(10, 5, False)


def test_best_candidate_is_the_lowest_of_equal_ones(spark):
    scores = spark.createDataFrame([(c, s, 0.5) for c in (4, 2) for s in range(2)], "candidate long, split int, score double")
    assert labels.best_candidate(labels.cv_table(scores)).first().candidate == 2


def test_missing_filters_fail_only_where_required(spark):
    series, filters = spark.createDataFrame([(1,), (2,)], "subject int"), spark.createDataFrame([(1, [1.0])], "subject int, taps array<double>")
    assert tables.with_filters(series, filters, required=False).where("taps is null").count() == 1
    with pytest.raises(Exception, match="no filter for subject 2"):
        tables.with_filters(series, filters).collect()


def test_results_files_round_trip_and_missing_columns_fail(spark, tmp_path):
    rows = spark.createDataFrame([(0.15, 1, 0.79, 34)], tables.RESULT_SCHEMA)
    tables.write_results(rows, f"file://{tmp_path}/r")
    back = tables.read_results(spark, f"file://{tmp_path}/r")
    assert back.drop("file").collect() == rows.collect() and back.first().file.endswith(".csv")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_results(spark, f"file://{tmp_path}/bad.csv")


def test_caches_are_told_apart_by_every_parameter(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for resampled in (False, True, False):
        assert tables.build_or_load(spark, f"file://{tmp_path}", "x", build, subjects=[35, 1], resampled=resampled).count() == 3
    assert len(built) == 2


def test_codebooks_by_class(spark, tmp_path):
    book = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [2.0])], "class int, centroid int, c array<double>")
    tables.write_codebooks(book, f"file://{tmp_path}/b")
    assert tables.read_codebooks(spark, f"file://{tmp_path}/b", [1]).first().c == [2.0]
    with pytest.raises(ValueError):
        tables.read_codebooks(spark, f"file://{tmp_path}/b", [1, 7])


def mat_file(**matrices):
    """A MAT v5 file with one compressed element for each matrix."""

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0".ljust(124, b" ") + b"\x00\x01IM"
    for name, value in matrices.items():
        logical = value.dtype == bool
        body = element(6, struct.pack("<II", 6 | (0x200 if logical else 0), 0)) + element(5, struct.pack("<2i", *value.shape)) + element(1, name.encode())
        packed = zlib.compress(element(14, body + (element(2, value.astype("u1").tobytes("F")) if logical else element(9, value.astype("<f8").tobytes("F")))))
        out += struct.pack("<II", 15, len(packed)) + packed
    return out


def test_recordings_are_unmixed(spark, tmp_path):
    w, s, x = np.array([[1.0, 2.0], [0.0, 1.0]]), np.eye(2) * 2, np.arange(6.0).reshape(2, 3)
    raw = mat_file(data=x, srate=np.array([[256.0]]), icaweights=w, icasphere=s, labels=np.array([[1.0], [7.0]]), expert_label_mask=np.array([[True], [False]]))
    (tmp_path / "subj-07.mat").write_bytes(raw)
    rows = recordings.recordings(spark, f"file://{tmp_path}").orderBy("ic").collect()
    assert np.allclose([r.samples for r in rows], w @ s @ x)
    assert [(r.subject, r.srate, r.label, r.is_expert) for r in rows] == [(7, 256.0, 0, True), (7, 256.0, 6, False)]
    assert recordings.recordings(spark, f"file://{tmp_path}", data=False).where("samples is null").count() == 2
    np.savez(tmp_path / "f.npz", np.ones((2, 3)))
    assert recordings.arrays(spark, f"file://{tmp_path}").first().shape == [2, 3]


def test_empty_tables(spark):
    none = samples(spark)
    assert windows.tumbling(none, 8).count() == windows.sliding(none, 8).count() == windows.half_overlapping(none, 8).count() == 0
    assert spectra.autocorrelation(none, 2).count() == 0


def test_greedy_seeds_equal_a_plain_computation(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 9))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    draws = [[0.4], [0.1, 0.9], [0.3, 0.5, 0.99], [0.0, 1.0]]
    own = np.lib.stride_tricks.sliding_window_view(x, 5, axis=1)
    near, want = np.full(60, np.inf), []
    for k, trials in enumerate(draws):
        ends = np.cumsum(near if k else np.ones(60))
        rows = np.minimum(np.searchsorted(ends, np.array(trials) * ends[-1]), 59)
        gaps = [[[((own[:, s] - own[r, w]) ** 2).sum(1) for w in range(5)] for s in range(5)] for r in rows]
        pots = np.round(np.minimum(np.array(gaps), near).sum(-1), 6)
        t, s, w = np.unravel_index(pots.argmin(), pots.shape)
        near = np.minimum(near, gaps[t][s][w])
        want.append((int(rows[t]), int(w), int(s)))
    for limits in ((1 << 20, 1 << 16), (26, 7)):
        monkeypatch.setattr(vectors, "POTENTIALS", limits[0])
        monkeypatch.setattr(vectors, "RANGE_ROWS", limits[1])
        centers, how = vectors.greedy_seeds(df, 4, 5, draws)
        assert [h[:3] for h in how] == want and how[-1][3] == pytest.approx(near.sum())
        assert np.allclose(centers, [own[r, w] for r, w, _ in want])


def test_books_larger_than_a_broadcast_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(40)], "id long, v array<double>")
    books = {0: rng.normal(size=(30, 8)), 3: rng.normal(size=(5, 8))}
    whole = sorted(map(tuple, vectors.assigned(df, books).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_VALUES", 50)
    assert sorted(map(tuple, vectors.assigned(df, books).collect())) == whole
    assert all(sum(c.size for _, c in b.values()) <= 50 for b in vectors._cut(books))


@pytest.mark.parametrize("scale, gaps", [(0.5, 0), (1.0, 7)])
def test_pivots_find_the_first_nearest_spectrum_with_fewer_distances(scale, gaps):
    rng = np.random.default_rng(gaps)
    centers = rng.random((20, 12))
    there = centers[rng.integers(20, size=900)] + 0.01 * rng.random((900, 12))
    there[300] = there[7]
    for k in range(gaps):
        there[rng.integers(900), rng.integers(12)] = np.nan
    cells = spectra.Cells(there, scale)
    own = np.concatenate([there[[7, 300, 500]], centers + 0.02 * rng.random((20, 12))])
    if gaps:
        own[5, 2] = np.nan
    for x in own:
        dist = np.round(np.sqrt(np.nansum((there - x) ** 2, 1) * scale), 9)
        assert cells.nearest(x) == (int(dist.argmin()), float(dist.min()))
        assert cells.nearest(x, float(dist.min())) is None
    assert cells.computed < len(own) * 900 * 1.1 if gaps else cells.computed < len(own) * 900 / 2
    assert spectra.Cells(there[:0], scale).nearest(own[0]) is None


def test_random_windows_are_distinct_and_only_those_drawn_are_made(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(n)]) for i, n in enumerate([3, 4, 5, 6, 40, 2000] * 30)], "subject int, samples array<double>")
    got = windows.random_offsets(df, 4, 5, seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.subject, []).append(r.start)
        assert r.w == [float(r.start + k) for k in range(4)]
    for i, n in enumerate([3, 4, 5, 6, 40, 2000] * 30):
        own = by.get(i, [])
        assert len(own) == len(set(own)) == max(0, min(5, n - 3)) and all(0 <= x <= n - 4 for x in own)
    few = [x for i, own in by.items() if i % 6 == 4 for x in own]
    assert len(set(few)) > 25  # of 37 offsets, 150 draws
    plan = windows.random_offsets(df, 4, 5, seed=3)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("n_taps, chunk", [(3, 16), (3, None), (90, 100), (90, None)])
def test_filters_by_chunks_equal_sums(spark, n_taps, chunk):
    rng = np.random.default_rng(n_taps)
    x = {(s, t): float(rng.normal()) for s in range(3) for t in range(400) if s < 2 or rng.random() < 0.02}
    h = {(s, k): float(rng.normal()) for s in (0, 2) for k in range(n_taps) if k % 4 != 1}
    samples = spark.createDataFrame([(s, t, v) for (s, t), v in x.items()], "subject int, t long, x double")
    filters = spark.createDataFrame([(s, k, v) for (s, k), v in h.items()] + [(0, -1, 5.0)], "subject int, k int, h double")
    want = {}
    for s, t in x:
        own = [(k, v) for (o, k), v in h.items() if o == s and (s, t - k) in x]
        if own:
            want[s, t] = sum(v * x[s, t - k] for k, v in own)
    got = {(r.subject, r.t): r.y for r in spectra.causal_fir(samples, filters, chunk=chunk).collect()}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-9 for key in want)
    assert spectra.causal_fir(samples, filters.limit(0)).count() == 0


@pytest.mark.parametrize("lags, chunk", [(5, 7), (5, None), (60, 61), (60, 130)])
def test_autocorrelations_of_chunks_add_up(spark, lags, chunk):
    rng = np.random.default_rng(lags)
    x = {s: rng.normal(size=n) for s, n in enumerate((200, 61, 3, 1))}
    df = spark.createDataFrame([(s, t, float(v)) for s, own in x.items() for t, v in enumerate(own)], "subject int, t long, x double")
    got = {(r.subject, r.lag): r.r for r in spectra.autocorrelation(df, lags, chunk=chunk).collect()}
    assert len(got) == 4 * (lags + 1)
    for s, own in x.items():
        for k in range(lags + 1):
            want = float(own[: len(own) - k] @ own[k:] / (own @ own)) if k < len(own) else None
            assert got[s, k] == (pytest.approx(want, abs=1e-9) if want is not None else None)


def test_of_caches_built_at_once_one_stays_and_readers_see_it_whole(spark):
    root, barrier, built = tables.new_path(spark, "race"), threading.Barrier(4), []

    def build(k):
        def make():
            barrier.wait(60)  # all have seen that there is none
            built.append(k)
            return spark.range(k * 100, k * 100 + 50).repartition(3)

        return make

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda k: sorted(r.id for r in tables.build_or_load(spark, root, "t", build(k), a=1).collect()), range(4)))
    assert sorted(built) == [0, 1, 2, 3] and len(set(map(tuple, found))) == 1 and len(found[0]) == 50

    def never():
        raise AssertionError("it is there already")

    assert tables.build_or_load(spark, root, "t", never, a=1).count() == 50
    folder = f"{root.removeprefix('file://')}/{tables.cache_key('t', a=1)}"
    assert sorted(n.split("-")[0] for n in os.listdir(folder) if not n.startswith(".")) == ["current", "data"]
    with pytest.raises(AssertionError):  # a build that fails names nothing
        tables.build_or_load(spark, root, "t", never, a=2)
    assert tables.build_or_load(spark, root, "t", lambda: spark.range(3), a=2).count() == 3


def test_generators_and_seeds_of_runs():
    assert vectors.child_seeds(5, 3) == vectors.child_seeds(5, 3) != vectors.child_seeds(6, 3)
    assert vectors.child_seeds(5, 4)[:3] == vectors.child_seeds(5, 3) and len(set(vectors.child_seeds(5, 50))) == 50
    own = np.random.default_rng(2)
    assert vectors.generator(own) is own and vectors.generator(np.int64(3)).random() == vectors.generator(3).random()
    assert vectors.generator().random() != vectors.generator().random()
    for wrong in ("x", 1.5, True):
        with pytest.raises(ValueError):
            vectors.generator(wrong)
