"""Vectors: nearest centroids with and without shifts, assignments of series, shift-invariant k-means.

A codebook goes to the tasks and meets a batch of vectors in one matrix product, so vectors are neither
multiplied into rows nor shuffled. A codebook of more than ``BROADCAST_VALUES`` goes in blocks of that size;
the best of each class so far rides along in a written table between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

#: The most values of a codebook, or block of one, that are sent to every task.
BROADCAST_VALUES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Cosine distance (1 from a zero vector) or squared euclidean distance."""
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    if metric == "euclidean":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"no metric {metric!r}")


def nearest_centroid(vectors: DataFrame, codebook: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, class, centroid, dist): for each vector and class the nearest centroid, the lowest on ties."""
    return shifted_nearest(vectors, codebook, metric).drop("shift")


def blocks_of(codebook: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A codebook (class, centroid, c) in blocks of at most ``BROADCAST_VALUES`` values: numbers and centroids by class.

    Blocks are numbered by running sums of sizes in Spark and fetched one by one.
    """
    ahead = F.sum(F.size("c")).over(Window.orderBy("class", "centroid")) - F.size("c")
    numbered = codebook.select("class", "centroid", "c", F.floor(ahead / F.lit(BROADCAST_VALUES)).cast("int").alias("block"))
    for block in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
        rows = numbered.where(F.col("block") == block).orderBy("class", "centroid").collect()
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r["class"], []).append((r.centroid, r.c))
        yield {label: (np.array([n for n, _ in own]), np.array([c for _, c in own], np.float64)) for label, own in found.items()}


def shifted_nearest(vectors: DataFrame, codebook: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, class, centroid, shift, dist): the nearest centroid of each class over all shifts of it in the vector.

    Of equal distances (to nine digits) the lowest centroid and then the lowest shift is taken.
    """
    return _nearest_of(vectors, blocks_of(codebook), metric)


def _nearest_of(vectors: DataFrame, blocks: Iterator[dict[int, tuple[np.ndarray, np.ndarray]]], metric: str) -> DataFrame:
    best = "array<struct<class:int,centroid:int,shift:int,dist:double>>"
    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.select("id", "v").withColumn("best", F.expr(f"cast(array() as {best})"))
    first = True
    for block in blocks:
        rows = rows if first else settled(rows)
        first = False
        rows = rows.mapInPandas(_better(rows.sparkSession.sparkContext.broadcast(block), metric), f"id {kind}, v array<double>, best {best}")
    return rows.select("id", F.explode("best").alias("b")).select("id", "b.class", "b.centroid", "b.shift", "b.dist")


def _better(shared, metric: str, rows: int = 512):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.iloc[low : low + rows].copy()
                x = np.array(part["v"].tolist(), np.float64)
                known: list[dict] = [{b["class"]: b for b in own} for own in part["best"]]
                for label, (numbers, centroids) in shared.value.items():
                    for own, c, s, d in zip(known, *best_shifts(x, centroids, metric)):
                        if label not in own or d < own[label]["dist"]:
                            own[label] = {"class": label, "centroid": int(numbers[c]), "shift": int(s), "dist": float(d)}
                part["best"] = [[own[k] for k in sorted(own)] for own in known]
                yield part

    return run


def best_shifts(x: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of ``x`` (n, T) and centroids (k, P): nearest centroid, its shift and distance."""
    n, width = x.shape
    k, length = centroids.shape
    windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    products = windows @ centroids.T  # (n, shifts, k)
    norms = np.einsum("nsp,nsp->ns", windows, windows)
    sizes = np.einsum("kp,kp->k", centroids, centroids)
    if metric == "cosine":
        root = np.sqrt(norms)[:, :, None] * np.sqrt(sizes)
        gaps = 1 - np.divide(products, root, out=np.zeros_like(products), where=root > 0)
    elif metric == "euclidean":
        gaps = np.maximum(norms[:, :, None] - 2 * products + sizes, 0)
    else:
        raise ValueError(f"no metric {metric!r}")
    gaps = np.round(gaps.transpose(0, 2, 1).reshape(n, -1), 9)
    best = gaps.argmin(1)
    return best // (width - length + 1), best % (width - length + 1), gaps[np.arange(n), best]


def assigned(vectors: DataFrame, books: dict[int, np.ndarray], metric: str = "cosine", rows: int = 512) -> DataFrame:
    """(id, class, centroid, shift, dist) like ``shifted_nearest``, for codebooks that are on the driver.

    Books of more than ``BROADCAST_VALUES`` values go in blocks of that size.
    """
    if sum(b.size for b in books.values()) > BROADCAST_VALUES:
        return _nearest_of(vectors, _cut(books), metric)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.iloc[low : low + rows]
                x = np.array(part["v"].tolist(), np.float64)
                for label, book in shared.value.items():
                    centroid, shift, dist = best_shifts(x, book, metric)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "class": label, "centroid": centroid, "shift": shift, "dist": dist})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInPandas(run, f"id {kind}, class int, centroid int, shift int, dist double")


def _cut(books: dict[int, np.ndarray]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Books in blocks of at most ``BROADCAST_VALUES`` values, or of one longer centroid."""
    block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    free = BROADCAST_VALUES
    for label, book in books.items():
        low, length = 0, max(1, book.shape[1])
        while low < len(book):
            if free < length and block:
                yield block
                block, free = {}, BROADCAST_VALUES
            high = min(len(book), low + max(1, free // length))
            block[label] = (np.arange(low, high), book[low:high])
            free -= (high - low) * length
            low = high
    if block:
        yield block


def shifted_norms(vectors: DataFrame, length: int) -> DataFrame:
    """(id, shift, norm2): squared norms of all windows of ``length`` values."""
    at = F.transform(F.sequence(F.lit(0), F.size("v") - length), lambda s: dot(F.slice("v", s + 1, F.lit(length)), F.slice("v", s + 1, F.lit(length))))
    return vectors.select("id", F.posexplode(at).alias("shift", "norm2"))


def centroid_update(assigned_vectors: DataFrame, length: int, k: int) -> DataFrame:
    """(centroid, c, n): means of the shifted windows of each cluster; an empty cluster is the zero vector."""
    spark = assigned_vectors.sparkSession
    window = F.slice("v", F.col("shift") + 1, F.lit(length))
    long = assigned_vectors.select("centroid", F.posexplode(window).alias("pos", "x"))
    means = long.groupBy("centroid", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    found = means.groupBy("centroid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))
    all_ = spark.range(k).select(F.col("id").cast("int").alias("centroid"))
    zero = F.array_repeat(F.lit(0.0), length)
    return all_.join(found, "centroid", "left").select("centroid", F.coalesce("c", zero).alias("c"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def inertia(assignments: DataFrame) -> DataFrame:
    return assignments.agg(F.sum("dist").alias("inertia"), F.countDistinct("centroid").alias("clusters"))


Init = Callable[[np.ndarray, int, int, np.random.Generator], np.ndarray]


def plus_plus(windows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++ over weighted windows: of 2 + ln k drawn by squared distance the one that helps most."""

    def gaps(row: int) -> np.ndarray:
        return ((windows - windows[row]) ** 2).sum(1) * weights

    chosen = [int(rng.choice(len(windows), p=weights / weights.sum()))]
    nearest = gaps(chosen[0])
    while len(chosen) < k:
        total = nearest.sum()
        picks = np.searchsorted(np.cumsum(nearest), rng.random(2 + int(np.log(k))) * total) if total > 0 else rng.integers(len(windows), size=1)
        options = [(np.minimum(nearest, gaps(int(row))), int(row)) for row in np.minimum(picks, len(windows) - 1)]
        nearest, row = min(options, key=lambda o: o[0].sum())
        chosen.append(row)
    return windows[chosen].copy()


#: The most trial windows times shifts whose sums a task holds; more trials go in several passes.
POTENTIALS = 1 << 20
#: Rows of a range from which rows are drawn.
RANGE_ROWS = 1 << 16


def greedy_seeds(vectors: DataFrame, k: int, length: int, draws: list[list[float]]) -> tuple[np.ndarray, list[tuple]]:
    """Shift-invariant greedy k-means++: ``k`` windows and how each was chosen, (row, window, shift, potential).

    ``draws`` has for each centroid its trials in [0, 1): the first one picks a row evenly, the others by the
    squared distance to what is chosen already, in order of id. All windows of a trial's row stand for election. The
    potential of (trial, window, shift) is the sum over all rows of the distance to the window at that shift, or of the
    row's least so far: one pass in which tasks add up vectors of potentials, which Spark merges by place. The least
    wins, of equal ones (to six digits) the first by trial, shift and window. Only the trials' rows and one sum for
    ``RANGE_ROWS`` rows come to the driver.
    """
    if k != len(draws) or not all(draws):
        raise ValueError("every centroid needs trials")
    slim = vectors.select("id", "v")
    rows = slim.count()
    if not rows:
        raise ValueError("fewer vectors than centroids")
    kind = vectors.schema["id"].dataType.simpleString()
    state = slim.repartitionByRange(1 + rows // RANGE_ROWS, "id").withColumn("part", F.spark_partition_id()).withColumn("near", F.lit(float("inf")))
    state = settled(state, "seeds")
    chosen, how = [], []
    for own in draws:
        trials = _drawn(state, own, even=not chosen)
        x = np.array([v for _, v in trials], np.float64)
        n_windows = x.shape[1] - length + 1
        if n_windows < 1:
            raise ValueError("centroids are longer than the vectors")
        best = None
        step = max(1, POTENTIALS // n_windows**2)
        for low in range(0, len(trials), step):
            sums = state.mapInPandas(_potentials(x[low : low + step], length), "at int, potential double").groupBy("at").agg(F.sum("potential").alias("potential"))
            found = sums.orderBy(F.round("potential", 6), "at").first()
            if best is None or round(found.potential, 6) < round(best[0], 6):
                best = (found.potential, found.at + low * n_windows**2)
        trial, shift, window = (int(i) for i in np.unravel_index(best[1], (len(trials), n_windows, n_windows)))
        centre = x[trial, window : window + length]
        chosen.append(centre)
        how.append((trials[trial][0], window, shift, best[0]))
        state = settled(state.mapInPandas(_nearer_to(centre, shift), f"id {kind}, v array<double>, part int, near double"), "seeds")
    return np.array(chosen), how


def _drawn(state: DataFrame, draws: list[float], *, even: bool) -> list[tuple]:
    """(id, v) of the row in which each draw falls, rows being laid end to end by id with the length of their distance."""
    size = F.lit(1.0) if even else F.col("near")
    parts = sorted((r.part, r.size) for r in state.groupBy("part").agg(F.sum(size).alias("size")).collect())
    ends = np.cumsum([s for _, s in parts])
    wanted = []
    for trial, draw in enumerate(draws):
        target = draw * ends[-1]
        at = min(int(np.searchsorted(ends, target)), len(parts) - 1)
        wanted.append((trial, parts[at][0], float(target - (ends[at - 1] if at else 0.0))))
    asked = state.sparkSession.createDataFrame(wanted, "trial int, part int, target double")
    upto = state.select("id", "part", F.sum(size).over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    hit = upto.join(F.broadcast(asked), "part")
    # the first row that reaches the target, or the last one where rounding keeps all below it
    first = hit.groupBy("trial").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("target"), F.col("id"))), F.max("id")).alias("id"))
    return [(r.id, r.v) for r in first.join(state.select("id", "v"), "id").orderBy("trial").collect()]


def _gaps(x: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """(rows, shifts, windows): squared distances of all windows of ``x`` to some windows."""
    own = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    norms = np.einsum("nsp,nsp->ns", own, own)
    return np.maximum(norms[:, :, None] - 2 * (own @ windows.T) + np.einsum("wp,wp->w", windows, windows), 0)


def _potentials(trials: np.ndarray, length: int, rows: int = 64):
    windows = [np.lib.stride_tricks.sliding_window_view(t, length) for t in trials]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(windows), len(windows[0]), len(windows[0])))
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.iloc[low : low + rows]
                x, near = np.array(part["v"].tolist(), np.float64), part["near"].to_numpy()
                for t, own in enumerate(windows):
                    total[t] += np.minimum(_gaps(x, own, length), near[:, None, None]).sum(0)
        yield pd.DataFrame({"at": np.arange(total.size, dtype=np.int32), "potential": total.ravel()})

    return run


def _nearer_to(centre: np.ndarray, shift: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)[:, shift : shift + len(centre)]
            yield batch.assign(near=np.minimum(batch["near"].to_numpy(), ((x - centre) ** 2).sum(1)))

    return run


def scalable_plus_plus(vectors: DataFrame, k: int, length: int, *, seed: int, rounds: int = 5) -> np.ndarray:
    """k-means|| over all rows: in each round every row is drawn with a probability in proportion to its squared distance.

    About 2 k rows a round come to the driver, each with one of its windows by a seeded hash; the candidates, weighted by the
    rows nearest to them, are reduced to k by greedy k-means++.
    """

    def unit(salt: int):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)

    def windows(rows: DataFrame) -> np.ndarray:
        start = F.floor(unit(0) * (F.size("v") - length + 1)).cast("int")
        return np.array([r.w for r in rows.orderBy("id").select(F.slice("v", start + 1, F.lit(length)).alias("w")).collect()], np.float64).reshape(-1, length)

    vectors = vectors.select("id", "v")
    chosen = windows(vectors.orderBy(unit(1), "id").limit(1))
    if not len(chosen):
        raise ValueError("fewer vectors than centroids")
    for salt in range(2, rounds + 2):
        gaps = settled(assigned(vectors, {0: chosen}, "euclidean").select("id", "dist"))
        total = gaps.agg(F.sum("dist")).first()[0] or 0.0
        if total <= 0:
            break
        drawn = gaps.where(unit(salt) < F.lit(2.0 * k / total) * F.col("dist")).select("id")
        chosen = np.concatenate([chosen, windows(vectors.join(drawn, "id", "left_semi"))])
    counts = {r.centroid: r["count"] for r in assigned(vectors, {0: chosen}, "euclidean").groupBy("centroid").count().collect()}
    if len(chosen) < k:  # fewer distinct rows than centroids, or an unlucky draw
        more = windows(vectors.orderBy(unit(rounds + 2), "id").limit(k))
        chosen = np.concatenate([chosen, more])
    weights = np.array([counts.get(i, 0) for i in range(len(chosen))], float)
    return plus_plus(chosen, np.maximum(weights, 1e-9), k, np.random.default_rng(seed))


def random_windows(x: np.ndarray, k: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """One random window of each of ``k`` random rows."""
    windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    return windows[rng.permutation(len(x))[:k], rng.integers(windows.shape[1], size=k)].copy()


def energetic_windows(x: np.ndarray, k: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """The window of the highest norm of each of ``k`` random rows."""
    windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[rng.permutation(len(x))[:k]]
    return windows[np.arange(k), np.einsum("nsp,nsp->ns", windows, windows).argmax(1)].copy()


INITS: dict[str, Init] = {"random": random_windows, "random-energy": energetic_windows}


def initial_centroids(vectors: DataFrame, k: int, length: int, *, init: str | np.ndarray | Init, metric: str, seed: int) -> np.ndarray:
    """Start centroids by name, array or callable: k-means++ elects among all windows, a pass for each centroid, k-means|| takes few passes for many. Random ones come from the k rows with the least seeded hashes of all."""
    if isinstance(init, np.ndarray):
        if init.shape != (k, length):
            raise ValueError(f"centroids must have the shape {(k, length)}")
        return init.astype(np.float64)
    if isinstance(init, str) and init in ("k-means++", "k-means||"):
        if metric != "euclidean":
            raise ValueError(f"{init} needs the euclidean metric")
        if init == "k-means||":
            return scalable_plus_plus(vectors, k, length, seed=seed)
        rng = np.random.default_rng(seed)
        return greedy_seeds(vectors, k, length, [rng.random(2 + int(np.log(k)) if c else 1).tolist() for c in range(k)])[0]
    if not callable(init) and init not in INITS:
        raise ValueError(f"no init {init!r}")
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()
    if len(rows) < k:
        raise ValueError("fewer vectors than centroids")
    make = init if callable(init) else INITS[init]
    return make(np.array([r.v for r in rows], np.float64), k, length, np.random.default_rng(seed))


def generator(seed: int | np.random.Generator | None = None) -> np.random.Generator:
    """A generator from a whole number, from the system's entropy where there is none, or the one that is given."""
    if isinstance(seed, np.random.Generator):
        return seed
    if seed is not None and (isinstance(seed, bool) or not isinstance(seed, (int, np.integer))):
        raise ValueError(f"{seed!r} is no seed")
    return np.random.default_rng(None if seed is None else np.random.SeedSequence(int(seed)))


def child_seeds(seed: int | np.random.Generator | None, n: int) -> list[int]:
    """Seeds of ``n`` runs whose draws have nothing to do with one another: the same ones for the same number."""
    return [int(s) for s in generator(seed).integers(0, 1 << 62, size=n)]


def shift_kmeans(vectors: DataFrame, k: int, length: int, *, metric: str = "cosine", init: str | np.ndarray | Init = "random", n_init: int = 1, max_iter: int = 20, tol: float = 1e-6, seed: int | np.random.Generator | None = 13) -> tuple[np.ndarray, DataFrame, float]:
    """Centroids (k, length), final assignments and inertia of the best of ``n_init`` runs.

    Each round assigns in batches and averages on the executors; k * length values come to the driver. A run's
    centroids are those of its round of least inertia, and the assignments returned are made with them. Each run draws by a
    seed of its own that follows from ``seed``.
    """
    vectors = settled(vectors.select("id", "v"))
    best: tuple[float, np.ndarray] | None = None
    for own in child_seeds(seed, n_init):
        centers = initial_centroids(vectors, k, length, init=init, metric=metric, seed=own)
        for _ in range(max_iter + 1):
            found = settled(assigned(vectors, {0: centers}, metric))
            total = found.agg(F.sum("dist")).first()[0] or 0.0
            if best is None or total < best[0]:
                best = (total, centers)
            moved = np.array([r.c for r in centroid_update(found.join(vectors, "id"), length, k).orderBy("centroid").collect()])
            if float(((moved - centers) ** 2).sum()) <= tol:
                break
            centers = moved
    return best[1], assigned(vectors, {0: best[1]}, metric).drop("class"), best[0]


def centroid_spread(codebook: DataFrame) -> DataFrame:
    """(class, centroid, var): the population variance of each centroid's values."""
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / F.size("c")
    gaps = F.transform("c", lambda x: F.pow(x - mean, 2))
    return codebook.select("class", "centroid", (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size("c")).alias("var"))
