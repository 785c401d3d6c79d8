"""Training, search and evaluation of classifiers on series: features by segment, splits, votes, stored results.

Series are known by (subject, ic). A ``Bundle`` holds what a feature type needs; ``extractor`` turns it into a
function from a segment length to (subject, ic, seg, features). Predictions either pool, features over the whole
validation segment, or vote, features over training segments and the most frequent prediction. Every fitted model is
the whole pipeline, scaling included, and stored and loaded as one.

A search makes the features of each segment length once (``Shared``). All candidates and splits read that table;
what they count, documents with a feature and rows of a class, is counted once by subject, and a split's counts are the
total less the held-out subject's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, labels
from ..sources.tables import exists, settled
from . import kernels, learners

KEYS = ["subject", "ic"]
Features = Callable[[int | None], DataFrame]
Scorer = Callable[[DataFrame], float]


@dataclass(frozen=True)
class Bundle:
    """Codes (subject, ic, t, book, code) of ``books`` codebooks of ``k`` codes, and samples (subject, ic, t, x) at ``srate``."""

    codes: DataFrame | None = None
    samples: DataFrame | None = None
    k: int = 0
    books: int = 0
    srate: float = 0.0


def bundle(kind: str, *, codes: Callable[[], DataFrame], samples: Callable[[], DataFrame], k: int, books: int, srate: float) -> Bundle:
    """Load what features of ``kind`` need and nothing else."""
    _known(kind)
    return Bundle(codes() if "bowav" in kind else None, samples() if "psd_autocorr" in kind else None, k, books, srate)


def _known(kind: str) -> None:
    if kind not in ("bowav", "psd_autocorr", "bowav_psd_autocorr"):
        raise ValueError(f"no feature type {kind!r}")


def _segment(rows: DataFrame, length: int | None, limit: int | None) -> DataFrame:
    """``rows`` of whole segments with ``seg``; without a length a series is one segment, ``limit`` cuts it first."""
    rows = rows if limit is None else rows.where(F.col("t") < limit)
    if length is None:
        return rows.withColumn("seg", F.lit(0).cast("long"))
    sizes = rows.groupBy(*KEYS).agg((F.max("t") + 1).alias("n"))
    cut = rows.join(sizes, KEYS).withColumn("seg", F.floor(F.col("t") / length).cast("long"))
    return cut.where((F.col("seg") + 1) * length <= F.col("n")).drop("n")


def _bags(b: Bundle, length: int | None, limit: int | None) -> DataFrame:
    at = _segment(b.codes, length, limit).withColumn("feature", (F.col("book") * b.k + F.col("code")).cast("int"))
    sizes = at.groupBy(*KEYS, "seg", "book").agg(F.count("*").alias("n"))
    counts = at.groupBy(*KEYS, "seg", "book", "feature").agg(F.count("*").alias("c"))
    rates = counts.join(sizes, [*KEYS, "seg", "book"]).withColumn("rate", F.col("c") / F.col("n"))
    return learners.dense(rates, [*KEYS, "seg"], b.books * b.k)


def _spectra(b: Bundle, length: int | None, limit: int | None) -> DataFrame:
    parts = _segment(b.samples, length, limit).groupBy(*KEYS, "seg").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    packed = parts.select(*KEYS, "seg", F.transform("s", lambda s: s["x"]).alias("samples"))
    return kernels.per_series(packed, kernels.feature_kernel(fs=b.srate)).select(*KEYS, "seg", array_to_vector("values").alias("features"))


def extractor(kind: str, b: Bundle, *, per_window: int = 1, limit: int | None = None) -> Features:
    """Features of ``kind`` by segment length, (subject, ic, seg, features).

    Lengths count the codes' windows, or samples where there are only spectra; in the combined type a window has
    ``per_window`` samples. With ``limit`` a series ends after so many units.
    """
    _known(kind)
    scale = per_window if kind == "bowav_psd_autocorr" else 1

    def units(x: int | None) -> int | None:
        return None if x is None else x * scale

    def both(length: int | None) -> DataFrame:
        left, right = _bags(b, length, limit), _spectra(b, units(length), units(limit)).withColumnRenamed("features", "more")
        joined = F.concat(vector_to_array("features"), vector_to_array("more"))
        return left.join(right, [*KEYS, "seg"]).select(*KEYS, "seg", array_to_vector(joined).alias("features"))

    return {"bowav": lambda n: _bags(b, n, limit), "psd_autocorr": lambda n: _spectra(b, n, limit), "bowav_psd_autocorr": both}[kind]


def once(features: Features) -> Features:
    """``features`` written when a length is first asked for and read from then on."""
    made: dict[int | None, DataFrame] = {}
    lock = Lock()

    def of(length: int | None) -> DataFrame:
        with lock:
            if length not in made:
                made[length] = settled(features(length), "features")
            return made[length]

    return of


def within(features: Features, limit: int | None, *, whole: Features | None = None) -> Features:
    """Features of the first ``limit`` units of each series: segments of ``features`` that end there.

    Where a prefix is one segment whatever its length, it has to be made by ``whole``, the features of that prefix.
    """

    def of(length: int | None) -> DataFrame:
        if length is None and limit is not None:
            if whole is None:
                raise ValueError("a prefix without segments needs features of its own")
            return whole(None)
        rows = features(length)
        return rows if limit is None or length is None else rows.where((F.col("seg") + 1) * length <= limit)

    return of


class Shared:
    """Features by segment length with the labels of their series, made once, and their counts by subject."""

    def __init__(self, features: Features, series: DataFrame) -> None:
        known = series.select(*KEYS, F.col("label").cast("double").alias("label"), "is_expert")
        self.rows = once(lambda length: features(length).join(known, KEYS, "left"))
        self._frequencies, self._classes = once(self._by_feature), once(self._by_class)
        self._left: dict[tuple, list] = {}

    def _by_feature(self, length: int | None) -> DataFrame:
        values = self.rows(length).where("label is not null").select("subject", F.posexplode(vector_to_array("features")).alias("feature", "rate"))
        return values.groupBy("subject", "feature").agg(F.count_if(F.col("rate") > 0).alias("df"), F.count("*").alias("n"))

    def _by_class(self, length: int | None) -> DataFrame:
        return self.rows(length).where("label is not null").groupBy("subject", "label", F.coalesce("is_expert", F.lit(False)).alias("is_expert")).agg(F.count("*").alias("n"))

    def training(self, length: int | None, held_out=None) -> DataFrame:
        """The labelled rows of all subjects but one."""
        rows = self.rows(length).where("label is not null")
        return rows if held_out is None else rows.where(F.col("subject") != F.lit(held_out))

    def _less(self, name: str, counts: Callable[[int | None], DataFrame], by: list[str], values: list[str], length: int | None, held_out) -> list:
        """The sums of ``values`` by ``by`` over all subjects but one: a row for each feature or class."""
        key = (name, length, held_out)
        if key not in self._left:
            kept = F.lit(1) if held_out is None else F.when(F.col("subject") != F.lit(held_out), 1).otherwise(0)
            self._left[key] = counts(length).groupBy(*by).agg(*[F.sum(F.col(v) * kept).alias(v) for v in values]).orderBy(*by).collect()
        return self._left[key]

    def frequencies(self, length: int | None, held_out=None) -> list[tuple[int, int]]:
        """(df, n) of each feature without one subject."""
        return [(r.df, r.n) for r in self._less("features", self._frequencies, ["feature"], ["df", "n"], length, held_out)]

    def classes(self, length: int | None, held_out=None) -> dict[tuple[float, bool], int]:
        """Rows by label and whether an expert gave it, without one subject."""
        return {(r.label, r.is_expert): r.n for r in self._less("classes", self._classes, ["label", "is_expert"], ["n"], length, held_out) if r.n}


# --- one model


def fitted(features: Features, series: DataFrame, kind: str, classifier: str, *, train: int | None, expert_weight: float = 1.0, bag_width: int = -1, shared: Shared | None = None, held_out=None, **params) -> PipelineModel:
    """The whole pipeline fitted on all segments of ``series`` (subject, ic, label, is_expert), expert rows weighing ``expert_weight``.

    A forest's weights are balanced over the classes, too: rows over classes times rows of the class. With ``held_out``
    the rows and counts of one subject are left out.
    """
    shared = shared or Shared(features, series)
    counts = shared.classes(train, held_out)
    if not counts:
        raise ValueError("no rows to learn from")
    rows_of = Counter()
    for (label, _), n in counts.items():
        rows_of[label] += n
    balanced = classifier == "random_forest"
    weight = {(label, expert): (expert_weight if expert else 1.0) * (rows_of.total() / (len(rows_of) * rows_of[label]) if balanced else 1.0) for label, expert in counts}
    by = F.create_map(*[F.lit(x) for (label, expert), w in weight.items() for x in (f"{label}:{expert}".lower(), w)])
    rows = shared.training(train, held_out)
    rows = rows.select("features", "label", by[F.concat_ws(":", F.col("label").cast("string"), F.coalesce("is_expert", F.lit(False)).cast("string"))].alias("w"))
    known = shared.frequencies(train, held_out) if kind != "psd_autocorr" else None
    total = sum(weight[key] * n for key, n in counts.items())
    return learners.estimator(classifier, kind, bag_width=bag_width, counts=known, weight="w", total_weight=total, **params).fit(rows)


def predictions(model: PipelineModel, features: Features, series: DataFrame, *, aggregate: str, train: int | None, val: int | None) -> DataFrame:
    """(subject, ic, group, pred) of ``series``: pooled or voted over validation segments."""
    if aggregate not in ("count_pooling", "majority_vote"):
        raise ValueError(f"no aggregation {aggregate!r}")
    if evaluation.skip_short(train, val, aggregate == "majority_vote"):
        raise ValueError("validation segments are shorter than training segments")
    rows = features(val if aggregate == "count_pooling" else train).join(series.select(*KEYS), KEYS, "left_semi")
    found = model.transform(rows).select(*KEYS, "seg", F.col("prediction").alias("pred"))
    if aggregate == "count_pooling":
        return found.withColumnRenamed("seg", "group")
    if train is None:
        return found.withColumnRenamed("seg", "group")
    return evaluation.regrouped_votes(found, train, val, KEYS)


def probabilities(model: PipelineModel, features: Features, length: int | None) -> DataFrame:
    """(subject, ic, seg, class, p) of every segment."""
    found = model.transform(features(length)).select(*KEYS, "seg", vector_to_array("probability").alias("p"))
    return found.select(*KEYS, "seg", F.posexplode("p").alias("class", "p"))


def balanced_accuracy(rows: DataFrame) -> float:
    return float(evaluation.balanced_accuracy(rows).first()[0] or 0.0)


def brain_f1(rows: DataFrame) -> float:
    return float(evaluation.f1(rows, []).first().f1)


def fit_and_score(features: Features, series: DataFrame, held_out, kind: str, classifier: str, params: dict, scorer: Scorer = balanced_accuracy, shared: Shared | None = None) -> dict:
    """Score, seconds to fit and seconds to score of one candidate where one subject is held out.

    It trains on all rows of the other subjects and scores the expert rows of the one held out. ``params`` has aggregate,
    train, val and expert_weight, and the estimator's own; ``scorer`` gets (y, pred, w), a row for each prediction.
    """
    own = dict(params)
    aggregate, val = own.pop("aggregate"), own.pop("val")
    shared = shared or Shared(features, series)
    began = time.perf_counter()
    model = fitted(features, series, kind, classifier, shared=shared, held_out=held_out, **own)
    ready = time.perf_counter()
    test = series.where(labels.role(held_out) == "test")
    said = predictions(model, shared.rows, test, aggregate=aggregate, train=own["train"], val=val)
    truth = test.select(*KEYS, F.col("label").cast("double").alias("y"), labels.expert_weight(own.get("expert_weight", 1.0)).alias("w"))
    score = scorer(said.join(truth, KEYS).select("y", "pred", "w"))
    return {"score": float(score), "fit_time": ready - began, "score_time": time.perf_counter() - ready}


# --- search

RESULTS = "candidate long, split int, held_out string, score double, fit_time double, score_time double"


def search(spark: SparkSession, features: Features, series: DataFrame, kind: str, classifier: str, candidates: list[dict], folder: str, *, scorer: Scorer = balanced_accuracy, parallelism: int = 2) -> DataFrame:
    """Scores of all candidates on all leave-one-subject-out splits, stored under ``folder``.

    A job's result is stored when it is there, so a search that was cut off goes on with the jobs that are left. Fits run
    side by side on the executors; subjects and candidates are on the driver, rows are not. The source is read once for
    each segment length.
    """
    # subjects with something to score, in order
    subjects = [r[0] for r in series.where("is_expert").select("subject").distinct().orderBy("subject").collect()]
    done = {(r.candidate, r.split) for r in stored(spark, folder).select("candidate", "split").collect()}
    jobs = [(c, s) for c in range(len(candidates)) for s in range(len(subjects)) if (c, s) not in done]
    shared = Shared(features, series)

    def run(job: tuple[int, int]) -> None:
        c, s = job
        r = fit_and_score(features, series, subjects[s], kind, classifier, candidates[c], scorer, shared)
        row = spark.createDataFrame([(c, s, str(subjects[s]), r["score"], r["fit_time"], r["score_time"])], RESULTS)
        row.coalesce(1).write.parquet(f"{folder}/job-{c}-{s}-{uuid.uuid4().hex}")

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(run, jobs))
    return stored(spark, folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The results under ``folder``, one of each job."""
    if not exists(spark, folder):
        return spark.createDataFrame([], RESULTS)
    found = spark.read.schema(RESULTS).parquet(f"{folder}/job-*")
    return evaluation.first_by(found, ["candidate", "split"], [F.col("score"), F.col("fit_time")])


def best_of(results: DataFrame, candidates: list[dict]) -> tuple[dict, float]:
    """The parameters of the best candidate by mean score, the lowest of equal ones, and that score."""
    row = labels.best_candidate(labels.cv_table(results)).first()
    if row is None:
        raise ValueError("no results")
    return candidates[row.candidate], row["mean"]


def refit(features: Features, series: DataFrame, kind: str, classifier: str, params: dict) -> PipelineModel:
    """The pipeline of the best parameters, fitted on all rows."""
    own = {k: v for k, v in params.items() if k not in ("aggregate", "val")}
    return fitted(features, series, kind, classifier, **own)


def save(model: PipelineModel, params: dict, path: str) -> None:
    """Store a whole pipeline with its parameters."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.parquet(f"{path}/params").first()[0])


# --- evaluation


def evaluated(models: dict[str, PipelineModel], extract: Callable[[str, int | None], Features], series: DataFrame, lengths: Iterable[int | None], *, aggregate: str, train: int | None) -> DataFrame:
    """(length, subject, f1, n): F1 of class 0 over the expert rows of every subject, for prefixes of several lengths.

    ``models`` has a pipeline for each feature type and ``extract(kind, limit)`` its features over the first ``limit`` units. A
    prefix gives one prediction: pooled over it, or voted by its training segments. Of two models the class of the highest
    product of probabilities counts. Lengths below the training length are left out where segments vote.
    """
    truth = series.where("is_expert").select(*KEYS, F.col("label").cast("double").alias("y"))
    vote, parts = aggregate == "majority_vote", []
    for length in lengths:
        if evaluation.skip_short(train, length, vote):
            continue
        unit = train if vote else length
        if len(models) == 1:
            (kind, model), = models.items()
            said = predictions(model, extract(kind, length), truth, aggregate=aggregate, train=train, val=None if vote else length).where(F.col("group") == 0)
        else:
            found = [probabilities(model, extract(kind, length), unit).withColumn("kind", F.lit(kind)) for kind, model in models.items()]
            rows = found[0]
            for more in found[1:]:
                rows = rows.unionByName(more)
            rows = rows.withColumn("series", F.struct(*KEYS)).select(F.col("series").alias("subject"), "kind", "seg", "class", "p")
            best = F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("m")
            said = evaluation.product_of_experts(rows).groupBy("subject").agg(best).select("subject.*", (-F.col("m.c")).cast("double").alias("pred"))
        scored = evaluation.f1(said.join(truth, KEYS).select("subject", "y", "pred"), ["subject"])
        parts.append(scored.select(F.lit(length).cast("int").alias("length"), "subject", "f1", "n"))
    if not parts:
        raise ValueError("every length is shorter than the training segments")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sweep(configs: list[dict], run: Callable[[dict], DataFrame]) -> DataFrame:
    """Results of all configurations in one table, each with its settings as columns; settings are strings, numbers or null."""
    names = sorted({name for c in configs for name in c})
    parts = []
    for config in configs:
        found = run(config)
        clash = set(found.columns) & set(names)
        if clash:
            raise ValueError(f"settings named like results: {sorted(clash)}")
        parts.append(found.select(*[F.lit(config.get(n)).cast("string").alias(n) for n in names], *found.columns))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- the network baseline


def labels_by_length(samples: DataFrame, lengths: list[int], network: kernels.Kernel) -> DataFrame:
    """(length, subject, ic, noisy): class probabilities that ``network`` gives the first ``length`` samples of each series.

    Series shorter than a length are left out there.
    """
    packed = samples.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    cut = packed.select(*KEYS, "s", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where(F.size("s") >= F.col("length"))
    rows = cut.select("length", *KEYS, F.transform(F.slice("s", 1, F.col("length")), lambda s: s["x"]).alias("samples"))
    return kernels.per_series(rows, network).withColumnRenamed("values", "noisy")


def baseline_f1(noisy: DataFrame, series: DataFrame) -> DataFrame:
    """(length, subject, f1, n): F1 of class 0 of the most probable class against the expert rows of every subject."""
    truth = series.where("is_expert").select(*KEYS, F.col("label").alias("y"))
    said = noisy.join(truth, KEYS).select("length", "subject", "y", labels.argmax(F.col("noisy")).alias("pred"))
    return evaluation.f1(said, ["length", "subject"])


def summary(scores: DataFrame) -> DataFrame:
    """(length, mean, std, n): over subjects."""
    return evaluation.by_window(scores.select(F.col("length").alias("window"), "subject", F.col("f1").alias("score"))).withColumnRenamed("window", "length")
