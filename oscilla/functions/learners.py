"""Learners on pyspark.ml: TF-IDF on rates as an estimator, forests and elastic-net logistic regression.

A forest's minimum of rows to split, which Spark's has not, is applied to grown trees: whether a node is split depends
on its own rows alone, so cutting the splits of small nodes gives the trees that would have been grown.

Deviations from usual single-machine learners: trees are at most 30 deep; float results of learners are
not bound to any other implementation.
"""

from __future__ import annotations

from math import log

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path


def dense(rates: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys..., features): rates of a document as a vector of ``width`` values, zeros for those it lacks."""
    table = rates.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "rate"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return table.select(*keys, array_to_vector(values).alias("features"))


class _TfidfParams(HasInputCol, HasOutputCol):
    norm = Param(Params._dummy(), "norm", "l1, l2 or none", TypeConverters.toString)
    use_idf = Param(Params._dummy(), "use_idf", "weight by inverse document frequency", TypeConverters.toBoolean)
    smooth_idf = Param(Params._dummy(), "smooth_idf", "count one document more with every feature", TypeConverters.toBoolean)
    sublinear_tf = Param(Params._dummy(), "sublinear_tf", "1 + ln of rates above 0", TypeConverters.toBoolean)
    width = Param(Params._dummy(), "width", "how many leading features are weighted; -1 for all, the others pass", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="features", outputCol="scaled", norm="l2", use_idf=True, smooth_idf=True, sublinear_tf=False, width=-1)

    def _checked(self):
        if self.getOrDefault(self.norm) not in ("l1", "l2", "none"):
            raise ValueError(f"no norm {self.getOrDefault(self.norm)!r}")
        return self


def idf_weights(counts: list[tuple[int, int]], smooth: bool = True) -> list[float]:
    """ln((1 + n) / (1 + df)) + 1 of (df, n), unsmoothed ln(n / df) + 1; 1 where nothing is known."""
    one = 1 if smooth else 0
    return [log((n + one) / (df + one)) + 1 if df + one else 1.0 for df, n in counts]


class TfidfRates(Estimator, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF on rates: document frequencies count rates above 0."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled", norm="l2", use_idf=True, smooth_idf=True, sublinear_tf=False, width=-1):
        super().__init__()
        self._set(**self._input_kwargs)._checked()

    @keyword_only
    def setParams(self, *, inputCol=None, outputCol=None, norm=None, use_idf=None, smooth_idf=None, sublinear_tf=None, width=None):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})._checked()

    def _fit(self, dataset: DataFrame) -> "TfidfRatesModel":
        get = self.getOrDefault
        values = dataset.select(F.posexplode(vector_to_array(get(self.inputCol))).alias("feature", "rate"))
        counts = values.groupBy("feature").agg(F.count_if(F.col("rate") > 0).alias("df"), F.count("*").alias("n")).orderBy("feature").collect()
        if not counts:
            raise ValueError("no rows to learn from")
        return self._copyValues(TfidfRatesModel(idf_weights([(r.df, r.n) for r in counts], get(self.smooth_idf))))

    def known(self, counts: list[tuple[int, int]]) -> "TfidfRatesModel":
        """The model of (df, n) of each feature, where they have been counted already."""
        return self._copyValues(TfidfRatesModel(idf_weights(counts, self.getOrDefault(self.smooth_idf))))


class TfidfRatesModel(Model, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """``idf`` and the transformation of vectors by it."""

    idf_values = Param(Params._dummy(), "idf_values", "weights of the features", TypeConverters.toListFloat)

    def __init__(self, idf: list[float] | None = None):
        super().__init__()
        if idf is not None:
            self._set(idf_values=idf)

    @property
    def idf(self) -> list[float]:
        return self.getOrDefault(self.idf_values)

    def feature_names(self) -> list[str]:
        return [f"tfidf{i}" for i in range(len(self.idf))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        all_ = vector_to_array(get(self.inputCol))
        width = len(self.idf) if get(self.width) < 0 else get(self.width)
        head, tail = F.slice(all_, 1, width), F.slice(all_, width + 1, len(self.idf) + 1)
        tf = (lambda r: F.when(r > 0, 1 + F.ln(F.when(r > 0, r))).otherwise(0.0)) if get(self.sublinear_tf) else (lambda r: r)
        weights = F.lit(self.idf[:width] if get(self.use_idf) else [1.0] * width)
        values = F.zip_with(head, weights, lambda r, w: tf(r) * w)
        out = dataset.withColumn("_v", values)
        size: Column | None = None
        if get(self.norm) == "l2":
            size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
        elif get(self.norm) == "l1":
            size = F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.abs(x))
        scaled = F.col("_v") if size is None else F.transform("_v", lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))
        return out.withColumn(get(self.outputCol), array_to_vector(F.concat(scaled, tail))).drop("_v")


def with_min_split(model: RandomForestClassificationModel, least: int) -> RandomForestClassificationModel:
    """The forest without splits of nodes of fewer than ``least`` rows (of the tree's own sample); those are leaves.

    Nodes are rows of the stored forest, with their counts; nodes below a cut one are no longer reached.
    """
    spark = SparkSession.active()
    grown, cut = new_path(spark, "forest"), new_path(spark, "forest")
    model.save(grown)
    model.save(cut)
    nodes = spark.read.parquet(f"{grown}/data")
    kinds = {f.name: f.dataType for f in nodes.schema["nodeData"].dataType.fields}
    leaf = {"gain": F.lit(-1.0), "leftChild": F.lit(-1), "rightChild": F.lit(-1), "split": F.struct(F.lit(-1), F.array().cast("array<double>"), F.lit(-1))}
    small = F.col("nodeData.rawCount") < least
    own = [F.when(small, leaf[name].cast(kind)).otherwise(F.col(f"nodeData.{name}")).alias(name) if name in leaf else F.col(f"nodeData.{name}") for name, kind in kinds.items()]
    nodes.withColumn("nodeData", F.struct(*own)).write.mode("overwrite").parquet(f"{cut}/data")
    return RandomForestClassificationModel.load(cut)


class MinSplitForest(Estimator):
    """A random forest that splits nodes of ``least`` rows or more."""

    def __init__(self, forest: RandomForestClassifier, least: int) -> None:
        super().__init__()
        self.forest, self.least = forest, least

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        return with_min_split(self.forest.fit(dataset), self.least)


def classifier(kind: str, *, trees: int = 300, min_rows: int = 1, min_split: int = 2, depth: int = 10, c: float = 1.0, l1_ratio: float = 0.0, weight: str | None = None, total_weight: float | None = None, seed: int = 13, features: str = "scaled"):
    """A random forest or a multinomial elastic-net logistic regression.

    ``c`` is the inverse of the penalty on the sum of losses. Spark takes their weighted mean, so its penalty is 1 / (c * ``total_weight``),
    the sum of the weights of the rows to learn from.
    """
    common = {"featuresCol": features, "labelCol": "label"} | ({"weightCol": weight} if weight else {})
    if kind == "random_forest":
        forest = RandomForestClassifier(numTrees=trees, minInstancesPerNode=min_rows, maxDepth=depth, seed=seed, **common)
        return forest if min_split <= 2 else MinSplitForest(forest, min_split)
    if kind == "logistic":
        if not total_weight:
            raise ValueError("a logistic regression needs the sum of the weights")
        return LogisticRegression(family="multinomial", elasticNetParam=l1_ratio, regParam=1.0 / (c * total_weight), standardization=False, maxIter=100, **common)
    raise ValueError(f"no classifier {kind!r}")


def estimator(kind: str, feature_type: str, *, bag_width: int = -1, norm: str = "l2", counts: list[tuple[int, int]] | None = None, **params) -> Pipeline:
    """TF-IDF and classifier for bags, classifier alone for spectra, TF-IDF on the leading bag part for both together.

    With ``counts``, (df, n) of each feature, documents are not counted again.
    """
    if feature_type == "psd_autocorr":
        return Pipeline(stages=[classifier(kind, features="features", **params)])
    if feature_type not in ("bowav", "bowav_psd_autocorr"):
        raise ValueError(f"no feature type {feature_type!r}")
    width = bag_width if feature_type == "bowav_psd_autocorr" else -1
    scale = TfidfRates(norm=norm, width=width)
    return Pipeline(stages=[scale if counts is None else scale.known(counts), classifier(kind, **params)])
