"""Feature extractors as table functions, callable from SQL.

    select * from series_features(table(select subject, t, x from long) partition by (subject) order by (t), 64.0D, 'features')

The first column of the table names the series and keeps its name and type; ``t`` and ``x`` are its samples. Spark deals
partitions to tasks, and one is a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import kernels

#: What a series is turned into, by name; each takes the samples and their rate.
EXTRACTORS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "features": kernels.features,
    "spectrum": lambda x, fs: kernels.formatted_psd(kernels.median_psd(x, fs)),
    "autocorrelation": kernels.autocorrelation,
}


@udtf
class SeriesFeatures:
    """(series' name, i, v) for the values that an extractor makes of each series."""

    @staticmethod
    def analyze(series: AnalyzeArgument, srate: AnalyzeArgument, extractor: AnalyzeArgument) -> AnalyzeResult:
        if not series.isTable:
            raise ValueError("series_features needs a table of series")
        names = [f.name for f in series.dataType.fields]
        if not {"t", "x"} <= set(names[1:]):
            raise ValueError("the table's columns are the name of a series, t and x")
        if not srate.isConstantExpression or srate.value is None or srate.value <= 0:
            raise ValueError("the sampling rate is a positive constant")
        if extractor.value not in EXTRACTORS or not isinstance(extractor.dataType, StringType):
            raise ValueError(f"extractors are {', '.join(EXTRACTORS)}")
        key = series.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(key.name, key.dataType), StructField("i", IntegerType()), StructField("v", DoubleType())]))

    def __init__(self) -> None:
        self.key, self.samples, self.srate, self.extractor = None, [], 0.0, ""

    def eval(self, series: Row, srate: float, extractor: str) -> None:
        self.key, self.srate, self.extractor = series[0], float(srate), extractor
        self.samples.append((series["t"], series["x"]))

    def terminate(self) -> Iterator[tuple]:
        if self.samples:
            x = np.array([v for _, v in sorted(self.samples)], np.float64)
            for i, v in enumerate(EXTRACTORS[self.extractor](x, self.srate).tolist()):
                yield self.key, i, float(v)


def register(spark: SparkSession) -> None:
    """Make ``series_features`` known to the session's SQL."""
    spark.udtf.register("series_features", SeriesFeatures)
