"""Tables, caches and files: Parquet caches keyed by all parameters, result CSV, codebooks, filters, checkpoints."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header of result files, fixed values of the format.
RESULT_SCHEMA = "`Prediction window [minutes]` double, `Subject ID` int, `Brain F1 score` double, `Number of ICs` int"
RESULT_COLUMNS = ["Prediction window [minutes]", "Subject ID", "Brain F1 score", "Number of ICs"]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster.

    Executors of a cluster would each write a folder of their own machine, and what is read back would lack rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="oscilla-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/oscilla-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str = "settled") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at files that survive executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cache_key(name: str, **params) -> str:
    """A file name that tells all parameters apart, whatever they are."""
    spelled = json.dumps(params, sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(spelled.encode()).hexdigest()[:20]}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def named_once(spark: SparkSession, draft: str, final: str) -> bool:
    """Give a finished file its final name by an operation that fails where the name is taken; whether it was free."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if fs.getScheme() == "file":  # a rename would overwrite there; a hard link doesn't
            source, target = (jvm.java.io.File(hadoop.Path(x).toUri().getPath()).toPath() for x in (draft, final))
            jvm.java.nio.file.Files.createLink(target, source)
        else:
            none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            context = hadoop.FileContext.getFileContext(hadoop.Path(final).toUri(), spark._jsc.hadoopConfiguration())
            context.rename(hadoop.Path(draft), hadoop.Path(final), none)
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName().endswith("FileAlreadyExistsException"):
            raise
        return False
    return True


def _text_of(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def build_or_load(spark: SparkSession, root: str, name: str, build, **params) -> DataFrame:
    """The table of these parameters under ``root``; built and written if it isn't there in full.

    A table is written aside and then named by the file ``current``, which is made where there is none and never
    changed. So readers see a whole table or none, and of several that build at once the first one's stays.
    """
    folder = f"{root.rstrip('/')}/{cache_key(name, **params)}"
    pointer = f"{folder}/current"
    if not exists(spark, pointer):
        data = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{folder}/{data}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/draft-{data}")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        stream = fs.create(target, False)
        stream.write(data.encode())
        stream.close()
        won = named_once(spark, target.toString(), pointer)
        fs.delete(target, False)
        if not won:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{data}"), True)
    return spark.read.parquet(f"{folder}/{_text_of(spark, pointer)}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV files with their name; fails where a column is missing."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in RESULT_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(RESULT_SCHEMA).csv(path)
    return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def write_results(rows: DataFrame, path: str) -> None:
    rows.select(*RESULT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_codebooks(codebook: DataFrame, path: str) -> None:
    """A folder for each class."""
    codebook.write.mode("overwrite").partitionBy("class").parquet(path)


def read_codebooks(spark: SparkSession, path: str, classes: list[int] | None = None) -> DataFrame:
    """All classes, or some: the others' folders are not opened. A class without codebook fails."""
    found = spark.read.parquet(path)
    if classes is None:
        return found
    there = {r[0] for r in found.select("class").where(F.col("class").isin(classes)).distinct().collect()}
    if set(classes) - there:
        raise ValueError(f"no codebook for classes {sorted(set(classes) - there)}")
    return found.where(F.col("class").isin(classes))


def write_by_subject(rows: DataFrame, path: str) -> None:
    """Filters (subject, taps), spectra (subject, bin, p) or barycenters, as one table."""
    rows.write.mode("overwrite").parquet(path)


def read_by_subject(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """What ``write_by_subject`` wrote, checked against ``columns``; None where there is nothing."""
    if not exists(spark, path):
        return None
    found = spark.read.parquet(path)
    missing = [c for c in columns.split() if c not in found.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return found.select(*columns.split())


def with_filters(series: DataFrame, filters: DataFrame, *, required: bool = True) -> DataFrame:
    """Series with their subject's ``taps``; a missing filter fails, or leaves null where it isn't required."""
    joined = series.join(filters.select("subject", "taps"), "subject", "left")
    if not required:
        return joined
    taps = F.when(F.col("taps").isNull(), F.raise_error(F.concat(F.lit("no filter for subject "), F.col("subject").cast("string")))).otherwise(F.col("taps"))
    return joined.withColumn("taps", taps)
