"""Recordings and array files as Spark sources: MAT v5 and NPZ, parsed in the executors from binary files.

A MAT v5 file is a header of 128 bytes and tagged elements; an element can be a zlib stream of another.
Numeric and logical matrices are read, column-major; ``names`` skips all others unparsed, so scanning
labels alone doesn't decode the signals.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the MAT v5 format: data types by number.
_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
_MATRIX, _COMPRESSED = 14, 15
#: Array classes 6 to 15 are numeric: double, single and the integers.
_NUMERIC = range(6, 16)


def _elements(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # a small element has its data in the tag
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size if kind == _COMPRESSED else 8 + -(-size // 8) * 8


def read_mat(raw: bytes, names: set[str] | None = None) -> dict[str, np.ndarray]:
    """The numeric matrices of a MAT v5 file by name."""
    if len(raw) < 128 or raw[126:128] != b"IM":
        raise ValueError("no little-endian MAT v5 file")
    found: dict[str, np.ndarray] = {}
    for kind, body in _elements(raw[128:]):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body)))
        if kind != _MATRIX:
            continue
        parts = _elements(body)
        flags = next(parts)[1]
        shape = np.frombuffer(next(parts)[1], "<i4")
        name = next(parts)[1].decode("latin-1")
        if flags[0] not in _NUMERIC or names is not None and name not in names:
            continue
        code, data = next(parts, (9, b""))
        value = np.frombuffer(data, _TYPES[code]).reshape(shape, order="F")
        found[name] = value.astype(bool) if flags[1] & 2 else value
    return found


def recordings(spark: SparkSession, path: str, *, data: bool = True) -> DataFrame:
    """(file, subject, srate, ic, label, is_expert, samples) of ``subj-NN.mat`` files; samples are null without ``data``.

    Activations are weights times sphere times data; labels count from 0.
    """
    names = {"srate", "labels", "expert_label_mask"} | ({"data", "icaweights", "icasphere"} if data else set())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                m = read_mat(content, names)
                label = m["labels"].ravel().astype(np.int32) - 1
                ics = m["icaweights"] @ m["icasphere"] @ m["data"] if data else [None] * len(label)
                yield pd.DataFrame({"file": file, "srate": float(m["srate"].ravel()[0]), "ic": np.arange(len(label), dtype=np.int32), "label": label, "is_expert": m["expert_label_mask"].ravel().astype(bool), "samples": [None if x is None else x.astype(np.float32) for x in ics]})

    rows = files.mapInPandas(run, "file string, srate double, ic int, label int, is_expert boolean, samples array<float>")
    return rows.withColumn("subject", F.regexp_extract("file", r"subj-(\d+)\.mat$", 1).cast("int"))


def arrays(spark: SparkSession, path: str, name: str = "arr_0") -> DataFrame:
    """(file, shape, values): one array of each NPZ file under ``path``; files without it fail."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as found:
                    value = found[name]
                yield pd.DataFrame({"file": [file], "shape": [list(value.shape)], "values": [value.ravel().astype(np.float64)]})

    return files.mapInPandas(run, "file string, shape array<int>, values array<double>")
