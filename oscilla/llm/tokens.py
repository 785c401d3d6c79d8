"""Token counts: batch encoding in an Arrow function that returns lengths only.

Only the text column goes to Python and only one number a row comes back. A worker takes its rows in
windows of bytes, however they are spread over rows, so a batch of many short texts and a part of a very
long one weigh the same. A window is cut into pieces at safe boundaries, places at which the tokenizer
starts anew whatever stands on either side; equal pieces are encoded once, in batches of about
``BATCH_BYTES``, and the lengths are summed by row. A stretch without a safe boundary is encoded whole.

What is safe depends on the tokenizer, named by ``CUTS``:

* ``spaces``: its splitter throws white space away and no rule reads over it, so each word stands alone.
  ASCII white space composes with nothing, so normal forms of the parts are those of the whole. A full
  stop or comma behind an ASCII letter begins a piece, too, as words of letters end there.
* ``letters``: byte-level splitting, where a space goes with the letters after it: before a space that
  stands between two ASCII letters.
* ``prefix``: each text gets a space in front and no entry of the vocabulary has one behind other
  characters: at a space between two ASCII letters, which the next piece gets back as its prefix.
* ``whole``: texts are encoded as they are; the choice for any other file.

The tokenizer's file is read by the driver and broadcast, up to ``MOST_BYTES``, so that executors need no
file. Special strings inside texts are handled as the library does by default; there are no begin, end
or added special tokens, no truncation and no padding.

Edge cases: a null text is empty; empty texts have no tokens; repeated rows are counted each. Only the id
and text columns are read, so other columns can have any name. Empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordscan import buffers

#: Bytes of text that are cut at a time, and bytes of distinct pieces that are encoded at a time.
WINDOW = 1 << 22
BATCH_BYTES = 1 << 16
#: Pieces whose lengths a worker keeps, and the longest of them.
KNOWN, KNOWN_BYTES = 1 << 19, 64
#: The largest tokenizer file that is broadcast.
MOST_BYTES = 1 << 26
#: How each file may be cut.
CUTS = {"word_bpe_49k.json": "spaces", "byte_bpe_50k.json": "letters", "piece_bpe_32k.model": "prefix"}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Counter:
    """Lengths of texts under one tokenizer, cut by one of the rules above."""

    def __init__(self, name: str, data: bytes, cut: str) -> None:
        if cut not in ("spaces", "letters", "prefix", "whole"):
            raise ValueError(f"unknown cut: {cut}")
        self.cut, self.known = cut, {}
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            own = Tokenizer.from_str(data.decode())
            own.no_truncation()
            own.no_padding()
            self.encoded = lambda texts: [len(x) for x in own.encode_batch(texts, add_special_tokens=False)]
        elif name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            piece = SentencePieceProcessor(model_proto=data)
            self.encoded = lambda texts: [len(x) for x in piece.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
        else:
            raise ValueError(f"no library for {name}")

    def marks(self, raw: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For the bytes from ``low`` to ``high``: which ones begin a piece and which ones belong to none."""
        size = high - low
        rows = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        first = np.zeros(size, bool)
        first[rows] = True
        if self.cut == "spaces":
            # a byte more on the left: the first byte begins a piece if a space or another row ends before it
            dropped = _SPACE[raw[max(0, low - 1) : high]]
            before = np.concatenate([[True], dropped])[:size] if not low else dropped[:-1]
            dropped = dropped[-size:]
            stop = (raw[low:high] == 44) | (raw[low:high] == 46)
            stop[1:] &= _LETTER[raw[low : high - 1]]
            stop[0] &= bool(low) and _LETTER[raw[low - 1]]
            return ~dropped & (before | first | stop), dropped
        none = np.zeros(size, bool)
        if self.cut == "whole":
            return first, none
        letter = np.zeros(size + 4, bool)  # of the bytes from low - 2 on
        there = slice(max(0, low - 2), min(len(raw), high + 2))
        letter[there.start - (low - 2) : there.stop - (low - 2)] = _LETTER[raw[there]]
        space = np.zeros(size + 1, bool)  # of the bytes from low - 1 on: a space between letters of one row
        there = slice(max(0, low - 1), high)
        space[there.start - (low - 1) :] = raw[there] == 32
        space &= letter[:-3] & letter[2:-1]
        ends = np.zeros(size + 3, bool)  # row starts among the bytes from low - 1 on
        rows = offsets[np.searchsorted(offsets, low - 1) : np.searchsorted(offsets, high + 2)] - (low - 1)
        ends[rows[rows < size + 3]] = True
        space &= ~ends[: size + 1] & ~ends[1 : size + 2]
        if self.cut == "letters":
            return first | space[1:], none
        return first | space[:-1], space[1:]

    def windows(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(low, starts, dropped) for windows that end where a piece begins."""
        low, size = 0, WINDOW
        while low < len(raw):
            high = min(len(raw), low + size)
            starts, dropped = self.marks(raw, offsets, low, high)
            if high < len(raw):
                later = np.flatnonzero(starts[1:])
                if not len(later):  # no safe boundary in so many bytes
                    size *= 2
                    continue
                high = low + 1 + int(later[-1])
            yield low, starts[: high - low], dropped[: high - low]
            low, size = high, WINDOW

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        """The lengths of distinct pieces; those not known yet are encoded in batches of even bytes."""
        out = [self.known.get(p) for p in pieces]
        new = [k for k, n in enumerate(out) if n is None]
        low, total = 0, 0
        for at, k in enumerate(new):
            total += len(pieces[k])
            if total >= BATCH_BYTES or at + 1 == len(new):
                own = [pieces[j] for j in new[low : at + 1]]
                for j, piece, n in zip(new[low : at + 1], own, self.encoded(own)):
                    out[j] = n
                    if len(piece) <= KNOWN_BYTES:
                        self.known[piece] = n
                low, total = at + 1, 0
        if len(self.known) > KNOWN:
            self.known.clear()
        return np.array(out, np.int64)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        raw, offsets = buffers(column)
        out = np.zeros(len(column), np.int64)
        filled = np.flatnonzero(np.diff(offsets))  # rows with bytes
        begins = offsets[filled]
        for low, starts, dropped in self.windows(raw, begins):
            kept = ~dropped
            at = np.flatnonzero(starts[kept])
            if not len(at):
                continue
            data = raw[low : low + len(starts)][kept]
            ends = np.append(at, len(data)).astype(np.int64)
            # bytes before the first piece of a window belong to none, as windows begin with one
            pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
            tokens = self.of_pieces(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
            rows = np.searchsorted(begins, low + np.flatnonzero(starts), "right") - 1
            out[filled] += np.bincount(rows, tokens, minlength=len(filled)).astype(np.int64)
        return out


@lru_cache(maxsize=2)
def counter(name: str, data: bytes, cut: str) -> Counter:
    """One for each tokenizer and Python worker: loading takes longer than a small batch."""
    return Counter(name, data, cut)


def token_count(spark: SparkSession, text: Column, tokenizer: str, *, cut: str | None = None) -> Column:
    """The number of tokens of ``text`` under the tokenizer in the file ``tokenizer``, a ``.json`` or ``.model``."""
    name = os.path.basename(tokenizer)
    if os.path.getsize(tokenizer) > MOST_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MOST_BYTES} bytes")
    with open(tokenizer, "rb") as file:
        data = spark.sparkContext.broadcast(file.read())
    cut = cut or CUTS.get(name, "whole")

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(name, data.value, cut)
        for batch in batches:
            yield pa.array(own.lengths(batch), pa.int64())

    return counted(text)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 2048, cut: str | None = None) -> DataFrame:
    """For each document its id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    filled = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = filled.select(F.col(id_col), F.octet_length("text").cast("long").alias("n_bytes"), token_count(docs.sparkSession, F.col("text"), tokenizer, cut=cut).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    return token_counts(documents.select(F.col("doc_id").cast("long"), "text"), tokenizer)
