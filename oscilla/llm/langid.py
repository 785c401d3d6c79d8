"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read a text's UTF-8 bytes in either direction; at every byte both states
give a distribution over the languages, and a document's probabilities are the mean of those of all
its bytes. Whole texts are read, in segments of ``SEGMENT`` bytes, so that a batch of any mix of
lengths is one matrix; both directions start ``WARM`` bytes before a segment's first byte, so the state
at every byte has seen at least so many of its neighbours on either side, where the text has them.
Training is backpropagation through time on segments of labelled documents with Adam, from a fixed seed.

Bounds: the network is trained on at most ``max_train`` documents a language, those with the least
hashes of their id, and of each on at most ``max_bytes`` bytes from a place the hash picks. Every language
is learned, so the sample grows with their number, and so do the steps of training above ``USUAL`` languages.
Prediction has no bound: every byte of every text counts.

``drop_unknown`` rejects by the network: a document stays if the probability of its best language is at
least ``LEAST`` times what a guess among the languages learned would have.

Edge cases: a null text and one without a letter are ``und`` with score 0. Null languages are not
learned. Without any labelled document, every text is ``und``, and ``drop_unknown`` can only reject those
without a letter. Ties go to the language that sorts first. Repeated rows and copies get equal results;
only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordscan import blocks, buffers

SEGMENT = 192
#: Bytes that either direction reads ahead of a segment, to bring its state up to it.
WARM = 32
HIDDEN = 8
#: The least probability that keeps a document, as a multiple of that of a guess.
LEAST = 1.3
#: Segments that go through the network together; fewer above USUAL languages, so that their probabilities take no more memory.
STRIDE = 2048
#: Languages up to which a batch and the steps of training are as they are; above, both follow the number of languages.
USUAL = 64


class ByteGru:
    """Weights for both directions: input tables (3H, 257), recurrent matrices (3H, H); output (L, 2H) and bias."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.tables = [rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32) for _ in range(2)]
        for table in self.tables:
            table[:hidden, 256] = 40  # an update gate of 1: padding leaves a state as it is, and has no gradient
        self.loops = [rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32) for _ in range(2)]
        self.out = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, self.out, self.bias]

    def _states(self, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) of one direction for bytes (T, B), 256 for padding."""
        h_n, table, loop = self.hidden, self.tables[way], self.loops[way]
        steps, batch = x.shape
        states = np.empty((steps, h_n, batch), np.float32)
        h = np.zeros((h_n, batch), np.float32)
        half = np.float32(0.5)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g = table.take(x[t], axis=1)
            u = loop @ h
            gates = u[: 2 * h_n]
            gates += g[: 2 * h_n]
            gates *= half
            np.tanh(gates, out=gates)
            gates += 1
            gates *= half  # update and reset gates
            z, r = gates[:h_n], gates[h_n:]
            rec = u[2 * h_n :]
            cand = rec * r
            cand += g[2 * h_n :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((t, h, z.copy(), r.copy(), rec.copy(), cand.copy()))
            new = states[t]
            np.subtract(h, cand, out=new)
            new *= z
            new += cand
            h = new
        return states

    def positions(self, x: np.ndarray, which: slice = slice(None)) -> np.ndarray:
        """Probabilities (T, L, B) of the languages at every byte, or at those of ``which``."""
        logits = self.out[:, : self.hidden] @ self._states(x[: which.stop], 0)[which.start or 0 :]
        after = x[which.start or 0 :]
        logits += self.out[:, self.hidden :] @ self._states(after, 1)[: len(logits)]
        logits += self.bias
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy a byte and its gradients, by backpropagation through time; ``used`` marks real bytes."""
        h_n, (steps, batch) = self.hidden, x.shape
        kept: list[list] = [[], []]
        states = [self._states(x, way, kept[way]) for way in range(2)]
        both = np.concatenate(states, 1)
        logits = self.out @ both + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        mass = used / used.sum()
        one = np.zeros_like(p)
        one[:, y, np.arange(batch)] = 1
        loss = float(-(np.log((p * one).sum(1) + 1e-12) * mass).sum())
        d = (p - one) * mass[:, None, :]
        d_out = np.einsum("tlb,thb->lh", d, both, optimize=True)
        d_both = self.out.T @ d
        grads: list[np.ndarray] = []
        loops = []
        # the bytes of all steps in order, so that each row of a table is one sum over a run of them
        order = np.argsort(x, axis=None, kind="stable")
        found, begin = np.unique(x.ravel()[order], return_index=True)
        for way in range(2):
            d_states = d_both[:, way * h_n : (way + 1) * h_n]
            d_table, d_loop = np.zeros_like(self.tables[way]), np.zeros_like(self.loops[way])
            carry = np.zeros((h_n, batch), np.float32)
            inputs = np.empty((3 * h_n, steps, batch), np.float32)
            d_rec = np.empty((3 * h_n, batch), np.float32)
            for t, before, z, r, rec, cand in reversed(kept[way]):
                dh = d_states[t] + carry
                d_cand = dh * (1 - z) * (1 - cand * cand)
                d_rec[:h_n] = dh * (before - cand) * z * (1 - z)
                d_rec[h_n : 2 * h_n] = d_cand * rec * r * (1 - r)
                d_rec[2 * h_n :] = d_cand * r
                inputs[: 2 * h_n, t] = d_rec[: 2 * h_n]
                inputs[2 * h_n :, t] = d_cand
                d_loop += d_rec @ before.T
                carry = dh * z + self.loops[way].T @ d_rec
            d_table[:, found] = np.add.reduceat(inputs.reshape(3 * h_n, -1)[:, order], begin, axis=1)
            grads.append(d_table)
            loops.append(d_loop)
        return loss, [*grads, *loops, d_out, d.sum((0, 2))[:, None]]

    def fit(self, x: np.ndarray, y: np.ndarray, used: np.ndarray, *, steps: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on random batches of segments (T, N)."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        for k in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], batch)
            _, grads = self.gradients(x[:, pick], y[pick], used[:, pick])
            speed = rate * (1 - k / (steps + 1)) ** 0.5
            for w, g, m, v in zip(self.weights(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (speed * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities (rows, L) of whole texts."""
        rows = len(offsets) - 1
        sums = np.zeros((rows, len(self.langs)))
        lengths = np.diff(offsets)
        pieces = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(rows), pieces)
        within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][row] + within * SEGMENT
        size = np.minimum(SEGMENT, offsets[1:][row] - start)
        order = np.argsort(size, kind="stable")  # short last segments go together
        stride = max(1, STRIDE * USUAL // max(USUAL, len(self.langs)))
        for low in range(0, len(order), stride):
            at = order[low : low + stride]
            longest = int(size[at].max())
            step = np.arange(-WARM, longest + WARM)[:, None]
            place = start[at] + step
            text = (place >= offsets[:-1][row[at]]) & (place < offsets[1:][row[at]])
            x = np.where(text, raw[np.clip(place, 0, len(raw) - 1)], np.int16(256))
            used = step[WARM : WARM + longest] < size[at]
            p = self.positions(x, slice(WARM, WARM + longest))
            p *= used[:, None, :]
            np.add.at(sums, row[at], p.sum(0).T)
        return sums / np.maximum(lengths, 1)[:, None]


def segments(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training segments (T, N) with their labels and masks; a text's last one is shorter."""
    cut = [(t[i : i + SEGMENT], y) for t, y in zip(texts, labels) for i in range(0, len(t), SEGMENT)]
    x = np.full((SEGMENT, len(cut)), 256, np.int16)
    used = np.zeros((SEGMENT, len(cut)), np.float32)
    for k, (piece, _) in enumerate(cut):
        x[: len(piece), k] = np.frombuffer(piece, np.uint8)
        used[: len(piece), k] = 1
    return x, np.array([y for _, y in cut]), used


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 160, max_bytes: int = 2048) -> ByteGru | None:
    """A network for the languages of ``docs``, from a bounded sample of it; None if there is nothing to learn."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(text).alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    # the share of each language's documents that gives max_train of them, by hash
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_train / n))])
    part = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - max_bytes // 2, F.lit(1))).cast("int")
    sample = rows.where(part < F.try_element_at(share, F.col("lang"))).select("lang", "h", F.substring(F.col("text"), start + 1, F.lit(max_bytes)).alias("text"))
    found = sample.orderBy("h", "lang").limit(2 * max_train * len(counts)).collect()
    found = found or rows.orderBy("h", "lang").select("lang", "h", F.substring("text", 1, max_bytes).alias("text")).limit(max_train).collect()
    langs = sorted({r.lang for r in found})
    net = ByteGru(langs)
    if len(langs) > 1:
        net.fit(*segments([r.text.encode()[:max_bytes] for r in found], [langs.index(r.lang) for r in found]), steps=260 * max(USUAL, len(langs)) // USUAL)
    return net


def _lettered(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or any that Unicode calls so."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    some = seen[offsets[1:]] > seen[offsets[:-1]]
    for row in np.flatnonzero(~some & (offsets[1:] > offsets[:-1])):
        some[row] = any(c.isalpha() for c in raw[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace"))
    return some


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows of a column: first row, end, their bytes and offsets."""
    raw, offsets = buffers(column)
    for low, high in blocks(offsets):
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _named(net: ByteGru | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """The language and its probability of every text of a column."""
    langs, scores = [], []
    for low, high, own, at in _pieces(column):
        letters = _lettered(own, at)
        pooled = net.documents(own, at) if net is not None else np.zeros((high - low, 1))
        best = pooled.argmax(1)
        for row in range(high - low):
            known = net is not None and letters[row]
            langs.append(net.langs[best[row]] if known else "und")
            scores.append(min(1.0, float(pooled[row, best[row]])) if known else 0.0)
    return langs, scores


def predict(docs: DataFrame, net: ByteGru | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _named(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"id {id_type}, lang string, score double").toDF(id_col, "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those not held out."""
    net = train(documents.where(~held_out()))
    return predict(documents, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST) -> DataFrame:
    """``docs`` without those the network can't name: no letter, or no language of ``least`` times a guess's probability.

    Rows are judged where they are read, on their text alone; all columns of the others stay as they are.
    Where fewer than two languages can be learned there is nothing to choose from, and every text with a letter stays.
    """
    net = train(docs.where(~held_out(id_col)), id_col=id_col, text=text, lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    ask = least / len(net.langs) if net is not None and len(net.langs) > 1 else 0.0
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            if shared.value is None:
                known = [bool(x) for low, high, own, offsets in _pieces(column) for x in _lettered(own, offsets)]
            else:
                known = [name != "und" and score >= ask for name, score in zip(*_named(shared.value, column))]
            yield batch.filter(pa.array(known, pa.bool_()))

    slots = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(slots, docs.schema.fields)])
    return docs.toDF(*slots).mapInArrow(run, schema).toDF(*docs.columns)
