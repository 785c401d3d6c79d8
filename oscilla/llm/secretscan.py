"""Secret scans, with DataFrame operations only.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The method adds
candidate strings, runs of 20 or more token characters with both letters and digits, in which a
window of 20 characters reaches the Shannon entropy asked of the string's character class. The
entropy moves along with the window: the state of the scan holds the count of every character in the
window, five bits each; the counts of the one that leaves and of the one that enters are moved by one and
change the sum of c * log2 c, nothing is counted anew. An allow-list drops added spans that
are placeholders, identifiers in their usual form or digit runs; it never touches base spans.

Most texts hold no candidate at all; one pass of a joint pattern finds that out and nothing else is done.

Edge cases: null and empty texts have no spans; spans of one kind never overlap, those of different
kinds may; texts of any length and strings of any length are scanned whole. Repeated rows are scanned
one by one. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, spans, with_fixed

#: Base kinds in order; the contract's patterns, with the least lengths of runs written into them.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character by class of characters: hexadecimal, letters and digits, base 64.
LEAST_BITS = (("^[0-9a-fA-F-]+$", 3.0), ("^[0-9A-Za-z]+$", 3.6), ("", 3.8))
#: Strings that are no secrets: placeholders, UUIDs, long digit runs, counted-up alphabets, paths and slugs.
#: A repeated group must be possessive: Java gives each repetition a frame of the stack where it could go back.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem|x{4}|0{6}|1234567|abcdefg"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^[0-9-]*[0-9]{14,}[0-9-]*$|^(?:[A-Za-z]++[-_/])++[A-Za-z0-9]{0,6}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
)


#: Characters with a count of their own; all others share one. Twelve counts of five bits make a word.
SYMBOLS = string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/_=-"
BITS, A_WORD = 5, 12
WORDS = -(-(len(SYMBOLS) + 1) // A_WORD)


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of any ``window`` consecutive characters, in bits; 0 for shorter texts.

    Characters that are not in ``SYMBOLS`` count as one and the same.
    """
    if not 0 < window < 1 << BITS:
        raise ValueError(f"a window has 1 to {(1 << BITS) - 1} characters")
    table = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 1)])

    def place(k: int) -> Column:
        shift = BITS * (k % A_WORD)
        return F.struct(F.lit(k // A_WORD).alias("word"), F.lit(shift).alias("shift"), F.lit(1 << shift).cast("long").alias("one"))

    places = F.array(*[place(SYMBOLS.find(chr(c)) % (len(SYMBOLS) + 1)) for c in range(128)])
    other = place(len(SYMBOLS))

    def scan(symbols: Column) -> Column:
        def count(words: Column, s: Column) -> Column:
            return F.call_function("shiftright", F.get(words, s["word"]), s["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        def step(state: Column, i: Column) -> Column:
            come, gone = F.get(symbols, i), F.get(symbols, i - window)
            full, words = i >= window, state["words"]
            same = full & (come["word"] == gone["word"]) & (come["shift"] == gone["shift"])
            was = count(words, gone)
            now = count(words, come) - same.cast("int")
            total = state["sum"] + F.when(full, F.get(table, was - 1) - F.get(table, was)).otherwise(0.0) + F.get(table, now + 1) - F.get(table, now)
            moved = F.transform(words, lambda w, j: w + F.when(come["word"] == j, come["one"]).otherwise(F.lit(0).cast("long")) - F.when(full & (gone["word"] == j), gone["one"]).otherwise(F.lit(0).cast("long")))
            bits = F.when(i >= window - 1, math.log2(window) - total / window).otherwise(0.0)
            return F.struct(moved.alias("words"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

        start = F.struct(F.array(*[F.lit(0).cast("long")] * WORDS).alias("words"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(symbols) - 1), start, step, lambda s: s["best"])

    chars = F.slice(F.split(text, "", -1), F.lit(1), F.length(text))
    symbols = F.transform(chars, lambda c: F.coalesce(F.get(places, F.ascii(c)), other))
    return F.when(F.length(text) >= window, let(symbols, scan)).otherwise(0.0)


def _strong(part: Column) -> Column:
    bits, ask = peak_entropy(part), F.lit(LEAST_BITS[-1][1])
    for pattern, least in reversed(LEAST_BITS[:-1]):
        ask = F.when(part.rlike(pattern), F.lit(least)).otherwise(ask)
    return ~part.rlike(ALLOWED) & (bits >= ask)


def _of_kind(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind"), s["part"].alias("part"))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``spans``: an array of (start, kind order, end, kind, text) in that order, for every document."""
    body = F.when(F.col("text").rlike(ANY), F.col("text"))
    rows = with_fixed(docs.select(F.col(id_col), F.col(text).alias("text")), body=body).drop("text")
    kinds = (
        (ASSIGN, 2, lambda s: F.length(s["part"]) >= 6),
        (ACCESS, 0, None),
        (HEX, 0, None),
        (CANDIDATE, 0, lambda s: _strong(s["part"])),
    )
    found = []
    for k, (pattern, group, keep) in enumerate(kinds):
        own = spans(F.col("body"), F.lit(pattern), group)
        own = F.filter(own, keep) if keep else own
        found.append(F.transform(own, _of_kind(k)))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string,part:string>>)")
    return with_fixed(rows, spans=F.when(F.col("body").isNull(), none).otherwise(F.array_sort(F.concat(*found)))).drop("body")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with assignments, keys, hexadecimal runs and strong candidates replaced in the text; all columns stay."""
    body = F.col(text)
    hidden = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, ASSIGN, "$1=" + mask), ACCESS, mask), HEX, mask)
    between, found = F.split(hidden, CANDIDATE, -1), F.regexp_extract_all(hidden, F.lit(CANDIDATE), F.lit(0))
    kept = F.transform(found, lambda p: F.when(_strong(p), F.lit(mask)).otherwise(p))
    pieces = F.array_join(F.transform(F.arrays_zip(between.alias("b"), kept.alias("k")), lambda x: F.concat(x["b"], F.coalesce(x["k"], F.lit("")))), "")
    return docs.withColumn(text, F.when(body.rlike(ANY), pieces).otherwise(body))


def op6_secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    rows = secret_spans(documents)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(F.filter("spans", lambda s: s["k"] < 3))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
