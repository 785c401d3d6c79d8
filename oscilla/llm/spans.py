"""Places of a regular expression in a text, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are evaluated once a row, however often later steps use them.

    A projection may be merged into the next one and its expressions repeated there, also inside the
    steps of higher-order functions; the generator of a one-element array is never merged.
    """
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.withColumn("_fixed", F.explode(F.array(one))).select(*rows.columns, *[F.col("_fixed")[name].alias(name) for name in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used, also inside further lambdas."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """All prefixes of an array folded by an associative function, by doubling: n log n steps, and no array grows in them."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def double(sums: Column, step: Column) -> Column:
        return F.transform(sums, lambda x, i: F.when(i >= step, combine(F.get(sums, i - step), x)).otherwise(x))

    return let(values, lambda v: F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, double))


def spans(text: Column, regex: Column, group: int = 0) -> Column:
    """All matches in order as an array of (start, end, part): code points, end exclusive, and one group's text.

    The pieces between the matches and the matches themselves are laid end to end; their places are
    running sums of lengths, so the work is n log n in the number of matches.
    """
    found, parts = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(group))
    between = F.split(text, regex, -1)
    lengths = F.zip_with(F.transform(found, F.length), F.slice(between, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("p")))

    def placed(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: x["m"] + x["p"]), lambda a, b: a + b)
        return F.transform(F.arrays_zip(ends.alias("end"), F.transform(m, lambda x: x["m"]).alias("m"), parts.alias("part")), lambda x: F.struct((x["end"] - x["m"]).alias("start"), x["end"].alias("end"), x["part"].alias("part")))

    return let(lengths, placed)
