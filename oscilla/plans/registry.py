"""How a module of queries registers them: a function and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    found: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            found[name] = f
            if sql:
                oracles[name] = sql
            return f

        return keep

    return found, oracles, query


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Sums of doubles differ in their last digits with the order of the rows; -0.0 becomes 0.0."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


#: The views of ``sources.signals`` in DuckDB.
SIGNAL = "signal as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as x from events)"
CODES = """codes as (select subject, t, 0 as book, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as code from (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as t, event_type from events)
  union all select user_id, row_number() over (partition by user_id order by ts, event_id) - 1, 1, cast(json_extract_string(props, '$.k') as integer) % 16 from events)"""
LONG = """long as (select l_suppkey as subject, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as t, l_quantity as x from lineitem)"""
SPECTRA = "spectra as (select l_suppkey as subject, year(l_shipdate) % 3 as channel, month(l_shipdate) - 1 as bin, cast(count(*) as double) as p from lineitem group by all)"
VECTORS = "vec as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings)"
LABELLED = "ics as (select source as subject, d.doc_id as ic, coalesce(quality, cast(n_chars % 3 <> 0 as integer)) as label, quality is not null as is_expert, cast(n_chars % 3 <> 0 as integer) as guess from documents d left join labels using (doc_id))"
RESULTS = "results as (select l_linenumber % 7 as win, l_suppkey as subject, 1 - (sum(cast(round(l_discount * 100) as bigint))::double / count(*)) / 100 as score from lineitem group by all)"
