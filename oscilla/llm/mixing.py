"""Mixing sources to target weights, with DataFrame operations only.

Leaves are (domain, language, source). Weights go down that tree from a token budget: the children of
a node share its budget by weight, none gets more than it can supply in ``max_epochs`` passes over
its documents, and what a child cannot supply goes to its siblings by weight before the parent passes
the rest to its own siblings. The shares of all children of all nodes come from window functions over
the tree alone: children sorted by supply / weight, so the full ones are a prefix.

A leaf with an allowance of A tokens out of T repeats all documents A div T times and takes from one
more epoch the prefix of A mod T tokens, in the order of md5(seed:epoch:doc_id); the document on the
edge gives its first tokens. Prefix sums are taken over hash ranges first, in the one range that holds
the edge over ids and sizes, and of one id and size over the parts of the table, so neither a hot source
nor a hot id is sorted in one task.

Edge cases: null languages and sources count as ''; a null or empty text has no tokens and is never
taken; a null id hashes as ''; rows of one id are rows of their own, each with its tokens, the shorter
first; missing weights are 1; a budget above the whole supply takes all of it; empty tables give empty
results. Only the named columns are read; others can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

LEVELS = ("domain", "lang", "source")
#: Documents of a hash range on average.
RANGE_ROWS = 4096


def tokens(text: str) -> Column:
    """Words of a text, ended by white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]++")), F.lit(0)).cast("long")


def _shares(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split ``budget`` among the children of each parent by ``weight``, ``supply`` permitting; adds ``share``.

    In order of supply / weight, child k is full if it and those before fit: supply_k * W_k <= weight_k
    * (budget - supply of those before), W_k the weight from k on. The others get their part of the
    rest, rounded down, and the remainder goes one token each to the first of them.
    """
    by = Window.partitionBy(*parent).orderBy(F.expr("supply / cast(weight as double)"), "node")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = F.col("supply").cast("decimal(38,0)")
    at = nodes.withColumn("spent", F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("w", F.sum("weight").over(after))
    at = at.withColumn("rest", F.greatest(F.col("budget") - F.col("spent"), F.lit(0)))
    at = at.withColumn("full", F.max(F.when(whole * F.col("w") > F.col("weight") * F.col("rest").cast("decimal(38,0)"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    open_ = Window.partitionBy(*parent, "full")
    at = at.withColumn("pool", F.max("rest").over(open_)).withColumn("ws", F.sum("weight").over(open_))
    at = at.withColumn("part", F.expr("cast((cast(weight as decimal(20,0)) * cast(pool as decimal(18,0))) div ws as bigint)"))
    at = at.withColumn("over", F.col("pool") - F.sum("part").over(open_)).withColumn("k", F.row_number().over(open_.orderBy("node")))
    share = F.when(F.col("full"), F.col("supply")).otherwise(F.least("supply", F.col("part") + (F.col("k") <= F.col("over")).cast("long")))
    return at.withColumn("share", share.cast("long")).drop("spent", "w", "rest", "full", "pool", "ws", "part", "over", "k")


def allowances(supply: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, available, share) for each leaf; ``supply`` has its available tokens.

    ``weights`` has for each level the whole-numbered weight of each name.
    """
    if any(w <= 0 for names in weights.values() for w in names.values()) or max_epochs < 1:
        raise ValueError("weights and epochs must be positive")
    tree = supply.withColumn("total", budget)
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        table = F.create_map(*[F.lit(x) for pair in weights.get(level, {}).items() for x in pair]) if weights.get(level) else None
        weight = F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)) if table is not None else F.lit(1)
        above = "total" if not depth else "share"
        nodes = tree.groupBy(*path).agg((F.sum("available") * max_epochs).alias("supply"), F.first(above).alias("budget"))
        nodes = nodes.select("*", F.col(level).alias("node"), weight.cast("long").alias("weight"))
        found = _shares(nodes, path[:-1]).select(*path, "share")
        tree = tree.drop("share").join(found, path)
    return tree.select(*LEVELS, "available", "share")


def _taken(counted: DataFrame, *, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int, seed: int, range_rows: int) -> DataFrame:
    """(row, id, leaf, epoch, n, take) for each row and epoch taken of ``counted``, a written table of (row, id, leaf, n)."""
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n").alias("available"), F.count("*").alias("docs"))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    shares = allowances(leaves.drop("docs"), F.lit(total * budget_percent // 100).cast("long"), weights, max_epochs)
    plan = leaves.select(*LEVELS, "docs").join(shares, list(LEVELS)).select(
        *LEVELS, F.expr("share div available").alias("rounds"), F.expr("share % available").alias("edge"),
        F.greatest(F.lit(1), F.shiftright(F.col("docs"), range_rows.bit_length() - 1)).alias("ranges"),
    )
    plan = written(plan, "mix-plan")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rounds").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    placed = counted.join(plan, list(LEVELS)).withColumn("key", key)
    placed = placed.withColumn("range", F.expr("cast(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * ranges div 4294967296 as bigint)"))

    def before(sums: DataFrame, *order: str) -> DataFrame:
        """``sums`` (leaf, ..., sum) with the tokens ahead of each in its leaf."""
        upto = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy(*order))
        return sums.withColumn("before", upto - F.col("sum"))

    # of all ranges only the one that holds the edge, and what comes before it
    sums = placed.where("edge > 0").groupBy(*LEVELS, "range").agg(F.sum("n").alias("sum"), F.first("edge").alias("edge"))
    edges = before(sums, "range").where("before < edge and edge <= before + sum").select(*LEVELS, F.col("range").alias("last"), F.col("before").alias("start"))
    placed = placed.join(edges, list(LEVELS), "left")
    within = placed.where("range = last")

    # in that range, of all (key, tokens) the one that holds it: rows of one id and size are alike there
    alike = within.groupBy(*LEVELS, "key", "id", "n").agg(F.sum("n").alias("sum"), F.first("edge").alias("edge"), F.first("start").alias("start"))
    alike = written(before(alike, "key", "id", "n").withColumn("left", F.expr("edge - start - before")), "mix-edge").where("left > 0")
    alike = alike.select(*LEVELS, "key", "n", "left", (F.col("left") < F.col("sum")).alias("cut"))
    held = within.join(alike, [*LEVELS, "key", "n"])

    # and of those the first rows, counted by the part of the table that they stand in, so that copies of one row are dealt out
    cut = held.where("cut").withColumn("part", F.shiftright("row", 33))
    parts = cut.groupBy(*LEVELS, "part").agg(F.count("*").alias("sum"))
    parts = before(parts, "part").select(*LEVELS, "part", "before")
    number = F.row_number().over(Window.partitionBy(*LEVELS, "part").orderBy("row"))
    cut = cut.join(parts, [*LEVELS, "part"]).withColumn("take", F.expr("left") - (F.col("before") + number - 1) * F.col("n")).where("take > 0")

    epochs = placed.where("rounds > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
    whole = placed.where("range < last").unionByName(held.where("not cut"), allowMissingColumns=True)
    shown = ["row", "id", *LEVELS]
    out = epochs.select(*shown, "epoch", "n", F.col("n").alias("take")).union(whole.select(*shown, "rounds", "n", "n"))
    return out.union(cut.select(*shown, "rounds", "n", F.least("n", "take")))


def _counted(docs: DataFrame, row: Column, domain: Column, id_col: str, text: str, lang: str, source: str) -> DataFrame:
    leaf = [F.coalesce(c, F.lit("")).alias(name) for c, name in ((domain, "domain"), (F.col(lang), "lang"), (F.col(source), "source"))]
    return written(docs.select(row.alias("row"), F.col(id_col).alias("id"), *leaf, tokens(text).alias("n")).where("n > 0"), "tokens")


def mix(docs: DataFrame, *, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 60, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each document and epoch taken: id, domain, lang, source, epoch, n_tokens, take_tokens.

    The budget is ``budget_percent`` of all tokens of ``docs``.
    """
    counted = _counted(docs, F.monotonically_increasing_id(), domain, id_col, text, lang, source)
    out = _taken(counted, budget_percent=budget_percent, weights=weights, max_epochs=max_epochs, seed=seed, range_rows=range_rows)
    return out.select(F.col("id").alias(id_col), *LEVELS, F.col("epoch").cast("long").alias("epoch"), F.col("n").alias("n_tokens"), F.col("take").cast("long").alias("take_tokens"))


def prefix(text: Column, n_tokens: Column) -> Column:
    """The text up to the end of its first ``n_tokens`` words."""
    pieces = F.regexp_extract_all(text, F.lit(r"([ \t\n\x0B\f\r]*+[^ \t\n\x0B\f\r]++)"))
    return F.array_join(F.slice(pieces, 1, n_tokens.cast("int")), "")


def mixed_documents(docs: DataFrame, *, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 60, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, a row for each epoch, texts on the edge cut to their prefix.

    ``docs`` is written with a number for each row, by which takes come back to it, so rows without id and rows that
    share one are told apart. Its columns can have any names.
    """
    names = docs.columns
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"), domain.alias("domain")), "mix-rows")
    own = {c: f"c{i}" for i, c in enumerate(names)}
    counted = _counted(base.select("row", "domain", "doc.*"), F.col("row"), F.col("domain"), own[id_col], own[text], own[lang], own[source])
    taken = _taken(counted, budget_percent=budget_percent, weights=weights, max_epochs=max_epochs, seed=seed, range_rows=range_rows)
    both = base.select("row", "doc").join(taken.select("row", "n", "take").hint("shuffle_hash"), "row")
    body = F.col("doc")[own[text]]
    cut = F.when(F.col("take") < F.col("n"), prefix(body, F.col("take"))).otherwise(body)
    return both.select(*[(cut if c == text else F.col("doc")[own[c]]).alias(c) for c in names])


#: The weights of production: by domain, language and source; any other name weighs 1.
WEIGHTS = {
    "domain": {"web": 4, "reference": 3, "code": 2, "forum": 1},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2, "src4": 3, "src9": 3},
}
#: The domain of a source: four groups of five.
DOMAIN = "case when source rlike '^src[0-4]$' then 'web' when source rlike '^src[5-9]$' then 'reference' when source rlike '^src1[0-4]$' then 'code' else 'forum' end"


def op2_mixing(documents: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, take_tokens of the production mix."""
    return mix(documents, domain=F.expr(DOMAIN), weights=WEIGHTS)


def _sql() -> str:
    """The same in DuckDB: shares by the closed form at each level, one running sum over each leaf."""
    parts = [
        f"""t as (select doc_id, case when regexp_matches(source, '^src[0-4]$') then 'web' when regexp_matches(source, '^src[5-9]$') then 'reference'
  when regexp_matches(source, '^src1[0-4]$') then 'code' else 'forum' end as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
  cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as bigint) as n from documents where len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 0)""",
        "leaf as (select domain, lang, source, cast(sum(n) as bigint) as available from t group by all)",
        "s0 as (select cast(sum(available) as bigint) * 60 // 100 as share from leaf)",
    ]
    for depth, level in enumerate(LEVELS):
        path, up = LEVELS[: depth + 1], LEVELS[:depth]
        weight = f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[level].items()) + " else 1 end"
        join = f"join s{depth} using ({', '.join(up)})" if up else "cross join s0"
        of = "partition by " + ", ".join(up) if up else ""
        group = f"partition by {', '.join([*up, 'isfull'])}"
        parts.append(f"""a{depth} as (select {', '.join(f'g.{p}' for p in path)}, g.supply, s{depth}.share as budget, {weight} as weight, g.{level} as node
  from (select {', '.join(path)}, cast(sum(available) as bigint) * 4 as supply from leaf group by all) g {join}),
b{depth} as (select *, greatest(budget - coalesce(sum(supply) over (win rows between unbounded preceding and 1 preceding), 0), 0) as rest,
  sum(weight) over (win rows between current row and unbounded following) as w from a{depth} window win as ({of} order by supply / cast(weight as double), node)),
c{depth} as (select *, max(case when supply * w > weight * rest then 1 else 0 end) over ({of} order by supply / cast(weight as double), node rows between unbounded preceding and current row) = 0 as isfull from b{depth}),
d{depth} as (select *, max(rest) over ({group}) as pool, weight * max(rest) over ({group}) // sum(weight) over ({group}) as part, row_number() over ({group} order by node) as k from c{depth}),
s{depth + 1} as (select {', '.join(path)}, cast(case when isfull then supply else least(supply, part + case when k <= pool - sum(part) over ({group}) then 1 else 0 end) end as bigint) as share from d{depth})""")
    parts.append("""p as (select t.*, share // available as rounds, share % available as edge,
  md5('17:' || cast(share // available as varchar) || ':' || cast(doc_id as varchar)) as key from t join leaf using (domain, lang, source) join s3 using (domain, lang, source)),
q as (select *, coalesce(sum(n) over (partition by domain, lang, source order by key, doc_id, n rows between unbounded preceding and 1 preceding), 0) as ahead from p)""")
    return "with " + ",\n".join(parts) + """
select doc_id, domain, lang, source, cast(epoch as bigint) as epoch, n as n_tokens, n as take_tokens from (select *, unnest(range(rounds)) as epoch from q)
union all select doc_id, domain, lang, source, cast(rounds as bigint), n, cast(least(n, edge - ahead) as bigint) from q where ahead < edge"""


ORACLE = _sql()
