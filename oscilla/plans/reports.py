"""Queries on labels, splits, votes, scores and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, labels
from ..operators.windows import capped
from ..sources import signals as src
from ..sources import tables
from . import workflows
from .registry import CODES, LABELLED, RESULTS, SIGNAL, SPECTRA, registry, rounded

QUERIES, ORACLES, query = registry()

# --- reports over result rows


@query("mean_std_by_window", f"with {RESULTS} select win as window, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as n from results group by win")
def mean_std_by_window(spark, d):
    return evaluation.by_window(src.results(spark, d)).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("report_head", f"with {RESULTS} select win as window, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as n from results group by win order by win limit 3")
def report_head(spark, d):
    return evaluation.ordered(evaluation.by_window(src.results(spark, d)), first=3).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("mean_std_join", f"with {RESULTS}, m as (select win, avg(score) as mean from results group by win), s as (select win, stddev_samp(score) as std from results group by win) select win as window, round(mean, 6) as mean, round(std, 6) as std from m join s using (win)")
def mean_std_join(spark, d):
    results = src.results(spark, d)
    mean, std = results.groupBy("window").agg(F.avg("score").alias("mean")), results.groupBy("window").agg(F.stddev_samp("score").alias("std"))
    return mean.join(std, "window").select("window", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("dedup_then_stats", f"""with {RESULTS}, twice as (select win, subject, score from results union all select win, subject, score from results where win = 5), one as (select distinct win, subject, score from twice)
select win as window, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as n from one group by win""")
def dedup_then_stats(spark, d):
    results = src.results(spark, d)
    twice = results.unionByName(results.where("window = 5"))
    one = evaluation.first_by(twice, ["window", "subject"], [F.col("score")])
    return evaluation.by_window(one).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("duplicate_rows_kept", f"with {RESULTS}, twice as (select win, subject, score from results union all select win, subject, score from results where win = 5) select win as window, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as n from twice group by win")
def duplicate_rows_kept(spark, d):
    results = src.results(spark, d)
    return evaluation.by_window(results.unionByName(results.where("window = 5"))).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("group_size_check", f"with {RESULTS} select win as window, count(distinct subject) as n from results where not (win = 2 and subject % 2 = 0) group by win having count(distinct subject) <> (select count(distinct subject) from results)")
def group_size_check(spark, d):
    results = src.results(spark, d)
    return evaluation.incomplete_windows(results.where("not (window = 2 and subject % 2 = 0)"), results.select("subject").distinct().count())


@query("union_configs", f"with {RESULTS} select 'a' as config, win as window, round(avg(score), 6) as mean from results where subject % 2 = 0 group by win union all select 'b', win, round(avg(score), 6) from results where subject % 2 = 1 group by win")
def union_configs(spark, d):
    results = src.results(spark, d).withColumn("config", F.when(F.col("subject") % 2 == 0, "a").otherwise("b"))
    parts = [results.where(F.col("config") == c).groupBy("config", "window").agg(rounded(F.avg("score")).alias("mean")) for c in ("a", "b")]
    return parts[0].unionByName(parts[1])


@query("config_filter", f"with {RESULTS} select win as window, subject, score from results where win = 3 and subject % 4 = 1")
def config_filter(spark, d):
    results = src.results(spark, d).withColumn("kind", F.col("subject") % 4)
    return evaluation.matching(results, {"window": 3, "kind": 1, "cmmn_filter": "x"}, ignore={"cmmn_filter"}).select("window", "subject", "score")


@query("window_isin", f"with {RESULTS} select win as window, subject, score from results where win in (1, 3, 5)")
def window_isin(spark, d):
    return src.results(spark, d).where(F.col("window").isin(1, 3, 5)).select("window", "subject", "score")


@query("idxmax_window", f"""with {RESULTS}, m as (select win, avg(score) as mean from results group by win)
select (select win from m order by round(mean, 9) desc, win limit 1) as window, round(max(mean), 6) as highest, round(avg(mean), 6) as overall, round(min(mean), 6) as lowest from m""")
def idxmax_window(spark, d):
    best = evaluation.best_window(evaluation.by_window(src.results(spark, d)))
    return best.select("window", *[rounded(c).alias(c) for c in ("highest", "overall", "lowest")])


@query("jackknife", f"""with {RESULTS}, o as (select win, subject, sum(score) as s, count(score) as n from results group by all), l as (select win, (sum(s) over (partition by win) - s) / (sum(n) over (partition by win) - n) as m from o)
select win as window, round(avg(m), 6) as mean, round(stddev_samp(m), 8) as std from l group by win""")
def jackknife(spark, d):
    return evaluation.jackknife(src.results(spark, d)).select("window", rounded("mean").alias("mean"), rounded("std", 8).alias("std"))


@query("error_band", f"with {RESULTS} select win as window, round(avg(score) - stddev_samp(score), 6) as low, round(avg(score), 6) as mid, round(avg(score) + stddev_samp(score), 6) as high from results group by win order by win")
def error_band(spark, d):
    table = evaluation.by_window(src.results(spark, d))
    return table.select("window", rounded(F.col("mean") - F.col("std")).alias("low"), rounded("mean").alias("mid"), rounded(F.col("mean") + F.col("std")).alias("high")).orderBy("window")


@query("distinct_configs", "select distinct l_returnflag as flag, l_linestatus as status from lineitem")
def distinct_configs(spark, d):
    return src.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).distinct()


# --- labels, splits, weights


@query("label_coalesce", f"with {LABELLED} select ic, subject, label, is_expert from ics")
def label_coalesce(spark, d):
    docs = src.table(spark, d, "documents").join(src.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    guess = F.when(F.col("n_chars") % 3 != 0, F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    return docs.select(F.col("doc_id").alias("ic"), F.col("source").alias("subject"), labels.coalesced(F.col("quality"), guess).alias("label"), F.col("quality").isNotNull().alias("is_expert"))


@query("label_remap", "select event_id, case cast(json_extract_string(props, '$.k') as integer) % 6 when 1 then 3 when 2 then 1 when 3 then 4 when 4 then 3 when 5 then 2 end as label from events")
def label_remap(spark, d):
    code = F.get_json_object("props", "$.k").cast("int") % 6
    return src.table(spark, d, "events").select("event_id", labels.remapped(code, {2: 1, 5: 2, 1: 3, 4: 3, 3: 4}).alias("label"))


@query("argmax_noisy", "select vec_id as id, list_position(embedding, list_max(embedding)) - 1 as best from embeddings")
def argmax_noisy(spark, d):
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), labels.argmax(F.col("embedding")).alias("best"))


@query("loso_splits", f"""with {LABELLED}, s as (select distinct subject as held_out from ics)
select held_out, case when subject <> held_out then 'train' else 'test' end as role, count(*) as n from s, ics where subject <> held_out or is_expert group by all""")
def loso_splits(spark, d):
    """Rows of each role of each split, from the counts by subject: no pair of row and split is made."""
    sizes = labels.split_sizes(src.series_labels(spark, d))
    return sizes.select("held_out", F.expr("stack(2, 'train', n_train, 'test', n_test) as (role, n)")).where("n > 0")


@query("loso_sizes", f"with {LABELLED} select subject as held_out, (select count(*) from ics) - count(*) as n_train, count(*) filter (is_expert) as n_test from ics group by subject")
def loso_sizes(spark, d):
    return labels.split_sizes(src.series_labels(spark, d))


@query("expert_rows", f"with {LABELLED} select subject, ic, label from ics where is_expert and subject = 'src3'")
def expert_rows(spark, d):
    return src.series_labels(spark, d).where(F.col("is_expert") & (F.col("subject") == "src3")).select("subject", "ic", "label")


@query("expert_weights", f"with {LABELLED} select ic, case when is_expert then 3 else 1 end::double as weight from ics")
def expert_weights(spark, d):
    return src.series_labels(spark, d).select("ic", labels.expert_weight(3).alias("weight"))


@query("balanced_weights", f"with {LABELLED} select label, count(*) as n, round((select count(*) from ics) / (2.0::double * count(*)), 6) as weight from ics group by label")
def balanced_weights(spark, d):
    return labels.balanced_weights(src.series_labels(spark, d)).withColumn("weight", rounded("weight"))


@query("sample_cap", f"""with {LABELLED}, r as (select *, row_number() over (partition by subject, label order by md5(cast(ic as varchar)), ic) as k from ics) select subject, label, ic from r where k <= 2""")
def sample_cap(spark, d):
    rows = src.series_labels(spark, d).select("subject", "label", "ic")
    return capped(rows, ["subject", "label"], [F.md5(F.col("ic").cast("string").cast("binary")), F.col("ic")], 2)


@query("proj_filter_class", f"with {LABELLED} select subject, ic from ics where label = 0")
def proj_filter_class(spark, d):
    return src.series_labels(spark, d).where("label = 0").select("subject", "ic")


@query("having_subject", f"with {LABELLED} select ic, subject from ics where exists (select 1 from ics o where o.subject = ics.subject and o.is_expert and o.label = 0)")
def having_subject(spark, d):
    rows = src.series_labels(spark, d)
    return rows.join(rows.where("is_expert and label = 0").select("subject").distinct(), "subject", "left_semi").select("ic", "subject")


@query("threshold_counts", """with s as (select label, embedding[1]::double as score from embeddings) select label, t.t::double as threshold, count(*) filter (score > t.t) as n from s, (values (-0.2), (-0.1), (0.0), (0.1), (0.2)) t(t) group by all""")
def threshold_counts(spark, d):
    rows = src.table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("score"))
    return evaluation.above_thresholds(rows, [-0.2, -0.1, 0.0, 0.1, 0.2])


@query("class_totals", "with r as (select lang as label, n_chars as size from documents) select label, count(*) as n, min(size) as shortest, max(size) as longest from r group by rollup (label)")
def class_totals(spark, d):
    return evaluation.with_total(src.table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("n_chars").alias("size")))


@query("gather_split", f"with {LABELLED} select ic, label from ics where ic in (select doc_id from labels where toxic = 0)")
def gather_split(spark, d):
    picked = src.table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("ic"))
    return src.series_labels(spark, d).join(picked, "ic", "left_semi").select("ic", "label")


# --- search

#: Parameters whose values are those that a column of a table has.
_GRID = {"lang": ("documents", "lang"), "priority": ("orders", "o_orderpriority"), "region": ("region", "r_name"), "segment": ("customer", "c_mktsegment")}
_GRID_SQL = "select ((a.i * (select count(*) from b) + b.i) * (select count(*) from c) + c.i) * (select count(*) from e) + e.i as candidate, a.v as lang, b.v as priority, c.v as region, e.v as segment from " + ", ".join(
    f"(select v, row_number() over (order by v) - 1 as i from {x}) {x}" for x in "abce")
_GRID_SQL = "with " + ", ".join(f"{x} as (select distinct {column} as v from {name} where {column} is not null)" for x, (name, column) in zip("abce", _GRID.values())) + " " + _GRID_SQL


def _grid(spark, d):
    values = {parameter: [r[0] for r in src.table(spark, d, name).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()] for parameter, (name, column) in _GRID.items()}
    return labels.grid(spark, values)


@query("grid_candidates", f"select cast(candidate as bigint) as candidate, lang, priority, region, segment from ({_GRID_SQL})")
def grid_candidates(spark, d):
    return _grid(spark, d)


@query("grid_size", f"select count(*) as n from ({_GRID_SQL})")
def grid_size(spark, d):
    return _grid(spark, d).agg(F.count("*").alias("n"))


@query("grid_jobs", f"select cast(candidate * 5 + s as bigint) as job, cast(candidate as bigint) as candidate, cast(s as integer) as split from ({_GRID_SQL}), (select unnest(range(5)) as s)")
def grid_jobs(spark, d):
    return labels.jobs(_grid(spark, d), 5)


@query("anti_done_jobs", f"select cast(candidate * 5 + s as bigint) as job, cast(candidate as bigint) as candidate, cast(s as integer) as split from ({_GRID_SQL}), (select unnest(range(5)) as s) where candidate * 5 + s not in (select n_nationkey * 3 from nation)")
def anti_done_jobs(spark, d):
    done = src.table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("job"))
    return labels.open_jobs(labels.jobs(_grid(spark, d), 5), done)


_SCORES = "scores as (select l_suppkey % 40 as candidate, l_linenumber % 7 as split, round(avg(l_discount), 9) as score, count(*) as w from lineitem group by all)"


def _scores(spark, d):
    lines = src.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("candidate"), (F.col("l_linenumber") % 7).alias("split"))
    return lines.agg(F.round(F.avg("l_discount"), 9).alias("score"), F.count("*").alias("w"))


@query("cv_store_rank", f"with {_SCORES}, m as (select candidate, round(avg(score), 9) as mean, stddev_pop(score) as std from scores group by candidate) select candidate, round(mean, 6) as mean, round(std, 6) as std, rank() over (order by mean desc) as rank from m")
def cv_store_rank(spark, d):
    return labels.cv_table(_scores(spark, d)).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("cv_store_weighted", f"with {_SCORES}, m as (select candidate, sum(w * score) / sum(w) as mean, sum(w * score * score) / sum(w) as sq from scores group by candidate) select candidate, round(round(mean, 9), 6) as mean, round(sqrt(greatest(sq - mean * mean, 0)), 6) as std, rank() over (order by round(mean, 9) desc) as rank from m")
def cv_store_weighted(spark, d):
    return labels.cv_table(_scores(spark, d), weight="w").withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("best_candidate", f"with {_SCORES} select candidate, round(round(avg(score), 9), 6) as mean from scores group by candidate order by round(avg(score), 9) desc, candidate limit 1")
def best_candidate(spark, d):
    return labels.best_candidate(labels.cv_table(_scores(spark, d))).select("candidate", rounded("mean").alias("mean"))


# --- votes and scores

_PRED = "pred as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as seg, cast(json_extract_string(props, '$.k') as integer) % 4 as pred from events)"


def _predictions(spark, d):
    events = src.table(spark, d, "events")
    seg = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return events.select(F.col("user_id").alias("subject"), seg.alias("seg"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("pred"))


@query("majority_vote", f"with {_PRED}, c as (select subject, pred, count(*) as n from pred group by all), r as (select *, row_number() over (partition by subject order by n desc, pred) as k from c) select subject, pred from r where k = 1")
def majority_vote(spark, d):
    return evaluation.majority(_predictions(spark, d), ["subject"])


@query("vote_regroup", f"""with {_PRED}, s as (select *, count(*) over (partition by subject) as s from pred), g as (select *, (s * 3) // 20 as n, s // ((s * 3) // 20) as per from s where (s * 3) // 20 > 0),
c as (select subject, seg // per as grp, pred, count(*) as n from g where seg < per * n group by all), r as (select *, row_number() over (partition by subject, grp order by n desc, pred) as k from c) select subject, grp as "group", pred from r where k = 1""")
def vote_regroup(spark, d):
    return evaluation.regrouped_votes(_predictions(spark, d), train=3, val=20)


_PROBA = """pr as (select user_id as subject, event_type as kind, event_id as seg, c as class, case when cast(json_extract_string(props, '$.k') as integer) % 3 = c then 0.6 else 0.2 end::double as p from events, (select unnest(range(3)) as c))"""


@query("logproba_ensemble", f"""with {_PROBA}, s as (select subject, kind, class, sum(ln(p + 1e-12::double)) as l from pr group by all), z as (select *, l - max(l) over w - ln(sum(exp(l - m)) over w) as q from (select *, max(l) over (partition by subject, kind) as m from s) window w as (partition by subject, kind)),
j as (select subject, class, sum(q) as l from z group by all), e as (select *, exp(l - max(l) over (partition by subject)) as e from j) select subject, cast(class as integer) as class, round(e / sum(e) over (partition by subject), 6) as p from e""")
def logproba_ensemble(spark, d):
    events = src.table(spark, d, "events")
    rows = events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.col("event_id").alias("seg"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("top"), F.explode(F.array(*map(F.lit, range(3)))).alias("class"))
    return evaluation.product_of_experts(rows.withColumn("p", F.when(F.col("top") == F.col("class"), 0.6).otherwise(0.2))).withColumn("p", rounded("p"))


def _truth(spark, d):
    rows = src.series_labels(spark, d)
    return rows.select("subject", "ic", "is_expert", F.col("label").alias("y"), F.col("guess").alias("pred"), labels.expert_weight(3).alias("w"))


@query("f1_class0", f"with {LABELLED} select subject, round(coalesce(2.0::double * count(*) filter (label = 0 and guess = 0) / nullif(count(*) filter (label = 0) + count(*) filter (guess = 0), 0), 0), 6) as f1, count(*) as n from ics where is_expert group by subject")
def f1_class0(spark, d):
    return evaluation.f1(_truth(spark, d).where("is_expert"), ["subject"]).withColumn("f1", rounded("f1"))


@query("f1_weighted", f"with {LABELLED}, w as (select *, case when is_expert then 3 else 1 end as w from ics) select round(2.0::double * sum(w) filter (label = 0 and guess = 0) / (sum(w) filter (label = 0) + sum(w) filter (guess = 0)), 6) as f1, count(*) as n from w")
def f1_weighted(spark, d):
    return evaluation.f1(_truth(spark, d), [], weight=F.col("w")).withColumn("f1", rounded("f1"))


@query("balanced_accuracy", f"with {LABELLED}, w as (select *, case when is_expert then 3 else 1 end::double as w from ics), r as (select label, coalesce(sum(w) filter (label = guess), 0) / sum(w) as r from w group by label) select round(avg(r), 6) as balanced_accuracy from r")
def balanced_accuracy(spark, d):
    return evaluation.balanced_accuracy(_truth(spark, d)).select(rounded("balanced_accuracy").alias("balanced_accuracy"))


@query("confusion_norm", f"with {LABELLED} select label as y, guess as pred, round(count(*) / (sum(count(*)) over (partition by label))::double, 6) as share from ics group by label, guess")
def confusion_norm(spark, d):
    return evaluation.confusion(_truth(spark, d)).withColumn("share", rounded("share"))


@query("eval_by_length", f"""with {SIGNAL}, f as (select v as length, subject, avg(x) as m from signal, (values (8), (16), (32)) l(v) where t < v group by all), p as (select length, subject, cast(m > 50 as integer) as pred, cast(subject % 3 = 0 as integer) as y from f)
select length, round(coalesce(2.0::double * count(*) filter (y = 0 and pred = 0) / nullif(count(*) filter (y = 0) + count(*) filter (pred = 0), 0), 0), 6) as f1, count(*) as n from p group by length""")
def eval_by_length(spark, d):
    from ..operators.windows import prefixes

    means = prefixes(src.signal(spark, d), [8, 16, 32]).select("length", "subject", (F.col("sum_x") / F.col("n")).alias("m"))
    rows = means.select("length", (F.col("m") > 50).cast("int").alias("pred"), (F.col("subject") % 3 == 0).cast("int").alias("y"))
    return evaluation.f1(rows, ["length"]).withColumn("f1", rounded("f1"))


#: Each user's codes of each book are a series.
_DOMINANT = """cnt as (select subject, t // {0} as seg, code, count(*) as n from (select subject * 2 + book as subject, t, code from codes) group by all), tot as (select *, sum(n) over (partition by subject, seg) as total from cnt),
dom as (select subject, seg, code as pred from (select *, row_number() over (partition by subject, seg order by n desc, code) as k from tot) where k = 1 and total = {0})"""


def _code_series(spark, d):
    return src.codes(spark, d).withColumn("subject", F.col("subject") * 2 + F.col("book")).drop("book")


@query("predict_pooled", f'with {CODES}, {_DOMINANT.format(16)} select subject, seg as "group", pred from dom')
def predict_pooled(spark, d):
    return workflows.pooled_predictions(_code_series(spark, d), 16)


@query("predict_voted", f"""with {CODES}, {_DOMINANT.format(8)}, s as (select *, count(*) over (partition by subject) as s from dom), g as (select *, s * 8 // 24 as n, s // (s * 8 // 24) as per from s where s * 8 // 24 > 0),
c as (select subject, seg // per as grp, pred, count(*) as n from g where seg < per * n group by all) select subject, grp as "group", pred from (select *, row_number() over (partition by subject, grp order by n desc, pred) as k from c) where k = 1""")
def predict_voted(spark, d):
    return workflows.voted_predictions(_code_series(spark, d), 8, 24)


@query("domain_filters", f"""with {SPECTRA}, mean as (select subject, bin, avg(p) as p from spectra group by all), un as (select bin, avg(p) as q from mean where subject % 2 = 0 group by bin)
select subject, bin, round(sqrt(q) / sqrt(p), 6) as h, 'unnormed-barycenter' as method from mean join un using (bin) where subject % 2 = 1""")
def domain_filters(spark, d):
    rows = src.spectra(spark, d)
    return workflows.domain_filters(rows.where("subject % 2 = 0"), rows.where("subject % 2 = 1"), "unnormed-barycenter").withColumn("h", rounded("h"))


@query("train_dictionary")
def train_dictionary(spark, d):
    series = src.packed(src.long_series(spark, d)).select("subject", F.col("subject").alias("ic"), (F.col("subject") % 7).alias("label"), "samples")
    _, found, _ = workflows.dictionary(series, label=0, k=4, centroid_length=48, window=64, max_iter=3)
    return found.groupBy("centroid").agg(F.count("*").alias("n"), rounded(F.sum("dist"), 4).alias("inertia"))


@query("result_files", f"with {RESULTS} select win::double as win, subject::integer as subject, score, 'results' as name from results")
def result_files(spark, d):
    """Result rows written as CSV and read back with their column check."""
    path = tables.new_path(spark, "results")
    rows = src.results(spark, d).select(*[F.col(c).cast(k).alias(n) for c, k, n in zip(("window", "subject", "score"), ("double", "int", "double"), tables.RESULT_COLUMNS)], F.lit(1).alias(tables.RESULT_COLUMNS[3]))
    tables.write_results(rows, path)
    back = tables.read_results(spark, path)
    return back.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(("win", "subject", "score"), tables.RESULT_COLUMNS)], F.lit("results").alias("name"))


# --- names

#: Parts of result files' names, fixed values of the format; each order line names a file by its numbers.
_CLASSIFIERS = ["random_forest", "logistic", "ensembled_logistic", "ICLabel"]
_FEATURES = ["bowav", "psd_autocorr", "bowav_psd_autocorr"]
_LENGTHS = ["300", "None", "none"]
_FILTERS = ["None", "normed-barycenter", "unnormed-barycenter", "subj_to_subj", "subj_to_subj-resampled", "original"]
_SUFFIXES = ["", "_clf-trained-on-filtered-data"]
_PARTS = [(_CLASSIFIERS, "l_orderkey"), (_FEATURES, "l_linenumber"), (_LENGTHS, "l_partkey"), (_FILTERS, "l_suppkey"), (_SUFFIXES, "l_orderkey // 4")]
_FILE_SQL = "select distinct " + " || ".join(f"{between} || ({values!r})[({number}) % {len(values)} + 1]" for (values, number), between in zip(_PARTS, ("''", "'_'", "'_'", "'_cmmn-'", "''"))) + " || '.csv' as file from lineitem"


def _files(spark, d):
    def part(values, number):
        return F.element_at(F.array(*map(F.lit, values)), (F.expr(number.replace("//", "div")) % len(values) + 1).cast("int"))

    picked = [part(*p) for p in _PARTS]
    name = F.concat(picked[0], F.lit("_"), picked[1], F.lit("_"), picked[2], F.lit("_cmmn-"), picked[3], picked[4], F.lit(".csv"))
    return src.table(spark, d, "lineitem").select(name.alias("file")).distinct()


@query("parse_config_name", f"""with n as ({_FILE_SQL}), s as (select file, replace(file, '.csv', '') as name from n)
select file, case when contains(name, 'random_forest') then 'random_forest' when contains(name, 'ensembled_logistic') then 'ensembled_logistic' when contains(name, 'logistic') then 'logistic' else 'unknown' end as classifier,
case when contains(name, 'bowav_psd_autocorr') then 'bowav_psd_autocorr' when contains(name, 'psd_autocorr') then 'psd_autocorr' when contains(name, 'bowav') then 'bowav' else 'unknown' end as feature,
case when regexp_matches(name, '_300(_|$)') then '300' when regexp_matches(name, '(?i)_none(_|$)') then 'None' else 'unknown' end as validation,
case when contains(name, 'cmmn-unnormed-barycenter') then 'unnormed-barycenter' when contains(name, 'cmmn-normed-barycenter') then 'normed-barycenter' when contains(name, 'cmmn-subj_to_subj-resampled') then 'subj_to_subj-resampled' when contains(name, 'cmmn-subj_to_subj') then 'subj_to_subj' when contains(name, 'cmmn-original') then 'original' else 'none' end as filter,
contains(name, 'clf-trained-on-filtered-data') as trained_on_filtered from s""")
def parse_config_name(spark, d):
    return _files(spark, d).select("file", *evaluation.parsed_name(F.regexp_replace("file", r"\.csv$", "")))


@query("base36_key", """with g as (select l_partkey as grp, list(distinct l_suppkey % 36) as ids from lineitem group by all),
b as (select grp, list_sum(list_transform(ids, lambda i: case when i between 1 and 34 then (1::bigint << (34 - i)::bigint) else 0 end))::bigint as v from g)
select grp, coalesce(nullif(ltrim(list_aggregate(list_transform(range(6, -1, -1), lambda e: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((v // pow(36, e)::bigint) % 36)::bigint + 1, 1)), 'string_agg', ''), '0'), ''), '0') as key from b""")
def base36_key(spark, d):
    lines = src.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("grp"))
    return lines.agg(F.collect_set((F.col("l_suppkey") % 36).cast("int")).alias("ids")).select("grp", evaluation.base36(F.col("ids")).alias("key"))


@query("cache_names", f"with {RESULTS} select distinct 'bowav_' || cast(win as varchar) || '_' || case when win = 0 then 'None' else 'subj_to_subj' end as name from results")
def cache_names(spark, d):
    suffix = F.when(F.col("window") == 0, "None").otherwise("subj_to_subj")
    return src.results(spark, d).select(F.concat_ws("_", F.lit("bowav"), F.col("window").cast("string"), suffix).alias("name")).distinct()
